"""Documents, graphs, key-value logs and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataweave.operators import document as N
from strataweave.operators import graph as G
from strataweave.operators import keyvalue as K
from strataweave.plans.registry import Plans

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
add = plans.add
col = F.col


def n_rows():
    return F.count(F.lit(1))



# Documents: every event is one, with a nested field and an array.


def _docs(t):
    tags = F.when(col("value") > 50, F.array(col("event_type"), F.lit("high"))).otherwise(F.array(col("event_type")))
    e = t.events.select("event_id", F.struct("user_id", "value", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), col("event_type").alias("kind")).alias("info"), tags.alias("tags")).alias("d"))
    return e.select(col("event_id").cast("string").alias("_id"), F.to_json("d").alias("doc"))


_D = "(SELECT CAST(event_id AS VARCHAR) AS id, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS kind FROM events)"


@add("doc_find", f"SELECT id AS _id, CAST(user_id AS VARCHAR) AS user_id, kind AS info_kind FROM {_D} WHERE k >= 30 AND k < 40 AND kind IN ('click', 'view') AND value > 20 AND NOT user_id = 5")
def _(t):
    spec = {"info.k": {"$gte": 30, "$lt": 40}, "info.kind": {"$in": ["click", "view"]}, "value": {"$gt": 20}, "user_id": {"$ne": 5}, "nothing": {"$exists": False}}
    return N.find(_docs(t), spec, ["user_id", "info.kind"])


@add("doc_find_regex", f"SELECT id AS _id, kind AS info_kind FROM {_D} WHERE regexp_matches(kind, '^c.*k$') AND kind NOT IN ('x') AND k = 0")
def _(t):
    return N.find(_docs(t), {"info.kind": {"$regex": "^c.*k$", "$nin": ["x"]}, "info.k": 0}, ["info.kind"])


@add("doc_find_page", f"SELECT id AS _id, CAST(value AS DOUBLE) AS value FROM {_D} ORDER BY value DESC, user_id, CAST(id AS BIGINT) LIMIT 25 OFFSET 10")
def _(t):
    page = N.find(_docs(t), sort=[("value", -1), ("user_id", 1), ("_id", 1)], fields=["value"], skip=10, limit=25)
    return page.withColumn("value", col("value").cast("double"))


@add("doc_update", f"SELECT id AS _id, CASE WHEN k < 10 THEN 'low' ELSE kind END AS kind, CASE WHEN k < 10 THEN k + 100 ELSE k END AS k FROM {_D}")
def _(t):
    done = N.update(_docs(t), {"info.k": {"$lt": 10}}, {"$set": {"info.kind": "low"}, "$inc": {"info.k": 100}, "$push": {"tags": "seen"}})
    return done.select("_id", N.get_path("doc", "info.kind").alias("kind"), N.get_path("doc", "info.k").cast("int").alias("k"))


@add("doc_delete", f"SELECT id AS _id FROM {_D} WHERE NOT (kind = 'click')")
def _(t):
    return N.delete(_docs(t), {"info.kind": "click"}).select("_id")


@add("doc_insert", "SELECT CAST(event_id AS VARCHAR) AS _id FROM events UNION SELECT CAST(r_regionkey - 10 AS VARCHAR) FROM region")
def _(t):
    new = N.collection(t.region.withColumn("r_regionkey", col("r_regionkey") - 10), "r_regionkey", name="regions")
    return N.insert(_docs(t), new).select("_id")


@add("doc_flatten", f"SELECT path, count(*) AS n FROM (SELECT unnest(['user_id', 'value', 'info', 'info.k', 'info.kind', 'tags', 'tags.0']) AS path FROM {_D} UNION ALL SELECT 'tags.1' FROM {_D} WHERE value > 50) GROUP BY 1")
def _(t):
    return N.flatten(_docs(t)).groupBy("path").agg(n_rows().alias("n"))


@add("doc_pipeline", f"SELECT id AS _id, kind, CAST(value AS DOUBLE) AS value FROM {_D} WHERE k > 90 ORDER BY value DESC, kind, CAST(id AS BIGINT) LIMIT 40")
def _(t):
    p = N.pipeline(_docs(t), [{"$match": {"info.k": {"$gt": 90}}}, {"$project": {"_id": 1, "kind": "$info.kind", "value": 1}}, {"$sort": {"value": -1, "kind": 1, "_id": 1}}, {"$limit": 40}])
    return p.withColumn("value", col("value").cast("double"))


@add("doc_group_all", f"SELECT count(*) * 1.0 AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, max(value) AS high, min(value) AS low FROM {_D}".replace("count(*) * 1.0", "CAST(count(*) AS DOUBLE)"))
def _(t):
    p = N.pipeline(_docs(t), [{"$group": {"_id": None, "n": {"$sum": 1}, "total": {"$sum": "$value"}, "mean": {"$avg": "$value"}, "high": {"$max": "$value"}, "low": {"$min": "$value"}}}])
    return p.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@add("doc_group", f"SELECT kind AS _id, CAST(count(*) AS DOUBLE) AS n, round(avg(value), 4) AS mean, CAST(max(k) AS DOUBLE) AS high FROM {_D} WHERE user_id > 20 GROUP BY 1")
def _(t):
    p = N.pipeline(_docs(t), [{"$match": {"user_id": {"$gt": 20}}}, {"$group": {"_id": "$info.kind", "n": {"$sum": 1}, "mean": {"$avg": "$value"}, "high": {"$max": "$info.k"}}}])
    return p.withColumn("mean", F.round("mean", 4))


@add("doc_unwind", f"SELECT tag AS _id, CAST(count(*) AS DOUBLE) AS n FROM (SELECT unnest(CASE WHEN value > 50 THEN [kind, 'high'] ELSE [kind] END) AS tag FROM {_D}) GROUP BY 1")
def _(t):
    return N.pipeline(_docs(t), [{"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$sum": 1}}}])


@add("doc_join_relational", f"SELECT r_name, count(*) AS n FROM {_D} JOIN region ON k % 5 = r_regionkey GROUP BY 1")
def _(t):
    docs = _docs(t).select((N.get_path("doc", "info.k").cast("int") % 5).alias("k5"))
    return docs.join(t.region, col("k5") == col("r_regionkey")).groupBy("r_name").agg(n_rows().alias("n"))


# Graphs: suppliers and parts joined by the items sold.


def _edges(t):
    s, p = F.concat(F.lit("s"), col("l_suppkey")), F.concat(F.lit("p"), col("l_partkey"))
    return t.lineitem.groupBy(s.alias("src"), p.alias("dst")).agg(F.min("l_discount").alias("weight"), F.lit("sells").alias("label"))


_E = "(SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_discount) AS weight FROM lineitem GROUP BY 1, 2)"


def _ring(t):
    """A sparse directed graph with long ways: number n leads to 2n + 1 and to n + 7."""
    n = t.customer.select(col("c_custkey").alias("n"), col("c_nationkey").alias("k"))
    far = F.struct((col("n") * 2 + 1).alias("dst"), (col("k") % 7 + 1).cast("double").alias("weight"))
    near = F.struct((col("n") + 7).alias("dst"), F.lit(2.0).alias("weight"))
    return n.select(col("n").alias("src"), F.explode(F.array(far, near)).alias("e")).select("src", "e.dst", "e.weight")


_R = "(SELECT c_custkey AS src, unnest([c_custkey * 2 + 1, c_custkey + 7]) AS dst, unnest([c_nationkey % 7 + 1.0, 2.0]) AS weight FROM customer)"


def _places(t):
    """Regions, nations and suppliers as vertices with properties, and edges down from region to supplier."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    row = lambda df, ident, label, props: df.select(ident.alias("id"), F.lit(label).alias("label"), F.to_json(F.struct(*props)).alias("props"))
    vertices = (
        row(t.region, name("r", "r_regionkey"), "Region", [col("r_name").alias("name")])
        .unionByName(row(t.nation, name("n", "n_nationkey"), "Nation", [col("n_name").alias("name"), col("n_nationkey").alias("number")]))
        .unionByName(row(t.supplier, name("s", "s_suppkey"), "Supplier", [col("s_name").alias("name"), col("s_acctbal").alias("balance")]))
    )
    edge = lambda df, a, b, label, since: df.select(a.alias("src"), b.alias("dst"), F.lit(label).alias("label"), F.to_json(F.struct(since.alias("since"))).alias("props"))
    edges = edge(t.nation, name("r", "n_regionkey"), name("n", "n_nationkey"), "HAS", col("n_nationkey") + 1990).unionByName(
        edge(t.supplier, name("n", "s_nationkey"), name("s", "s_suppkey"), "HOSTS", col("s_suppkey") % 30 + 1990)
    )
    return vertices, edges


@add("graph_find_edges", f"SELECT dst FROM {_E} WHERE src = 's7'")
def _(t):
    return G.edge_filter(_edges(t), "sells", {"src": "s7"}).select("dst")


@add("graph_find_vertices", "SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal >= 1000 AND s_acctbal <= 5000")
def _(t):
    return G.find_vertices(_places(t)[0], "Supplier", {"balance": {"$gte": 1000, "$lte": 5000}}).select("id")


@add("graph_find_edges_by_props", "SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier WHERE s_suppkey % 30 + 1990 > 2010 AND s_nationkey <> 3")
def _(t):
    return G.find_edges(_places(t)[1], "HOSTS", {"since": {"$gt": 2010}, "src": {"$ne": "n3"}}).select("src", "dst")


@add(
    "graph_pattern",
    """SELECT 'r' || n_regionkey AS v0, 'n' || n_nationkey AS v1, 's' || s_suppkey AS v2, n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey
    WHERE n_nationkey >= 5 AND s_acctbal < 0 AND s_suppkey % 30 + 1990 <= 2015""",
)
def _(t):
    v, e = _places(t)
    return G.match(
        v, e, ["HAS", "HOSTS"], ["Region", "Nation", "Supplier"], {1: {"number": {"$gte": 5}}, 2: {"balance": {"$lt": 0}}},
        {1: {"since": {"$lte": 2015}}}, {"nation": (1, "name"), "supplier": (2, "name")},
    )


@add(
    "graph_join_relational",
    """SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey
    WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY 1""",
)
def _(t):
    v, e = _places(t)
    found = G.match(v, e, ["HOSTS"], ["Nation", "Supplier"], {1: {"balance": {"$gt": 9000}}}, returns={"number": (0, "number")})
    nations = found.select(col("number").cast("int").alias("nation_id")).distinct()
    joined = t.customer.join(nations, col("c_nationkey") == col("nation_id")).join(t.nation, col("c_nationkey") == col("n_nationkey"))
    return joined.groupBy("n_name").agg(n_rows().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@add("graph_degree", f"SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {_E} UNION ALL SELECT dst, 0, 1 FROM {_E}) GROUP BY 1")
def _(t):
    return G.degrees(_edges(t)).select("id", col("out_degree").cast("long"), col("in_degree").cast("long"))


@add("graph_two_hop", f"SELECT DISTINCT a.dst AS v1, b.dst AS v2 FROM {_R} a JOIN {_R} b ON b.src = a.dst WHERE a.src = 3")
def _(t):
    e = _ring(t).withColumn("label", F.lit("next"))
    return G.match(t.nation, e, ["next", "next"]).where("v0 = 3").select("v1", "v2").distinct()


_BFS = f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_R}), r(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 6)"""


@add("graph_bfs", _BFS + " SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(t):
    return G.bfs(G.arcs(_ring(t)), t.spark.createDataFrame([(1,)], "id long"), 6)


@add(
    "graph_dfs",
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    r(id, path) AS (SELECT 'r1', ['r1'] UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN e ON src = id)
    SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS place, id FROM r""",
)
def _(t):
    order = G.dfs_order(_places(t)[1], "r1")
    return t.spark.createDataFrame(list(enumerate(order)), "place int, id string")


# Distances only fall, so a table with one row a vertex is lowered until nothing changes.
_SP = f"""WITH RECURSIVE e AS (SELECT src, dst, CAST(min(weight) AS DOUBLE) AS w FROM {_R} GROUP BY 1, 2),
    r(id, distance) USING KEY (id) AS (SELECT CAST(1 AS BIGINT), 0.0::DOUBLE UNION
      SELECT e.dst, min(r.distance + e.w) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r x ON x.id = e.dst WHERE x.id IS NULL OR r.distance + e.w < x.distance GROUP BY e.dst)
    SELECT id, distance FROM r"""


@add("graph_shortest_path", _SP)
def _(t):
    return G.shortest_paths(G.arcs(_ring(t), "weight"), t.spark.createDataFrame([(1,)], "id long"))


@add("graph_undirected", f"SELECT n, count(*) AS k FROM (SELECT src AS n FROM {_R} UNION ALL SELECT dst FROM {_R}) GROUP BY 1")
def _(t):
    return G.arcs(_ring(t).withColumn("directed", F.lit(False))).groupBy(col("src").alias("n")).agg(n_rows().alias("k"))


@add(
    "graph_simple_paths",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_R}), r(at_, path) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL
      SELECT dst, list_append(path, dst) FROM r JOIN e ON src = at_ WHERE at_ <> 31 AND len(path) <= 4 AND NOT list_contains(path, dst))
    SELECT path, CAST(len(path) - 1 AS INT) AS hops FROM r WHERE at_ = 31""",
)
def _(t):
    return G.simple_paths(_ring(t), 1, 31, 4)


_RANKS = 10


def _pagerank_sql() -> str:
    e = f"e AS MATERIALIZED (SELECT src, dst FROM {_E}), o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY 1)"
    ids = "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)"
    parts = [e, ids, "r0 AS (SELECT id, 1 / c.n AS rank FROM v, c)"]
    for i in range(_RANKS):
        loose = f"(SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o))"
        got = f"(SELECT e.dst, sum(r.rank / o.n) AS got FROM r{i} r JOIN e ON e.src = r.id JOIN o ON o.src = r.id GROUP BY 1)"
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, (0.15 + 0.85 * {loose}) / c.n + 0.85 * coalesce(g.got, 0) AS rank FROM v CROSS JOIN c LEFT JOIN {got} g ON g.dst = v.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(rank, 9) AS rank FROM r{_RANKS}"


@add("graph_pagerank", _pagerank_sql())
def _(t):
    return G.pagerank(_edges(t), _RANKS).withColumn("rank", F.round("rank", 9))


@add("graph_components", "SELECT o_orderkey + 1000000000 AS id, o_custkey AS component FROM orders UNION SELECT o_custkey, o_custkey FROM orders")
def _(t):
    return G.connected_components(t.orders.select((col("o_orderkey") + 1_000_000_000).alias("src"), col("o_custkey").alias("dst")))


@add(
    "graph_component_sizes",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM {_E} UNION ALL SELECT dst, src FROM {_E}),
    r(id, component) USING KEY (id) AS (SELECT a, min(least(a, b)) FROM e GROUP BY 1 UNION
      SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.id JOIN recurring.r x ON x.id = e.b WHERE r.component < x.component GROUP BY 1)
    SELECT component, count(*) AS n FROM r GROUP BY 1""",
)
def _(t):
    return G.connected_components(_edges(t)).groupBy("component").agg(n_rows().alias("n"))


@add("graph_communities")
def _(t):
    return G.label_propagation(_ring(t))


@add("graph_modularity")
def _(t):
    e = _ring(t)
    found = G.modularity_communities(e)
    return found.groupBy("community").agg(n_rows().alias("n")).withColumn("modularity", F.lit(round(G.modularity(e, found), 6)))


@add(
    "graph_closeness",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_R}), r(source, id, depth) AS (SELECT s, s, 0 FROM (VALUES (CAST(1 AS BIGINT)), (2), (5)) v(s) UNION
      SELECT source, dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 5),
    d AS (SELECT source, id, min(depth) AS depth FROM r GROUP BY 1, 2)
    SELECT source AS id, count(*) - 1 AS reached, round(CASE WHEN sum(depth) > 0 THEN (count(*) - 1) / sum(depth) ELSE 0.0 END, 12) AS closeness FROM d GROUP BY 1""",
)
def _(t):
    return G.closeness(_ring(t), t.spark.createDataFrame([(1,), (2,), (5,)], "id long"), 5).withColumn("closeness", F.round("closeness", 12))


@add("graph_betweenness", "SELECT 'n' || s_nationkey AS id, CAST(count(*) AS DOUBLE) AS score FROM supplier GROUP BY 1")
def _(t):
    v, e = _places(t)
    return G.betweenness(e, v.where("label = 'Region'").select("id"), 3).where("score > 0")


# Key-value logs: users are keys, events set or delete their value.


def _log(t):
    return t.events.select(col("user_id").alias("key"), col("value"), "ts", "event_id", (col("event_type") == "purchase").alias("gone"), F.get_json_object("props", "$.k").cast("int").alias("k"))


_L = "(SELECT user_id AS key, value, ts, event_id, event_type = 'purchase' AS gone, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 7 AS node FROM events)"


@add("kv_latest", f"SELECT key, value FROM {_L} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1 AND NOT gone")
def _(t):
    return K.latest_per_key(_log(t), "key", ["ts", "event_id"], col("gone")).select("key", "value")


@add("kv_ttl", f"SELECT event_id FROM {_L} WHERE k IS NULL OR ts + to_minutes(k * 60) > TIMESTAMP '2024-01-20'")
def _(t):
    log = _log(t).withColumn("expires", col("ts") + F.make_dt_interval(hours=col("k")))
    return K.alive(log, "expires", F.expr("timestamp_ntz'2024-01-20'")).select("event_id")


@add("kv_mget", f"SELECT DISTINCT key FROM {_L} WHERE key IN (1, 5, 9, 100000)")
def _(t):
    return K.get_many(_log(t), "key", [1, 5, 9, 100000]).select("key").distinct()


@add("kv_scan", "SELECT c_name FROM customer WHERE c_name LIKE '%1_' ORDER BY c_name LIMIT 15 OFFSET 5")
def _(t):
    return K.scan(t.customer.select("c_name"), "c_name", 5, "*1?", 15)


@add("crdt_lww", f"SELECT k AS element FROM {_L} GROUP BY 1 HAVING NOT arg_max(gone, {{'a': ts, 'b': event_id}})")
def _(t):
    return K.lww_merge(_log(t).withColumn("element", col("k")), "element", ["ts", "event_id"], "gone")


@add("crdt_orset", f"SELECT DISTINCT k AS element FROM (SELECT k, event_id % 500 AS tag FROM {_L} WHERE NOT gone) a WHERE NOT EXISTS (SELECT 1 FROM {_L} r WHERE r.gone AND r.k = a.k AND r.event_id % 500 = a.tag)")
def _(t):
    ops = _log(t).select(col("k").alias("element"), (col("event_id") % 500).alias("tag"), "gone")
    return K.or_set(ops.where("not gone"), ops.where("gone"), "element", "tag")


@add("crdt_gcounter", f"SELECT key, CAST(sum(m) AS BIGINT) AS total FROM (SELECT key, node, max(k) AS m FROM {_L} GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return K.g_counter(_log(t).withColumn("node", col("event_id") % 7), "key", "node", "k")


@add("crdt_pncounter", f"SELECT key, CAST(sum(u) - sum(d) AS BIGINT) AS total FROM (SELECT key, node, max(k) AS u, max(k % 10) AS d FROM {_L} GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return K.pn_counter(_log(t).select("key", (col("event_id") % 7).alias("node"), "k", (col("k") % 10).alias("d")), "key", "node", "k", "d")


@add("vector_clock", "SELECT n_nationkey, CASE WHEN a >= c AND b >= d AND (a > c OR b > d) THEN 1 WHEN a <= c AND b <= d AND (a < c OR b < d) THEN -1 ELSE 0 END AS o FROM (SELECT n_nationkey, n_nationkey % 3 AS a, n_nationkey % 4 AS b, n_nationkey % 5 AS c, n_nationkey % 2 AS d FROM nation)")
def _(t):
    n = col("n_nationkey")
    a, b = F.create_map(F.lit("x"), n % 3, F.lit("y"), n % 4), F.create_map(F.lit("x"), n % 5, F.lit("y"), n % 2)
    return t.nation.select("n_nationkey", K.compare_clocks(a, b).alias("o"))


@add("quorum_read", f"SELECT k AS key, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM {_L} GROUP BY 1 HAVING count(*) >= 100")
def _(t):
    log = t.events.select(F.get_json_object("props", "$.k").cast("int").alias("key"), "value", "event_id")
    return K.quorum_read(log.withColumn("answer", col("event_id")), "key", "answer", "value", "event_id", 100)


@add("quorum_by_node", f"SELECT key, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM {_L} WHERE k < 30 GROUP BY 1 HAVING count(DISTINCT node) >= 6")
def _(t):
    log = _log(t).where("k < 30").select("key", (col("event_id") % 7).alias("node"), "value", "event_id")
    return K.quorum_read(log, "key", "node", "value", "event_id", 6)


for _mode, _keep in (("nx", "NOT IN"), ("xx", "IN")):
    _old = f"(SELECT key, max(event_id) AS id FROM {_L} WHERE key % 3 = 0 GROUP BY 1)"

    @add(f"kv_set_{_mode}", f"SELECT key, id FROM {_old} WHERE key % 2 > 0 OR '{_mode}' = 'nx' UNION ALL SELECT user_id, -1 FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) WHERE user_id {_keep} (SELECT key FROM {_old})")
    def _(t, mode=_mode):
        log = _log(t)
        entries = log.where("key % 3 = 0").groupBy("key").agg(F.max("event_id").alias("id"))
        writes = log.where("key % 2 = 0").select("key").distinct().withColumn("id", F.lit(-1).cast("long"))
        return K.set_if(entries, writes, "key", mode)


@add("kv_cleanup", f"SELECT event_id FROM {_L} WHERE NOT (gone AND ts < TIMESTAMP '2024-01-15')")
def _(t):
    return K.cleanup_before(_log(t), col("gone"), "ts", F.expr("timestamp_ntz'2024-01-15'")).select("event_id")


@add("codec_rle", f"""SELECT key, kind, count(*) AS n, min(ts) AS first_ FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM (
    SELECT user_id AS key, event_type AS kind, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY key, run, kind""")
def _(t):
    e = t.events.select(col("user_id").alias("key"), col("event_type").alias("kind"), "ts", "event_id")
    return K.run_lengths(e, ["key"], ["ts", "event_id"], "kind").select("key", "kind", "n", "first_")


@add("codec_delta", """SELECT event_id, d - lag(d) OVER w AS delta FROM (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER v AS d FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id))
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    e = t.events.withColumn("us", F.unix_micros(col("ts").cast("timestamp")))
    return K.deltas(e, ["user_id"], ["ts", "event_id"], "us", times=2).select("event_id", "delta")


@add("codec_xor")
def _(t):
    return K.xor_with_previous(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "bits")


@add("msg_last_n", "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events QUALIFY place <= 20")
def _(t):
    return K.last_messages(t.events, "event_type", ["ts", "event_id"], 20).select("event_type", "event_id", "place")


@add("msg_pattern", "SELECT event_id FROM events WHERE event_type LIKE 'p%e'")
def _(t):
    from strataweave.functions.text import glob_to_regex

    return t.events.where(col("event_type").rlike(glob_to_regex("p*e"))).select("event_id")


# Event time


@add("ev_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total")).select(col("w.start").alias("start_"), "event_type", "n", "total")


@add("ev_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS start_, count(*) AS n FROM events, (VALUES (0), (1)) v(i) GROUP BY 1")
def _(t):
    return t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(n_rows().alias("n")).select(col("w.start").alias("start_"), "n")


@add("ev_session", """SELECT user_id, min(ts) AS start_, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(t):
    return t.events.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(n_rows().alias("n")).select("user_id", col("w.start").alias("start_"), "n")


@add("ev_dedup", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2, time_bucket(INTERVAL 1 DAY, ts)")
def _(t):
    day = F.window("ts", "1 day")
    return t.events.groupBy("user_id", "event_type", day.alias("w")).agg(F.min("event_id").alias("first_id")).select("user_id", "event_type", "first_id")


@add("ev_running", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 4).alias("running"))
