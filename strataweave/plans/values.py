"""Scalar functions, JSON and arrays, changes to tables and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.numeric import gcd, haversine_km, replica_score
from strataweave.functions.text import full_text_match, lenient_equals, shard_of
from strataweave.operators import dml as D
from strataweave.plans.registry import Plans

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
add = plans.add
col = F.col


@add("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@add("json_variant", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM events")
def _(t):
    return t.events.select("event_id", (F.variant_get(F.parse_json("props"), "$.k", "long") + 1).alias("k1"))


@add("json_valid", "SELECT event_type, count(*) FILTER (json_valid(props)) AS n_valid, count(*) FILTER (NOT json_valid(event_type)) AS n_bad FROM events GROUP BY 1")
def _(t):
    ok = lambda c: F.sum(F.when(F.try_parse_json(c).isNotNull(), 1).otherwise(0))
    return t.events.groupBy("event_type").agg(ok(col("props")).alias("n_valid"), (F.count(F.lit(1)) - ok(col("event_type"))).alias("n_bad"))


@add("json_set", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS kind FROM events")
def _(t):
    changed = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), col("event_type"))))
    return t.events.select("event_id", changed.alias("d")).select("event_id", F.get_json_object("d", "$.k").cast("int").alias("k"), F.get_json_object("d", "$.kind").alias("kind"))


@add("json_wildcard", "SELECT c_nationkey, list_sort(list(c_custkey)) AS ids FROM customer GROUP BY 1")
def _(t):
    docs = t.customer.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct(col("c_custkey").alias("id"))).alias("items"))).alias("d"))
    return docs.select("c_nationkey", F.sort_array(F.from_json(F.get_json_object("d", "$.items[*].id"), "array<bigint>")).alias("ids"))


@add("json_table", "SELECT s_nationkey, s_suppkey, s_name FROM supplier")
def _(t):
    docs = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("d"))
    return docs.select("s_nationkey", F.inline(F.from_json("d", "array<struct<s_suppkey bigint, s_name string>>")))


_ARRAYS = "SELECT n_regionkey, list_sort(list(n_nationkey)) AS a FROM nation GROUP BY 1"


@add(
    "array_ops",
    f"""SELECT n_regionkey, a[1] AS first_, len(a) AS n, list_contains(a, 7) AS has7, list_append(a, 99) AS more, list_filter(a, lambda x: x <> 7) AS less FROM ({_ARRAYS})""",
)
def _(t):
    a = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("a"))
    return a.select(
        "n_regionkey", F.element_at("a", 1).alias("first_"), F.size("a").cast("long").alias("n"), F.array_contains("a", 7).alias("has7"), F.array_append("a", F.lit(99)).alias("more"), F.array_remove("a", F.lit(7)).alias("less")
    )


@add("array_any", "SELECT p_partkey FROM part WHERE p_size = ANY([1, 7, 21])")
def _(t):
    return t.part.where(F.array_contains(F.array(F.lit(1), F.lit(7), F.lit(21)), col("p_size"))).select("p_partkey")


@add("composite_access", "SELECT c_custkey, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
def _(t):
    nested = t.customer.join(t.nation, col("c_nationkey") == col("n_nationkey")).select("c_custkey", F.struct(col("c_name").alias("name"), F.struct(col("n_name").alias("nation")).alias("place"), col("c_mktsegment").alias("segment")).alias("who"))
    return nested.where(col("who.segment") == "BUILDING").select("c_custkey", "who.name", col("who.place.nation").alias("nation"))


@add("composite_update", "SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS kind FROM customer")
def _(t):
    nested = t.customer.select("c_custkey", "c_acctbal", F.struct(col("c_name").alias("name"), col("c_mktsegment").alias("kind")).alias("who"))
    changed = nested.withColumn("who", F.when(col("c_acctbal") < 0, col("who").withField("kind", F.lit("debtor"))).otherwise(col("who")))
    return changed.select("c_custkey", "who.name", "who.kind")


@add("extract_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"))


@add("full_text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'forklift') AND contains(lower(text), 'invoice')")
def _(t):
    return t.documents.where(full_text_match(col("text"), "forklift invoice")).select("doc_id")


@add(
    "haversine",
    """SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))), 4) AS km
    FROM (SELECT n_nationkey, n_nationkey * 7 - 80 AS la, n_nationkey * 13 - 170 AS lo FROM nation) a JOIN (SELECT n_nationkey, n_nationkey * 7 - 80 AS la, n_nationkey * 13 - 170 AS lo FROM nation) b ON a.n_nationkey < b.n_nationkey""",
)
def _(t):
    place = t.nation.select("n_nationkey", (col("n_nationkey") * 7 - 80).alias("la"), (col("n_nationkey") * 13 - 170).alias("lo"))
    a, b = place.alias("a"), place.alias("b")
    km = haversine_km(col("a.la"), col("a.lo"), col("b.la"), col("b.lo"))
    return a.join(b, col("a.n_nationkey") < col("b.n_nationkey")).select(col("a.n_nationkey").alias("a"), col("b.n_nationkey").alias("b"), F.round(km, 4).alias("km"))


@add(
    "nearest_replica",
    """SELECT c_custkey, arg_min(r_regionkey, (abs(c_nationkey - r_regionkey * 5) * 10 + 100 * (r_regionkey % 3) * 0.1 - CASE WHEN r_regionkey = 2 THEN 50 ELSE 0 END, r_regionkey)) AS replica
    FROM customer, region GROUP BY 1""",
)
def _(t):
    # Replicas are the five regions, a table of fixed size.
    r = F.broadcast(t.region)
    score = replica_score(F.abs(col("c_nationkey") - col("r_regionkey") * 5) * 10, (col("r_regionkey") % 3) * 0.1, col("r_regionkey") == 2)
    return t.customer.join(r, F.lit(True)).groupBy("c_custkey").agg(F.min_by("r_regionkey", F.struct(score.alias("s"), "r_regionkey")).alias("replica"))


@add("regex_match", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '7[0-9]$')")
def _(t):
    return t.customer.where(col("c_name").rlike("7[0-9]$")).select("c_custkey")


@add("key_shards", "SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 16 AS INT) AS shard, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(shard_of(col("o_orderkey"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@add("gcd_scalar", "SELECT l_orderkey, gcd(l_orderkey, l_partkey) AS g FROM lineitem WHERE l_quantity > 48")
def _(t):
    return t.lineitem.where("l_quantity > 48").select("l_orderkey", gcd(col("l_orderkey"), col("l_partkey")).alias("g"))


@add("lenient_compare", "SELECT n_nationkey FROM nation WHERE n_nationkey = 7 OR lower(n_name) = 'nation_3' OR lower(n_name) = lower('GERMANY')")
def _(t):
    n = t.nation
    return n.where(lenient_equals(col("n_nationkey").cast("string"), F.lit("7.0")) | lenient_equals(col("n_name"), F.lit("Nation_3")) | lenient_equals(col("n_name"), F.lit("germany"))).select("n_nationkey")


@add("identity_column", "SELECT c_custkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(t):
    new = t.customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return D.with_identity(t.supplier.select(col("s_suppkey").alias("id")), new.withColumn("id", F.lit(None).cast("long")), "id", ["c_custkey"]).select("c_custkey", "id")


@add("composite_max", "SELECT user_id, max(ROW(ts, event_id)).event_id AS last_event FROM (SELECT user_id, {'ts': ts, 'event_id': event_id} AS s, ts, event_id FROM events) GROUP BY 1".replace("max(ROW(ts, event_id)).event_id", "(max(s)).event_id"))
def _(t):
    return t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event"))


# Changes to tables


@add("dml_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 0 FROM region")
def _(t):
    return D.insert(t.nation, t.region.select((col("r_regionkey") + 100).alias("n_nationkey"), col("r_name").alias("n_name")), {"n_regionkey": 0})


@add("dml_insert_values", "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (90, 'NORTH'), (91, NULL))")
def _(t):
    return D.insert_values(t.spark, t.region, [{"r_regionkey": 90, "r_name": "NORTH"}, {"r_regionkey": 91}], batch_size=1)


@add("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'RESET' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    return D.update(t.customer, {"c_acctbal": 0.0, "c_mktsegment": "RESET"}, col("c_acctbal") < 0).select("c_custkey", "c_acctbal", "c_mktsegment")


@add("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 100000 OR o_orderstatus = 'P', false)")
def _(t):
    return D.delete(t.orders, (col("o_totalprice") < 100000) | (col("o_orderstatus") == "P")).select("o_orderkey")


@add("dml_delete_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100)")
def _(t):
    return D.delete_first(t.orders, [col("o_totalprice"), col("o_orderkey")], 100, ["o_orderkey"]).select("o_orderkey")


@add("dml_truncate", "SELECT * FROM region WHERE false")
def _(t):
    return D.truncate(t.region)


@add("dml_replace", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'replaced' ELSE s_name END AS s_name FROM supplier")
def _(t):
    new = t.supplier.where("s_acctbal < 0").withColumn("s_name", F.lit("replaced"))
    return D.replace_into(t.supplier, new, ["s_suppkey"]).select("s_suppkey", "s_name")


@add(
    "dml_merge",
    """SELECT coalesce(a.c_custkey, b.k) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN b.v WHEN b.k IS NULL THEN a.c_acctbal ELSE a.c_acctbal + b.v END AS c_acctbal
    FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS k, 1.5 AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.k
    WHERE NOT (a.c_custkey IS NOT NULL AND b.k IS NOT NULL AND a.c_acctbal < 0)""",
)
def _(t):
    target = t.customer.where("c_custkey % 3 > 0").select("c_custkey", "c_acctbal")
    source = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit(1.5).alias("c_acctbal"))
    return D.merge(target, source, ["c_custkey"], {"c_acctbal": col("t.c_acctbal") + col("s.c_acctbal")}, matched_delete=col("t.c_acctbal") < 0)


@add("pk_violations", "SELECT id, count(*) AS n FROM departments GROUP BY 1 HAVING count(*) > 1 OR id IS NULL")
def _(t):
    return D.key_violations(t.departments, ["id"])


@add("unique_violations", "SELECT category, name, count(*) AS n FROM products WHERE category IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return D.key_violations(t.products, ["category", "name"], primary=False)


@add("fk_orphans", "SELECT id, dept_id FROM employees WHERE dept_id IS NOT NULL AND dept_id NOT IN (SELECT id FROM departments WHERE id IS NOT NULL)")
def _(t):
    return D.foreign_key_violations(t.employees, "dept_id", t.departments, "id").select("id", "dept_id")


@add("fk_restrict", "SELECT id, name FROM departments WHERE id IN (SELECT dept_id FROM employees)")
def _(t):
    return D.restricted(t.departments, "id", t.employees, "dept_id").select("id", "name")


@add(
    "check_violations",
    """SELECT id, load_id, list_filter([CASE WHEN NOT (price > 0) THEN 'price' END, CASE WHEN NOT (stock >= 0) THEN 'stock' END], lambda x: x IS NOT NULL) AS broken
    FROM products WHERE NOT coalesce(price > 0, true) OR NOT coalesce(stock >= 0, true)""",
)
def _(t):
    return D.check_violations(t.products, {"price": col("price") > 0, "stock": col("stock") >= 0}).select("id", "load_id", "broken")


