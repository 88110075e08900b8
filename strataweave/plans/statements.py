"""Queries that go through the statement engine or run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataweave.engine import Engine
from strataweave.operators.types import TypeRegistry, read_with_children
from strataweave.plans.registry import Plans, Tables
from strataweave.sources import files, shared_dir, table
from strataweave.streaming import events as S

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
add = plans.add
col = F.col


def _engine(t: Tables, **keys: tuple[str, ...]) -> Engine:
    """An engine over tables of the directory, in a session of its own so that views do not mix."""
    e = Engine(t.spark.newSession())
    for name, key in keys.items():
        e.register(name, table(e.spark, t.sf_dir, name), key=key)
    return e


@add("sql_changes", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 900, 'new'")
def _(t):
    e = _engine(t, nation=("n_nationkey",))
    e.sql("UPDATE nation SET n_name = concat(upper(n_name), '!') WHERE n_regionkey = 1")
    e.sql("DELETE FROM nation WHERE n_regionkey = 2")
    e.sql("INSERT INTO nation VALUES (900, 'new', 0)")
    return e.sql("SELECT n_nationkey, n_name FROM nation")


@add("sql_merge", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT -s_suppkey, 0.0 FROM supplier WHERE s_suppkey % 10 = 1")
def _(t):
    e = _engine(t, supplier=("s_suppkey",))
    s = e.table("supplier")
    e.register("supplier", s.select("s_suppkey", "s_acctbal"), key=("s_suppkey",))
    e.register("news", s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit(1.0).alias("s_acctbal")).unionByName(s.where("s_suppkey % 10 = 1").select((-col("s_suppkey")).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal"))))
    e.sql("MERGE INTO supplier s USING news n ON s.s_suppkey = n.s_suppkey WHEN MATCHED THEN UPDATE SET s_acctbal = s.s_acctbal + n.s_acctbal WHEN NOT MATCHED THEN INSERT (s_suppkey, s_acctbal) VALUES (n.s_suppkey, n.s_acctbal)")
    return e.sql("SELECT * FROM supplier")


@add("sql_transaction", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'kept'")
def _(t):
    e = _engine(t, region=("r_regionkey",))
    e.script("BEGIN; INSERT INTO region VALUES (50, 'kept'); SAVEPOINT a; DELETE FROM region; ROLLBACK TO a; COMMIT; BEGIN; UPDATE region SET r_name = 'x'; ROLLBACK")
    return e.sql("SELECT r_regionkey, r_name FROM region")


@add("sql_function", "SELECT o_orderkey, o_totalprice * CAST(1.25 AS DOUBLE) AS gross FROM orders WHERE o_totalprice > 400000")
def _(t):
    e = _engine(t, orders=("o_orderkey",))
    e.sql("CREATE FUNCTION gross(x DOUBLE) RETURNS DOUBLE AS RETURN x * 1.25D")
    return e.sql("SELECT o_orderkey, gross(o_totalprice) AS gross FROM orders WHERE o_totalprice > 400000")


@add("sql_procedure", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
def _(t):
    e = _engine(t, customer=("c_custkey",))
    e.sql("CREATE PROCEDURE count_of(IN segment STRING, IN least INT) BEGIN SELECT count(*) AS n FROM customer WHERE c_mktsegment = :segment AND c_acctbal > :least; END")
    return e.sql("CALL count_of('BUILDING', 100)")


@add("sql_trigger", "SELECT r_regionkey AS id, 'gone' AS what FROM region WHERE r_regionkey > 2")
def _(t):
    e = _engine(t, region=("r_regionkey",))
    e.script("CREATE TABLE log (id INT, what VARCHAR(10)); CREATE TRIGGER g AFTER DELETE ON region FOR EACH ROW INSERT INTO log SELECT r_regionkey, 'gone' FROM old_rows; DELETE FROM region WHERE r_regionkey > 2")
    return e.sql("SELECT id, what FROM log")


@add("sql_join_hint", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return _engine(t, nation=(), region=()).sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WITH (JOIN_TYPE='HASH')")


@add("sql_document", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation WHERE n_regionkey >= 3 AND n_nationkey < 20")
def _(t):
    from strataweave.operators.document import collection

    e = _engine(t)
    e.collections["nations"] = collection(table(e.spark, t.sf_dir, "nation"), "n_nationkey")
    return e.sql("""DOCUMENT.FIND('nations', {"n_regionkey": {"$gte": 3}, "n_nationkey": {"$lt": 20}}, ["n_name"])""")


@add("sql_graph", "SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) v(id, depth)")
def _(t):
    e = _engine(t)
    for v in "abcd":
        e.sql(f"""GRAPH.CREATE_VERTEX('Node', {{"id": "{v}"}})""")
    for a, b in ("ab", "bc"):
        e.sql(f"GRAPH.CREATE_EDGE('{a}', '{b}', 'NEXT')")
    return e.sql("GRAPH.TRAVERSE('a', 5)")


@add(
    "sql_merge_conditional",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal >= 0 AND c_custkey % 2 = 0 THEN 'when matched' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_custkey % 3 > 0 AND NOT (c_acctbal >= 0 AND c_custkey % 2 = 0 AND c_custkey % 5 = 0)
    UNION ALL SELECT c_custkey, c_acctbal * 100, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND c_acctbal > 5000""".replace(
        "CASE WHEN c_acctbal < 0 THEN 0.0", "CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 0.0"
    ),
)
def _(t):
    e = _engine(t)
    c = table(e.spark, t.sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    e.register("accounts", c.where("c_custkey % 3 > 0"), key=("c_custkey",))
    e.register("news", c.where("c_custkey % 2 = 0").select(col("c_custkey").alias("k"), col("c_acctbal").alias("v")))
    e.sql("""MERGE INTO accounts a USING news n ON a.c_custkey = n.k
      WHEN MATCHED AND n.v < 0 THEN UPDATE SET c_acctbal = 0.0
      WHEN MATCHED AND n.k % 5 = 0 THEN DELETE
      WHEN MATCHED THEN UPDATE SET c_mktsegment = 'when matched'
      WHEN NOT MATCHED AND n.v > 5000 THEN INSERT (c_custkey, c_acctbal, c_mktsegment) VALUES (n.k, n.v * 100, 'new')""")
    return e.sql("SELECT * FROM accounts")


@add("sql_identity", "SELECT * FROM (VALUES (100, 'a'), (105, 'b'), (110, 'c'), (115, 'd')) x(id, v)")
def _(t):
    e = _engine(t)
    e.script("CREATE TABLE things (id BIGINT IDENTITY(100, 5) PRIMARY KEY, v VARCHAR(5)); INSERT INTO things (v) VALUES ('a'), ('b'), ('c'); INSERT INTO things (v) VALUES ('d')")
    return e.sql("SELECT CAST(id AS INT) AS id, v FROM things")


@add("sql_check", "SELECT n_nationkey, n_regionkey, 'check_1' AS refused FROM nation WHERE n_regionkey < 3")
def _(t):
    from strataweave.engine import ConstraintError

    e = _engine(t)
    e.sql("CREATE TABLE places (n_nationkey INT CHECK (n_nationkey >= 0), n_regionkey INT, CONSTRAINT check_1 CHECK (n_regionkey < 3 OR n_regionkey IN (7, 8)))")
    nation = table(e.spark, t.sf_dir, "nation").select("n_nationkey", "n_regionkey")
    e.insert("places", nation.where("n_regionkey < 3"))
    refused = ""
    try:
        e.insert("places", nation.where("n_regionkey = 4"))
    except ConstraintError as x:
        refused = str(x).rsplit(" ", 1)[-1]
    return e.table("places").withColumn("refused", F.lit(refused))


@add(
    "sql_trigger_row",
    """SELECT n_nationkey AS id, n_name AS before_, n_name || '?' AS after_ FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT 901, NULL, 'new' UNION ALL SELECT n_nationkey, n_name, NULL FROM nation WHERE n_regionkey = 3""",
)
def _(t):
    e = _engine(t, nation=("n_nationkey",))
    e.script("""CREATE TABLE log (id INT, before_ VARCHAR(30), after_ VARCHAR(30));
      CREATE TRIGGER u AFTER UPDATE ON nation FOR EACH ROW INSERT INTO log VALUES (NEW.n_nationkey, OLD.n_name, NEW.n_name);
      CREATE TRIGGER i AFTER INSERT ON nation FOR EACH ROW INSERT INTO log (id, after_) VALUES (NEW.n_nationkey, NEW.n_name);
      CREATE TRIGGER d BEFORE DELETE ON nation FOR EACH ROW INSERT INTO log SELECT OLD.n_nationkey, n.n_name, NULL FROM nation n WHERE n.n_nationkey = OLD.n_nationkey;
      UPDATE nation SET n_name = concat(n_name, '?') WHERE n_regionkey = 2;
      INSERT INTO nation VALUES (901, 'new', 0);
      DELETE FROM nation WHERE n_regionkey = 3""")
    return e.table("log")


@add("sql_update_literal", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'go where you want, set = (x)' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2")
def _(t):
    e = _engine(t, region=("r_regionkey",))
    e.sql("UPDATE region SET r_name = 'go where you want, set = (x)' WHERE r_regionkey = 1 AND r_name <> 'x where y'")
    e.sql("DELETE FROM region WHERE r_name <> ' limit 5' AND r_regionkey = 2")
    return e.sql("SELECT r_regionkey, r_name FROM region")


@add("sql_join_hints", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9500")
def _(t):
    e = _engine(t, customer=(), nation=(), region=())
    return e.sql(
        "SELECT c_name, n_name, r_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey WITH (JOIN_TYPE='MERGE') "
        "JOIN region r ON n_regionkey = r_regionkey WITH (JOIN_TYPE='HASH') WHERE c_acctbal > 9500"
    )


@add("sql_document_changes", "SELECT * FROM (VALUES ('0', 'seen', 3.0), ('1', 'seen', 3.0)) v(_id, mark, n)".replace("('1', 'seen', 3.0)", "('9', 'late', 1.0)"))
def _(t):
    e = _engine(t)
    e.sql("CREATE COLLECTION notes")
    e.sql("""DOCUMENT.INSERT('notes', [{"_id": "0", "mark": "new", "n": 2}, {"_id": "1", "mark": "where, set = (x)", "n": 5}, {"_id": "9", "mark": "late", "n": 1}])""")
    e.sql("""DOCUMENT.UPDATE('notes', {"_id": "0"}, {"$set": {"mark": "seen"}, "$inc": {"n": 1}})""")
    e.sql("""DOCUMENT.DELETE('notes', {"mark": "where, set = (x)"})""")
    return e.sql("""DOCUMENT.AGGREGATE('notes', [{"$project": {"_id": 1, "mark": 1, "n": 1}}, {"$sort": {"_id": 1}}])""").withColumn("n", col("n").cast("double"))


@add("sql_find_path", "SELECT * FROM (VALUES ('far', 0, 'a'), ('far', 1, 'b'), ('far', 2, 'c'), ('far', 3, 'd'), ('near', 0, 'a'), ('near', 1, 'd')) v(kind, place, id)")
def _(t):
    e = _engine(t)
    for v in "abcd":
        e.sql(f"""GRAPH.CREATE_VERTEX('Node', {{"id": "{v}", "rank": {ord(v)}}})""")
    for a, b, w in (("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 9)):
        e.sql(f"""GRAPH.CREATE_EDGE('{a}', '{b}', 'NEXT', {{"weight": {w}}})""")
    far, near = e.sql("GRAPH.FIND_PATH('a', 'd')"), e.sql("GRAPH.FIND_PATH('a', 'd', 2)")
    return far.withColumn("kind", F.lit("far")).unionByName(near.withColumn("kind", F.lit("near")))


@add("sql_graph_search", "SELECT * FROM (VALUES ('match', 'b', 'c'), ('edge', 'a', 'd'), ('vertex', 'c', NULL), ('vertex', 'd', NULL)) v(kind, x, y)")
def _(t):
    e = _engine(t)
    for v in "abcd":
        e.sql(f"""GRAPH.CREATE_VERTEX('Node', {{"id": "{v}", "rank": {ord(v)}}})""")
    for a, b, w in (("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 9)):
        e.sql(f"""GRAPH.CREATE_EDGE('{a}', '{b}', 'NEXT', {{"weight": {w}}})""")
    v = e.sql("""GRAPH.FIND_VERTICES('Node', {"rank": {"$gte": 99}})""").select(F.lit("vertex").alias("kind"), col("id").alias("x"), F.lit(None).cast("string").alias("y"))
    found = e.sql("""GRAPH.FIND_EDGES('NEXT', {"weight": {"$gt": 1}})""").select(F.lit("edge").alias("kind"), col("src").alias("x"), col("dst").alias("y"))
    m = e.sql("""GRAPH.MATCH(["NEXT"], ["Node", "Node"], {"0": {"rank": 98}})""").select(F.lit("match").alias("kind"), col("v0").alias("x"), col("v1").alias("y"))
    return v.unionByName(found).unionByName(m)


# Statements about the catalog, scripts, sinks and types


@add("sql_script", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey <> 3 GROUP BY 1")
def _(t):
    """SCRIPT 'file' with comments, quoted semicolons and several statements."""
    e = _engine(t, nation=("n_nationkey",))
    path = f"{shared_dir(t.spark)}/strataweave-script-{uuid.uuid4().hex}.sql"
    text = "-- a; b\nDELETE FROM nation WHERE n_nationkey = 3 AND n_name <> 'x;y'; /* ; */ SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey;"
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return e.sql(f"SCRIPT '{path}'")


@add("sink_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    """Written sorted with a codec by nation, and read back."""
    path = f"{shared_dir(t.spark)}/strataweave-sink-{uuid.uuid4().hex}"
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    files.write(rows, path, codec="zstd", partition_by=["c_nationkey"], sort_by=["c_custkey"])
    return files.read(t.spark, path, schema=rows.schema).select("c_custkey", "c_name", "c_acctbal")


@add("sink_json", "SELECT CAST(json_extract(to_json(n), '$.n_nationkey') AS INT) AS k, n_name AS name FROM nation n")
def _(t):
    out = files.as_json(t.nation)
    return out.select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("k"), F.get_json_object("value", "$.n_name").alias("name"))


@add("sql_batch_insert", "SELECT n_nationkey AS id, n_name AS name, 7 AS qty FROM nation UNION ALL SELECT 1000, 'last', 1")
def _(t):
    e = _engine(t)
    e.sql("CREATE TABLE things (id INT PRIMARY KEY, name VARCHAR(30) NOT NULL, qty INT DEFAULT 7)")
    records = [{"id": r["n_nationkey"], "name": r["n_name"]} for r in table(e.spark, t.sf_dir, "nation").collect()]  # records come from the driver
    e.batch_insert("things", records, batch_size=10)
    e.batch_insert("things", [{"id": 1000, "name": "last", "qty": 1}])
    return e.table("things")


@add(
    "sql_catalog",
    """SELECT * FROM (VALUES ('column', 'region.r_regionkey'), ('column', 'region.r_name'), ('index', 'by_name'), ('procedure', 'p'), ('table', 'region'), ('table', 'scratch'), ('temporary', 'scratch'),
    ('trigger', 'g'), ('type', 'addr'), ('view', 'big'), ('function', 'twice'), ('collection', 'notes'), ('preference', '3')) v(kind, name)""",
)
def _(t):
    """SHOW statements after CREATE ones, and a preference that limits results."""
    e = _engine(t, region=("r_regionkey",))
    e.script("""CREATE TEMPORARY TABLE scratch (a INT); CREATE TABLE gone (a INT); DROP TABLE gone; CREATE VIEW big AS SELECT * FROM region WHERE r_regionkey > 2; CREATE VIEW v2 AS SELECT 1 AS x; DROP VIEW v2;
      CREATE INDEX by_name ON region (r_name); CREATE INDEX i2 ON region (r_regionkey); DROP INDEX i2; CREATE TYPE addr AS (street VARCHAR(10), zip INT); CREATE COLLECTION notes;
      CREATE FUNCTION twice(x INT) RETURNS INT AS RETURN x * 2; CREATE PROCEDURE p(IN a INT) BEGIN SELECT :a AS a; END; CREATE TRIGGER g AFTER DELETE ON region FOR EACH ROW INSERT INTO scratch VALUES (OLD.r_regionkey)""")
    out = [("column", f"region.{r[0]}") for r in e.sql("SHOW COLUMNS FROM region").collect()]
    for kind, what, place in (
        ("index", "INDEXES", 1), ("procedure", "PROCEDURES", 0), ("table", "TABLES", 0), ("temporary", "TEMP_TABLES", 0), ("trigger", "TRIGGERS", 0),
        ("type", "TYPES", 0), ("view", "VIEWS", 0), ("function", "FUNCTIONS", 0), ("collection", "COLLECTIONS", 0),
    ):
        out += [(kind, r[place]) for r in e.sql(f"SHOW {what}").collect()]
    e.sql("SET PREFERENCE max_results 3")
    out.append(("preference", str(e.sql("SELECT * FROM region").count())))
    return t.spark.createDataFrame(out, "kind string, name string")


@add("sql_view_temp_cache", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def _(t):
    """A temporary table filled through a cached view; the cache is cleared again."""
    e = _engine(t, customer=("c_custkey",))
    e.script("CACHE TABLE customer; CREATE VIEW rich AS SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 9000; CREATE TEMPORARY TABLE picked (c_custkey BIGINT)")
    e.sql("INSERT INTO picked SELECT c_custkey FROM rich WHERE c_mktsegment = 'BUILDING'")
    e.sql("CACHE CLEAR ALL")
    return e.table("picked")


@add("sql_explain", "SELECT * FROM (VALUES ('explain', true), ('show create', true), ('visualize', true)) v(what, ok)")
def _(t):
    e = _engine(t, region=("r_regionkey",))
    plans_ = [("explain", "Physical Plan" in e.sql("EXPLAIN SELECT * FROM region").first()[0]), ("visualize", "Physical Plan" in e.sql("VISUALIZE BPTREE region").first()[0])]
    plans_.append(("show create", "PRIMARY KEY (r_regionkey)" in e.sql("SHOW CREATE TABLE region").first()[0]))
    return t.spark.createDataFrame(plans_, "what string, ok boolean")


@add("sql_inherits", "SELECT c_custkey AS id, c_name AS note FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    """A table with a column of a composite type that inherits from another; the parent is read with its children."""
    e = _engine(t)
    e.script("CREATE TYPE place AS (nation INT, balance DOUBLE); CREATE TABLE base (id BIGINT, note TEXT); CREATE TABLE child (home place) INHERITS (base)")
    e.insert("base", table(e.spark, t.sf_dir, "customer").select(col("c_custkey").alias("id"), col("c_name").alias("note")))
    e.insert("child", table(e.spark, t.sf_dir, "supplier").select(col("s_suppkey").alias("id"), col("s_name").alias("note"), F.struct(col("s_nationkey").alias("nation"), col("s_acctbal").alias("balance")).alias("home")))
    e.sql("UPDATE child SET home.balance = 0 WHERE home.balance < 0")
    return read_with_children(e.table("base"), e.table("child"))


@add(
    "type_validation",
    """SELECT p_partkey, p_size BETWEEN 1 AND 25 AS size_ok, length(p_brand) <= 8 AS brand_ok, TRY_CAST(p_name AS INT) IS NOT NULL AS number_ok FROM part""",
)
def _(t):
    reg = TypeRegistry()
    reg.create_domain("small", "int", "value BETWEEN 1 AND 25")
    return t.part.select("p_partkey", reg.valid(col("p_size").cast("string"), "small").alias("size_ok"), reg.valid(col("p_brand"), "varchar(8)").alias("brand_ok"), reg.valid(col("p_name"), "int").alias("number_ok"))


# A pattern as the path makes streams take a file as well as a folder of that name.


@add("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start_, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    schema = t.events.schema
    stream = S.read_files(t.spark, f"{t.sf_dir}/events.parque[t]", schema).withColumn("ts", col("ts").cast("timestamp"))
    counted = S.windowed(stream, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")], "60 days")
    return S.run_to_table(counted, "complete").select(col("window.start").cast("timestamp_ntz").alias("start_"), "event_type", "n")


@add("stream_keep_latest", "SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY 1")
def _(t):
    """The log in several batches, the newest row of every key kept; the last folder is the state."""
    base = f"{shared_dir(t.spark)}/strataweave-latest-{uuid.uuid4().hex}"
    t.events.select("user_id", "ts", "event_id").repartition(3).write.parquet(f"{base}/in")
    stream = S.read_files(t.spark, f"{base}/in", t.events.select("user_id", "ts", "event_id").schema, files_per_trigger=1)
    q = S.keep_latest(stream, f"{base}/state", "user_id", ["ts", "event_id"], f"{base}/log")
    q.awaitTermination()
    return S.latest_state(t.spark, f"{base}/state", stream.schema).select("user_id", "event_id")


@add("stream_batches", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def _(t):
    """A trigger on every batch that appends what it is about; a batch that comes again writes the same folder."""
    base = f"{shared_dir(t.spark)}/strataweave-batches-{uuid.uuid4().hex}"
    stream = S.read_files(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema)
    act = lambda rows, number: rows.where("value > 50").select("event_type").write.mode("overwrite").parquet(f"{base}/out/part={number}")
    S.on_each_batch(stream, act, f"{base}/log").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@add(
    "stream_expired",
    """SELECT user_id AS key, max(ts) + INTERVAL 1 HOUR AS expired_at FROM events WHERE user_id IS NOT NULL
    GROUP BY 1 HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""",
)
def _(t):
    """Keys not written for an hour of event time when the log ends; the log comes as one batch, and a last row moves the clock."""
    base = f"{shared_dir(t.spark)}/strataweave-expired-{uuid.uuid4().hex}"
    e = t.events.where("user_id is not null").select("user_id", col("ts").cast("timestamp").alias("ts"))
    e.coalesce(1).write.parquet(f"{base}/in/part=0")
    last = t.events.agg(F.max("ts").cast("timestamp").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts")
    last.coalesce(1).write.parquet(f"{base}/in/part=1")
    stream = S.read_files(t.spark, f"{base}/in/part=*", e.schema, files_per_trigger=1)
    out = S.run_to_table(S.expiring_keys(stream, "user_id", "ts", 3600, "0 seconds"))
    return out.where("key >= 0").select("key", col("expired_at").cast("timestamp_ntz").alias("expired_at"))


@add("stream_subscribe", "SELECT event_id, event_type FROM events WHERE event_type = 'click' OR event_type LIKE 'p%e'")
def _(t):
    stream = S.read_files(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema)
    return S.run_to_table(S.subscribe(stream.select("event_id", "event_type"), "event_type", ["click"], ["p*e"]))


@add("stream_dedup", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def _(t):
    stream = S.read_files(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema).withColumn("ts", col("ts").cast("timestamp"))
    return S.run_to_table(S.deduplicated(stream, "ts", ["user_id", "event_type"], "400 days")).agg(F.count(F.lit(1)).alias("n"))
