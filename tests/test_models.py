"""Documents, graphs, types, key-value types, codecs, files and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from strataweave.functions.numeric import gcd_agg
from strataweave.functions.predicates import document_filter, from_json_text
from strataweave.functions.text import glob_to_regex
from strataweave.operators import aggregates as A
from strataweave.operators import document as N
from strataweave.operators import graph as G
from strataweave.operators import joins as J
from strataweave.operators import keyvalue as K
from strataweave.operators.types import TypeRegistry, read_with_children
from strataweave.sources import files
from strataweave.streaming import events as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def docs(spark, *items):
    return spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(items)], "_id string, doc string")


@pytest.mark.parametrize(
    ("spec", "hits"),
    [
        ({}, "0123"), ({"n": 0}, "0"), ({"n": {"$gte": 0}}, "01"), ({"n": {"$lt": 5}}, "0"), ({"n": {"$ne": 0}}, "123"), ({"n": {"$exists": False}}, "23"),
        ({"s": {"$regex": "^a"}}, "1"), ({"n": {"$in": [5, 7]}}, "1"), ({"n": {"$nin": [5]}}, "023"), ({"a.b": "x"}, "2"), ({"l[1]": 9}, "3"), ({"l.0": 8}, "3"),
        ({"$or": [{"n": 0}, {"a.b": "x"}]}, "02"), ({"$not": {"n": 0}}, "123"), ({"ok": False}, "0"),
    ],
)
def test_document_filter(spark, spec, hits):
    d = docs(spark, {"n": 0, "ok": False}, {"n": 5, "s": "abc"}, {"a": {"b": "x"}}, {"l": [8, 9]})
    assert "".join(r[0] for r in rows(d.where(document_filter(spec, from_json_text(F.col("doc")))))) == hits


def test_flatten_and_bad_json(spark):
    d = docs(spark, {"a": {"b": [1, {"c": "x"}]}}).union(spark.createDataFrame([("9", "{bad"), ("8", None)], "_id string, doc string"))
    assert [r[1:] for r in rows(N.flatten(d))] == [("a", '{"b":[1,{"c":"x"}]}'), ("a.b", '[1,{"c":"x"}]'), ("a.b.0", "1"), ("a.b.1", '{"c":"x"}'), ("a.b.1.c", "x")]


def test_pipeline_null_group_and_scalar_unwind(spark):
    d = docs(spark, {"t": ["x", "y"], "v": 1}, {"t": "x", "v": 3}, {"v": 5}, {"t": "x"})
    assert rows(N.pipeline(d, [{"$group": {"_id": "$t2", "s": {"$sum": "$v"}, "a": {"$avg": "$zz"}}}])) == [("null", 9.0, 0.0)]
    assert rows(N.pipeline(d, [{"$unwind": {"path": "$t"}}, {"$group": {"_id": "$t", "n": {"$sum": 1}, "s": {"$sum": "$v"}}}])) == [("x", 3.0, 4.0), ("y", 1.0, 1.0)]


EDGES = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0), ("x", "y", 2.0)]


def edges(spark, items=EDGES):
    return spark.createDataFrame(items, "src string, dst string, weight double")


def test_graph_walks(spark):
    e, start = edges(spark), spark.createDataFrame([("a",)], "id string")
    assert rows(G.bfs(e, start, 5)) == [("a", 0), ("b", 1), ("c", 1)]
    d = G.shortest_paths(e, start)
    assert rows(d) == [("a", 0.0), ("b", 1.0), ("c", 2.0)]
    assert G.path_to(e, d, "c") == ["a", "b", "c"] and G.path_to(e, d, "y") == []
    assert G.dfs_order(e, "a") == ["a", "b", "c"]
    assert rows(G.simple_paths(e, "a", "c", 3)) == [(["a", "b", "c"], 2), (["a", "c"], 1)]
    assert rows(G.bfs(edges(spark, []), start, 3)) == [("a", 0)]


def test_components_of_a_long_chain_and_a_hub(spark):
    items = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 40)] + [(5, 5), (77777, 77777)]
    e = spark.createDataFrame(items, "src long, dst long")
    got = dict(rows(G.connected_components(e)))
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(40)} == {1000} and got[77777] == 77777


def test_pagerank_adds_up(spark):
    r = G.pagerank(edges(spark), 15)
    assert abs(r.agg(F.sum("rank")).first()[0] - 1) < 1e-9 and r.count() == 5


def test_betweenness(spark):
    # Two shortest ways from a to d, through b and c; from there on to e.
    e = edges(spark, [("a", "b", 1.0), ("a", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)])
    every = spark.createDataFrame([(v,) for v in "abcde"], "id string")
    assert {k: v for k, v in rows(G.betweenness(e, every, 9)) if v} == {"b": 1.0, "c": 1.0, "d": 3.0}


def test_types(spark):
    reg = TypeRegistry()
    reg.create("addr", {"street": "varchar(5)", "zip": "int"})
    reg.create_domain("grade", "int", "value BETWEEN 1 AND 5")
    reg.create("person", {"name": "text", "home": "addr", "marks": "grade[]"})
    with pytest.raises(ValueError):
        reg.drop("addr")
    with pytest.raises(ValueError):
        reg.create("loop", {"x": "loop"})
    df = spark.createDataFrame([("1", "abc"), ("9", "abcdef"), ("x", None), (None, "")], "g string, s string")
    assert [tuple(r) for r in df.select(reg.valid(F.col("g"), "grade"), reg.valid(F.col("s"), "varchar(5)")).collect()] == [(True, True), (False, False), (False, True), (True, True)]
    base = reg.create_table("t", {"id": "int"})
    child = reg.create_table("u", {"extra": "person"}, "t")
    assert child.fieldNames() == ["id", "extra"]
    assert read_with_children(spark.createDataFrame([(1,)], base), spark.createDataFrame([(2, None)], child)).count() == 2


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([5, 5, 5, 7, 7, 5, None, None])] + [("m", 0, 1)], "k string, i int, v int")
    runs = K.run_lengths(df, ["k"], ["i"], "v")
    assert [r[2:4] for r in sorted((tuple(r) for r in runs.where("k = 'k'").collect()), key=lambda r: r[1])] == [(5, 3), (7, 2), (5, 1), (None, 2)]
    assert K.expand_runs(runs, ["k"], "v").count() == 9
    full = df.where("v is not null")
    back = K.undo_deltas(K.deltas(full, ["k"], ["i"], "v"), ["k"], ["i"], "v", "delta")
    assert back.where("value <> v").count() == 0
    assert [r[0] for r in K.xor_with_previous(full.withColumn("v", F.col("v").cast("double")), ["k"], ["i"], "v").where("k = 'k'").orderBy("i").select("bits").collect()][1:3] == [0, 0]


def test_joins_on_edges(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 9), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), (None, 1, 1), ("b", None, 3)], "k string, at int, v int")
    assert sorted(((r.k, r.t, r.v) for r in J.asof_join(left, right, ["k"], "t", "at", ["v"]).collect()), key=str) == sorted([("a", 5, 51), ("a", 1, None), ("b", 9, None), (None, 9, None), ("a", None, None)], key=str)
    both = J.equi_join(left, right, [("k", "k")], "full")
    assert both.columns == ["k", "t", "right_k", "at", "v"] and both.where("k is null and right_k is null").count() == 2  # one of each side


@pytest.mark.parametrize(("n", "loops"), [(100, True), (200_000, False)])
def test_nested_loops_only_over_few_pairs(spark, n, loops):
    left, right = spark.range(n).withColumnRenamed("id", "a"), spark.range(n).select(F.col("id").alias("b"), (F.col("id") % 10).alias("v"))
    out = J.equi_join(left, right, [("a", "b")], "inner", "NESTED_LOOP")
    assert ("CartesianProduct" in out._jdf.queryExecution().sparkPlan().toString()) == loops
    assert out.count() == n and out.where("a <> b").count() == 0


@pytest.mark.parametrize("values", [[], [None], [1, None], [1, 1, 5], [7]])
def test_not_in_as_sql_has_it(spark, values):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    right = spark.createDataFrame([(v,) for v in values], "k bigint")
    want = spark.sql("SELECT * FROM {left} WHERE k NOT IN (SELECT k FROM {right})", left=left, right=right)
    out = J.not_in(left, right, ("k", "k"))
    assert out.columns == ["k", "v"] and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert J.not_in(left, left, ("k", "k")).count() == 0
    known = left.where("k is not null").withColumnRenamed("k", "value_")
    assert J.not_in(known, known.where("v = 'a'"), ("value_", "value_")).count() == 1


def test_not_in_broadcasts_no_column(spark):
    from strataweave.plans.relational import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["not_in_subquery"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_gcd_and_histograms(spark):
    df = spark.createDataFrame([("a", 12), ("a", -18), ("a", None), ("b", None), ("c", 7), ("c", 0)], "k string, v int")
    assert rows(df.groupBy("k").agg(gcd_agg("v").alias("g"))) == [("a", 6), ("b", None), ("c", 7)]
    assert A.equi_height_histogram(df.limit(0), "v", 4).count() == 0
    assert [r[3] for r in rows(A.equi_height_histogram(spark.range(10), "id", 4))] == [3, 3, 2, 2]


@pytest.mark.parametrize(("glob", "text", "hit"), [("a*c", "abbc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("a.c", "abc", False)])
def test_glob(spark, glob, text, hit):
    assert spark.range(1).where(F.lit(text).rlike(glob_to_regex(glob))).count() == hit


@pytest.mark.parametrize("form", ["parquet", "orc", "json", "csv"])
def test_file_formats(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    files.write(df, f"{tmp_path}/t", form, sort_by=["i"])
    assert rows(files.read(spark, f"{tmp_path}/t", form, df.schema).orderBy("i").select(F.coalesce("s", F.lit("-")))) == [("-",), ("a",)]


def test_script_split():
    assert files.statements("a; 'x;y'; -- c;\nBEGIN; CREATE PROCEDURE p() BEGIN b; c; END; d") == ["a", "'x;y'", "BEGIN", "CREATE PROCEDURE p() BEGIN b; c; END", "d"]


def test_streams_equal_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.read_files(spark, f"{tmp_path}/in", df.schema)
    n = F.count(F.lit(1)).alias("n")
    got = S.to_memory(S.windowed(stream, "ts", "1 hour", ["event_type"], [n], "40 days"), "w1", "complete")
    assert rows(got) == rows(df.groupBy(F.window("ts", "1 hour").alias("window"), "event_type").agg(n))
    assert S.to_memory(S.deduplicated(stream, "ts", ["user_id"], "60 days"), "d1").count() == df.select("user_id").distinct().count()
    assert S.to_memory(S.subscribe(stream, "event_type", ["click"], ["p*"]), "s1").count() == df.where("event_type = 'click' or event_type like 'p%'").count()
    q = S.keep_latest(stream, f"{tmp_path}/latest", "user_id", ["ts", "event_id"], f"{tmp_path}/cp")
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/latest/0")) == rows(K.latest_per_key(df, "user_id", ["ts", "event_id"]))
    assert S.to_memory(S.expiring_keys(stream, "user_id", "ts", 3600, "0 seconds"), "e1").count() > 0


def test_bounds_on_rounds_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "src long, dst long, weight double")
    start = spark.createDataFrame([(0,)], "id long")
    with pytest.raises(RuntimeError):
        G.shortest_paths(chain, start, max_rounds=3)
    far = G.shortest_paths(chain, start)
    assert rows(far) == [(i, float(i)) for i in range(6)]
    with pytest.raises(RuntimeError):
        G.path_to(chain, far, 5, max_steps=4)
    assert G.path_to(chain, far, 5, max_steps=5) == [0, 1, 2, 3, 4, 5]


def test_graph_queries_see_all_customers(spark, tmp_path):
    from strataweave.plans.models import QUERIES

    ids = range(1490, 1521)
    spark.createDataFrame([(i, i % 25) for i in ids], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    want = {v for i in ids for v in (i, 2 * i + 1, i + 7)}
    assert {r[0] for r in QUERIES["graph_communities"](spark, str(tmp_path)).select("id").collect()} == want


def cliques(spark):
    """Three groups of five, all joined within, and one edge from group to group."""
    inside = [(10 * g + i, 10 * g + j) for g in range(3) for i in range(5) for j in range(i)]
    return spark.createDataFrame([*inside, (0, 10), (10, 20), (20, 0), (None, 4)], "src long, dst long")


def test_communities_of_high_modularity(spark):
    e = cliques(spark)
    got = G.modularity_communities(e)
    assert dict(rows(got)) == {10 * g + i: 10 * g for g in range(3) for i in range(5)}
    # 33 edges, 30 of them within; each group holds a third of the ends.
    assert abs(G.modularity(e, got) - (30 / 33 - 1 / 3)) < 1e-9
    assert rows(G.modularity_communities(e.limit(0))) == []


def test_label_propagation(spark):
    """By hand: after one round each vertex has the smallest label among the most frequent of its neighbours."""
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert dict(rows(G.label_propagation(e, 1))) == {1: 2, 2: 1, 3: 1, 4: 3}
    assert dict(rows(G.label_propagation(cliques(spark).where("src is not null"), 6)))[24] in range(20, 25)


PLACES = [("a", "P", {"age": 30, "name": "Ann"}), ("b", "P", {"age": 17}), ("c", "P", {"age": 45, "name": "Cy"}), ("d", "C", {"name": "Acme"})]
WAYS = [("a", "b", "KNOWS", {"since": 2001}), ("a", "c", "KNOWS", {"since": 2010}), ("c", "d", "WORKS", {}), ("b", "d", "WORKS", {})]


def small_graph(spark):
    v = spark.createDataFrame([(i, lab, json.dumps(p)) for i, lab, p in PLACES], "id string, label string, props string")
    e = spark.createDataFrame([(a, b, lab, json.dumps(p)) for a, b, lab, p in WAYS], "src string, dst string, label string, props string")
    return v, e


def test_find_and_match_by_properties(spark):
    v, e = small_graph(spark)
    assert [r[0] for r in rows(G.find_vertices(v, "P", {"age": {"$gte": 30, "$lte": 40}}).select("id"))] == ["a"]
    assert [r[0] for r in rows(G.find_vertices(v, None, {"name": {"$exists": True}}).select("id"))] == ["a", "c", "d"]
    assert G.find_vertices(v).count() == 4 and G.find_edges(e, "KNOWS", None, "a", "b").count() == 1
    assert [tuple(r) for r in G.find_edges(e, where={"since": {"$gt": 2005}}).select("src", "dst").collect()] == [("a", "c")]
    got = G.match(v, e, ["KNOWS", "WORKS"], ["P", None, "C"], {1: {"age": {"$gte": 18}}}, returns={"who": (0, "name"), "firm": (2, "name")})
    assert rows(got) == [("a", "c", "d", "Ann", "Acme")]
    assert rows(G.match(v, e, [None], edge_where={0: {"since": 2001}})) == [("a", "b")]


def test_paths_within_hops(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 9.0), ("a", "c", 4.0)])
    assert G.path_within(e, "a", "d", 1) == ["a", "d"] and G.path_within(e, "a", "d", 2) == ["a", "c", "d"]
    assert G.path_within(e, "a", "d", 3) == G.path_within(e, "a", "d", 9) == ["a", "b", "c", "d"]
    assert G.path_within(e, "d", "a", 5) == [] and G.path_within(e, "a", "a", 3) == ["a"]


def test_long_chains_are_walked_to_the_end(spark):
    n = 30
    e = edges(spark, [(f"{i:03}", f"{i + 1:03}", 1.0) for i in range(n)] + [("000", "025", 100.0)])
    start = spark.createDataFrame([("000",)], "id string")
    assert dict(rows(G.shortest_paths(e, start))) == {f"{i:03}": float(i) for i in range(n + 1)}
    assert dict(rows(G.bfs(e, start)))["030"] == 6 and len(G.dfs_order(e, "000")) == n + 1


def test_range_lookup_edges(spark):
    points = spark.createDataFrame([(i, p) for i, p in enumerate([None, -5, 0, 0, 3, 9, 10, 10, 99])], "i int, p int")
    starts = spark.createDataFrame([(0, "a"), (3, "b"), (3, "c"), (10, "d"), (None, "z")], "s int, v string").repartition(3)
    got = {r["i"]: r["v"] for r in J.range_lookup(points.repartition(4), "p", starts, "s", ["v"]).collect()}
    assert got == {0: None, 1: None, 2: "a", 3: "a", 4: "c", 5: "c", 6: "d", 7: "d", 8: "d"}
    assert J.range_lookup(points, "p", starts.limit(0), "s", ["v"]).where("v is null").count() == 9
    assert J.range_lookup(points.limit(0), "p", starts, "s", ["v"]).count() == 0


def test_range_lookup_of_one_hot_place_is_spread(spark, monkeypatch):
    """9,900 points at one place: the written table has them in all partitions."""
    written = []
    monkeypatch.setattr(J, "materialize", lambda df, label, make=J.materialize: written.append(make(df, label)) or written[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        points = spark.range(10_000).selectExpr("id", "IF(id < 9900, 5, id) AS p")
        out = J.range_lookup(points, "p", spark.range(20).selectExpr("id AS s", "id * 2 AS v"), "s", ["v"])
        assert out.where("v <> IF(p = 5, 10, 38)").count() == 0 and out.count() == 10_000
        sizes = [r["count"] for r in written[0].groupBy("pid_").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2_500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_gcd_by_splits(spark):
    df = spark.createDataFrame([("a", 12), ("a", -18), ("a", None), ("b", None), ("c", 7), ("c", 0), (None, 4), (None, 10)], "k string, v int").repartition(3)
    assert {tuple(r) for r in A.gcd_by(df, ["k"], "v").collect()} == {("a", 6), ("b", None), ("c", 7), (None, 2)}
    assert rows(A.gcd_by(df.where("k = 'a'"), [], "v")) == [(6,)] and A.gcd_by(df.limit(0), ["k"], "v").count() == 0


def test_positions(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 9), ("b", 2), ("b", 1)], "v string, place_ int").repartition(3)
    got = rows(A.with_positions(df, ["v"]).select("place", F.coalesce("v", F.lit("-"))))
    assert got == [(0, "-"), (1, "a"), (2, "b"), (3, "b"), (4, "b")]
    assert [r[0] for r in A.with_positions(df, ["v"], descending=True).where("v is null").select("place").collect()] == [4]
    assert A.with_positions(df.limit(0), ["v"]).count() == 0


def test_conditional_sets_and_quorum(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    show = lambda mode: sorted(map(str, (tuple(r) for r in K.set_if(old, new, "k", mode).collect())))
    assert show("NX") == sorted(map(str, [("a", 1), ("b", 2), (None, 3), ("c", 30)])) and show("XX") == sorted(map(str, [("a", 1), ("b", 20), (None, 3)]))
    assert show("") == sorted(map(str, [("a", 1), ("b", 20), (None, 3), ("c", 30)]))
    answers = spark.createDataFrame([("k", "r1", 1, 1), ("k", "r1", 2, 2), ("m", "r1", 5, 1), ("m", "r2", 6, 3), ("m", None, 9, 9)], "k string, r string, v int, n int")
    assert rows(K.quorum_read(answers, "k", "r", "v", "n", 2)) == [("m", 6, 3)]
    log = spark.createDataFrame([(1, True, 5), (2, True, 20), (3, False, 1), (4, True, None)], "i int, gone boolean, t int")
    assert [r[0] for r in rows(K.cleanup_before(log, F.col("gone"), "t", F.lit(10)))] == [2, 3, 4]


def test_estimates_of_filters(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)] + [(None,)] * 10, "x int")
    of = lambda op, v: A.filter_estimate(df, "x", op, v, "exact").first()["estimate"]
    assert of("=", 3) == pytest.approx(1) and of("=", 99) == 0 and of("<>", 3) == pytest.approx(9) and of("<", 5.5) == pytest.approx(5) and of(">", 10) == 0 and of(">=", -4) == pytest.approx(10)
    assert A.filter_estimate(df.limit(0), "x", "=", 1).first()["selectivity"] == 0


def test_written_tables_are_deleted_at_the_end(spark):
    import os

    from strataweave.sources import intermediates, materialize

    with intermediates():
        df = materialize(spark.range(5))
        path = df._strataweave_path.removeprefix("file://")
        assert os.path.isdir(path) and df.count() == 5
    assert not os.path.exists(path)


def test_expiry_of_each_key(spark, tmp_path):
    from datetime import datetime as dt

    at = lambda h, m=0: dt(2024, 1, 1, h, m)
    parts = [[("a", at(1)), ("b", at(1, 30)), ("a", at(1, 10))], [("b", at(2))], [("c", at(9))], [("z", at(9, 1))]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "k string, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = S.read_files(spark, f"{tmp_path}/in/part=*", spark.read.parquet(f"{tmp_path}/in/part=0").schema, files_per_trigger=1)
    got = S.run_to_table(S.expiring_keys(stream, "k", "t", 3600, "0 seconds"))
    assert rows(got) == [("a", at(2, 10)), ("b", at(3))]


def test_latest_over_several_batches(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i, f"v{i}") for i in range(60)], "k int, i int, v string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = S.read_files(spark, f"{tmp_path}/in", df.schema, files_per_trigger=1)
    S.keep_latest(stream, f"{tmp_path}/state", "k", ["i"], f"{tmp_path}/cp").awaitTermination()
    assert rows(S.latest_state(spark, f"{tmp_path}/state", df.schema)) == rows(K.latest_per_key(df, "k", ["i"]))
