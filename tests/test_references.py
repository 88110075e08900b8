from datetime import datetime as dt

import pytest

from strataweave.operators.references import alive_intervals, orphan_counts, orphan_references

D = [dt(2020, 1, d) for d in range(1, 32)]


def run(spark, refs, loads, gone, **kw):
    child = spark.createDataFrame(refs, "child_id long, k int, t timestamp, ref_key string, n int")
    a = alive_intervals(spark.createDataFrame(loads, "id int, at timestamp"), spark.createDataFrame(gone, "id int, at timestamp"))
    return child, orphan_references(child, "child_id", "k", "t", a, **kw)


def brute(refs, loads, gone):
    out = []
    for c, k, t, *_ in refs:
        if k is None:
            continue
        events = sorted([(at, 1, 1) for i, at in loads if i == k and at is not None] + [(at, 2, 0) for i, at in gone if i == k and at is not None])
        before = [e for e in events if t is not None and e[0] <= t]
        if not before or not before[-1][2]:
            out.append((c, k))
    return sorted(out)


LOADS = [(1, D[0]), (1, D[0]), (1, D[9]), (2, D[4]), (3, D[0]), (4, D[2]), (None, D[0]), (5, None)]
GONE = [(1, D[5]), (3, D[3]), (3, D[3]), (4, D[2]), (9, D[0])]
REFS = [(i, k, D[t] if t is not None else None, "x", 0) for i, (k, t) in enumerate([(1, 0), (1, 5), (1, 7), (1, 9), (1, 20), (2, 3), (2, 4), (3, 2), (3, 3), (4, 2), (4, 9), (5, 9), (6, 1), (None, 1), (1, None), (9, 5), (1, 7), (1, 7)])]


@pytest.mark.parametrize("hot_share", [0.001, 0.2])
def test_against_brute_force(spark, hot_share):
    _, out = run(spark, REFS, LOADS, GONE, hot_share=hot_share)
    assert sorted((r["child_id"], r["ref_key"]) for r in out.collect()) == brute(REFS, LOADS, GONE)


def test_hot_key_is_split_and_counts_stay(spark):
    refs = [(i, 1 if i % 3 else 7, D[i % 31], "x", 0) for i in range(300)]
    child, out = run(spark, refs, LOADS, GONE, hot_share=0.1)
    assert sorted((r["child_id"], r["ref_key"]) for r in out.collect()) == brute(refs, LOADS, GONE)
    counts = orphan_counts(child, "k", "t", out).first()
    assert (counts["n_refs"], counts["n_orphans"]) == (300, len(brute(refs, LOADS, GONE)))


def test_empty_tables(spark):
    child, out = run(spark, [], LOADS, GONE)
    assert out.count() == 0 and orphan_counts(child, "k", "t", out).count() == 0
    assert run(spark, REFS, [], [])[1].count() == len([r for r in REFS if r[1] is not None])


def _most_read(spark, job):
    """Shuffle records of the largest task and of the median one, in the stages that a job reads shuffled rows in."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, quantiles, None)
    old = stages()  # the store drops old stages
    last = max((old.apply(i).stageId() for i in range(old.size())), default=-1)
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    got = stages()
    out = []
    for i in range(got.size()):
        stage = got.apply(i)
        if stage.stageId() <= last:
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
        read = sorted(tasks.apply(t).taskMetrics().get().shuffleReadMetrics().recordsRead() for t in range(tasks.size()) if tasks.apply(t).taskMetrics().isDefined())
        if read and read[-1]:
            out.append((read[-1], read[len(read) // 2]))
    return out


@pytest.mark.parametrize("orphaned", [False, True])
def test_half_of_the_rows_on_one_key(spark, orphaned):
    """A hot key that is always alive is never shuffled by row, one that is not is spread out."""
    n = 80_000
    child = spark.range(n).selectExpr("id AS child_id", "IF(id % 2 = 0, 7, id div 2 % 20000 + 100) AS k", "timestamp'2020-01-10' AS t")
    loads = spark.range(20_200).selectExpr("id", f"IF(id % 10 = 0 OR {orphaned} AND id = 7, timestamp'2020-01-20', timestamp'2020-01-01') AS at")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        orphans = lambda child, loads: orphan_references(child, "child_id", "k", "t", alive_intervals(loads))
        got = []
        read = _most_read(spark, lambda: got.extend(r["child_id"] for r in orphans(child, loads).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    late = {i for i in range(n) if i % 2 and (i // 2 % 20000 + 100) % 10 == 0}
    assert len(got) == len(set(got)) and set(got) == (late | set(range(0, n, 2)) if orphaned else late)
    assert read and all(most <= 2 * max(mid, 500) for most, mid in read)
    if not orphaned:
        assert max(most for most, _ in read) < n // 8


def test_many_suspects_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr("strataweave.operators.references.BROADCAST_KEYS", 0)
    monkeypatch.setattr("strataweave.operators.references.ROWS_PER_SALT", 2)
    _, out = run(spark, REFS, LOADS, GONE, hot_share=0.2)
    assert sorted((r["child_id"], r["ref_key"]) for r in out.collect()) == brute(REFS, LOADS, GONE)


def test_a_parent_key_that_is_loaded_over_and_over(spark):
    loads = [(1, dt(2020, 1, d, h)) for d in range(1, 6) for h in range(24)] + [(2, dt(2020, 1, 3, 5))]
    gone = [(1, dt(2020, 1, 2, 3, 30)), (1, dt(2020, 1, 4, 23, 30)), (1, dt(2020, 1, 5, 0)), (3, D[0])]
    got = alive_intervals(spark.createDataFrame(loads, "id int, at timestamp"), spark.createDataFrame(gone, "id int, at timestamp"))
    want = [(1, dt(2020, 1, 1, 0), dt(2020, 1, 2, 3, 30)), (1, dt(2020, 1, 2, 4), dt(2020, 1, 4, 23, 30)), (1, dt(2020, 1, 5, 1), None), (2, dt(2020, 1, 3, 5), None)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
