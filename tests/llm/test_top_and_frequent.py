"""Top rows per group, most frequent values and percentiles against brute force."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, isclose

import pytest

from strataweave.llm.heavy_hitters import top_k
from strataweave.llm.percentiles import merge_states, percentiles, value_state
from strataweave.llm.topn import top_n

RNG = random.Random(5)
ROWS = [(RNG.choice(["a", "a", "a", "b", None]), RNG.choice([None, 1.0, 2.0, 2.0, 5.5]), RNG.choice([None, *range(40)])) for _ in range(300)]
ROWS += [("hot", float(i % 7), i) for i in range(30_000)] + [("one", 3.0, 1), ("one", 3.0, 1), ("nan", float("nan"), 2), ("nan", 1.0, 3)]


def table(spark, rows):
    # Names that the operators use inside must not matter.
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "grp string, score double, id int, g int, s int, rank string")
    return df.repartition(5)


def best(rows, n):
    groups = defaultdict(list)
    for g, s, i in rows:
        if g is not None and s is not None:
            groups[g].append((s, i))
    key = lambda x: (-(float("inf") if x[0] != x[0] else x[0]), x[1] is None, x[1] or 0)
    return sorted((g, r + 1, i) for g, v in groups.items() for r, (_, i) in enumerate(sorted(v, key=key)[:n])) if rows else []


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n(spark, n):
    got = sorted(((r["grp"], r["rank"], r["id"]) for r in top_n(table(spark, ROWS), "grp", "score", "id", n).collect()), key=str)
    assert got == sorted(best(ROWS, n), key=str)


def test_top_n_empty(spark):
    assert top_n(table(spark, []), "grp", "score", "id", 3).count() == 0


def test_top_n_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(((r["grp"], r["rank"], r["id"]) for r in top_n(table(spark, ROWS[:300]), "grp", "score", "id", 10).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(best(ROWS[:300], 10), key=str)


VALUES = [7] * 4000 + [9] * 4000 + [3] * 2500 + [None] * 500 + list(range(100, 9000)) + list(range(100, 2000))


@pytest.mark.parametrize("k", [1, 2, 3, 40])
def test_top_k(spark, k):
    values = VALUES[:]
    random.Random(k).shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "value int, n int").repartition(6)
    want = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [tuple(r) for r in top_k(df, "value", k).collect()] == want


def test_top_k_of_texts_sorted_input_and_empty(spark):
    df = spark.createDataFrame([(x,) for x in ["", "", "b", "a", None]], "c string")
    assert [tuple(r) for r in top_k(df, "c", 5).collect()] == [("", 2), ("a", 1), ("b", 1)]
    # Every split holds other values: no local leader is a leader overall.
    apart = spark.createDataFrame([(i // 3,) for i in range(3000)] + [(50,)], "c int").repartitionByRange(8, "c")
    assert [tuple(r) for r in top_k(apart, "c", 2).collect()] == [(50, 4), (0, 3)]
    assert top_k(df.limit(0), "c", 3).count() == 0


def exact(values, p):
    v = sorted(values)
    low = v[max(0, ceil(Fraction(p * len(v), 100)) - 1)]
    at, part = divmod((len(v) - 1) * p, 100)
    return low, v[at] + (v[min(at + 1, len(v) - 1)] - v[at]) * part / 100


def test_percentiles_and_merged_states(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.0, 1.0, 2.5, rng.random() * 100])) for _ in range(20_000)] + [("x", 4.0), (None, 1.0), (None, 3.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame([(g, v, 1, "q") for g, v in rows], "grp string, v double, n int, pid string").repartition(4)
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            groups[g].append(v)
    percents = [0, 1, 10, 50, 90, 99, 100]
    whole = value_state(df, ["grp"], "v")
    parts = merge_states(value_state(df.where("v < 2"), ["grp"], "v"), value_state(df.where("v >= 2"), ["grp"], "v"))
    for state in (whole, parts):
        got = {(r["grp"], r["percent"]): r for r in percentiles(state, percents).collect()}
        assert set(got) == {(g, p) for g in groups for p in percents}
        for (g, p), r in got.items():
            low, between = exact(groups[g], p)
            assert r["n_values"] == len(groups[g]) and r["lower"] == low and isclose(r["interpolated"], between, rel_tol=1e-9)
    assert percentiles(value_state(df.limit(0), ["grp"], "v"), [50]).count() == 0


def test_states_need_not_be_merged(spark):
    df = spark.createDataFrame([("a", float(i % 9)) for i in range(100)] + [(None, 1.0)], "g string, v double")
    parts = [value_state(df.where(c), ["g"], "v") for c in ("v < 5", "v >= 3", "v < 0")]
    plain, merged = percentiles(parts[0].unionByName(parts[1]).unionByName(parts[2]), [0, 10, 50, 90, 100]), percentiles(merge_states(*parts), [0, 10, 50, 90, 100])
    assert sorted(map(str, plain.collect())) == sorted(map(str, merged.collect()))


def test_least_count(spark):
    df = spark.createDataFrame([(v,) for v in range(20) for _ in range(v)], "v long").repartition(5)
    assert [tuple(r) for r in top_k(df, "v", 10, 17).collect()] == [(19, 19), (18, 18), (17, 17)]
    assert [tuple(r) for r in top_k(df, "v", 2, 17).collect()] == [(19, 19), (18, 18)] and top_k(df, "v", 5, 99).count() == 0
