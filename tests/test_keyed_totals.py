from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.operators.keyed_totals import keyed_totals

SCHEMA = "g string, k long, v int, block long, offsets string"


def brute(rows):
    out = defaultdict(lambda: [0, 0])
    for g, k, v, *_ in rows:
        out[g, k][0] += 1
        out[g, k][1] += v or 0
    return {(g, k, n, s) for (g, k), (n, s) in out.items()}


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    return {tuple(r) for r in keyed_totals(df, "g", "k", ("v",)).collect()}


def test_hot_key_nulls_ties_negative_and_far_keys(spark):
    rows = [("a", 5, 1)] * 500 + [("a", None, 2), ("a", None, None), (None, 5, 3), (None, None, 4), ("b", -1, 5), ("b", -1025, 6), ("b", 2**62, 7), ("b", -(2**62), 8), ("b", 1023, 9), ("b", 1024, 10), ("c", 0, None)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        keyed_totals(spark.createDataFrame([("a", "b")], "g string, k string"), "g", "k")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3000, 3000)), st.one_of(st.none(), st.integers(-5, 5))), max_size=60))
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_sums_beyond_doubles_and_beyond_64_bits(spark):
    big = spark.createDataFrame([("a", 1, 2**53), ("a", 1, 1), ("a", 2, -(2**62)), ("a", 2, -(2**62) + 1), ("b", 1, 2**62), ("b", 1, 2**62 - 1)], "g string, k long, v long")
    assert {tuple(r)[:2]: r["sum_v"] for r in keyed_totals(big, "g", "k", ("v",)).collect()} == {("a", 1): 2**53 + 1, ("a", 2): -(2**63) + 1, ("b", 1): 2**63 - 1}
    with pytest.raises(Exception, match="64 bits"):
        keyed_totals(spark.createDataFrame([("a", 1, 2**62)] * 2, "g string, k long, v long"), "g", "k", ("v",)).collect()


@pytest.mark.parametrize("at_once", [1, 3, 2000])
def test_sparse_keys_and_blocks_over_several_batches(spark, monkeypatch, at_once):
    from strataweave.operators import keyed_totals as module

    rows = [("a" if i % 3 else None, (i * 7919 % 400) * (10**6 if i % 2 else 1), i % 11) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    monkeypatch.setattr(module, "ROWS_AT_ONCE", at_once)
    parts = [list(module._count_splits(2)(iter(df.select("g", "k", F.col("v").cast("long").alias("v0")).where(f"k % 7 = {i}").toArrow().to_batches()))) for i in range(7)]
    merged = pa.Table.from_batches([b for p in parts for b in p]).sort_by([("g", "ascending"), ("block", "ascending")])
    got = pa.Table.from_batches(list(module._sum_blocks(2, ["g", "k", "n", "s"])(iter(merged.to_batches(max_chunksize=50)))))
    assert {tuple(r.values()) for r in got.to_pylist()} == brute(rows) and got.num_rows == len(brute(rows))
