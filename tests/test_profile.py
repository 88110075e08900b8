import random

import numpy as np
import pytest

from strataweave.operators.profile import Rule, load_discrimination, load_findings, profile
from strataweave.operators.two_sample import _fit, _Rows, _sums, discrimination
from strataweave.plans import data_care

RULES = (Rule("x", 0, 1000, open_low=True), Rule("s", allowed=("a", "b")))
SCHEMA = "id int, load_id int, x double, s string, bin int, n int, ci int"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, 1, 1) for i, r in enumerate(rows)], SCHEMA)


def rows(load, n, x, s):
    rng = random.Random(load)
    return [(load, x(rng), s(rng)) for _ in range(n)]


def found(spark, data):
    return {(r["column_name"], r["load_id"], r["check_name"]) for r in load_findings(table(spark, data), "t", "load_id", RULES, ("id",)).collect()}


def base(load, n=300):
    return rows(load, n, lambda r: float(r.randint(10, 30)), lambda r: r.choice("ab"))


def test_each_check(spark):
    data = base(1) + base(2)
    data += rows(3, 300, lambda r: None if r.random() < 0.2 else float(r.randint(10, 30)), lambda r: r.choice("ab"))
    data += rows(4, 300, lambda r: -1.0 if r.random() < 0.2 else float(r.randint(10, 30)), lambda r: r.choice("abbz"))
    data += rows(5, 300, lambda r: 20.0 if r.random() < 0.8 else float(r.randint(10, 30)), lambda r: r.choice("ab"))
    data += rows(6, 300, lambda r: float(r.randint(40, 90)), lambda r: "a" if r.random() < 0.9 else "b")
    data += [(None, 5.0, "a"), (None, None, None)]
    assert found(spark, data) == {("x", 3, "nulls"), ("x", 4, "range"), ("s", 4, "pattern"), ("x", 5, "constant"), ("x", 6, "shift"), ("s", 6, "shift"), ("s", 6, "constant")}


def test_edges(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None, None)]) == {("x", 1, "nulls"), ("s", 1, "nulls")}
    assert found(spark, [(1, 5.0, "a"), (2, float("nan"), "z")]) == {("x", 1, "constant"), ("s", 1, "constant"), ("x", 2, "range"), ("x", 2, "constant"), ("s", 2, "pattern"), ("s", 2, "constant")}


def test_profile_counts(spark):
    got = {(r["column_name"], r["load_id"]): tuple(r)[3:] for r in profile(table(spark, [(1, 5.0, "a"), (1, 5.0, None), (1, None, "z"), (None, -2.0, "b")]), "t", "load_id", RULES).collect()}
    assert got["x", 1] == (3, 1, 0, 1, 5.0, 5.0)
    assert got["s", 1] == (3, 1, 1, 2, None, None)
    assert got["x", None] == (1, 0, 1, 1, -2.0, -2.0)
    assert profile(table(spark, []), "t", "load_id", RULES).count() == 0


def test_classifier_sees_a_change_and_ignores_none(spark):
    data = base(1, 2000) + base(2, 2000) + rows(3, 2000, lambda r: float(r.randint(25, 60)), lambda r: r.choice("ab"))
    auc = {(r["load_id"], r["column_name"]): r for r in load_discrimination(table(spark, data), "load_id", RULES, ("id",)).collect()}
    assert auc[3, "x"]["auc_alone"] > 0.8 and auc[3, "x"]["auc_all"] - auc[3, "x"]["auc_without"] > 0.3
    assert abs(auc[2, "x"]["auc_alone"] - 0.5) < 0.03 and abs(auc[3, "s"]["auc_alone"] - 0.5) < 0.03
    assert load_discrimination(table(spark, base(1)), "load_id", RULES, ("id",)).count() == 0


def test_shift_with_hardly_any_change_of_a_large_load(spark):
    """Medians from 1 to 2 by 0.2 % of the rows, and shares turned over in 0.2 % of the cells: AUC gains of about 0.001."""
    n = 200_000
    x = "CASE WHEN i < {} THEN 1.0D ELSE 2.0D END"
    s = "CASE WHEN i % 500 = 0 THEN '{}' ELSE 'z' END"
    loads = [spark.range(n).selectExpr("id AS i").selectExpr("int(i) AS id", f"{load} AS load_id", x.format(ones) + " AS x", s.format(t) + " AS s") for load, ones, t in ((1, 100_200, "a"), (2, 99_800, "b"))]
    df = loads[0].unionByName(loads[1])
    got = [(r["column_name"], r["load_id"]) for r in load_findings(df, "t", "load_id", RULES, ("id",)).collect() if r["check_name"] == "shift"]
    assert sorted(got) == [("s", 2), ("x", 2)]


def test_findings_are_ranked_by_the_classifier(spark):
    data = base(1) + rows(2, 300, lambda r: float(r.randint(40, 90)), lambda r: r.choice("aaaab"))
    got = [tuple(r)[1:] for r in load_findings(table(spark, data), "t", "load_id", RULES, ("id",)).collect()]
    assert got[0] == ("x", 2, "shift") and {g[0] for g in got[1:]} == {"s"}


def test_many_columns_need_no_matrix_of_columns_by_columns(spark):
    """50 columns and 4 loads: the same figures in one task a pair as by rounds over partitions."""
    rng = random.Random(3)
    m, pairs, codes = 50, 3, [6] * 50
    data = [(p, y, rng.randint(0, 1), *(rng.randint(0, 3) + (2 * y if c == 7 else 0) for c in range(m)), 1 + rng.randint(0, 2)) for p in range(pairs) for y in (0, 1) for _ in range(150)]
    vectors = spark.createDataFrame(data, "pair int, later int, fold int, " + "".join(f"c{c} int, " for c in range(m)) + "n long")
    one, many = (discrimination(vectors, pairs, codes, local_vectors=n) for n in (10**6, 0))
    assert len(one) == len(many) == pairs * m
    for a, b in zip(one, many, strict=True):
        assert (a.pair, a.column) == (b.pair, b.column) and max(abs(x - y) for x, y in zip(a[2:], b[2:], strict=True)) < 2e-3
    assert all(x.auc_alone > 0.8 for x in one if x.column == 7) and all(x.auc_alone < 0.65 for x in one if x.column != 7)


@pytest.mark.parametrize("n", [20_000, 2_000_000])
def test_a_shift_is_the_same_at_every_size(spark, n):
    """Medians 10 and 20 by 50.2 and 49.8 % of the rows."""
    part = lambda load, low: spark.range(n).selectExpr("int(id) AS id", f"{load} AS load_id", f"IF(id < {low}, 10.0D, 20.0D) AS x", "'a' AS s")
    df = part(1, n * 502 // 1000).unionByName(part(2, n * 498 // 1000))
    got = [(r["column_name"], r["load_id"]) for r in load_findings(df, "t", "load_id", RULES, ("id",)).collect() if r["check_name"] == "shift"]
    assert got == [("x", 2)]
    auc = {r["column_name"]: r["auc_alone"] for r in load_discrimination(df, "load_id", RULES, ("id",)).collect()}
    assert abs(auc["x"] - 0.502) < (0.02 if n < 100_000 else 0.001)


def test_fitted_models_have_no_slope_left():
    rng = np.random.default_rng(5)
    rows = _Rows(np.zeros(4000, np.int64), rng.integers(0, 2, 4000).astype(float), rng.integers(0, 2, 4000), np.ones(4000), 1 + np.stack([rng.integers(0, 4, 4000), 4 + rng.integers(0, 3, 4000)], 1))
    rows = rows._replace(later=np.where(rows.at[:, 0] > 3, 1.0, rows.later))
    variants = [(0, 1), (1,), (0,)]
    beta = _fit((2, 3, 8), lambda b: _sums(rows, b, variants))
    slope = _sums(rows, beta, variants)[:, :-1, 1:] + 1.0 * beta
    assert np.abs(slope).max() < 1e-5 * 4000


@pytest.mark.parametrize("later", ["products", "order_details"])
def test_findings_of_both_tables_are_one_list_by_the_classifier(spark, tmp_path, later):
    """In ``later`` all numbers move, in the other table 1 % of them: both shift, and the table that moved more comes first."""
    part = lambda load, low: spark.range(2000).selectExpr(f"{load} AS load_id", "int(id) AS id", f"IF(id < {low}, 10, 20) AS x")
    for name in ("products", "order_details"):
        first, second = (2000, 0) if name == later else (1010, 990)
        both = part(1, first).unionByName(part(2, second))
        shape = ("id", "load_id", "CAST(id % 7 + 1 AS DOUBLE) AS price", "x AS stock") if name == "products" else ("id AS order_id", "id AS product_id", "load_id", "x AS quantity", "elt(id % 4 + 1, 'Pending', 'Shipped', 'Delivered', 'Cancelled') AS status")
        both.selectExpr(*shape).write.parquet(f"{tmp_path}/{name}.parquet")
    shifts = {"products": ("products", "stock", 2, "shift"), "order_details": ("order_details", "quantity", 2, "shift")}
    got = [tuple(r) for r in data_care.p6_found(spark, str(tmp_path)).collect()]
    moved = [g for g in got if g[3] == "shift"]
    assert moved[0] == shifts[later] and set(moved) == set(shifts.values())
    figures = {(r["table_name"], r["column_name"], r["load_id"]): r for r in data_care.p6_load_discrimination(spark, str(tmp_path)).collect()}
    ranked = data_care.p6_ranked(spark, str(tmp_path)).collect()
    assert [tuple(r)[:4] for r in ranked] == got
    for r in ranked:
        known = figures.get(tuple(r)[:3])
        assert all(r[c] == (known and pytest.approx(known[c])) for c in ("auc_all", "auc_without", "auc_alone", "auc_gain", "auc_error"))
    gains = [r["auc_gain"] for r in ranked]
    with_gain = [g for g in gains if g is not None]
    assert with_gain == sorted(with_gain, reverse=True) and gains == with_gain + [None] * (len(gains) - len(with_gain)) and None in gains
