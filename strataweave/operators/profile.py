"""Column profiles of loads: exact base aggregates, and a classifier that tells loads apart.

One pass puts every cell into a fine bin and counts bins per load and column;
null rates, cells outside a rule and the bin of any order statistic follow from
these counts, whose number depends on loads, columns and bins only. For changes
between loads a logistic regression is trained on each pair of neighbouring
loads (:mod:`strataweave.operators.two_sample`); its cross-fitted discrimination
stands beside each finding and ranks them, and the exact medians or shares of
every pair decide.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strataweave.operators.two_sample import discrimination
from strataweave.sources.storage import discard, materialize

FINE_BINS = 4096
COARSE_BINS = 16


@dataclass(frozen=True)
class Rule:
    """What is inside: ``low <= x <= high`` (``low < x`` if ``open_low``), or one of ``allowed``."""

    column: str
    low: float = 0.0
    high: float = 0.0
    open_low: bool = False
    allowed: tuple[str, ...] = ()

    @property
    def text(self) -> bool:
        return bool(self.allowed)

    @property
    def codes(self) -> int:
        """Values of the coarse code: inside bins, outside, null."""
        return (len(self.allowed) if self.text else COARSE_BINS) + 2

    def inside(self, x: Column) -> Column:
        if self.text:
            return x.isin(*self.allowed)
        return ((x > self.low) if self.open_low else (x >= self.low)) & (x <= self.high)

    def fine(self, x: Column) -> Column:
        """-1 for null, 0 to FINE_BINS - 1 inside (in the order of the values), and above that outside."""
        if self.text:
            place = F.array_position(F.array(*map(F.lit, self.allowed)), x) - 1
        else:
            scale = FINE_BINS / float(np.log1p(self.high - self.low))
            place = F.least(F.lit(FINE_BINS - 1), F.floor(F.log1p(x - F.lit(self.low)) * F.lit(scale)))
        out = F.lit(FINE_BINS) + F.pmod(F.xxhash64(x), F.lit(FINE_BINS))
        return F.when(x.isNull(), F.lit(-1)).when(self.inside(x), place).otherwise(out).cast("int")

    def value(self) -> Column:
        return F.col(f"`{self.column}`").cast("string" if self.text else "double")


def _cells(df: DataFrame, load: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``load_id, ci, bin, num, txt``: one row per cell."""
    cell = [
        F.struct(
            F.lit(i).alias("ci"),
            r.fine(r.value()).alias("bin"),
            (F.lit(None).cast("double") if r.text else r.value()).alias("num"),
            (r.value() if r.text else F.lit(None).cast("string")).alias("txt"),
        )
        for i, r in enumerate(rules)
    ]
    return df.select(F.col(f"`{load}`").alias("load_id"), F.inline(F.array(*cell)))


def bin_counts(df: DataFrame, load: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``load_id, ci, bin, n, low, high``: cells per load, column number and fine bin."""
    return (
        _cells(df, load, rules)
        .groupBy("load_id", "ci", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("low"), F.max("num").alias("high"))
    )


def profile(df: DataFrame, table_name: str, load: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Base aggregates per load and column, all exact.

    ``table_name, column_name, load_id, n_cells, n_null, n_outside, n_distinct,
    min_value, max_value``; the last two are null for text. Rows without a load
    form a load of their own with a null ``load_id``; repeated rows count each
    time; distinct counts leave nulls out. Only the named columns are read. An
    empty table has no loads and gives no rows.
    """
    # Distinct values are counted after values are made unique per load, so that no task holds a load's values.
    cells = _cells(df, load, rules)
    values = (
        cells.groupBy("load_id", "ci", "num", "txt")
        .agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("bin"))
        .groupBy("load_id", "ci")
        .agg(
            F.sum("n").alias("n_cells"),
            F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).alias("n_null"),
            F.sum(F.when(F.col("bin") >= FINE_BINS, F.col("n")).otherwise(0)).alias("n_outside"),
            F.sum(F.when(F.col("bin") >= 0, 1).otherwise(0)).alias("n_distinct"),
            F.min("num").alias("min_value"),
            F.max("num").alias("max_value"),
        )
    )
    return values.select(
        F.lit(table_name).alias("table_name"), _name(rules), "load_id", "n_cells", "n_null", "n_outside", "n_distinct", "min_value", "max_value"
    )


def _name(rules: tuple[Rule, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(r.column) for r in rules)), F.col("ci") + 1).alias("column_name")


def _cuts(counts: DataFrame, before: DataFrame) -> DataFrame:
    """``pair, ci, cuts``: for each pair of loads the fine bins at which the coarse bins of a numeric column begin.

    The cuts are quantiles of the two loads together, their median among them, so
    a median that moves from one load to the next moves rows across a cut.
    """
    inside = counts.where((F.col("bin") >= 0) & (F.col("bin") < FINE_BINS) & F.col("low").isNotNull())
    both = inside.join(F.broadcast(before), "load_id").groupBy("pair", "ci", "bin").agg(F.sum("n").alias("n"))  # two rows a load
    column = Window.partitionBy("pair", "ci")  # at most FINE_BINS rows
    upto = F.sum("n").over(column.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("upto", upto).withColumn("total", F.sum("n").over(column))
    # A cut after each bin in which the k-th of COARSE_BINS - 1 quantiles lies.
    reached = lambda n: F.floor(n * COARSE_BINS / F.col("total"))
    crossed = reached(F.col("upto")) > reached(F.col("upto") - F.col("n"))
    return ranked.where(crossed & (F.col("upto") < F.col("total"))).groupBy("pair", "ci").agg(F.sort_array(F.collect_list(F.col("bin") + 1)).alias("cuts"))


def load_discrimination(df: DataFrame, load: str, rules: tuple[Rule, ...], unit: tuple[str, ...]) -> DataFrame:
    """How well each column tells a load from the one before it.

    ``load_id, column_name, auc_all, auc_without, auc_alone, auc_gain, auc_error``: the
    cross-fitted AUC of a logistic regression on all columns, on all but this one
    (ablation) and on this one; ``auc_gain`` is the larger of the loss by ablation
    and the gain of the column alone over 0.5, and ``auc_error`` the standard error
    of an AUC of equal loads of this size. ``unit`` names the columns whose
    hash puts a row into a fold, so copies of a row share one. Rows without a
    load are left out; a table with fewer than two loads gives no rows.
    """
    counts = _written_counts(df, load, rules)
    sizes = {r["load_id"]: r["n_cells"] for r in _bins_of_interest(counts, rules) if r["first_row"] and r["ci"] == 0}
    found = _discriminate(df, load, rules, unit, counts, sizes)
    discard(counts)
    return _small_table(df.sparkSession, found, _DISCRIMINATION)


_FIGURES = ("auc_all", "auc_without", "auc_alone", "auc_gain", "auc_error")
_DISCRIMINATION = "load_id long, column_name string" + "".join(f", {c} double" for c in _FIGURES)
_FINDINGS = "table_name string, column_name string, load_id long, check_name string"


def _small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation, whose size Spark knows."""
    kind = T._parse_datatype_string(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], kind.fieldNames()), kind)


def _written_counts(df: DataFrame, load: str, rules: tuple[Rule, ...]) -> DataFrame:
    counts = bin_counts(df.where(F.col(f"`{load}`").isNotNull()), load, rules)
    return materialize(counts.withColumn("load_id", F.col("load_id").cast("long")), "bins")


def _bins_of_interest(counts: DataFrame, rules: tuple[Rule, ...]) -> list[Row]:
    """Per load and column its sums, the bin of the median of its inside numbers, bins with 60 % of the non-null cells, and allowed texts.

    One row of each load and column at least, marked as ``first_row``; their number
    is bounded by loads, columns and allowed texts.
    """
    bin_, n = F.col("bin"), F.col("n")
    inside = (bin_ >= 0) & (bin_ < FINE_BINS)
    is_text = F.element_at(F.array(*(F.lit(r.text) for r in rules)), F.col("ci") + 1)
    column = Window.partitionBy("load_id", "ci")  # at most a row a bin
    total = lambda c: F.sum(F.when(c, n).otherwise(0)).over(column)
    placed = counts.select(
        "load_id", "ci", "bin", "n", is_text.alias("is_text"), inside.alias("inside"),
        F.sum(F.when(inside, n).otherwise(0)).over(_by_bin()).alias("upto"),
        F.sum("n").over(column).alias("n_cells"), total(bin_ >= 0).alias("n_full"), total(inside).alias("n_in"),
        (F.row_number().over(column.orderBy("bin")) == 1).alias("first_row"),
    )
    rank = F.floor((F.col("n_in") + 1) / 2).cast("long")
    before = F.col("upto") - n
    is_median = F.col("inside") & ~F.col("is_text") & (F.col("upto") >= rank) & (before < rank)
    is_heavy = (bin_ >= 0) & (n * 100 >= F.col("n_full") * 60)
    marked = placed.withColumns({"is_median": is_median, "is_heavy": is_heavy, "place": rank - before})
    return marked.where("first_row or is_median or is_heavy or (is_text and inside)").orderBy("load_id", "ci", "bin").collect()


def _discriminate(df: DataFrame, load: str, rules: tuple[Rule, ...], unit: tuple[str, ...], counts: DataFrame, sizes: dict[int, int]) -> list[tuple]:
    """Rows of :func:`load_discrimination`. ``sizes``: rows of each load, by load in order."""
    spark = df.sparkSession
    pairs = list(pairwise(sizes))
    if not pairs:
        return []
    # Every load is the later one of a pair and the earlier one of the next.
    roles = [x for i, (a, b) in enumerate(pairs) for x in ((a, i, 0), (b, i, 1))]
    before = _small_table(spark, roles, "load_id long, pair int, later int")
    at = {(r["pair"], r["ci"]): r["cuts"] for r in _cuts(counts, before).collect()}  # one row a pair and column
    # The coarse bin of every fine one, by pair and column: bounded by loads, columns and bins.
    numeric = [i for i, r in enumerate(rules) if not r.text]
    coarse = lambda cuts: np.searchsorted(np.array(cuts), np.arange(FINE_BINS), "right").astype(np.int8)
    with_bins = [(*role, *(coarse(at.get((role[1], i), [])) for i in numeric)) for role in roles]
    before = _small_table(spark, with_bins, "load_id long, pair int, later int" + "".join(f", k{i} array<tinyint>" for i in numeric))

    fine = [r.fine(r.value()).alias(f"f{i}") for i, r in enumerate(rules)]
    fold = F.pmod(F.xxhash64(*(F.col(f"`{u}`") for u in unit)), F.lit(2)).cast("int").alias("fold")
    rows = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").cast("long").alias("load_id"), fold, *fine)
    codes = []
    for i, r in enumerate(rules):
        f = F.col(f"f{i}")
        place = f if r.text else F.get(f"k{i}", f)
        codes.append(F.when(f < 0, r.codes - 1).when(f >= FINE_BINS, r.codes - 2).otherwise(place).cast("int").alias(f"c{i}"))
    names = [f"c{i}" for i in range(len(rules))]
    roled = rows.join(F.broadcast(before), "load_id").select("pair", "later", "fold", *codes)
    vectors = roled.groupBy("pair", "later", "fold", *names).agg(F.count(F.lit(1)).alias("n"))
    found = discrimination(vectors, len(pairs), [r.codes for r in rules])
    error = [((sizes[a] + sizes[b] + 1) / (12 * sizes[a] * sizes[b])) ** 0.5 for a, b in pairs]
    gain = lambda x: max(x.auc_all - x.auc_without, x.auc_alone - 0.5)
    return [(pairs[x.pair][1], rules[x.column].column, x.auc_all, x.auc_without, x.auc_alone, gain(x), error[x.pair]) for x in found]


def load_findings(df: DataFrame, table_name: str, load: str, rules: tuple[Rule, ...], unit: tuple[str, ...]) -> DataFrame:
    """:func:`findings_with_evidence` without the figures, by :func:`in_rank`."""
    return without_evidence(in_rank(findings_with_evidence(df, table_name, load, rules, unit)))


def in_rank(findings: DataFrame) -> DataFrame:
    """Findings of one or several tables, the largest AUC gain first; the first load of a table has no gain and comes last."""
    return findings.orderBy(F.col("auc_gain").desc_nulls_last(), "table_name", "load_id", "column_name", "check_name")


def without_evidence(findings: DataFrame) -> DataFrame:
    return findings.drop(*_FIGURES)


def findings_with_evidence(df: DataFrame, table_name: str, load: str, rules: tuple[Rule, ...], unit: tuple[str, ...]) -> DataFrame:
    """Loads and columns that stand out, with the classifier's figures: ``table_name, column_name, load_id, check_name, auc_all, auc_without, auc_alone, auc_gain, auc_error``.

    Checks: ``nulls`` (8 % of the cells), ``range`` or ``pattern`` (5 % of the
    non-null cells outside), ``constant`` (one value in 60 % of the non-null
    cells) and ``shift`` against the load before (medians of inside numbers 1.5
    times apart, or shares of allowed texts 0.25 apart). Every load and column is
    compared exactly, however small the change of the distribution: which rows there
    are does not depend on the classifier. Its figures, those of
    :func:`load_discrimination` for the load and column, say how far the column tells the
    load from the one before it, and :func:`in_rank` orders by them; they are null in
    the first load. Repeated rows count each time. Rows without a load, a load without
    inside cells and an empty table have no case.
    """
    spark = df.sparkSession
    counts = _written_counts(df, load, rules)
    bins = _bins_of_interest(counts, rules)
    sums = {(r["load_id"], r["ci"]): r for r in bins if r["first_row"]}
    sizes = {r["load_id"]: r["n_cells"] for k, r in sums.items() if k[1] == 0}
    with ThreadPoolExecutor(1) as pool:  # the two read the table at the same time
        exact = pool.submit(_values, df, load, rules, bins)
        figures = {r[:2]: r[2:] for r in _discriminate(df, load, rules, unit, counts, sizes)}
        heavy, medians = exact.result()
    discard(counts)
    found: list[tuple[int, int, str]] = []
    for (at, ci), r in sums.items():
        n_null, n_out = r["n_cells"] - r["n_full"], r["n_full"] - r["n_in"]
        if n_null * 100 >= r["n_cells"] * 8:
            found.append((at, ci, "nulls"))
        if r["n_full"] and n_out * 100 >= r["n_full"] * 5:
            found.append((at, ci, "pattern" if rules[ci].text else "range"))

    found += [(at, ci, "constant") for at, ci in heavy]
    shares = {(r["load_id"], r["ci"], r["bin"]): Fraction(r["n"], r["n_in"]) for r in bins if r["is_text"] and r["inside"]}
    for before, at in pairwise(sizes):
        for ci, rule in enumerate(rules):
            if not (sums[before, ci]["n_in"] and sums[at, ci]["n_in"]):
                continue
            if rule.text:
                gap = sum(abs(shares.get((at, ci, b), 0) - shares.get((before, ci, b), 0)) for b in range(len(rule.allowed))) / 2
                moved = gap >= Fraction(1, 4)
            else:
                low, high = sorted((medians[before, ci], medians[at, ci]))
                moved = low != high and high * 2 >= low * 3
            if moved:
                found.append((at, ci, "shift"))
    none = (None,) * len(_FIGURES)
    rows = [(table_name, rules[ci].column, at, check, *figures.get((at, rules[ci].column), none)) for at, ci, check in sorted(found)]
    out = _small_table(spark, rows, _FINDINGS + "".join(f", {c} double" for c in _FIGURES))
    return out.withColumn("load_id", F.col("load_id").cast(df.schema[load].dataType))


def _values(df: DataFrame, load: str, rules: tuple[Rule, ...], bins: list[Row]) -> tuple[set[tuple[int, int]], dict[tuple[int, int], Decimal]]:
    """Columns of which one value has 60 % of the non-null cells, and exact medians of inside numbers, by load and column."""
    wanted = [(r["load_id"], r["ci"], r["bin"], r["n_full"], r["place"], r["is_median"], r["is_heavy"]) for r in bins if r["is_median"] or r["is_heavy"]]
    if not wanted:
        return set(), {}
    targets = _small_table(df.sparkSession, wanted, "load_id long, ci int, bin int, n_full long, place long, is_median boolean, is_heavy boolean")
    cells = _cells(df.where(F.col(f"`{load}`").isNotNull()), load, rules).withColumn("load_id", F.col("load_id").cast("long"))
    # Two bins a load and column at most.
    hit = cells.join(F.broadcast(targets), ["load_id", "ci", "bin"])
    counted = hit.groupBy("load_id", "ci", "bin", "num", "txt", "n_full", "place", "is_median", "is_heavy").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("load_id", "ci", "bin").orderBy("num").rowsBetween(Window.unboundedPreceding, 0))
    at_median = F.col("is_median") & (F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))
    constant = F.col("is_heavy") & (F.col("n") * 100 >= F.col("n_full") * 60)
    ranked = counted.withColumn("upto", upto).select("load_id", "ci", F.col("num").cast(T.DecimalType(24, 6)).alias("num"), at_median.alias("m"), constant.alias("c"))
    rows = ranked.where("m or c").collect()  # two rows a load and column at most
    return {(r["load_id"], r["ci"]) for r in rows if r["c"]}, {(r["load_id"], r["ci"]): r["num"] for r in rows if r["m"]}


def _by_bin():
    """Running order of the bins within a load and column."""
    return Window.partitionBy("load_id", "ci").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
