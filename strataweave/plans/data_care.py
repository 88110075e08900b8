"""Queries on orphan references, hot keys and column profiles (p2, p5, p6)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators.keyed_totals import keyed_totals
from strataweave.operators.profile import Rule, findings_with_evidence, in_rank, load_discrimination, profile, without_evidence
from strataweave.operators.references import alive_intervals, orphan_counts, orphan_references
from strataweave.sources import table

PRODUCT_RULES = (Rule("price", 0, 50_000, open_low=True), Rule("stock", 0, 100_000))
ORDER_RULES = (Rule("quantity", 1, 500), Rule("status", allowed=("Pending", "Shipped", "Delivered", "Cancelled")))


def _order_time():
    return F.coalesce(F.col("ordered_at"), F.col("loaded_at"))


def _alive(spark: SparkSession, sf_dir: str, parent: str) -> DataFrame:
    gone = table(spark, sf_dir, "tombstones").where(F.col("table_name") == parent).select("key_value", "deleted_at")
    return alive_intervals(table(spark, sf_dir, parent).select("id", "loaded_at"), gone)


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order_refs = table(spark, sf_dir, "order_details"), "order_id", "product_id", _order_time(), _alive(spark, sf_dir, "products")
    staff_refs = table(spark, sf_dir, "employees"), "id", "dept_id", "loaded_at", _alive(spark, sf_dir, "departments")
    with ThreadPoolExecutor(2) as pool:  # the jobs of the two tables at the same time
        orders, staff = (pool.submit(orphan_references, *refs) for refs in (order_refs, staff_refs))
        return orders.result(), staff.result()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, staff = _orphans(spark, sf_dir)
    return (
        orders.select(F.lit("order_details").alias("child_table"), F.col("child_id").cast("long").alias("child_id"))
        .unionByName(staff.select(F.lit("employees").alias("child_table"), F.col("child_id").cast("long").alias("child_id")))
        .distinct()
    )


def p2_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans of both child tables per month of the reference time."""
    orders, staff = _orphans(spark, sf_dir)
    a = orphan_counts(table(spark, sf_dir, "order_details"), "product_id", _order_time(), orders)
    b = orphan_counts(table(spark, sf_dir, "employees"), "dept_id", "loaded_at", staff)
    return (
        a.withColumn("child_table", F.lit("order_details"))
        .unionByName(b.withColumn("child_table", F.lit("employees")))
        .select("child_table", "period", "n_refs", "n_orphans", F.round("orphan_share", 9).alias("orphan_share"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "order_details")
    sizes = rows.groupBy(F.col("load_id").alias("of_load")).agg(F.count(F.lit(1)).alias("n_load"))
    totals = keyed_totals(rows, "load_id", "product_id").where("product_id is not null")
    return totals.join(sizes, F.col("load_id") == F.col("of_load")).where(F.col("n_rows") * 100 >= F.col("n_load") * 6).select("load_id", "product_id")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and summed quantity of every product in every load."""
    return keyed_totals(table(spark, sf_dir, "order_details"), "load_id", "product_id", ("quantity",))


def _products(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "products"), "products", "load_id", PRODUCT_RULES, ("id",)


def _details(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "order_details"), "order_details", "load_id", ORDER_RULES, ("order_id", "product_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_evidence(p6_ranked(spark, sf_dir))


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of both tables as one list in the classifier's order, with its figures."""
    return in_rank(findings_with_evidence(*_products(spark, sf_dir)).unionByName(findings_with_evidence(*_details(spark, sf_dir))))


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _products(spark, sf_dir), _details(spark, sf_dir)
    return profile(*a[:4]).unionByName(profile(*b[:4]))


def p6_load_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-fitted AUCs of each load against the one before, per column."""
    out = None
    for df, name, load, rules, unit in (_products(spark, sf_dir), _details(spark, sf_dir)):
        part = load_discrimination(df, load, rules, unit).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_ORPHANS = """
WITH parents AS (
  SELECT 'order_details' AS child_table, id AS k, loaded_at AS ts, 1 AS alive FROM products
  UNION SELECT 'employees', id, loaded_at, 1 FROM departments
  UNION SELECT CASE table_name WHEN 'products' THEN 'order_details' ELSE 'employees' END, key_value, deleted_at, 0 FROM tombstones),
spans AS (
  SELECT child_table, k, ts AS a, lead(ts) OVER (PARTITION BY child_table, k ORDER BY ts, alive DESC) AS b, alive FROM parents),
refs AS (
  SELECT 'order_details' AS child_table, order_id AS child_id, product_id AS k, coalesce(ordered_at, loaded_at) AS ts FROM order_details
  UNION ALL SELECT 'employees', id, dept_id, loaded_at FROM employees),
checked AS (
  SELECT r.*, NOT EXISTS (SELECT 1 FROM spans s WHERE s.child_table = r.child_table AND s.k = r.k AND s.alive = 1
                          AND s.a <= r.ts AND (s.b IS NULL OR r.ts < s.b)) AS orphan
  FROM refs r WHERE r.k IS NOT NULL)
"""


def _rule_sql(t: str, c: str, inside: str, number: bool) -> str:
    v = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, load_id, count(*) AS n_cells, count(*) - count({c}) AS n_null,
      CAST(sum(CASE WHEN {c} IS NOT NULL AND NOT ({inside}) THEN 1 ELSE 0 END) AS BIGINT) AS n_outside,
      count(DISTINCT {c}) AS n_distinct, min({v}) AS min_value, max({v}) AS max_value FROM {t} GROUP BY load_id"""


_CELLS = """
cells AS (
  SELECT 'products' AS t, 'price' AS c, load_id AS l, CAST(price AS DOUBLE) AS x, CAST(price AS VARCHAR) AS s, price > 0 AND price <= 50000 AS ok FROM products
  UNION ALL SELECT 'products', 'stock', load_id, stock, CAST(stock AS VARCHAR), stock BETWEEN 0 AND 100000 FROM products
  UNION ALL SELECT 'order_details', 'quantity', load_id, quantity, CAST(quantity AS VARCHAR), quantity BETWEEN 1 AND 500 FROM order_details
  UNION ALL SELECT 'order_details', 'status', load_id, NULL, status, status IN ('Pending', 'Shipped', 'Delivered', 'Cancelled') FROM order_details),
base AS (SELECT t, c, l, count(*) AS n, count(s) AS n_full, count(*) FILTER (s IS NOT NULL AND ok) AS n_in FROM cells GROUP BY ALL),
loads AS (SELECT t, l, lag(l) OVER (PARTITION BY t ORDER BY l) AS p FROM (SELECT DISTINCT t, l FROM cells WHERE l IS NOT NULL)),
meds AS (SELECT t, c, l, CAST(quantile_disc(x, 0.5) AS DECIMAL(24, 6)) AS m FROM cells WHERE ok AND x IS NOT NULL GROUP BY ALL),
top AS (SELECT t, c, l, max(k) AS k FROM (SELECT t, c, l, s, count(*) AS k FROM cells WHERE s IS NOT NULL GROUP BY ALL) GROUP BY ALL),
stat AS (SELECT t, c, l, s, count(*) AS k FROM cells WHERE c = 'status' AND ok GROUP BY ALL),
gaps AS (
  SELECT o.t, o.c, o.l, sum(abs(coalesce(a.k, 0) / b.n_in - coalesce(e.k, 0) / d.n_in)) / 2 AS gap
  FROM (SELECT loads.t, 'status' AS c, loads.l, loads.p, v.s FROM loads, (VALUES ('Pending'), ('Shipped'), ('Delivered'), ('Cancelled')) v(s)
        WHERE loads.t = 'order_details' AND p IS NOT NULL) o
  JOIN base b ON (b.t, b.c, b.l) = (o.t, o.c, o.l) AND b.n_in > 0 JOIN base d ON (d.t, d.c, d.l) = (o.t, o.c, o.p) AND d.n_in > 0
  LEFT JOIN stat a ON (a.l, a.s) = (o.l, o.s) LEFT JOIN stat e ON (e.l, e.s) = (o.p, o.s) GROUP BY ALL)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_orphan_counts": p2_orphan_counts,
    "p5_found": p5_found,
    "p5_totals": p5_totals,
    "p6_found": p6_found,
    "p6_ranked": p6_ranked,
    "p6_profile": p6_profile,
    "p6_load_discrimination": p6_load_discrimination,
}

ORACLE = {
    "p2_found": _ORPHANS + "SELECT DISTINCT child_table, CAST(child_id AS BIGINT) AS child_id FROM checked WHERE orphan",
    "p2_orphan_counts": _ORPHANS
    + """SELECT child_table, date_trunc('month', ts) AS period, count(*) AS n_refs, CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans,
      round(CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS orphan_share FROM checked GROUP BY 1, 2""",
    "p5_found": """SELECT load_id, product_id FROM (
      SELECT load_id, product_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY load_id) AS all_n FROM order_details GROUP BY 1, 2)
      WHERE product_id IS NOT NULL AND n * 100 >= all_n * 6""",
    "p5_totals": """SELECT load_id, product_id, count(*) AS n_rows, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS sum_quantity
      FROM order_details GROUP BY 1, 2""",
    "p6_found": "WITH "
    + _CELLS
    + """SELECT t AS table_name, c AS column_name, l AS load_id, 'nulls' AS check_name FROM base WHERE (n - n_full) * 100 >= n * 8 AND l IS NOT NULL
    UNION ALL SELECT t, c, l, CASE c WHEN 'status' THEN 'pattern' ELSE 'range' END FROM base WHERE n_full > 0 AND (n_full - n_in) * 100 >= n_full * 5 AND l IS NOT NULL
    UNION ALL SELECT t, c, l, 'constant' FROM top JOIN base USING (t, c, l) WHERE k * 100 >= n_full * 60
    UNION ALL SELECT a.t, a.c, a.l, 'shift' FROM meds a JOIN loads o ON (o.t, o.l) = (a.t, a.l) JOIN meds b ON (b.t, b.c, b.l) = (a.t, a.c, o.p)
      WHERE a.m <> b.m AND greatest(a.m, b.m) * 2 >= least(a.m, b.m) * 3
    UNION ALL SELECT t, c, l, 'shift' FROM gaps WHERE gap >= 0.25 - 1e-12""",
    "p6_profile": " UNION ALL ".join(
        (
            _rule_sql("products", "price", "price > 0 AND price <= 50000", True),
            _rule_sql("products", "stock", "stock BETWEEN 0 AND 100000", True),
            _rule_sql("order_details", "quantity", "quantity BETWEEN 1 AND 500", True),
            _rule_sql("order_details", "status", "status IN ('Pending', 'Shipped', 'Delivered', 'Cancelled')", False),
        )
    ),
}
