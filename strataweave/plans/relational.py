"""Filters, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions.predicates import condition
from strataweave.operators import aggregates as A
from strataweave.operators import joins as J
from strataweave.plans.registry import Plans, Tables

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
add = plans.add
col = F.col


def n_rows():
    return F.count(F.lit(1))



def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["revenue_by_segment"](spark, sf_dir)


@add(
    "revenue_by_segment",
    """SELECT c_mktsegment AS segment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_items
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY revenue DESC LIMIT 10""",
)
def _(t: Tables):
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return (
        t.lineitem.join(o, col("l_orderkey") == col("o_orderkey"))
        .join(t.part.select("p_partkey"), col("l_partkey") == col("p_partkey"))
        .join(t.customer, col("o_custkey") == col("c_custkey"))
        .groupBy(col("c_mktsegment").alias("segment"))
        .agg(F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 2).alias("revenue"), n_rows().alias("n_items"))
        .orderBy(col("revenue").desc())
        .limit(10)
    )


# Scans


@add("scan_project", "SELECT o_orderkey, O_TOTALPRICE AS total, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey")
def _(t):
    return t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", col("O_TOTALPRICE").alias("total"), "o_orderdate").orderBy("o_orderkey")


@add("select_star", "SELECT * FROM nation")
def _(t):
    return t.nation.select("*")


@add("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
def _(t):
    return t.orders.where(col("o_orderkey") == 42)


@add("range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 250 ORDER BY o_orderkey")
def _(t):
    return t.orders.where(col("o_orderkey").between(100, 250)).select("o_orderkey", "o_custkey").orderBy("o_orderkey")


@add("ndim_range", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 1000 AND 1500 AND p_partkey BETWEEN 1 AND 100000")
def _(t):
    return t.part.where(col("p_size").between(10, 20) & col("p_retailprice").between(1000, 1500) & col("p_partkey").between(1, 100000)).select("p_partkey", "p_size", "p_retailprice")


@add("scan_with_keys", "SELECT CAST(c_custkey AS VARCHAR) || '|' || c_name AS row_key, c_acctbal FROM customer")
def _(t):
    return t.customer.select(F.concat_ws("|", col("c_custkey").cast("string"), "c_name").alias("row_key"), "c_acctbal")


@add("postings", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))


@add("values_source", "SELECT id, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
def _(t):
    return t.sql("SELECT id, name FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(id, name)")


@add("table_sample")
def _(t):
    return t.orders.sample(0.1, seed=7)


@add("rand_rows")
def _(t):
    return t.customer.orderBy(F.rand(3)).limit(10).select("c_custkey", F.rand(5).alias("u"))


# Predicates


@add("filter_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderstatus != 'P' AND o_custkey < 1000")
def _(t):
    return t.orders.where((col("o_totalprice") > 100000) & (col("o_totalprice") <= 200000) & (col("o_orderstatus") != "P") & (col("o_custkey") < 1000)).select("o_orderkey")


@add("filter_or_nested", "SELECT p_partkey FROM part WHERE p_size < 5 OR (p_brand = 'Brand#11' AND NOT (p_retailprice < 1200))")
def _(t):
    tree = {
        "operator": "OR",
        "operands": [
            {"column": "p_size", "operator": "<", "value": 5},
            {"operator": "AND", "operands": [{"column": "p_brand", "operator": "=", "value": "Brand#11"}, {"operator": "NOT", "operands": [{"column": "p_retailprice", "operator": "<", "value": 1200}]}]},
        ],
    }
    return t.part.where(condition(tree)).select("p_partkey")


@add(
    "filter_like_in_between_null",
    """SELECT id, name, dept_id FROM employees WHERE name LIKE '%a%' AND (dept_id IN (1, 2, 3, 5) OR salary BETWEEN 50000 AND 52000 OR salary IS NULL) AND name IS NOT NULL""",
)
def _(t):
    return t.employees.where(col("name").like("%a%") & (col("dept_id").isin(1, 2, 3, 5) | col("salary").between(50000, 52000) | col("salary").isNull()) & col("name").isNotNull()).select("id", "name", "dept_id")


@add("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000").select("o_custkey"), col("c_custkey") == col("o_custkey"), "left_semi").select("c_custkey")


@add("not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return J.not_in(t.orders, t.lineitem, ("o_orderkey", "l_orderkey")).select("o_orderkey")


@add("exists_corr", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_discount > 0.09)")
def _(t):
    return t.sql("SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_discount > 0.09)", "supplier", "lineitem")


@add("scalar_subquery", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def _(t):
    return t.sql("SELECT o_orderkey, (SELECT count(*) FROM {lineitem} WHERE l_orderkey = o_orderkey) AS n_items FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})", "orders", "lineitem")


@add("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(col("p_size") < 10, "small").when(col("p_size") < 30, "medium").otherwise("large").alias("size_class"))


@add("computed_projection", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity / 2 AS half FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.round(col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax")), 6).alias("charge"), (col("l_quantity") / 2).alias("half"))


@add("derived_table", "SELECT seg, max(n) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey AS k, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) a GROUP BY 1, 2) b GROUP BY seg")
def _(t):
    return t.customer.where("c_acctbal > 0").groupBy(col("c_mktsegment").alias("seg"), "c_nationkey").agg(n_rows().alias("n")).groupBy("seg").agg(F.max("n").alias("most"))


_CTE = """WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM {orders} GROUP BY 1),
    big AS (SELECT k, s FROM spent WHERE s > (SELECT avg(s) FROM spent))
    SELECT c_mktsegment AS segment, count(*) AS n FROM big JOIN {customer} ON c_custkey = k GROUP BY 1"""


@add("cte_multi", _CTE.replace("{", "").replace("}", ""))
def _(t):
    return t.sql(_CTE, "orders", "customer")


_TREE = """WITH RECURSIVE tree(id, boss, depth) AS (
    SELECT p_partkey, CAST(NULL AS BIGINT), 0 FROM {part} WHERE p_partkey = 1
    UNION ALL SELECT p_partkey, p_partkey div 3, depth + 1 FROM {part} JOIN tree ON p_partkey div 3 = id WHERE p_partkey > 1)
    SELECT depth, count(*) AS n, sum(id) AS s FROM tree GROUP BY depth"""


@add("recursive_hierarchy", _TREE.replace("{", "").replace("}", "").replace("p_partkey div 3", "p_partkey // 3").replace("sum(id)", "CAST(sum(id) AS BIGINT)"))
def _(t):
    return t.sql(_TREE, "part")


@add("quoted_names", 'SELECT n_name AS "näme with blank" FROM nation -- a comment')
def _(t):
    return t.sql("SELECT n_name AS `näme with blank` FROM {nation} -- a comment", "nation")


# Joins

_IN = "SELECT c_custkey, c_name, o_orderkey FROM customer {how} JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON o_custkey = c_custkey{more}"


def _join(how: str, algorithm: str = "AUTO"):
    def run(t: Tables):
        big = t.orders.where("o_totalprice > 250000")
        return J.equi_join(t.customer, big, [("c_custkey", "o_custkey")], how, algorithm).select("c_custkey", "c_name", "o_orderkey")

    return run


for _name, _how, _sql in (("inner", "inner", "INNER"), ("left", "left", "LEFT"), ("right", "right", "RIGHT"), ("full", "full", "FULL")):
    add(f"join_{_name}", _IN.format(how=_sql, more=""))(_join(_how))
for _name in ("hash", "merge", "nested_loop", "index"):
    add(f"join_hint_{_name}", _IN.format(how="INNER", more=""))(_join("inner", _name))


@add("join_null_keys", "SELECT e.id, d.name FROM employees e LEFT JOIN departments d ON e.dept_id = d.id WHERE e.salary IS NULL")
def _(t):
    return t.employees.where("salary is null").join(t.departments.select(col("id").alias("d_id"), "name").withColumnRenamed("name", "d_name"), col("dept_id") == col("d_id"), "left").select("id", col("d_name").alias("name"))


@add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    # Two tables of fixed size: regions and nations.
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@add("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(t):
    return J.equi_join(t.orders, t.lineitem.where("l_returnflag = 'R'"), [("o_orderkey", "l_orderkey")], "left_semi").select("o_orderkey")


@add("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return J.equi_join(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], "left_anti").select("o_orderkey")


@add("join_theta", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_nationkey AND n_nationkey < r_regionkey * 4")
def _(t):
    return t.region.join(t.nation, (col("r_regionkey") < col("n_nationkey")) & (col("n_nationkey") < col("r_regionkey") * 4)).select("r_regionkey", "n_nationkey")


@add("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))).select(col("a.n_name").alias("a"), col("b.n_name").alias("b"))


@add(
    "join_multiway",
    """SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""",
)
def _(t):
    return (
        t.orders.join(t.customer, col("o_custkey") == col("c_custkey"))
        .join(t.nation, col("c_nationkey") == col("n_nationkey"))
        .join(t.region, col("n_regionkey") == col("r_regionkey"))
        .groupBy("r_name")
        .agg(n_rows().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@add(
    "join_lateral_top1",
    "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x",
)
def _(t):
    return J.top_per_key(t.customer, t.orders, ("c_custkey", "o_custkey"), [col("o_totalprice").desc(), col("o_orderkey")]).select("c_custkey", "o_orderkey")


@add("join_name_clash", "SELECT e.id, d.id AS right_id, e.name, d.name AS right_name FROM employees e JOIN departments d ON e.dept_id = d.id")
def _(t):
    return J.equi_join(t.employees, t.departments, [("dept_id", "id")]).select("id", "right_id", "name", "right_name")


@add(
    "asof_join",
    """SELECT o_orderkey, price_ts, price FROM (SELECT o_orderkey, o_orderdate, o_custkey % 5 AS k FROM orders) o
    ASOF LEFT JOIN (SELECT ts AS price_ts, user_id % 5 AS k, max(value) AS price FROM events GROUP BY ALL) e ON o.k = e.k AND o.o_orderdate + INTERVAL 20 YEAR >= e.price_ts""",
)
def _(t):
    orders = t.orders.select("o_orderkey", (col("o_orderdate") + F.expr("INTERVAL 20 YEAR")).alias("at"), (col("o_custkey") % 5).alias("k"))
    prices = t.events.groupBy(col("ts").alias("price_ts"), (col("user_id") % 5).alias("k")).agg(F.max("value").alias("price"))
    return J.asof_join(orders, prices, ["k"], "at", "price_ts", ["price_ts", "price"]).select("o_orderkey", "price_ts", "price")


@add("range_lookup", "SELECT p_partkey, start_at FROM part ASOF LEFT JOIN (SELECT s_suppkey * 37 AS start_at FROM supplier) ON p_partkey >= start_at")
def _(t):
    return J.range_lookup(t.part.select("p_partkey"), "p_partkey", t.supplier.select((col("s_suppkey") * 37).alias("start_at")), "start_at", ["start_at"])


@add("range_lookup_ties", "SELECT l_orderkey, l_linenumber, start_at, s_name FROM lineitem ASOF LEFT JOIN (SELECT s_suppkey % 13 AS start_at, max(s_name) AS s_name FROM supplier GROUP BY 1) ON CAST(l_quantity AS BIGINT) >= start_at + 5")
def _(t):
    """Few places with many rows each."""
    starts = t.supplier.select((col("s_suppkey") % 13 + 5).alias("at_5"), (col("s_suppkey") % 13).alias("start_at"), "s_name")
    points = t.lineitem.select("l_orderkey", "l_linenumber", col("l_quantity").cast("long").alias("q"))
    return J.range_lookup(points, "q", starts, "at_5", ["start_at", "s_name"]).select("l_orderkey", "l_linenumber", "start_at", "s_name")


@add("interval_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_suppkey * 20 AND p_retailprice < s_suppkey * 20 + 30")
def _(t):
    ranges = t.supplier.select("s_suppkey", (col("s_suppkey") * 20.0).alias("low"), (col("s_suppkey") * 20.0 + 30).alias("high"))
    return J.interval_join(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", ranges, "low", "high", 30.0).select("p_partkey", "s_suppkey")


# Aggregates


@add(
    "agg_global",
    "SELECT count(*) AS n, count(salary) AS n_paid, sum(salary) AS total, round(avg(salary), 4) AS mean, min(salary) AS low, max(salary) AS high FROM employees",
)
def _(t):
    a = A.aggregate(t.employees, [("COUNT", "*", "n"), ("COUNT", "salary", "n_paid"), ("SUM", "salary", "total"), ("AVG", "salary", "mean"), ("MIN", "salary", "low"), ("MAX", "salary", "high")])
    return a.withColumn("mean", F.round(col("mean").cast("double"), 4))


@add("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0")
def _(t):
    return A.aggregate(t.orders.where("o_orderkey < 0"), [("COUNT", "*", "n"), ("SUM", "o_totalprice", "total")])


@add("agg_gcd", "SELECT stock_class, list_reduce(list(DISTINCT abs(stock)), lambda a, b: gcd(a, b)) AS g FROM (SELECT category AS stock_class, CAST(stock AS BIGINT) * 6 AS stock FROM products WHERE stock IS NOT NULL) GROUP BY 1")
def _(t):
    stock = t.products.where("stock is not null").select(col("category").alias("stock_class"), (col("stock").cast("long") * 6).alias("v"))
    return A.gcd_by(stock, ["stock_class"], "v", "g")


@add("agg_median_stddev", "SELECT c_mktsegment AS segment, round(median(c_acctbal), 4) AS mid, round(stddev_samp(c_acctbal), 4) AS dev FROM customer GROUP BY 1")
def _(t):
    a = A.aggregate(t.customer, [("MEDIAN", "c_acctbal", "mid"), ("STDEV", "c_acctbal", "dev")], ["c_mktsegment"])
    return a.select(col("c_mktsegment").alias("segment"), F.round("mid", 4).alias("mid"), F.round("dev", 4).alias("dev"))


@add("count_distinct", "SELECT count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderstatus) AS n_status FROM orders")
def _(t):
    return A.aggregate(t.orders, [("COUNT_DISTINCT", "o_custkey", "n_customers"), ("COUNT_DISTINCT", "o_orderstatus", "n_status")])


@add("approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, true AS close FROM lineitem GROUP BY 1")
def _(t):
    """Exact and approximate distinct values side by side; the error of the sketch is about 5 %."""
    both = A.aggregate(t.lineitem, [("APPROX_COUNT_DISTINCT", "l_partkey", "about"), ("COUNT_DISTINCT", "l_partkey", "n_parts")], ["l_returnflag"])
    return both.select("l_returnflag", "n_parts", (F.abs(col("about") / col("n_parts") - 1) < 0.15).alias("close"))


@add(
    "group_having",
    "SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2 HAVING count(*) > 3 ORDER BY total DESC, o_custkey LIMIT 50",
)
def _(t):
    g = A.aggregate(t.orders, [("COUNT", "*", "n"), ("SUM", "o_totalprice", "total")], ["o_custkey", "o_orderstatus"], having=col("n") > 3)
    return g.withColumn("total", F.round("total", 2)).orderBy(col("total").desc(), "o_custkey").limit(50)


@add("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def _(t):
    return (
        t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 2).alias("sum_disc"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            n_rows().alias("n"),
        )
    )


@add("distinct_single", "SELECT DISTINCT category FROM products ORDER BY category NULLS LAST")
def _(t):
    return t.products.select("category").distinct().orderBy(col("category").asc_nulls_last())


@add("distinct_multi", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@add(
    "pivot_conditional",
    """SELECT c_mktsegment AS segment, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o,
    sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def _(t):
    p = t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).groupBy(col("c_mktsegment").alias("segment")).pivot("o_orderstatus", ["F", "O", "P"]).agg(n_rows())
    return p.select("segment", *(F.coalesce(col(x), F.lit(0)).alias(x.lower()) for x in "FOP"))


@add("monthly_revenue", "SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(n_rows().alias("n"))


@add("array_agg", "SELECT c_nationkey, list_sort(list(c_custkey)) AS keys FROM customer WHERE c_acctbal > 9000 GROUP BY 1")
def _(t):
    return A.aggregate(t.customer.where("c_acctbal > 9000"), [("ARRAY_AGG", "c_custkey", "keys")], ["c_nationkey"])


@add("group_json", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(n_rows().alias("n"), F.round(F.avg("value"), 8).alias("mean"))


for _name, _sql, _f in (
    ("cube", "CUBE (o_orderstatus, o_orderpriority)", lambda o: o.cube("o_orderstatus", "o_orderpriority")),
    ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)", lambda o: o.rollup("o_orderstatus", "o_orderpriority")),
    ("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority))", lambda o: o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")),
):
    add(f"agg_{_name}", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {_sql}")(lambda t, f=_f: f(t.orders).agg(n_rows().alias("n")).select("o_orderstatus", "o_orderpriority", "n"))


# Statistics


@add(
    "col_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_length FROM products"
        for c in ("id", "category", "stock")
    ),
)
def _(t):
    return A.column_stats(t.products, ["id", "category", "stock"]).withColumn("avg_length", F.round("avg_length", 6))


@add("most_common", "SELECT status AS value, count(*) AS n FROM order_details WHERE status IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _(t):
    return A.most_common(t.order_details, "status", 10)


@add(
    "hist_topk_other",
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS bucket, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
    SELECT bucket, n FROM c WHERE r <= 8 UNION ALL SELECT 'OTHER', CAST(sum(n) AS BIGINT) FROM c WHERE r > 8 HAVING sum(n) > 0""",
)
def _(t):
    return A.frequency_histogram(t.events, "user_id", 8)


@add(
    "hist_equi_height",
    """SELECT CAST(b AS INT) AS bucket, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n, count(DISTINCT o_totalprice) AS n_distinct
    FROM (SELECT o_totalprice, ntile(16) OVER (ORDER BY o_totalprice) AS b FROM orders) GROUP BY 1""",
)
def _(t):
    return A.equi_height_histogram(t.orders, "o_totalprice", 16)


@add(
    "hist_equi_width",
    """SELECT CAST(CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 12 ELSE floor((c_acctbal + 1000) / 1000) + 1 END AS INT) AS bucket, count(*) AS n FROM customer GROUP BY 1""",
)
def _(t):
    return A.equi_width_histogram(t.customer, "c_acctbal", -1000, 10000, 11)


@add(
    "corr_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))),
)
def _(t):
    return A.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@add(
    "join_estimate",
    """SELECT n_left, n_right, d_left, d_right, CAST(n_left AS DOUBLE) * n_right / greatest(d_left, d_right, 1) AS estimate FROM
    (SELECT count(o_orderkey) AS n_left, count(DISTINCT o_orderkey) AS d_left FROM orders), (SELECT count(l_orderkey) AS n_right, count(DISTINCT l_orderkey) AS d_right FROM lineitem)""",
)
def _(t):
    return A.join_cardinality(t.orders, t.lineitem, ("o_orderkey", "l_orderkey"), "exact")


@add(
    "filter_estimate",
    """SELECT 'equal' AS kind, count(*) AS n_rows, round(1.0 / count(DISTINCT p_size), 9) AS selectivity FROM part
    UNION ALL SELECT 'above', count(*), round((max(o_totalprice) - 200000) / (max(o_totalprice) - min(o_totalprice)), 9) FROM orders""",
)
def _(t):
    equal, above = A.filter_estimate(t.part, "p_size", "=", 7, "exact"), A.filter_estimate(t.orders, "o_totalprice", ">", 200000.0, "exact")
    both = equal.withColumn("kind", F.lit("equal")).unionByName(above.withColumn("kind", F.lit("above")))
    return both.select("kind", "n_rows", F.round("selectivity", 9).alias("selectivity"))


@add("rand_range", "SELECT CAST(1000 AS BIGINT) AS n, true AS inside, true AS spread, least(count(*), 25) AS n_rows FROM customer")
def _(t):
    """RAND(n, low, high) and n random rows; what any draw must be like."""
    v = A.random_values(t.spark, 1000, 1, 100, 11).agg(n_rows().alias("n"), ((F.min("value") >= 1) & (F.max("value") < 100)).alias("inside"), F.avg("value").between(40, 61).alias("spread"))
    some = A.random_rows(t.customer.select("c_custkey"), 25, 3).agg(F.countDistinct("c_custkey").alias("n_rows"))
    return v.join(F.broadcast(some))  # one row each


@add(
    "trailing_summary",
    """SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high
    FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE GROUP BY 1""",
)
def _(t):
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.join(F.broadcast(last), col("ts") > col("last") - F.expr("INTERVAL 60 MINUTE"))  # one row
    return recent.groupBy("event_type").agg(n_rows().alias("n"), F.sum(F.when(col("value") > 50, 1).otherwise(0)).alias("n_high"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


# Windows


def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")



@add(
    "win_row_rank_dense",
    """SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr FROM (SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal / 1000) AS INT) AS b FROM customer)
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY b, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY b)""",
)
def _(t):
    c = t.customer.select("c_custkey", "c_nationkey", F.floor(col("c_acctbal") / 1000).alias("b"))
    w, v = Window.partitionBy("c_nationkey").orderBy("b", "c_custkey"), Window.partitionBy("c_nationkey").orderBy("b")
    return c.select("c_custkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"))


@add("win_agg_partition", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS mean, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("mean"), F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@add("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t):
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(_by_customer()).alias("before"), F.lead("o_orderkey", 2).over(_by_customer()).alias("after"))


@add(
    "win_frame_moving_avg",
    """SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(_by_customer().rowsBetween(-2, 0)), 4).alias("moving"))


@add(
    "win_range_frame",
    "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near FROM supplier",
)
def _(t):
    return t.supplier.select("s_suppkey", n_rows().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey").rangeBetween(-20, 20)).alias("near"))


@add("topk_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(col("o_totalprice").desc(), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey")


# Sorting and limits


@add("order_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey")
def _(t):
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy(col("p_brand").desc(), "p_size", "p_partkey")


@add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 100")
def _(t):
    return t.orders.orderBy(col("o_totalprice").desc(), "o_orderkey").offset(100).limit(20).select("o_orderkey")


@add("top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(col("c_acctbal").desc(), "c_custkey").limit(10)


@add("order_nulls", "SELECT id, salary FROM employees ORDER BY salary ASC NULLS FIRST, id, loaded_at")
def _(t):
    return t.employees.orderBy(col("salary").asc_nulls_first(), "id", "loaded_at").select("id", "salary")


@add("order_natural", """SELECT name FROM (SELECT DISTINCT trim(name) AS name FROM departments) ORDER BY name IS NOT NULL, TRY_CAST(name AS DOUBLE) IS NULL, TRY_CAST(name AS DOUBLE), lower(name)""")
def _(t):
    from strataweave.functions.text import natural_order

    names = t.departments.select(F.trim("name").alias("name")).distinct()
    return names.orderBy(*natural_order(col("name")))


@add("sort_positions", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS place FROM customer")
def _(t):
    return A.with_positions(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "place")


# Set operations

_A = "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000"
_B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'"


def _sets(t):
    return t.orders.where("o_totalprice > 200000").select(col("o_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(col("o_custkey").alias("k"))


for _name, _word, _f in (
    ("union", "UNION", lambda a, b: a.union(b).distinct()),
    ("union_all", "UNION ALL", lambda a, b: a.union(b)),
    ("intersect", "INTERSECT", lambda a, b: a.intersect(b)),
    ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    ("except", "EXCEPT", lambda a, b: a.subtract(b)),
    ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
):
    add(f"set_{_name}", f"{_A} {_word} {_B}")(lambda t, f=_f: f(*_sets(t)))


@add("set_nested", f"({_A} UNION {_B}) EXCEPT (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    a, b = _sets(t)
    return a.union(b).distinct().subtract(t.customer.where("c_acctbal < 0").select("c_custkey"))
