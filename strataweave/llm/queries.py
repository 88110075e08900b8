"""Queries on the documents and on the tables of people, orders and products (p1, p3, p4, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.heavy_hitters import top_k
from strataweave.llm.mixing import mix
from strataweave.llm.packing import CAPACITY, pack
from strataweave.llm.percentiles import percentiles, value_state
from strataweave.llm.review import THRESHOLD, calibration_table, rates, scores
from strataweave.llm.topn import top_n
from strataweave.sources import table


def _latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The row of each non-null key with the latest ``loaded_at``; rows that tie are identical."""
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("loaded_at", *columns)).alias("row_"))
    return newest.select(key, *(F.col(f"row_.{c}").alias(c) for c in columns))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _latest(table(spark, sf_dir, "employees"), "id", "dept_id", "salary")
    best = top_n(people, "dept_id", "salary", "id", 5)
    known = table(spark, sf_dir, "departments").select(F.col("id").alias("known")).distinct()
    # A department is known as a whole, so it is looked up for the few rows that are left.
    return best.join(known, F.col("dept_id") == F.col("known"), "left_semi").select("dept_id", "id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best paid of every department, known or not, with their rank."""
    return top_n(_latest(table(spark, sf_dir, "employees"), "id", "dept_id", "salary"), "dept_id", "salary", "id", 10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "order_details")
    least = -(-rows.count() // 200)
    # At most 200 values can hold half a percent each.
    return top_k(rows, "product_id", 200, max(1, least)).select(F.col("value").alias("product_id"))


def p3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent products and their counts."""
    return top_k(table(spark, sf_dir, "order_details"), "product_id", 100).withColumnRenamed("value", "product_id")


def _salary_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _latest(table(spark, sf_dir, "employees"), "id", "dept_id", "salary").where("salary > 0 and dept_id is not null")
    state = value_state(people, ["dept_id"], "salary")
    known = table(spark, sf_dir, "departments").select(F.col("id").alias("known")).distinct()
    state = state.join(known, F.col("dept_id") == F.col("known"), "left_semi")
    return state.select(F.lit("employees.salary").alias("field_name"), F.col("dept_id").cast("string").alias("group_key"), "value", "n")


def _price_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = _latest(table(spark, sf_dir, "products"), "id", "category", "price").where("price > 0 and category is not null")
    return value_state(goods, ["category"], "price").select(F.lit("products.price").alias("field_name"), F.col("category").alias("group_key"), "value", "n")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of salaries per department and prices per category."""
    state = _salary_state(spark, sf_dir).unionByName(_price_state(spark, sf_dir))
    return percentiles(state, [1, 10, 25, 50, 75, 90, 99]).withColumn("interpolated", F.round("interpolated", 4))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(_salary_state(spark, sf_dir).unionByName(_price_state(spark, sf_dir)), [10, 50, 90])
    of = lambda p: F.max(F.when(F.col("percent") == p, F.col("lower")))
    wide = found.groupBy("field_name", "group_key").agg(F.max("n_values").alias("n"), of(10).alias("low"), of(50).alias("mid"), of(90).alias("high"))
    return wide.where("n >= 30 and (high * 2 >= mid * 5 or mid * 2 >= low * 5)").select("field_name", "group_key")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes: container, piece and range of tokens."""
    return pack(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only a divided document has a second piece.
    return p7_pack(spark, sf_dir).where("piece = 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens in them, and the least number of containers that could hold them."""
    used = p7_pack(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("length").alias("tokens"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("tokens").alias("n_tokens"),
        F.ceil(F.sum("tokens") / CAPACITY).alias("least_containers"),
        F.max("tokens").alias("most_in_one"),
    )


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and pieces of every document in containers, and how many of these are too full: none may be."""
    packed = p7_pack(spark, sf_dir)
    full = packed.where("container is not null").groupBy("container").agg(F.sum("length").alias("in_it"))
    docs = packed.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count("container").alias("n_pieces"), F.max(F.col("start") + F.col("length")).alias("end_at"))
    over = full.agg(F.count_if(F.col("in_it") > CAPACITY).alias("n_overfull"))
    return docs.join(F.broadcast(over))  # one row


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats, in slots of the mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).chosen


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares


def p8_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source has its share to one document, and uses none more often than allowed."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    mixed = mix(docs, targets)
    uses = mixed.chosen.groupBy("source").agg((F.max("repeat_no") + 1).alias("uses"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id", "repeat_no").alias("n_different"))
    largest = docs.agg(F.max(F.octet_length("text")).alias("largest"))
    goal = F.least(F.col("wanted_tokens"), F.col("available_tokens").cast("double") * F.col("max_repeats"))
    return (
        mixed.shares.join(targets.select("source", "max_repeats"), "source")
        .join(uses, "source", "left")
        .join(F.broadcast(largest))  # one row
        .select(
            "source", "available_tokens", F.round("wanted_tokens", 3).alias("wanted_tokens"), "is_short",
            ((F.col("used_tokens") >= goal - 1e-3) & (F.col("used_tokens") - goal <= F.col("largest"))).alias("share_kept"),
            (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), (F.coalesce("n", F.lit(0)) == F.coalesce("n_different", F.lit(0))).alias("all_different"),
        )
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where("is_short").select("source")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, likely verdict and evidence of every document."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), table(spark, sf_dir, "term_list"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and flagged documents per source."""
    return rates(p9_scores(spark, sf_dir))


def p9_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of labelled documents, without their own labels, against the share of positive ones."""
    return calibration_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), table(spark, sf_dir, "term_list"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


_PEOPLE = """
people AS (SELECT id, dept_id, salary FROM employees WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
goods AS (SELECT id, category, price FROM products WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)
"""
_GROUPS = (
    _PEOPLE
    + """,
vals AS (
  SELECT 'employees.salary' AS field_name, CAST(dept_id AS VARCHAR) AS group_key, salary AS v FROM people
  WHERE salary > 0 AND dept_id IN (SELECT id FROM departments)
  UNION ALL SELECT 'products.price', category, price FROM goods WHERE price > 0 AND category IS NOT NULL)
"""
)

QUERIES = {
    "p1_found": p1_found,
    "p1_ranked": p1_ranked,
    "p3_found": p3_found,
    "p3_top_products": p3_top_products,
    "p4_found": p4_found,
    "p4_percentiles": p4_percentiles,
    "p7_found": p7_found,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p7_documents": p7_documents,
    "p8_reached": p8_reached,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
    "p9_calibration": p9_calibration,
}

ORACLE = {
    "p1_found": "WITH "
    + _PEOPLE
    + """SELECT dept_id, id FROM people WHERE salary IS NOT NULL AND dept_id IN (SELECT id FROM departments)
      QUALIFY row_number() OVER (PARTITION BY dept_id ORDER BY salary DESC, id) <= 5""",
    "p1_ranked": "WITH "
    + _PEOPLE
    + """SELECT dept_id, id, salary, CAST(row_number() OVER (PARTITION BY dept_id ORDER BY salary DESC, id) AS INT) AS rank
      FROM people WHERE salary IS NOT NULL AND dept_id IS NOT NULL QUALIFY rank <= 10""",
    "p3_found": """SELECT product_id FROM order_details WHERE product_id IS NOT NULL GROUP BY 1
      HAVING count(*) * 200 >= (SELECT count(*) FROM order_details)""",
    "p3_top_products": """SELECT product_id, count(*) AS n_rows FROM order_details WHERE product_id IS NOT NULL
      GROUP BY 1 ORDER BY n_rows DESC, product_id LIMIT 100""",
    "p4_found": "WITH "
    + _GROUPS
    + """, q AS (SELECT field_name, group_key, count(*) AS n, quantile_disc(v, 0.1) AS a, quantile_disc(v, 0.5) AS m, quantile_disc(v, 0.9) AS b FROM vals GROUP BY 1, 2)
      SELECT field_name, group_key FROM q WHERE n >= 30 AND (b * 2 >= m * 5 OR m * 2 >= a * 5)""",
    "p4_percentiles": "WITH "
    + _GROUPS
    + ", q AS (SELECT field_name, group_key, count(*) AS n_values, unnest([1, 10, 25, 50, 75, 90, 99]) AS percent,"
    + " unnest(quantile_disc(v, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])) AS lower,"
    + " unnest(quantile_cont(CAST(v AS DOUBLE), [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])) AS i FROM vals GROUP BY 1, 2)"
    + " SELECT field_name, group_key, percent, n_values, lower, round(i, 4) AS interpolated FROM q",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
    "p7_documents": """SELECT doc_id, coalesce(strlen(text), 0) AS tokens, (coalesce(strlen(text), 0) + 8191) // 8192 AS n_pieces, coalesce(strlen(text), 0) AS end_at,
      CAST(0 AS BIGINT) AS n_overfull FROM documents""",
    "p8_reached": """SELECT t.source, CAST(coalesce(d.n, 0) AS BIGINT) AS available_tokens, round(t.target_share * a.n, 3) AS wanted_tokens,
      coalesce(d.n, 0) * t.max_repeats < t.target_share * a.n AS is_short, true AS share_kept, true AS repeats_kept, true AS all_different
      FROM mix_targets t LEFT JOIN (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1) d ON lower(trim(t.source)) = d.source,
      (SELECT sum(strlen(text)) AS n FROM documents) a""",
    "p8_found": """SELECT t.source FROM mix_targets t LEFT JOIN (
        SELECT lower(trim(source)) AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1) d ON lower(trim(t.source)) = d.source
      WHERE coalesce(d.n, 0) * t.max_repeats < t.target_share * (SELECT sum(strlen(text)) FROM documents)""",
}
