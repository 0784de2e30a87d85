"""The driver's star-schema tables seen as procurement data.

A line item is an award: the customer buys, the supplier wins, the part is the item. ``bronze`` gives the same
rows as all-text records with the defects planted that silver has to deal with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.functions.text import item_key
from spendloom.functions.values import SERIAL_EPOCH
from spendloom.operators.telemetry import LOG_SCHEMA, with_cost
from spendloom.schema import DATE_COLUMNS, ITEM_TEXT

NO_BREAK_SPACE = " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Line items with buyer, place, winner and item; join sides are left to Spark to size up.

    The buyers are joined with their orders first, so a line item moves twice, narrow: to its order and to its part.
    The part comes last: its texts, the widest columns, don't move on, and the awards of an item lie together.
    """
    at = lambda name: table(spark, sf_dir, name)
    bought = (
        at("orders")
        .join(at("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(at("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(at("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        (at("lineitem") if lineitem is None else lineitem)
        .join(at("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(at("part"), F.col("l_partkey") == F.col("p_partkey"))
    )


def _part_texts() -> dict[str, Column]:
    c = F.col
    return {
        "notice_title": F.concat(c("p_type"), F.lit(" "), c("p_name")),
        "item_name": c("p_name"),
        "item_desc": F.concat(
            c("p_brand"), F.lit(" "), c("p_type"), F.lit(" size "), c("p_size").cast("string")
        ),
        "unspsc_code": c("p_brand"),
        "unspsc_desc": c("p_type"),
    }


def _values() -> dict[str, Column]:
    c = F.col
    price = c("l_extendedprice").cast("decimal(15,2)")
    shipped = c("l_shipdate").cast("date")
    size = (
        F.when(c("s_suppkey") % 10 == 0, F.lit(None).cast("string"))
        .when(c("s_acctbal") < 2500, "Micro")
        .when(c("s_acctbal") < 5000, "Small")
        .when(c("s_acctbal") < 7500, "Medium")
        .otherwise("Large")
    )
    return {
        "government_branch": c("l_returnflag"),
        "classification": c("p_type"),
        "org_group": c("c_mktsegment"),
        "procurement_mode": c("o_orderpriority"),
        "awardee_size": size,
        "quarter": F.concat(
            F.year("l_shipdate").cast("string"), F.lit("-Q"), F.quarter("l_shipdate").cast("string")
        ),
        "agency": c("c_name"),
        "region": c("r_name"),
        "province": c("n_name"),
        "city": F.concat(c("n_name"), F.lit(" City")),
        "contract_amount": (price * (F.lit(1) - c("l_discount").cast("decimal(4,2)"))).cast("decimal(15,2)"),
        "approved_budget": price,
        "item_budget": price,
        "published_date": c("o_orderdate").cast("date"),
        "closing_date": F.date_add(c("o_orderdate").cast("date"), 20),
        "award_published_date": F.date_add(shipped, 1),
        "award_date": shipped,
        "proceed_date": F.date_add(shipped, 5),
        "effectivity_date": F.date_add(shipped, 10),
        "end_date": F.date_add(shipped, 40),
        "awardee": c("s_name"),
        "award_title": F.concat(F.lit("Award of "), c("p_name")),
        **_part_texts(),
        "quantity": c("l_quantity"),
        "line_item_no": c("l_linenumber"),
        "contract_duration": F.lit(30),
        "award_ref": F.concat(
            c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string")
        ),
    }


def awards(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Clean, typed awards with their item id."""
    values = _values()
    key = item_key(*[values[c] for c in ITEM_TEXT])
    return lines(spark, sf_dir, lineitem).select(
        key.alias("item_id"), *[expr.alias(name) for name, expr in values.items()]
    )


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The awards as raw text with planted defects, among them exact copies of rows."""
    key = F.col("l_orderkey")
    values = _values()
    texts = {name: expr.cast("string") for name, expr in values.items()}
    for name in DATE_COLUMNS:
        days = F.datediff(values[name], F.lit(SERIAL_EPOCH).cast("date"))
        texts[name] = days.cast("string")
    texts["award_date"] = F.when(key % 11 == 5, F.concat(texts["award_date"], F.lit(".5"))).otherwise(
        texts["award_date"]
    )
    texts["closing_date"] = F.when(key % 13 == 6, "NULL").otherwise(texts["closing_date"])
    texts["contract_amount"] = (
        F.when(key % 4 == 0, "NULL")
        .when(key % 97 == 1, F.lit(None))
        .when(key % 53 == 2, "0")
        .otherwise(texts["contract_amount"])
    )
    texts["item_budget"] = F.when(key % 5 == 1, "-1").otherwise(texts["item_budget"])
    texts["contract_duration"] = F.when(key % 6 == 1, "0").otherwise(texts["contract_duration"])
    title = texts["notice_title"]
    texts["notice_title"] = (
        F.when(key % 7 == 1, F.concat(F.lit(" "), F.replace(title, F.lit(" "), F.lit("  "))))
        .when(key % 17 == 1, F.concat(F.lit(NO_BREAK_SPACE), title, F.lit(" ")))
        .otherwise(title)
    )
    texts["item_desc"] = F.when(key % 19 == 3, "NULL").otherwise(texts["item_desc"])
    rows = lines(spark, sf_dir, table(spark, sf_dir, "lineitem")).select(key, *[expr.alias(name) for name, expr in texts.items()])
    copies = F.when(key % 10 == 3, 2).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy", "l_orderkey")


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a catalogue item, with the part key."""
    texts = _part_texts()
    key = item_key(*[texts[c] for c in ITEM_TEXT])
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"), *[expr.alias(name) for name, expr in texts.items()], "p_partkey"
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: parts whose texts are equal are one item."""
    first = F.row_number().over(W.partitionBy("item_id").orderBy("p_partkey"))
    items = part_items(spark, sf_dir).withColumn("_rn", first)
    return items.filter("_rn = 1").drop("_rn", "p_partkey")


def _part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items with the vector of their number.

    Merged, as files tell little about the size of the parts' texts: a broadcast of ten MB by its files is nine times
    that on the driver, once for each reading.
    """
    vectors = table(spark, sf_dir, "embeddings")
    return part_items(spark, sf_dir).hint("merge").join(vectors, F.col("p_partkey") == F.col("vec_id"))


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, embedding, label): the vector with a part's number is the vector of its item."""
    joined = _part_vectors(spark, sf_dir)
    return joined.groupBy("item_id").agg(
        F.min_by("embedding", "vec_id").alias("embedding"), F.min_by("label", "vec_id").alias("label")
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per embedding label: text and vector of the label's first item, which is also the target."""
    joined = _part_vectors(spark, sf_dir)
    first = joined.groupBy("label").agg(
        F.min_by(F.struct("notice_title", "embedding", "item_id"), "vec_id").alias("q")
    )
    return first.select(
        F.col("label").cast("bigint").alias("query_id"),
        F.col("q.notice_title").alias("query_text"),
        F.col("q.embedding").alias("query_vector"),
        F.col("q.item_id").alias("target_item_id"),
    )


def query_log(events: DataFrame) -> DataFrame:
    """Events seen as logged queries."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    log = events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("query"),
        F.lit(1).cast("bigint").alias("matched_items_count"),
        F.col("value").alias("total_spend"),
        F.col("value").alias("latency_ms"),
        F.lit(0).alias("used_vector"),
        F.lit(1).alias("used_llm"),
        F.when(F.col("event_type") == "purchase", "thumbs_up")
        .when(F.col("event_type") == "error", "thumbs_down")
        .alias("feedback"),
        tokens.alias("prompt_tokens"),
        (tokens + F.floor("value").cast("bigint")).alias("total_tokens"),
    )
    return with_cost(log).select(*LOG_SCHEMA.fieldNames())


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents seen as graded answers, scores from 1 to 5."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return joined.select(
        "doc_id",
        (1 + 4 * F.col("quality")).alias("faithfulness"),
        (5 - 4 * F.col("toxic")).alias("relevance"),
        (1 + F.col("n_chars") % 5).alias("completeness"),
    )


def logged_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL text per order, good and bad ones, as a query log would hold them."""
    c = F.col
    ref = c("o_orderkey").cast("string")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    shapes = [
        text('SELECT "Region", COUNT(*) FROM gold.all_awards WHERE "Award Reference No." = ', ref, ' GROUP BY "Region"'),
        text("select * from gold.all_awards where quarter = '2025-Q1' limit ", ref, ";"),
        text("DROP TABLE gold.t_", ref),
        text("SELECT 1; DELETE FROM gold.all_awards WHERE 1=", ref, ";"),
        text('with t as (select * from all_awards) select count(*) from t where "Award Date"  like \'1998%\' and 1<', ref),
        text("SELECT REPLACE(Region, 'x', '", ref, "') FROM all_awards"),
        text("  UPDATE gold.all_awards SET Region = '", ref, "'  "),
        text("SELECT * FROM all_awards WHERE award date LIKE '", ref, "%' LIMIT 5 ;"),
        text("INSERT INTO all_awards VALUES ('", ref, "')"),
        text("   ;"),
        text("SELECT COUNT(*)\nFROM all_awards\nWHERE \"Contract Amount\" >", ref),
        text("SELECT java_method('java.lang.System', 'getProperty', '", ref, "') FROM all_awards"),
        text("SELECT COUNT(*) FROM parquet.`/lake/", ref, "`"),
    ]
    pick = F.pmod(c("o_orderkey"), F.lit(len(shapes))).cast("int")
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("log_id"), F.get(F.array(*shapes), pick).alias("sql")
    )
