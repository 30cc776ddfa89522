"""The driver's tables as books, units, mentions and edges: a year of orders is a book, a quarter a chapter, an order a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronokg.operators.positions import in_book


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, book_number, chapter, chunk_index, relative_position), a row per order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("unit_id"), (F.year("o_orderdate") - 1994).alias("book_number"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("chapter"), "o_orderdate",
    )
    return in_book(orders, "book_number", ["o_orderdate", "unit_id"]).drop("o_orderdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their book and chapter; ``ord`` is a mention's place in the scan."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") - 1994).alias("book_number"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("chapter"), "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entity mentions per order line: its part and its supplier."""
    both = F.explode(
        F.array(
            F.struct(F.concat(F.lit("part:"), "l_partkey").alias("name"), F.col("l_returnflag").alias("type"), F.concat(F.lit("qty "), F.col("l_quantity").cast("int")).alias("description"), F.lit(0).alias("side")),
            F.struct(F.concat(F.lit("supp:"), "l_suppkey").alias("name"), F.col("l_linestatus").alias("type"), F.lit("").alias("description"), F.lit(1).alias("side")),
        )
    )
    return lines(spark, sf_dir).select("book_number", "chapter", F.col("l_orderkey").alias("unit_id"), F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), both.alias("m")).select("book_number", "chapter", "unit_id", F.struct("at", "m.side").alias("ord"), "m.name", "m.type", "m.description")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge mention from part to supplier per order line."""
    return lines(spark, sf_dir).select(
        F.concat(F.lit("part:"), "l_partkey").alias("source"), F.concat(F.lit("supp:"), "l_suppkey").alias("target"), "book_number", "chapter", F.col("l_returnflag").alias("type"),
        (1 + F.col("l_quantity").cast("int") % 10).alias("strength"), F.concat(F.lit("qty "), F.col("l_quantity").cast("int")).alias("description"), F.col("l_orderkey").alias("unit_id"), F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )


def user_mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entity, edge) mentions of events: a user is a book, an ISO week a chapter, an event a unit; an edge goes to the user's next event type, which may not have been seen."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.weekofyear("ts").cast("string").alias("chapter"), F.row_number().over(order).alias("unit_ord"), F.lead("event_type").over(order).alias("next_type"))
    entities = events.select(F.col("event_type").alias("name"), F.col("user_id").alias("book_number"), "chapter", "unit_ord")
    return entities, events.where("next_type is not null").select(F.col("event_type").alias("source"), F.col("next_type").alias("target"), F.col("user_id").alias("book_number"), "chapter", "unit_ord", F.col("event_id").alias("unit_id"))
