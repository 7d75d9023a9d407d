"""The model tables as lazy views of the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Microseconds since the start of the event clock; both ends are wall-clock times, so the
# session time zone does not matter.
_EVENT_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
_ORDER_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _place() -> list:
    return [
        F.expr("vec_id div 100").alias("measu"),
        (F.col("vec_id") % 10).cast("int").alias("x"),
        F.expr("(vec_id div 10) % 10").cast("int").alias("y"),
    ]


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """First wavelength: recordings of 10 x 10 pixels, one trace per embedding."""
    values = F.transform("embedding", lambda e: 1000 + 100 * e.cast("double"))
    return table(spark, sf, "embeddings").select(*_place(), values.alias("trace"))


def traces2(spark: SparkSession, sf: str) -> DataFrame:
    """Second wavelength of the same pixels."""
    values = F.transform(F.reverse("embedding"), lambda e: 800 + 50 * e.cast("double"))
    return table(spark, sf, "embeddings").select(*_place(), values.alias("trace"))


def area(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("label % 3 <> 0").select(*_place())


def roi_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Per-recording region membership: the embedding label is the region."""
    roi = F.concat(F.lit("r"), F.col("label").cast("string")).alias("roi")
    return table(spark, sf, "embeddings").select(F.expr("vec_id div 100").alias("measu"), roi, *_place()[1:])


def stimuli(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases are pulses; ``stim_idx`` (the event number) is their order of entry."""
    start = F.expr(_EVENT_US) / F.lit(200000000.0)
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("measu"),
            F.col("event_id").cast("int").alias("stim_idx"),
            F.get_json_object("props", "$.k").alias("odor"),
            F.col("value").alias("conc"),
            start.alias("on_ms"),
            (start + F.col("value") * 10).alias("off_ms"),
            F.lit(200.0).alias("period_ms"),
        )
    )


def clock(spark: SparkSession, sf: str) -> DataFrame:
    """Frame clock: one row per view event, with its time on the pulse axis."""
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type") == "view")
        .select(
            "event_id",
            F.col("user_id").alias("measu"),
            (F.expr(_EVENT_US) / F.lit(200000000.0)).alias("t_ms"),
        )
    )


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("animal"),
        F.col("o_orderkey").alias("measu"),
        F.col("o_orderpriority").alias("label"),
        F.when(status == "F", 1).when(status == "O", 0).otherwise(-1).alias("analyze"),
        (100 + 50 * (F.col("o_orderkey") % 5)).cast("double").alias("cycle"),
        (F.expr(_ORDER_US) / F.lit(1000000.0)).alias("utc"),
        F.col("o_totalprice").alias("price"),
    )
