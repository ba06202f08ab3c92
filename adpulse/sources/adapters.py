"""Deterministic adapters from the driver's TPC-H-style tables to our sources.

The driver ships no advertising data, so facts and dimensions are derived
from ``lineitem``, ``events``, ``supplier`` and ``part`` by fixed rules
(FIXTURES.md section 2).  Every adapter is a lazy DataFrame over the whole
input table; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _campaign_of(key) -> F.Column:
    return F.concat(F.lit("CMP"), F.lpad((key % 10).cast("string"), 3, "0"))


def ads_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Ad-performance extract; ``_load_seq`` stands in for load recency."""
    li = lineitem
    qty = F.col("l_quantity").cast("long")
    camp = _campaign_of(F.col("l_suppkey"))
    return li.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_linenumber").cast("int").alias("hour"),
        camp.alias("campaign_id"),
        F.when(F.col("l_partkey") % 331 == 0, F.lit("CMP999_AG99"))
        .otherwise(F.concat(camp, F.lit("_AG0"), (F.col("l_partkey") % 3).cast("string")))
        .alias("adgroup_id"),
        F.when(F.col("l_returnflag") == "A", "Google Ads")
        .when(F.col("l_returnflag") == "N", "Facebook Ads")
        .otherwise("TikTok Ads")
        .alias("channel"),
        (qty * 100).alias("impressions"),
        (qty * (F.col("l_partkey") % 5)).alias("clicks"),
        F.when(F.col("l_orderkey") % 200 == 0, -F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice"))
        .alias("spend"),
        (qty * (F.col("l_partkey") % 5) * (F.col("l_linenumber") % 3)).alias("conversions"),
        (F.col("l_extendedprice") * (F.col("l_linenumber") % 4)).alias("revenue"),
        F.col("l_orderkey").alias("_load_seq"),
    )


def ga_from_events(events: DataFrame) -> DataFrame:
    """Web-analytics event extract."""
    d = F.col("ts").cast("date")
    uid_mod = F.col("user_id") % 4
    return events.select(
        d.alias("date"),
        F.hour("ts").cast("int").alias("hour"),
        F.when(F.col("event_type") == "signup", "sign_up")
        .when(F.col("event_type") == "view", "page_view")
        .otherwise(F.col("event_type"))
        .alias("event_name"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("S"), F.col("user_id").cast("string"), F.lit("_"), d.cast("string")))
        .alias("session_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("/p"), (F.col("event_id") % 11).cast("string")).alias("page"),
        F.when(uid_mod == 0, "google").when(uid_mod == 1, "facebook").when(uid_mod == 2, "tiktok")
        .alias("source"),
        F.when(uid_mod == 3, F.lit(None).cast("string")).otherwise(F.lit("cpc")).alias("medium"),
        F.when((uid_mod == 3) | (F.col("event_id") % 20 == 0), F.lit(None).cast("string"))
        .otherwise(_campaign_of(F.col("event_id")))
        .alias("campaign_id"),
    )


_OBJECTIVES = ["Awareness", "Traffic", "Conversions", "App Install", "Lead Gen"]


def campaigns_from_supplier(supplier: DataFrame) -> DataFrame:
    """Campaign dimension; residue 9 is left out so CMP009 is an orphan."""
    k = F.col("s_suppkey")
    obj = F.element_at(F.array(*[F.lit(o) for o in _OBJECTIVES]), (k % 5 + 1).cast("int"))
    done = (k % 10) < 3
    return (
        supplier.where(k % 10 != 9)
        .select(
            _campaign_of(k).alias("campaign_id"),
            F.concat(F.lit("Campaign_"), F.lpad((k % 10).cast("string"), 3, "0")).alias("campaign_name"),
            obj.alias("objective"),
            (50 + 45 * (k % 10)).cast("double").alias("budget_daily"),
            F.lit("1995-01-01").cast("date").alias("start_date"),
            F.when(done, F.lit("2000-01-01").cast("date")).alias("end_date"),
            F.when(done, "Completed").otherwise("Active").alias("status"),
        )
        .distinct()
    )


_TARGETING = ["Interest", "Lookalike", "Broad"]
_BIDDING = ["Manual CPC", "Target CPA", "Target ROAS"]


def adgroups_from_supplier_part(supplier: DataFrame, part: DataFrame) -> DataFrame:
    """Ad-group dimension: each campaign residue times each part residue mod 3.

    Built as explode + semi-join on the (at most three) residues present in
    ``part`` rather than a cross join.
    """
    residues = part.select((F.col("p_partkey") % 3).cast("int").alias("j")).distinct()
    camps = supplier.select(_campaign_of(F.col("s_suppkey")).alias("campaign_id")).distinct()
    j = F.col("j")
    return (
        camps.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .join(residues, "j", "left_semi")
        .select(
            F.concat(F.col("campaign_id"), F.lit("_AG0"), j.cast("string")).alias("adgroup_id"),
            "campaign_id",
            F.concat(F.lit("AdGroup_0"), j.cast("string")).alias("adgroup_name"),
            F.element_at(F.array(*[F.lit(t) for t in _TARGETING]), j + 1).alias("targeting_type"),
            F.element_at(F.array(*[F.lit(b) for b in _BIDDING]), j + 1).alias("bid_strategy"),
        )
    )


def driver_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four source extracts, keyed by their bronze table name."""
    return {
        "bronze_ads_performance": ads_from_lineitem(read_table(spark, sf_dir, "lineitem")),
        "bronze_ga_events": ga_from_events(read_table(spark, sf_dir, "events")),
        "bronze_campaigns": campaigns_from_supplier(read_table(spark, sf_dir, "supplier")),
        "bronze_adgroups": adgroups_from_supplier_part(
            read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "part")
        ),
    }
