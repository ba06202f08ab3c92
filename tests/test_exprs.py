from pyspark.sql import functions as F

from adpulse.functions import exprs as X


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_round_half_away_scales_the_double(spark):
    # Table rounding scales first: 1.005 and 0.285 are just below the half.
    assert _one(spark, X.round_half_away(F.lit(1.005), 2)) == 1.0
    assert _one(spark, X.round_half_away(F.lit(0.285), 2)) == 0.28
    assert _one(spark, X.round_half_away(F.lit(2.5), 0)) == 3.0
    assert _one(spark, X.round_half_away(F.lit(-2.5), 0)) == -3.0


def test_round_half_even_matches_pandas(spark):
    import numpy as np

    vals = [0.125, 0.135, 2.675, 1.005, -0.125, 12345.675]
    got = [_one(spark, X.round_half_even(F.lit(v), 2)) for v in vals]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_safe_ratio_guards_zero_negative_and_null(spark, df):
    d = df([(10, 0), (10, -5), (10, None), (1, 3)], "n long, d long")
    got = [r["r"] for r in d.select(X.safe_ratio("n", "d", 4).alias("r")).collect()]
    assert got == [0.0, 0.0, 0.0, 0.3333]


def test_event_category(spark, df):
    names = ["purchase", "add_to_cart", "begin_checkout", "sign_up", "page_view", "scroll", "click",
             "video_start", "video_complete", "file_download", "session_start", "login", "mystery", None]
    d = df([(n,) for n in names], "e string")
    got = [r["c"] for r in d.select(X.event_category(F.col("e")).alias("c")).collect()]
    assert got == ["conversion"] * 4 + ["engagement"] * 6 + ["navigation"] * 2 + ["other"] * 2


def test_money_sum_is_exact_and_order_free(spark, df):
    vals = [0.1, 0.2, 0.3, 1234567.89, -0.07] * 200
    d = df([(v,) for v in vals], "x double")
    got = d.agg(X.money_sum("x").alias("s")).first()["s"]
    assert got == round(sum(round(v * 100) for v in vals) / 100.0, 2)
    assert d.repartition(7).agg(X.money_sum("x").alias("s")).first()["s"] == got


def test_thousands_and_layers(spark, df):
    d = df([(0, "bronze_x"), (1234567, "gold_y"), (12, "quality_check_results")], "n long, t string")
    rows = d.select(X.thousands("n").alias("s"), X.layer_of("t").alias("l")).collect()
    assert [(r.s, r.l) for r in rows] == [("0", "BRONZE"), ("1,234,567", "GOLD"), ("12", "SYSTEM")]
