"""Cost views over the log of scorer calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import api_cost

# The projection's month, the quota view's days and the daily soft cap.
MONTH_DAYS = 30
QUOTA_DAYS = 30
SOFT_CAP_GBP = 5.00


def _day(as_of) -> Column:
    return F.lit(as_of).cast("date")


def _on(as_of) -> Column:
    """Timestamps of one day, as a range that a scan can prune on."""
    return (F.col("timestamp") >= _day(as_of)) & (F.col("timestamp") < F.date_add(_day(as_of), 1))


def price_calls(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``est_cost_gbp`` from ``rates(operation, input_rate, cached_rate, output_rate)``.

    Operations without a rate cost nothing.
    """
    card = rates.select("operation", "input_rate", "cached_rate", "output_rate")
    joined = calls.join(card, "operation", "left")
    rate = {c: F.coalesce(c, F.lit(0.0)) for c in ("input_rate", "cached_rate", "output_rate")}
    cost = api_cost("input_tokens", "cached_input_tokens", "output_tokens", *rate.values())
    return joined.withColumn("est_cost_gbp", F.round(cost, 6)).drop(*rate)


def cost_by_day_op_model(calls: DataFrame, as_of, days: int = QUOTA_DAYS) -> DataFrame:
    recent = calls.filter(F.col("timestamp") >= F.date_sub(_day(as_of), days))
    return recent.groupBy(F.to_date("timestamp").alias("day"), "operation", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cached_input_tokens").alias("cached_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("est_cost_gbp"), 4).alias("est_cost_gbp"),
    )


def cost_sorted(calls: DataFrame, as_of) -> DataFrame:
    return cost_by_day_op_model(calls, as_of).orderBy(
        F.desc("day"), F.desc("est_cost_gbp"), "operation", "model"
    )


def cost_today(calls: DataFrame, as_of) -> DataFrame:
    total = F.round(F.coalesce(F.sum("est_cost_gbp"), F.lit(0.0)), 6)
    return calls.filter(_on(as_of)).agg(total.alias("today_gbp"))


def cost_month(calls: DataFrame, as_of) -> DataFrame:
    month = F.col("timestamp") >= F.trunc(_day(as_of), "month")
    return calls.filter(month).agg(
        F.coalesce(F.sum("est_cost_gbp"), F.lit(0.0)).alias("month_gbp")
    )


def cost_projection(calls: DataFrame, as_of) -> DataFrame:
    """Month so far, scaled to a 30-day month."""
    scaled = F.col("month_gbp") / F.dayofmonth(_day(as_of)) * MONTH_DAYS
    return cost_month(calls, as_of).withColumn("projected_gbp", scaled)


def cache_hit_rate(calls: DataFrame, as_of) -> DataFrame:
    """Share of the day's input tokens that came from the cache, as shown on the dashboard."""
    cached = F.coalesce(F.sum("cached_input_tokens"), F.lit(0))
    total = F.coalesce(F.sum("input_tokens"), F.lit(0))
    shown = F.when(
        total > 0, F.concat(F.format_string("%.0f", F.bround(cached / total * 100, 0)), F.lit("%"))
    ).otherwise("—")
    return calls.filter(_on(as_of)).agg(shown.alias("cache_hit_rate"))


def soft_cap_status(calls: DataFrame, as_of, cap: float = SOFT_CAP_GBP) -> DataFrame:
    today = cost_today(calls, as_of)
    return today.withColumn("over_cap", F.col("today_gbp") > cap)
