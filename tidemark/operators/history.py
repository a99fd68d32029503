"""Look-back features per event: counts, sums and means over the entity's earlier events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookback_history(
    events: DataFrame,
    entity: str = "patient_id",
    event: str = "admission_id",
    date: str = "admission_date",
    end_date: str = "discharge_date",
    stay: str = "length_of_stay_days",
    outcome: str = "readmit_30day_flag",
    intensive: str = "icu_flag",
    long_window: str = "12 MONTHS",
    short_window: str = "90 DAYS",
    heavy_use: int = 3,
) -> DataFrame:
    """One row per event with its entity's history strictly before the event's date.

    Rows are first folded to one row per entity and day. The range frames then run over days, so the ordered part of
    the work per entity is bounded by the calendar even when one entity owns a large share of all events. As days are
    unique there, "back to N months, strictly before" is the frame up to the current row minus the row itself.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    days = (
        events.filter(F.col(date).isNotNull())
        .groupBy(F.col(entity).alias("_entity"), F.col(date).alias("_day"))
        .agg(
            F.count(event).alias("_n"),
            F.sum(flag(outcome)).alias("_outcomes"),
            F.count(F.when(F.col(intensive), F.col(event))).alias("_intensive"),
            F.sum(F.coalesce(F.col(stay).cast("long"), F.lit(0))).alias("_stay"),
            F.count(stay).alias("_stays"),
            F.max(end_date).alias("_end"),
        )
    )
    frame = "OVER (PARTITION BY _entity ORDER BY _day RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW)"
    long_frame, short_frame = frame.format(long_window), frame.format(short_window)

    def before(column: str, over: str):
        return F.expr(f"sum({column}) {over}") - F.col(column)

    seen = days.select(
        "_entity",
        "_day",
        before("_n", long_frame).alias("prior_admissions_12m"),
        before("_n", short_frame).alias("prior_admissions_90d"),
        before("_outcomes", long_frame).alias("prior_readmissions_1y"),
        before("_intensive", long_frame).alias("prior_icu_stays"),
        before("_stay", long_frame).alias("_stay_sum"),
        before("_stays", long_frame).alias("_stay_count"),
        F.expr(
            "max(_end) OVER (PARTITION BY _entity ORDER BY _day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ).alias("last_discharge_date"),
    )
    base = events.select(event, entity, date)
    joined = base.join(seen, (base[entity] == seen["_entity"]) & (base[date] == seen["_day"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    mean_stay = F.col("_stay_sum").cast("decimal(20,0)") / F.nullif(F.col("_stay_count"), F.lit(0)).cast("decimal(20,0)")
    return joined.select(
        event,
        entity,
        date,
        zero("prior_admissions_12m"),
        zero("prior_admissions_90d"),
        zero("prior_readmissions_1y"),
        zero("prior_icu_stays"),
        F.round(F.coalesce(mean_stay, F.lit(0)), 2).alias("prior_los_avg_days"),
        "last_discharge_date",
        F.datediff(date, "last_discharge_date").alias("days_since_last_discharge"),
        (F.coalesce(F.col("prior_admissions_12m"), F.lit(0)) >= heavy_use).alias("high_utilizer_flag"),
    )
