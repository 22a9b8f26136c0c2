"""Month-end labels and their audit from daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendars import doy_date, month_end
from ..functions.clean import assert_unique

RULES = ("strict_calendar_end", "last_record")
AUDIT = (
    "station_id scale source_calendar year month expected_month_end last_record_date last_record_is_month_end has_month_end_record month_end_spei_valid "
    "last_record_spei strict_month_end_spei n_daily_records n_month_end_records n_duplicate_date_rows invalid_date_rows_in_file"
).split()


def month_audit(daily: DataFrame, calendar: str = "noleap_365", ties: list[str] | None = None) -> DataFrame:
    """A row for each (scale, station, month) with a valid date: AUDIT columns and `strict_source_date`.

    daily: station_id, scale, year, doy, spei and, for records of one date, `ties`; the record with the
    greatest ties counts as the later one. Records go by date first and dates by month, both with
    partial sums; rows without a valid date become a group of their own, whose count is handed to the
    station's months by a window over month rows.
    """
    rows = daily.withColumn("date", doy_date(F.col("year"), F.col("doy"), calendar))
    by_date = rows.groupBy("scale", "station_id", "date").agg(F.count("*").alias("n"), F.max_by("spei", F.struct(*map(F.col, ties)) if ties else F.struct(F.col("spei"))).alias("spei"))
    by_date = by_date.withColumn("end", month_end(F.col("date"), calendar)).withColumn("at_end", F.col("date") == F.col("end"))
    months = by_date.groupBy("scale", "station_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.max("end").alias("end"), F.max("date").alias("last"), F.max_by("spei", "date").alias("last_record_spei"),
        F.max(F.when(F.col("at_end"), F.col("date"))).alias("strict_source_date"), F.max_by("spei", F.when(F.col("at_end"), F.col("date"))).alias("strict_month_end_spei"),
        F.sum("n").alias("n_daily_records"), F.coalesce(F.sum(F.when(F.col("at_end"), F.col("n"))), F.lit(0)).alias("n_month_end_records"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_date_rows"),
    )
    lost = F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("n_daily_records"))).over(W.partitionBy("scale", "station_id")), F.lit(0))
    months = months.withColumn("invalid_date_rows_in_file", lost).where("year IS NOT NULL")
    return months.select(
        "station_id", "scale", F.lit(calendar).alias("source_calendar"), "year", "month",
        F.date_format("end", "yyyy-MM-dd").alias("expected_month_end"), F.date_format("last", "yyyy-MM-dd").alias("last_record_date"),
        (F.col("last") == F.col("end")).alias("last_record_is_month_end"), (F.col("n_month_end_records") > 0).alias("has_month_end_record"),
        F.col("strict_month_end_spei").isNotNull().alias("month_end_spei_valid"), "last_record_spei", "strict_month_end_spei",
        "n_daily_records", "n_month_end_records", "n_duplicate_date_rows", "invalid_date_rows_in_file", F.date_format("strict_source_date", "yyyy-MM-dd").alias("strict_source_date"),
    )


def labels_from_audit(audit: DataFrame, rule: str = "strict_calendar_end") -> DataFrame:
    """(station_id, year, month, month_end_date, source_date, scale, spei); months without a record keep a null label and an empty source."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule}")
    date, value = ("strict_source_date", "strict_month_end_spei") if rule == RULES[0] else ("last_record_date", "last_record_spei")
    return audit.select("station_id", "year", "month", F.col("expected_month_end").alias("month_end_date"), F.coalesce(date, F.lit("")).alias("source_date"), "scale", F.col(value).alias("spei"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Counts of the audit by scale, in order of scale."""
    no = lambda c: F.count_if(~F.col(c))
    out = audit.groupBy("scale").agg(
        F.count("*").alias("n_station_months"), F.count_distinct("station_id").alias("n_stations"), no("last_record_is_month_end").alias("n_last_record_not_month_end"),
        no("has_month_end_record").alias("n_missing_month_end_record"), no("month_end_spei_valid").alias("n_invalid_month_end_spei"), F.sum("n_duplicate_date_rows").alias("n_duplicate_date_rows"),
    )
    return out.withColumn("n_valid_strict_labels", F.col("n_station_months") - F.col("n_invalid_month_end_spei")).orderBy("scale")


def extract_labels(
    daily: DataFrame, lookup: DataFrame | None = None, rule: str = "strict_calendar_end", calendar: str = "noleap_365",
    start_year: int | None = None, end_year: int | None = None, ties: list[str] | None = None, validate: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, audit, summary): years are inclusive bounds; labels get all columns of the lookup by station_id."""
    audit = month_audit(daily, calendar, ties)
    if start_year is not None:
        audit = audit.where(F.col("year") >= start_year)
    if end_year is not None:
        audit = audit.where(F.col("year") <= end_year)
    labels = labels_from_audit(audit, rule)
    if lookup is not None and "station_id" in lookup.columns:
        if validate:
            assert_unique(lookup, ["station_id"], "station lookup")
        labels = labels.join(lookup.withColumn("station_id", F.col("station_id").cast("string")), "station_id", "left")
    audit = audit.select(*AUDIT)
    return labels, audit, audit_summary(audit)
