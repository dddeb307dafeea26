"""Reporting calendars and academic-year bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_day(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def month_series(as_of, years_back: int = 5) -> Column:
    """Month starts from ``years_back`` years before the month of ``as_of`` up to it."""
    this_month = F.trunc(as_day(as_of), "MM")
    return F.sequence(F.add_months(this_month, -12 * years_back), this_month, F.expr("INTERVAL 1 MONTH"))


def reporting_periods(spark: SparkSession, as_of, years_back: int = 5) -> DataFrame:
    """(month_start, month_end), 61 rows by default; both are dates."""
    months = spark.range(1).select(F.explode(month_series(as_of, years_back)).alias("month_start"))
    return months.withColumn("month_end", F.last_day("month_start"))


def per_client_periods(clients: DataFrame, as_of, years_back: int = 5) -> DataFrame:
    """Every row of ``clients`` once per reporting month."""
    months = clients.withColumn("month_start", F.explode(month_series(as_of, years_back)))
    return months.withColumn("month_end", F.last_day("month_start"))


def months_back(clients: DataFrame, as_of, steps: int = 48) -> DataFrame:
    """Every row of ``clients`` with each month counted back from ``as_of``.

    Both bounds are timestamps. The end is the last day of the current month moved back
    whole months, so it clamps to a shorter month but never grows to a longer one.
    """
    this_month = F.trunc(as_day(as_of), "MM")
    stepped = clients.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return stepped.select(
        *clients.columns,
        F.add_months(this_month, -F.col("step")).cast("timestamp").alias("month_start"),
        F.add_months(F.last_day(this_month), -F.col("step")).cast("timestamp").alias("month_end"),
    )


def academic_years(session_dates: DataFrame) -> DataFrame:
    """First start and last end of each client's academic years."""
    return session_dates.groupBy("client", "academic_year").agg(
        F.min("start_date").alias("year_start"), F.max("end_date").alias("year_end")
    )


def academic_months(session_dates: DataFrame, as_of, months: int) -> DataFrame:
    """(client, academic_year, month_start): the calendar months that begin inside each year.

    Spreading years over their months turns a range join into one by month. Years reach no
    further than the ``months`` before the month of ``as_of``.
    """
    last = F.trunc(as_day(as_of), "MM")
    opened = F.greatest(F.col("year_start"), F.add_months(last, -months))
    closed = F.least(F.col("year_end"), last)
    years = academic_years(session_dates).where(
        F.col("year_start").isNotNull() & F.col("year_end").isNotNull() & (opened <= closed)
    )
    spread = years.withColumn(
        "month_start", F.explode(F.sequence(F.trunc(opened, "MM"), closed, F.expr("INTERVAL 1 MONTH")))
    )
    return spread.where(F.col("month_start") >= F.col("year_start")).select("client", "academic_year", "month_start")
