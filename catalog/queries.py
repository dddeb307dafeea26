"""The registered queries: library calls over the adapters, in a comparable form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import adapters as a
from catalog.adapters import AS_OF
from catalog.model_queries import MODELLING
from catalog.oracle import COHORT_KEYS, TENANT_RESPONSES_ABOVE
from vitalspan import configure
from vitalspan.functions.prefix import with_both_ranks
from vitalspan.operators import features, tenants, usage
from vitalspan.operators.calendar import academic_years, months_back, reporting_periods
from vitalspan.operators.cohorts import COHORTS, cohort_buckets, cohort_report
from vitalspan.operators.tenure import client_tenure
from vitalspan.operators.tickets import ticket_rollup
from vitalspan.plans import training
from vitalspan.plans.tenant_run import tenant_features
from vitalspan.session import scratch_path
from vitalspan.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def present(df: DataFrame) -> DataFrame:
    """Dates and times as text, flags as 0/1, lists joined, doubles to six places."""

    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.BooleanType):
            column = column.cast("int")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(kind, (T.DoubleType, T.DecimalType)):
            column = F.round(column.cast("double"), 6)
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def panel(spark: SparkSession, sf_dir: str, users_above: int | None = None) -> DataFrame:
    return usage.scrub_usage(a.usage_panel(spark, sf_dir), users_above=users_above)


def orders_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.trunc("o_orderdate", "MM")).alias("month_start")
    orders = a.table(spark, sf_dir, "orders").groupBy(month).agg(F.count("o_orderkey").alias("orders"))
    periods = reporting_periods(spark, AS_OF).join(orders, "month_start", "left")
    return periods.withColumn("orders", F.coalesce("orders", F.lit(0)))


def lines_per_month_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate").alias("day")
    days = a.table(spark, sf_dir, "lineitem").groupBy(day).agg(F.count("l_orderkey").alias("lines"))
    months = months_back(spark.range(1).select(F.lit(0).alias("one")), AS_OF).drop("one")
    monthly = months.join(
        days, (F.trunc("day", "MM").cast("timestamp") == F.col("month_start")) & (F.col("day") <= F.col("month_end")), "left"
    )
    return monthly.groupBy("month_start", "month_end").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def change_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = usage.health_change(panel(spark, sf_dir))
    return changed.groupBy("hs_change_type", "change_type_order").agg(F.count(F.lit(1)).alias("account_months"))


def tickets_by_month(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return ticket_rollup(a.tickets(spark, sf_dir), a.organisations(spark, sf_dir), rows)


def build_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.stored_months(spark, sf_dir)
    return training.training_table(
        a.usage_panel(spark, sf_dir, months),
        a.monthly_usage(spark, sf_dir, months),
        a.tickets(spark, sf_dir),
        a.organisations(spark, sf_dir),
        a.accounts(spark, sf_dir),
        a.subscriptions(spark, sf_dir),
        AS_OF,
    )


def build_full_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tenant_features(a.tenant_tables(spark, sf_dir), AS_OF, TENANT_RESPONSES_ABOVE)
    return training.full_training_set(
        build_training(spark, sf_dir),
        runs["dna_common_assessments"],
        runs["dna_system_admin_tenure"],
        runs["dna_prebuilt_report_usage"],
        a.account_owners(spark, sf_dir),
    )


def one_cohort(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir, users_above=0)
        source = COHORTS[name][0]
        monthly = usage.scrub_monthly_usage(a.monthly_usage(spark, sf_dir)) if source == "monthly" else None
        counts = tickets_by_month(spark, sf_dir, rows) if source == "tickets" else None
        return cohort_buckets(rows, monthly, counts, [name])

    return run


def all_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.stored_months(spark, sf_dir)
    rows = usage.scrub_usage(a.usage_panel(spark, sf_dir, months), users_above=0)
    monthly = usage.scrub_monthly_usage(a.monthly_usage(spark, sf_dir, months))
    return cohort_report(rows, monthly, tickets_by_month(spark, sf_dir, rows))


def value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = usage.scrub_usage(a.usage_panel(spark, sf_dir, a.stored_months(spark, sf_dir)))
    rows = stored.select("sf_an", "start_date", F.col("user_created_custom_reports").alias("reports"))
    return with_both_ranks(rows, "reports")


def tenant_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.tenant_tables(spark, sf_dir)
    return tenants.tenant_accounts(t.clients, t.definitions, t.entries)


def report_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.tenant_tables(spark, sf_dir)
    owners = tenants.tenant_accounts(t.clients, t.definitions, t.entries)
    return features.report_usage(owners, t.prebuilts, t.access_log, t.session_dates, AS_OF)


def report_usage_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report usage written by title and month, with each row's place as it is read back."""
    path = scratch_path(spark, "report-usage")
    tables.write_ordered(report_usage(spark, sf_dir), path, ["title", "month_start", "client", "jasper_prebuilt_id", "academic_year"])
    return tables.read_ordered(spark, path).select("place", "title", "month_start", "client", "jasper_prebuilt_id", "academic_year")


def admin_first_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.tenant_tables(spark, sf_dir)
    months = features.admin_months(features.first_rollovers(t.basic_log, t.users, t.user_roles, t.roles), AS_OF)
    return months.select(
        "client", "user_id", "username", "month_start", "rollover_date", "roles", F.size("roles").alias("role_count")
    )


def admin_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.tenant_tables(spark, sf_dir)
    owners = tenants.tenant_accounts(t.clients, t.definitions, t.entries)
    return features.admin_tenure(owners, t.basic_log, t.users, t.user_roles, t.roles, AS_OF)


def common_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's nations taken as one district."""
    t = a.tenant_tables(spark, sf_dir)
    nations, regions = a.table(spark, sf_dir, "nation"), a.table(spark, sf_dir, "region")
    districts = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.col("n_name").alias("client"), "r_name")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.join(districts, "client").withColumn("client", F.col("r_name")).select(*rows.columns)

    district = {n: whole(getattr(t, n)) for n in ("responses", "enrolments", "session_dates")}
    district |= {n: whole(getattr(t, n)).distinct() for n in ("sessions", "assessments")}
    owner = whole(t.clients.select("client")).distinct().withColumn("sf_an", F.lit("none"))
    return features.common_assessments(owner, as_of=AS_OF, **district).drop("sf_an")


def tenant_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tenant_features(a.tenant_tables(spark, sf_dir), AS_OF, TENANT_RESPONSES_ABOVE)
    picks = {
        "dna_prebuilt_report_usage": ("report", F.col("title"), "times_accessed", "count_of_distinct_users"),
        "dna_system_admin_tenure": (
            "admin",
            F.array_join("usernames", ","),
            "login_count_last_3_months",
            "sa_tenure_in_days",
        ),
        "dna_common_assessments": (
            "common",
            F.col("academic_year").cast("string"),
            "common_assessment_count",
            "cumulative_common_assessment_count_per_ay",
        ),
    }
    frames = []
    for name, (feature, detail, amount, second) in picks.items():
        frames.append(
            runs[name].select(
                "client",
                "sf_an",
                F.to_date("month_start").alias("month_start"),
                F.lit(feature).alias("feature"),
                detail.alias("detail"),
                F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("amount"),
                F.col(second).cast("long").alias("second_amount"),
            )
        )
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


RELATIONAL: dict[str, Query] = {
    "reporting_calendar": orders_per_period,
    "calendar_back_49": lines_per_month_back,
    "usage_scrub": panel,
    "monthly_usage_scrub": lambda s, d: usage.scrub_monthly_usage(a.monthly_usage(s, d)),
    "health_lags": lambda s, d: usage.health_lags(panel(s, d)),
    "forward_band_window": lambda s, d: usage.forward_band_range(panel(s, d)),
    "health_change": lambda s, d: usage.health_change(panel(s, d)),
    "change_type_counts": change_type_counts,
    "client_tenure": lambda s, d: client_tenure(a.subscriptions(s, d), AS_OF),
    "ticket_rollup": lambda s, d: tickets_by_month(s, d, panel(s, d)),
    "training_table": lambda s, d: training.longest_tenure_first(build_training(s, d)),
    "full_training_set": build_full_training,
    "cohort_report": all_cohorts,
    "value_ranks": value_ranks,
    "manager_vs_computed": lambda s, d: usage.manager_vs_computed(a.usage_panel(s, d)),
    "tenant_account_id": tenant_accounts,
    "academic_year_bounds": lambda s, d: academic_years(a.tenant_tables(s, d).session_dates),
    "report_usage": report_usage,
    "report_usage_ordered": report_usage_ordered,
    "admin_first_rollover": admin_first_rollover,
    "admin_tenure": admin_tenure,
    "common_assessments": common_assessments,
    "tenant_features": tenant_run,
    **{key: one_cohort(name) for key, name in COHORT_KEYS.items()},
}


def comparable(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(query(configure(spark), sf_dir))

    return run


def all_queries() -> dict[str, Query]:
    return {name: comparable(query) for name, query in {**RELATIONAL, **MODELLING}.items()}
