"""Features taken from the tenants' own databases, all tenants in one job.

Every input carries ``client``; ``accounts`` is (client, sf_an) with one row per tenant.
Logs shrink by (client, key, month) before they meet a calendar, so a busy tenant costs
its log scan and no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.calendar import academic_months, as_day, month_series, months_back, per_client_periods

# Reports whose use is tracked, and the log's name for a report.
REPORT_TITLES = (
    "Assessment Matrix Report",
    "Assessment Response Frequency",
    "Skills Assessment Parent Letter",
    "Site Assessment Overview",
    "Teacher Assessment Overview",
    "Assessment Student Overview",
    "Assessment Site Peer Comparison",
    "Assessment Teacher Peer Comparison",
    "Multiple Assessment Summary Report",
)
REPORT_RESOURCE = "report_jasper_prebuilt"

# Log texts, and users and roles that are the vendor's own.
TERM_UPDATED = "%Updated term%"
LOGGED_IN = "User logged in"
VENDOR_USER = "%illuminator%"
VENDOR_ROLE = "Illuminate Admin"
MONTHS_BEFORE_ROLLOVER = 3


def _in_month(stamp: str):
    """Month of a timestamp and whether it is no later than midnight of the month's last day."""
    month = F.to_date(F.trunc(stamp, "MM"))
    return month, F.col(stamp) <= F.last_day(stamp).cast("timestamp")


def _on_calendar(stamp: str, as_of, months: int):
    """A plain range test the scan can prune by."""
    this_month = F.trunc(as_day(as_of), "MM")
    first, after = F.add_months(this_month, -months), F.add_months(this_month, 1)
    return (F.col(stamp) >= first.cast("timestamp")) & (F.col(stamp) < after.cast("timestamp"))


def report_usage(
    accounts: DataFrame,
    prebuilts: DataFrame,
    access_log: DataFrame,
    session_dates: DataFrame,
    as_of,
    years_back: int = 5,
    titles: Sequence[str] = REPORT_TITLES,
) -> DataFrame:
    """Accesses and distinct users per client, report and month, zero-filled."""
    month, in_time = _in_month("accessed_at")
    seen = (
        access_log.where(_on_calendar("accessed_at", as_of, 12 * years_back))
        .where((F.col("resource_type") == REPORT_RESOURCE) & in_time)
        .groupBy("client", F.col("remote_id").alias("jasper_prebuilt_id"), month.alias("month_start"), "user_id")
        .agg(F.count("accessed_at").alias("accesses"))
        .groupBy("client", "jasper_prebuilt_id", "month_start")
        .agg(F.sum("accesses").alias("accesses"), F.count("user_id").alias("users"))
    )
    reports = (
        prebuilts.where(F.col("title").isin(*titles))
        .groupBy("client", "title", "jasper_prebuilt_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    slate = reports.withColumn("month_start", F.explode(month_series(as_of, years_back)))
    used = slate.join(seen, ["client", "jasper_prebuilt_id", "month_start"], "left")
    return (
        used.join(academic_months(session_dates, as_of, 12 * years_back), ["client", "month_start"], "left")
        .join(accounts, "client")
        .select(
            "client",
            "sf_an",
            "month_start",
            "academic_year",
            "jasper_prebuilt_id",
            "title",
            F.coalesce(F.col("accesses") * F.col("copies"), F.lit(0)).cast("long").alias("times_accessed"),
            F.coalesce("users", F.lit(0)).cast("long").alias("count_of_distinct_users"),
        )
    )


def _shifted():
    """An edit's rollover date, shifted before any minimum since month arithmetic can reorder days."""
    return F.col("log_time") - F.expr(f"INTERVAL {MONTHS_BEFORE_ROLLOVER} MONTHS")


def first_rollovers(basic_log: DataFrame, users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Users who edited a term: (client, user_id, username, rollover_date, roles).

    The date is three months before the edit. A user whose every role is the vendor's is left
    out. ``roles`` lists the other roles' names, a NULL last for a nameless role or for no role.
    """
    edits = (
        basic_log.where(F.col("description").ilike(TERM_UPDATED))
        .groupBy("client", "user_id")
        .agg(F.min(_shifted()).alias("rollover_date"))
    )
    return _of_customers(edits, users, user_roles, roles)


def user_activity(basic_log: DataFrame, as_of, years_back: int = 5) -> DataFrame:
    """(client, user_id, rollover_date, logins) of users who edited a term, in one scan of the log.

    ``logins`` maps a month of the calendar to its logins, so it has one entry a month at most.
    The log shrinks by (client, user, month) first. Edits too late for the calendar's last
    month are not read; a user with none before has no admin month either.
    """
    month, in_time = _in_month("log_time")
    edit = F.col("description").ilike(TERM_UPDATED)
    login = (F.col("description") == LOGGED_IN) & in_time & _on_calendar("log_time", as_of, 12 * years_back)
    # A month of slack, as shorter months move a shifted day.
    last = F.add_months(F.trunc(as_day(as_of), "MM"), MONTHS_BEFORE_ROLLOVER + 2)
    monthly = (
        basic_log.where(F.col("log_time") < last.cast("timestamp"))
        .where(edit | login)
        .groupBy("client", "user_id", month.alias("month_start"))
        .agg(F.min(F.when(edit, _shifted())).alias("first"), F.count(F.when(login, 1)).alias("logins"))
    )
    counted = F.when(F.col("logins") > 0, F.struct("month_start", "logins"))
    return (
        monthly.groupBy("client", "user_id")
        .agg(F.min("first").alias("rollover_date"), F.map_from_entries(F.collect_list(counted)).alias("logins"))
        .where(F.col("rollover_date").isNotNull())
    )


def _of_customers(edits: DataFrame, users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """``edits`` of users who are not the vendor's own, with their names and roles."""
    other_role = F.col("role_name").isNull() | (F.col("role_name") != VENDOR_ROLE)
    held = (
        user_roles.join(roles, ["client", "role_id"], "left")
        .groupBy("client", "user_id")
        .agg(
            F.max(other_role).alias("other_role"),
            F.array_sort(F.collect_set(F.when(other_role, F.col("role_name")))).alias("named"),
            F.max(F.col("role_name").isNull()).alias("nameless"),
        )
    )
    named = F.coalesce("named", F.array().cast("array<string>"))
    roles_held = F.when(F.coalesce("nameless", F.lit(True)), F.array_append(named, F.lit(None).cast("string"))).otherwise(named)
    people = users.where(~F.col("username").ilike(VENDOR_USER)).select("client", "user_id", "username")
    kept = [c for c in edits.columns if c not in ("client", "user_id")]
    return (
        edits.join(people, ["client", "user_id"])
        .join(held, ["client", "user_id"], "left")
        .where(F.coalesce("other_role", F.lit(True)))
        .select("client", "user_id", "username", *kept, roles_held.alias("roles"))
    )


def admin_months(rollovers: DataFrame, as_of, years_back: int = 5) -> DataFrame:
    """Every reporting month of an admin from the rollover date on.

    A user's earliest date is the same in each month that reaches it, so the months are
    spread after the aggregate and no log row meets the calendar.
    """
    months = per_client_periods(rollovers, as_of, years_back)
    return months.where(F.col("rollover_date") <= F.col("month_end").cast("timestamp"))


def admin_tenure(
    accounts: DataFrame,
    basic_log: DataFrame,
    users: DataFrame,
    user_roles: DataFrame,
    roles: DataFrame,
    as_of,
    years_back: int = 5,
    window_months: int = 3,
    logins_above: int = 1,
) -> DataFrame:
    """Active system admins per client and month and the longest of their tenures.

    An admin is active in a month when the logins of the last three admin months exceed
    ``logins_above``. Months without one have an empty user list and tenure 0.
    """
    admins = _of_customers(user_activity(basic_log, as_of, years_back), users, user_roles, roles)
    months = admin_months(admins, as_of, years_back)
    recent = (
        Window.partitionBy("client", "user_id").orderBy("month_start").rowsBetween(1 - window_months, Window.currentRow)
    )
    active = (
        months.withColumn("logins", F.coalesce(F.try_element_at("logins", "month_start"), F.lit(0)))
        .withColumn("recent", F.sum("logins").over(recent))
        .where(F.col("recent") > logins_above)
        .groupBy("client", "month_start")
        .agg(
            F.array_sort(F.collect_set("username")).alias("usernames"),
            F.max("logins").alias("month_login_count"),
            F.max("recent").alias("login_count_last_3_months"),
            F.min("rollover_date").alias("rollover_date"),
        )
    )
    held = F.expr("extract(DAY FROM CAST(month_end AS TIMESTAMP) - rollover_date)")
    return (
        per_client_periods(accounts, as_of, years_back)
        .join(active, ["client", "month_start"], "left")
        .select(
            "client",
            "sf_an",
            "month_start",
            "month_end",
            F.coalesce("usernames", F.array().cast("array<string>")).alias("usernames"),
            "month_login_count",
            "login_count_last_3_months",
            "rollover_date",
            F.coalesce(held, F.lit(0)).cast("int").alias("sa_tenure_in_days"),
        )
    )


def site_responses(
    responses: DataFrame, enrolments: DataFrame, sessions: DataFrame, assessments: DataFrame, as_of, steps: int = 48
) -> DataFrame:
    """Responses per client, month, academic year, assessment and site.

    A response counts where an enrolment of its student covers the date, and where the date
    lies in one of the counted-back months; an end that fell short of its month's last day
    leaves out the days after it.
    """
    spans = months_back(responses.sparkSession.range(1).select(F.lit(0).alias("one")), as_of, steps)
    ends = F.broadcast(  # steps + 1 rows
        spans.select(F.to_date("month_start").alias("month_start"), F.to_date("month_end").alias("month_end"))
    )
    recent = responses.where(_on_calendar("date_taken", as_of, steps))
    dated = recent.withColumn("month_start", F.to_date(F.trunc("date_taken", "MM"))).join(ends, "month_start")
    covered = F.col("date_taken").between(F.col("entry_date"), F.col("leave_date"))
    # Counted per session before sessions and titles join, so a large site meets them as few rows.
    per_session = (
        dated.where(F.col("date_taken") <= F.col("month_end"))
        .join(enrolments, ["client", "student_id"])
        .where(covered)
        .groupBy("client", "session_id", "month_start", "assessment_id")
        .agg(F.count("student_id").alias("given"))
    )
    return (
        per_session.join(sessions, ["client", "session_id"])
        .join(assessments, ["client", "assessment_id"])
        .groupBy("client", "academic_year", "month_start", "assessment_id", "title", "site_id")
        .agg(F.sum("given").alias("responses"))
    )


def common_assessments(
    accounts: DataFrame,
    responses: DataFrame,
    enrolments: DataFrame,
    sessions: DataFrame,
    assessments: DataFrame,
    session_dates: DataFrame,
    as_of,
    steps: int = 48,
    responses_above: int = 10,
    sites_above: int = 1,
) -> DataFrame:
    """Assessments given at several sites, per month and running over the academic year.

    Months without any show 0 for both counts. Counts meet the calendar by month alone, so
    a month inside two academic years yields each pairing.
    """
    shared = (
        site_responses(responses, enrolments, sessions, assessments, as_of, steps)
        .where(F.col("responses") > responses_above)
        .groupBy("client", "academic_year", "month_start", "assessment_id", "title")
        .agg(F.count("site_id").alias("sites"))
        .where(F.col("sites") > sites_above)
    )
    so_far = (
        Window.partitionBy("client", "academic_year")
        .orderBy("month_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = (
        shared.groupBy("client", "academic_year", "month_start")
        .agg(F.count("assessment_id").alias("found"))
        .withColumn("running", F.sum("found").over(so_far))
        .select("client", "month_start", "found", "running")
    )
    return (
        academic_months(session_dates, as_of, steps)
        .join(accounts, "client")
        .join(counted, ["client", "month_start"], "left")
        .select(
            "client",
            "sf_an",
            F.col("month_start").cast("timestamp").alias("month_start"),
            "academic_year",
            F.coalesce("found", F.lit(0)).cast("long").alias("common_assessment_count"),
            F.coalesce("running", F.lit(0)).cast("long").alias("cumulative_common_assessment_count_per_ay"),
        )
    )
