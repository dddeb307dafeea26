from conftest import at, day, rows
from pyspark.sql import functions as F

from vitalspan.operators import features

AS_OF = "2020-03-10"


def owners(spark, *clients):
    return spark.createDataFrame([(c, f"sf-{c}") for c in clients], "client string, sf_an string")


def years(spark, *spans):
    return spark.createDataFrame(
        [(c, y, day(s), day(e)) for c, y, s, e in spans], "client string, academic_year int, start_date date, end_date date"
    )


def test_report_usage_ends_at_midnight_of_the_last_day(spark):
    titles = spark.createDataFrame(
        [("c", 1, "Assessment Matrix Report"), ("c", 2, "Other"), ("c", 3, "Site Assessment Overview")],
        "client string, jasper_prebuilt_id long, title string",
    )
    log = spark.createDataFrame(
        [
            ("c", 1, at("2020-01-31T00:00:00"), "report_jasper_prebuilt", 5),
            ("c", 1, at("2020-01-31T00:00:01"), "report_jasper_prebuilt", 6),
            ("c", 1, at("2020-01-02T10:00:00"), "report_jasper_prebuilt", 5),
            ("c", 1, at("2020-01-03T10:00:00"), "report_jasper_prebuilt", None),
            ("c", 1, at("2020-01-03T10:00:00"), "dashboard", 7),
            ("c", 2, at("2020-01-03T10:00:00"), "report_jasper_prebuilt", 7),
            ("d", 1, at("2020-01-03T10:00:00"), "report_jasper_prebuilt", 7),
        ],
        "client string, remote_id long, accessed_at timestamp, resource_type string, user_id long",
    )
    spans = years(spark, ("c", 2020, "2019-08-01", "2020-06-30"))
    found = features.report_usage(owners(spark, "c"), titles, log, spans, AS_OF)
    assert found.count() == 2 * 61
    january = found.where("month_start = DATE'2020-01-01'")
    assert rows(january, "title", "academic_year", "times_accessed", "count_of_distinct_users") == [
        ("Assessment Matrix Report", 2020, 3, 1),
        ("Site Assessment Overview", 2020, 0, 0),
    ]
    assert found.where("academic_year IS NULL AND month_start < DATE'2019-08-01'").count() == 2 * 53


def admin_frames(spark, log, users, held, roles):
    return (
        spark.createDataFrame(log, "client string, user_id long, log_time timestamp, description string"),
        spark.createDataFrame(users, "client string, user_id long, username string"),
        spark.createDataFrame(held, "client string, user_id long, role_id long"),
        spark.createDataFrame(roles, "client string, role_id long, role_name string"),
    )


def test_admins_shift_before_the_minimum_and_skip_the_vendor(spark):
    log = [
        ("c", 1, at("2019-05-31T01:00:00"), "x UPDATED TERM y"),
        ("c", 1, at("2019-05-30T23:00:00"), "Updated term"),
        ("c", 2, at("2019-05-01T00:00:00"), "Updated term"),
        ("c", 3, at("2019-05-01T00:00:00"), "Updated term"),
        ("c", 4, at("2019-05-01T00:00:00"), "Updated term"),
        ("c", 5, at("2019-05-01T00:00:00"), "something else"),
    ]
    users = [("c", i, "Illuminator X" if i == 2 else f"u{i}") for i in range(1, 6)]
    frames = admin_frames(spark, log, users, [("c", 3, 9), ("c", 4, 9), ("c", 4, 8)], [("c", 9, "Illuminate Admin"), ("c", 8, None)])
    found = features.first_rollovers(*frames)
    assert rows(found, "user_id", "rollover_date") == [(1, at("2019-02-28T01:00:00")), (4, at("2019-02-01T00:00:00"))]
    months = features.admin_months(found.where("user_id = 1"), AS_OF)
    # The end of February 2019 is midnight, an hour before the rollover date.
    assert months.agg(F.min("month_start")).first()[0] == day("2019-03-01")


def test_admin_tenure_needs_two_logins_in_three_months(spark):
    log = [("c", 1, at("2019-07-15T12:00:00"), "Updated term")]
    log += [("c", 1, at("2019-09-05T08:00:00"), "User logged in"), ("c", 1, at("2019-11-05T08:00:00"), "User logged in")]
    log += [("c", 1, at("2019-11-30T08:00:00"), "User logged in")]
    frames = admin_frames(spark, log, [("c", 1, "ann")], [("c", 1, 1)], [("c", 1, "Teacher")])
    found = features.admin_tenure(owners(spark, "c", "idle"), *frames, AS_OF)
    assert found.count() == 2 * 61
    active = found.where("size(usernames) > 0")
    assert rows(active, "client", "month_start", "month_login_count", "login_count_last_3_months", "sa_tenure_in_days") == [
        ("c", day("2019-11-01"), 1, 2, 228)
    ]
    assert found.where("client = 'idle' AND sa_tenure_in_days = 0 AND rollover_date IS NULL").count() == 61


def test_late_edits_and_logins_outside_the_calendar_do_not_count(spark):
    log = [
        ("c", 1, at("2019-07-15T12:00:00"), "Updated term"),
        ("c", 1, at("2019-06-02T12:00:00"), "TERM was Updated term again"),
        ("c", 1, at("2019-08-01T00:00:00"), "User logged in"),
        ("c", 1, at("2019-08-31T00:00:01"), "User logged in"),  # after midnight of the month's last day
        ("c", 1, at("1999-08-01T00:00:00"), "User logged in"),
        ("c", 2, at("2020-09-26T00:00:00"), "Updated term"),
        ("c", 3, at("2019-08-01T00:00:00"), "User logged in"),
        ("c", 4, None, "Updated term"),
        ("c", 4, None, "User logged in"),
    ]
    activity = features.user_activity(admin_frames(spark, log, [("c", 1, "ann")], [("c", 1, 1)], [("c", 1, "Teacher")])[0], AS_OF)
    found = [(r.user_id, r.rollover_date, r.logins) for r in activity.collect()]
    assert found == [(1, at("2019-03-02T12:00:00"), {day("2019-08-01"): 1})]


def test_common_assessments_thresholds_and_overlapping_years(spark):
    pupils = [("c", s * 100 + i, f"s{s}") for s in range(3) for i in range(12)]
    enrolled = spark.createDataFrame(
        [("c", p, site, day("2019-08-01"), day("2020-06-30")) for _, p, site in pupils],
        "client string, student_id long, session_id string, entry_date date, leave_date date",
    )
    sessions = spark.createDataFrame([("c", f"s{s}", f"site{s}", 2020) for s in range(3)], "client string, session_id string, site_id string, academic_year int")
    titles = spark.createDataFrame([("c", 1, "one"), ("c", 2, "two")], "client string, assessment_id long, title string")
    given = []
    for _, p, site in pupils:
        if site != "s2":
            given.append(("c", p, 1, day("2019-10-05")))  # twelve at two sites
        if site == "s0" or p % 100 < 10:
            given.append(("c", p, 2, day("2019-10-06")))  # twelve at one site, ten at the others
        given.append(("c", p, 2, day("2019-12-31")))  # twelve at three sites
    given.append(("c", 0, 1, day("2015-01-01")))  # before the calendar
    responses = spark.createDataFrame(given, "client string, student_id long, assessment_id long, date_taken date")
    spans = years(spark, ("c", 2020, "2019-08-01", "2020-06-30"), ("c", 2021, "2020-01-01", "2021-06-30"))
    found = features.common_assessments(owners(spark, "c", "d"), responses, enrolled, sessions, titles, spans, AS_OF)
    counted = {
        (str(r["month_start"])[:7], r["academic_year"]): (r["common_assessment_count"], r["cumulative_common_assessment_count_per_ay"])
        for r in found.where("client = 'c'").collect()
    }
    assert counted[("2019-10", 2020)] == (1, 1)
    assert counted[("2019-11", 2020)] == (0, 0)
    assert counted[("2019-12", 2020)] == (1, 2)
    assert counted[("2020-01", 2020)] == counted[("2020-01", 2021)] == (0, 0)
    assert found.where("client = 'd'").count() == 0  # no academic years of its own
