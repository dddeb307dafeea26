from conftest import at, day

from vitalspan.operators.calendar import academic_years, months_back, reporting_periods


def test_reporting_periods_are_61_months(spark):
    found = reporting_periods(spark, "2001-08-15").orderBy("month_start").collect()
    assert len(found) == 61
    assert tuple(found[0]) == (day("1996-08-01"), day("1996-08-31"))
    assert tuple(found[-1]) == (day("2001-08-01"), day("2001-08-31"))


def test_counting_back_from_a_short_month_keeps_its_day(spark):
    one = spark.createDataFrame([("a",)], "client string")
    found = months_back(one, "2021-02-10").orderBy("month_start").collect()
    assert len(found) == 49
    assert found[-1]["month_end"] == at("2021-02-28")
    assert found[-2]["month_start"] == at("2021-01-01")
    assert found[-2]["month_end"] == at("2021-01-28")


def test_academic_years(spark):
    dates = spark.createDataFrame(
        [("a", 2020, day("2019-08-01"), day("2019-12-20")), ("a", 2020, day("2020-01-05"), day("2020-06-10"))],
        "client string, academic_year int, start_date date, end_date date",
    )
    assert [tuple(r) for r in academic_years(dates).collect()] == [("a", 2020, day("2019-08-01"), day("2020-06-10"))]
