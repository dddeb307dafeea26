import random

import duckdb
import pandas as pd
from conftest import day, rows

from vitalspan.operators.tenure import client_tenure, earliest_starts

SCHEMA = "account_number string, account_name string, start_date date, end_date date, product_name string, product_group string"
AS_OF = "2020-06-15"


def subscriptions(spark, values):
    return spark.createDataFrame(
        [(a, n, day(s), day(e) if e else None, "DnA License", "DnA") for a, n, s, e in values], SCHEMA
    )


def reached(spark, values):
    return {(r[0], r[1]): str(r[2]) for r in earliest_starts(subscriptions(spark, values), AS_OF).collect()}


def test_gap_of_90_days_joins_and_91_does_not(spark):
    assert reached(
        spark,
        [
            ("a", "A", "2015-06-01", None),
            ("a", "A", "2014-01-01", "2015-03-03"),
            ("b", "B", "2015-06-01", None),
            ("b", "B", "2014-01-01", "2015-03-02"),
        ],
    ) == {("a", "A"): "2014-01-01", ("b", "B"): "2015-06-01"}


def test_an_older_longer_subscription_bridges_a_miss(spark):
    assert reached(
        spark,
        [("a", "A", "2015-06-01", None), ("a", "A", "2015-01-01", "2015-02-01"), ("a", "A", "2000-01-01", "2015-03-10")],
    ) == {("a", "A"): "2000-01-01"}


def test_an_open_end_seeds_but_does_not_extend(spark):
    # Both are active; the older is the seed itself, through its own activity.
    assert reached(spark, [("a", "A", "2020-01-01", None), ("a", "A", "2014-01-01", None)]) == {("a", "A"): "2014-01-01"}
    # Under another name an open end never chains.
    assert reached(spark, [("a", "A", "2020-01-01", None), ("a", "B", "2021-01-01", None)]) == {("a", "A"): "2020-01-01"}


def test_a_chain_crosses_names_of_one_account(spark):
    assert reached(
        spark,
        [("a", "New", "2015-06-01", None), ("a", "Old", "2010-01-01", "2015-05-31"), ("a", "Old", "2005-01-01", "2009-12-31")],
    )[("a", "Old")] == "2005-01-01"


def test_tenure_before_the_chain_is_negative(spark):
    found = client_tenure(subscriptions(spark, [("a", "A", "2020-01-01", None)]), AS_OF)
    days = {str(r["as_of_date"]): r["subscriber_tenure_days"] for r in found.collect()}
    assert len(days) == 61
    assert days["2019-12-31"] == -1 and days["2020-06-30"] == 181


def test_only_priced_products_count(spark):
    df = spark.createDataFrame(
        [
            ("a", "A", day("2020-01-01"), None, "dna rate", "DnA"),
            ("b", "B", day("2020-01-01"), None, "DnA support", "DnA"),
            ("c", "C", day("2020-01-01"), None, "DnA License", "Other"),
        ],
        SCHEMA,
    )
    assert [r[0] for r in earliest_starts(df, AS_OF).collect()] == ["a"]


def test_random_chains_equal_the_recursive_query(spark):
    source = random.Random(11)
    values = []
    for account in range(150):
        for _ in range(source.randint(1, 9)):
            start = pd.Timestamp("2010-01-01") + pd.Timedelta(days=source.randint(0, 3900))
            end = start + pd.Timedelta(days=source.randint(1, 700))
            name = source.choice(["x", "y"]) if account % 2 else "x"
            values.append((f"a{account}", name, str(start.date()), None if source.random() < 0.05 else str(end.date())))
    frame = pd.DataFrame(values, columns=["account_number", "account_name", "start_date", "end_date"])  # noqa: F841
    want = duckdb.sql(
        """
        WITH RECURSIVE s AS (SELECT account_number a, account_name n, CAST(start_date AS DATE) sd, CAST(end_date AS DATE) ed FROM frame),
        ends AS (SELECT CAST(last_day(d) AS DATE) m FROM generate_series(DATE '2015-06-01', DATE '2020-06-01', INTERVAL 1 MONTH) g(d)),
        c AS (SELECT a, n, min(sd) sd FROM s JOIN ends ON sd <= m AND (ed > m OR ed IS NULL) GROUP BY a, n
              UNION SELECT s.a, s.n, s.sd FROM s JOIN c ON s.a = c.a AND s.sd < c.sd AND s.ed >= c.sd - 90)
        SELECT a, n, CAST(min(sd) AS VARCHAR) FROM c GROUP BY a, n"""
    ).fetchall()
    found = earliest_starts(subscriptions(spark, values), AS_OF)
    assert rows(found.withColumn("s", found["earliest_start"].cast("string")), "account_number", "account_name", "s") == sorted(
        want, key=str
    )


def test_many_starts_take_windows_or_one_walk_and_no_arrays(spark):
    """Nine thousand starts an account; one account has one name, the other two."""
    from datetime import timedelta

    made = []
    for account, names in (("one", ["a"]), ("two", ["a", "b"])):
        for i in range(9_000):
            start = day("1990-01-01") + timedelta(days=i)
            made.append((account, names[i % len(names)], start, start + timedelta(days=1)))
    made.append(("one", "a", day("2019-01-01"), None))
    made.append(("two", "b", day("2014-10-01"), None))
    df = spark.createDataFrame(made, "account_number string, account_name string, start_date date, end_date date")
    df = df.selectExpr("*", "'DnA' AS product_group", "'DnA Rate' AS product_name")
    found = earliest_starts(df, "2020-01-15")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "array_append" not in plan
    got = {tuple(r)[:2]: r["earliest_start"] for r in found.collect()}
    # The last short one of "one" ended more than ninety days before; those of "two" did not.
    assert got == {("one", "a"): day("2019-01-01"), ("two", "a"): day("1990-01-01"), ("two", "b"): day("1990-01-02")}
