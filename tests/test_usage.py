import random

import pytest
from conftest import day, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalspan.operators import usage
from vitalspan.operators.tickets import ticket_rollup

PANEL = (
    "sf_an string, atd_database string, start_date date, atd_client_health_score double, "
    "atd_client_health_score_band string, atd_users_count long"
)


def panel(spark, values):
    return spark.createDataFrame(
        [(a, d, day(s), float(i), b, 1) for i, (a, d, s, b) in enumerate(values)], PANEL
    )


def random_panel(spark, seed, months=True):
    source = random.Random(seed)
    values = []
    for account in range(6):
        for database in range(source.choice([1, 1, 2, 5])):
            for month in range(24):
                if source.random() < 0.75:
                    on = 1 if months else source.randint(1, 28)
                    text = f"{2000 + month // 12}-{month % 12 + 1:02d}-{on:02d}"
                    band = source.choice(["Red", "Yellow", "Green", None, "Blue"])
                    values.append((f"a{account}", f"d{account}-{database}", text, band))
    return panel(spark, values)


def test_scrub_drops_off_season_and_unnamed_databases(spark):
    df = panel(
        spark,
        [("a", "d", "2020-05-01", "Red"), ("a", "d", "2020-06-01", "Red"), ("a", None, "2020-05-01", "Red")],
    )
    assert usage.scrub_usage(df).count() == 1
    assert usage.scrub_usage(df, users_above=1).count() == 0


def test_change_flag_per_band(spark):
    later = {"Red": "Green", "Yellow": "Red", "Green": "Yellow", None: "Green", "Blue": "Red"}
    values = []
    for i, (now, then) in enumerate(later.items()):
        values += [(f"a{i}", f"d{i}", "2020-01-01", now), (f"a{i}", f"d{i}", "2020-04-01", then)]
    found = usage.health_change(panel(spark, values)).where("start_date = DATE'2020-01-01'")
    kinds = {r["hs_band"]: (r["hs_did_change"], r["hs_change_type"], r["change_type_order"]) for r in found.collect()}
    assert kinds["Red"] == (True, "Red/Yellow to Green", 3)
    assert kinds["Yellow"] == (False, "Stayed Red/Yellow", 1)
    assert kinds["Green"] == (True, "Green to Red/Yellow", 2)
    # An unknown band has no code of its own and counts as changed once any code follows.
    assert kinds[None] == (True, "Red/Yellow to Green", 3)
    assert kinds["Blue"] == (True, "Red/Yellow to Green", 3)


def test_no_later_month_means_no_flag(spark):
    df = panel(spark, [("a", "d", "2020-01-01", "Green"), ("a", "d", "2020-05-01", "Red")])
    assert [r["hs_did_change"] for r in usage.health_change(df).collect()] == [None, None]


@pytest.mark.parametrize("months", [True, False])
def test_forward_range_equals_a_self_join(spark, months):
    df = random_panel(spark, 3, months)
    from vitalspan.functions.bands import band_code

    now, later = df.alias("n"), df.alias("l")
    code = band_code(F.col("l.atd_client_health_score_band"))
    near = (
        (F.col("n.atd_database") == F.col("l.atd_database"))
        & (F.col("l.start_date") > F.col("n.start_date"))
        & (F.col("l.start_date") <= F.add_months("n.start_date", 3))
    )
    want = now.join(later, near, "left").groupBy("n.sf_an", "n.atd_database", "n.start_date", "n.atd_client_health_score").agg(
        F.min(code).alias("lo"), F.max(code).alias("hi")
    )
    columns = ["sf_an", "atd_database", "start_date"]
    got = usage.forward_band_range(df, month_starts=months)
    assert rows(got, *columns, "interval_min_band_number", "interval_max_band_number") == rows(want, *columns, "lo", "hi")


def test_split_accounts_have_the_same_lags(spark):
    df = random_panel(spark, 5).unionByName(panel(spark, [(None, f"n{i}", f"2000-0{1 + i % 3}-01", "Red") for i in range(9)]))
    history = Window.partitionBy("sf_an").orderBy("start_date", "atd_database")
    names = {"date": "start_date", "band": "atd_client_health_score_band", "": "atd_client_health_score"}
    found = [F.lag(c, n).over(history).alias(f"hs_{usage.lag_label(n)}_lag" + (k and f"_{k}")) for n in usage.LAGS for k, c in names.items()]
    want = df.select("sf_an", "start_date", *found)
    assert rows(usage.health_lags(df), *want.columns) == rows(want, *want.columns)


def test_lags_count_rows_and_ties_go_by_database(spark):
    df = panel(
        spark, [("a", "d2", "2020-01-01", "Red"), ("a", "d1", "2020-01-01", "Green"), ("a", "d1", "2020-09-01", "Yellow")]
    )
    found = usage.health_lags(df).where("start_date = DATE'2020-09-01'").first()
    assert (found["hs_1_lag_date"], found["hs_1_lag_band"], found["hs_1_lag"]) == (day("2020-01-01"), "Red", 0.0)
    assert found["hs_4_lag_band"] is None


def test_tickets_count_once_per_database_and_zero_where_none(spark):
    df = panel(
        spark,
        [("a", "d1", "2020-01-01", "Red"), ("a", "d2", "2020-01-01", "Red"), ("b", "d3", "2020-01-01", "Red")],
    )
    tickets = spark.sql("SELECT explode(sequence(1L, 3L)) ticket_id, 7L org_id, TIMESTAMP'2020-01-31 23:00:00' created_at")
    orgs = spark.createDataFrame(
        [(7, "North", "a"), (7, "South", "a"), (8, "None", ""), (9, "Null", None)],
        "org_id long, name string, ie_salesforce_id string",
    )
    found = rows(ticket_rollup(tickets, orgs, df), "sf_an", "name", "ticket_count")
    assert found == [("a", "North", 6), ("a", "South", 6), ("b", None, 0)]
