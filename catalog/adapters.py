"""Shapes of the library's inputs, derived from the driver's tables.

Money and shares are summed as whole cents and hundredths, so sums do not depend on row
order. ``events`` cover one January; each of its days stands for one month, and the time
of day for the place inside the month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.operators.features import REPORT_TITLES
from vitalspan.plans.tenant_run import TenantTables
from vitalspan.session import scratch_path
from vitalspan.sources.tables import read_table, snapshot

AS_OF = "2001-08-31"
STRETCH_START = "1999-02-01"


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


LINE_SUMS = ("qty", "disc", "tax", "lines", "returned")


def _text_key(column: str) -> Column:
    return F.col(column).cast("string")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: line measures as whole numbers."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS o_orderkey",
        "CAST(round(l_quantity) AS BIGINT) AS qty",
        "CAST(round(l_discount * 100) AS BIGINT) AS disc",
        "CAST(round(l_tax * 100) AS BIGINT) AS tax",
        "1L AS lines",
        "CAST(l_returnflag = 'R' AS BIGINT) AS returned",
    )
    return lines.groupBy("o_orderkey").agg({c: "sum" for c in LINE_SUMS}).selectExpr(
        "o_orderkey", *[f"`sum({c})` AS {c}" for c in LINE_SUMS]
    )


def account_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "to_date(trunc(o_orderdate, 'MM')) AS start_date",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
        "o_orderpriority",
    )
    months = orders.join(order_lines(spark, sf_dir), "o_orderkey", "left").groupBy("o_custkey", "start_date")
    return months.agg(
        F.expr("count(1) AS orders"),
        F.expr("sum(cents) AS cents"),
        F.expr("min(o_orderpriority) AS priority"),
        *[F.expr(f"coalesce(sum({c}), 0L) AS {c}") for c in LINE_SUMS],
    )


def stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``account_months`` written once, as the rollup tables it stands for would be."""
    return snapshot(account_months(spark, sf_dir), scratch_path(spark, "account-months"))


def usage_panel(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    """The monthly usage rollup."""
    months = account_months(spark, sf_dir) if months is None else months
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS state")
    people = table(spark, sf_dir, "customer").join(nations, "c_nationkey").selectExpr(
        "c_custkey AS o_custkey", "state", "c_mktsegment AS csm_name"
    )
    eighth = "CAST({} AS DECIMAL(20, 0)) * CAST('0.125' AS DECIMAL(4, 3))"
    return months.join(people, "o_custkey").selectExpr(
        "CAST(o_custkey AS STRING) AS sf_an",
        "concat('db_', o_custkey) AS atd_database",
        "start_date",
        "CAST((cents + 500) div 1000 AS DOUBLE) / 1000.0D AS atd_client_health_score",
        "CASE WHEN cents < 6000000 THEN 'Red' WHEN cents < 18000000 THEN 'Yellow' ELSE 'Green' END"
        " AS atd_client_health_score_band",
        "orders AS atd_users_count",
        "qty AS atd_student_count",
        "CAST(qty % 101 AS DOUBLE) AS atd_users_login_percent",
        "CAST(disc * 7 % 101 AS DOUBLE) AS atd_students_assessed_percent",
        "CAST(tax * 3 % 101 AS DOUBLE) AS atd_feature_adoption_score",
        "disc AS asmt_created_flex",
        "qty AS asmt_admin_flex",
        "tax AS asmt_created_ib",
        "lines AS asmt_admin_ib",
        f"CASE WHEN priority != '5-LOW' THEN {eighth.format('disc')} END AS asmt_created_flex_score",
        f"{eighth.format('qty')} AS asmt_admin_flex_score",
        f"{eighth.format('tax')} AS asmt_created_ib_score",
        f"{eighth.format('lines')} AS asmt_admin_ib_score",
        "returned AS user_created_custom_reports",
        "state",
        "csm_name",
        "CASE priority WHEN '1-URGENT' THEN 'Red' WHEN '2-HIGH' THEN 'Yellow' ELSE 'Green' END AS csm_health",
    )


def monthly_usage(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    """The second usage table: a row per month and one more, typed 'year', each January."""
    months = account_months(spark, sf_dir) if months is None else months
    return months.selectExpr(
        "CAST(o_custkey AS STRING) AS sf_an",
        "start_date",
        "explode(CASE WHEN month(start_date) = 1 THEN array('month', 'year') ELSE array('month') END) AS date_range_type",
        "CAST(lines * 10 % 101 AS DOUBLE) AS teachers_login_percent",
        "tax * 2 AS asmt_admin_inspect_prebuilt",
        "returned * 3 + lines AS summary_asmt_created",
        "disc % 13 AS tile_layouts_created_modified",
        "CAST(qty % 2 AS INT) AS integration_educlimber",
        "CAST(disc % 2 AS INT) AS integration_fast",
        "CAST(tax % 2 AS INT) AS integration_google_classroom",
        "CAST(lines % 2 AS INT) AS integration_pra",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription per order with lines; every fourth account goes by two names."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_type")
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS o_orderkey", "l_partkey", "CAST(round(l_quantity) AS BIGINT) AS qty"
    )
    terms = lines.join(parts, "l_partkey").groupBy("o_orderkey").agg(
        F.expr("CAST(sum(qty) AS INT) AS days"), F.expr("max(p_type) AS p_type")
    )
    return table(spark, sf_dir, "orders").join(terms, "o_orderkey").selectExpr(
        "CAST(o_custkey AS STRING) AS account_number",
        "concat('Account ', o_custkey, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN ' B' ELSE '' END)"
        " AS account_name",
        "to_date(o_orderdate) AS start_date",
        "CASE WHEN NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')"
        " THEN date_add(to_date(o_orderdate), days) END AS end_date",
        "concat('dna ', p_type, CASE WHEN p_type = 'PROMO' THEN ' Rate' ELSE ' License' END) AS product_name",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'Other' ELSE 'DnA' END AS product_group",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _text_key("c_custkey").alias("account_number"),
        F.col("c_acctbal").alias("arr_dna"),
        (F.col("c_nationkey") % 2).cast("int").alias("has_ise"),
    )


def stretched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with January's days spread over as many months."""
    moment = F.col("ts").cast("timestamp")
    month = F.add_months(F.lit(STRETCH_START).cast("date"), F.dayofmonth(moment) - 1)
    inside = F.unix_micros(moment) - F.unix_micros(F.date_trunc("day", moment))
    days = F.dayofmonth(F.last_day(month))
    stamp = F.timestamp_micros(F.unix_micros(month.cast("timestamp")) + inside * days)
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        stamp.alias("at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretched_events(spark, sf_dir).where(F.col("event_type") == "error").select(
        F.col("event_id").alias("ticket_id"), F.col("user_id").alias("org_id"), F.col("at").alias("created_at")
    )


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One organisation per customer; some name no account, some an empty one."""
    key = F.col("c_custkey")
    account = F.when(key % 11 == 3, None).when(key % 11 == 5, "").otherwise(_text_key("c_custkey"))
    return table(spark, sf_dir, "customer").select(
        key.alias("org_id"), F.col("c_name").alias("name"), account.alias("ie_salesforce_id")
    )


def tenant_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database per supplier, named so that every naming rule has cases."""
    key = F.col("s_suppkey")
    plain = F.concat(F.lit("dist"), key.cast("string"))
    marks = ["{}", "{}_backup", "demo{}", "_{}", "{}_sandbox", "{}_a", "Postgres{}", "client{}", "{}_old", "{}"]
    name = plain
    for i, mark in enumerate(marks):
        front, back = mark.split("{}")
        name = F.when(key % len(marks) == i, F.concat(F.lit(front), plain, F.lit(back))).otherwise(name)
    server = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    return table(spark, sf_dir, "supplier").select(server.alias("server"), name.alias("db"), key.alias("number"))


def _customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("client"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey")


def tenant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretched events under the nation of their user."""
    owners = _customer_nation(spark, sf_dir).select("client", F.col("c_custkey").alias("user_id"))
    return stretched_events(spark, sf_dir).join(owners, "user_id")


def tenant_tables(spark: SparkSession, sf_dir: str) -> TenantTables:
    """Every nation as a tenant."""
    nations = table(spark, sf_dir, "nation")
    clients = nations.select(F.col("n_name").alias("client"))
    key = F.col("n_nationkey")
    spelling = F.when(key % 3 == 0, "salesforce.account_number").when(key % 3 == 1, "Salesforce.Account_Number").otherwise(
        "SALESFORCE.ACCOUNT-NUMBER"
    )
    named = nations.where(key % 5 != 4).select(
        F.col("n_name").alias("client"), (key * 10 + 1).cast("long").alias("definition_id"), spelling.alias("key")
    )
    other = nations.select(
        F.col("n_name").alias("client"), (key * 10 + 2).cast("long").alias("definition_id"), F.lit("district.name").alias("key")
    )
    first = _customer_nation(spark, sf_dir).groupBy("client", "c_nationkey").agg(F.min("c_custkey").alias("account"))
    entries = first.select(
        "client",
        (F.col("c_nationkey") * 10 + 1).cast("long").alias("definition_id"),
        F.concat(F.lit("{"), F.col("account").cast("string"), F.lit("}")).alias("value"),
    )
    customers = _customer_nation(spark, sf_dir)
    events = tenant_events(spark, sf_dir)
    titles = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).alias("title")) for i, t in enumerate(REPORT_TITLES)])
    untracked = F.struct(F.lit(9).cast("long").alias("id"), F.lit("Another Report").alias("title"))
    reports = nations.select(F.col("n_name").alias("client"), F.explode(F.array_append(titles, untracked)).alias("r"))
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"
    )
    owned = table(spark, sf_dir, "orders").join(
        customers.select("client", F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    order_clients = owned.select("client", F.col("o_orderkey").alias("l_orderkey"))
    year = F.year(F.add_months(F.to_date("o_orderdate"), 5))
    session_id = F.concat_ws("-", "c_mktsegment", year)
    given = table(spark, sf_dir, "part").join(nations, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    role_id = F.col("c_mktsegment")
    roles_of = F.when(F.col("c_custkey") % 3 == 0, F.array(role_id, F.lit("extra"))).when(
        F.col("c_custkey") % 7 == 1, F.array().cast("array<string>")
    ).otherwise(F.array(role_id))
    segments = customers.select("client", "c_mktsegment").distinct()
    return TenantTables(
        clients=clients,
        definitions=named.unionByName(other),
        entries=entries,
        session_dates=owned.select(
            "client",
            year.alias("academic_year"),
            F.to_date(F.trunc("o_orderdate", "MM")).alias("start_date"),
            F.last_day("o_orderdate").alias("end_date"),
        ),
        prebuilts=reports.select("client", F.col("r.id").alias("jasper_prebuilt_id"), F.col("r.title").alias("title")),
        access_log=events.where(F.col("event_type") == "view").select(
            "client",
            (F.col("k") % 10).cast("long").alias("remote_id"),
            F.col("at").alias("accessed_at"),
            F.when(F.col("k") % 11 == 0, "dashboard").otherwise("report_jasper_prebuilt").alias("resource_type"),
            "user_id",
        ),
        basic_log=events.select(
            "client",
            "user_id",
            F.col("at").alias("log_time"),
            F.when(F.col("event_type") == "signup", "User logged in")
            .when((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0), "updated TERM 12")
            .when(F.col("event_type") == "purchase", "User Updated term")
            .otherwise(F.col("event_type"))
            .alias("description"),
        ),
        users=customers.select(
            "client",
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_custkey") % 50 == 7, F.concat(F.lit("Illuminator "), "c_name")).otherwise(F.col("c_name")).alias(
                "username"
            ),
        ),
        user_roles=customers.select("client", F.col("c_custkey").alias("user_id"), F.explode(roles_of).alias("role_id")),
        roles=segments.select(
            "client",
            role_id.alias("role_id"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "Illuminate Admin")
            .when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
            .alias("role_name"),
        ).unionByName(clients.select("client", F.lit("extra").alias("role_id"), F.lit("Illuminate Admin").alias("role_name"))),
        responses=lines.join(order_clients, "l_orderkey").select(
            "client",
            F.col("l_orderkey").alias("student_id"),
            F.col("p_type").alias("assessment_id"),
            F.to_date("l_shipdate").alias("date_taken"),
        ),
        enrolments=owned.select(
            "client",
            F.col("o_orderkey").alias("student_id"),
            session_id.alias("session_id"),
            F.to_date("o_orderdate").alias("entry_date"),
            F.date_add(F.to_date("o_orderdate"), 720).alias("leave_date"),
        ),
        sessions=owned.select(
            "client",
            session_id.alias("session_id"),
            F.col("c_mktsegment").alias("site_id"),
            year.alias("academic_year"),
        ).distinct(),
        assessments=given.select(
            F.col("n_name").alias("client"), F.col("p_type").alias("assessment_id"), F.lower("p_type").alias("title")
        ).distinct(),
    )


def account_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenant, a nation, that owns each account under its own database name."""
    key = _text_key("c_custkey")
    return _customer_nation(spark, sf_dir).select(key.alias("sf_an"), F.concat(F.lit("db_"), key).alias("atd_database"), "client")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular model input: label, three numbers and two categories per labelled document."""
    text = F.col("text")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("toxic").cast("double").alias("label"),
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("double").alias("n_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("double").alias("n_lines"),
        "lang",
        "source",
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") == 3).cast("double").alias("label"), "embedding"
    )


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a score per order line."""
    mixed = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), ((mixed % 1000) / 1000.0).alias("score")
    )
