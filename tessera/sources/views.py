"""The entities of the reports, read from the star-schema tables. Each is a plan over Parquet: filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: F is succeeded, P failed, O queued. A job starts an hour after it is made."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued")
    minutes = F.col("o_orderkey") % 97 + 1
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("feature_id"), status.alias("status"),
        _pick(F.col("o_orderkey"), "web", "bot", "mini_app").alias("origin_channel"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("started_at"),
        F.when(status != "queued", F.timestamp_add("MINUTE", minutes.cast("int"), F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR"))).alias("completed_at"),
        F.col("o_totalprice").alias("amount"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, created with their first order; every fiftieth is a test account."""
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("created_at"))
    c = read(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("plan"), _pick(F.col("c_nationkey"), "en", "uz", "ru").alias("locale"),
        _pick(F.col("c_custkey"), "web", "bot", "mini_app").alias("first_channel"), (F.col("c_custkey") % 50 == 0).alias("is_test"), "created_at",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), "event_type", F.col("ts").cast("timestamp").alias("occurred_at"),
        _pick(F.col("user_id"), "bot", "web", "mini_app").alias("channel"), _pick(F.col("user_id"), "en", "uz", "ru").alias("locale"),
        F.when(F.col("user_id") % 50 == 0, "development").otherwise("production").alias("environment"), F.col("props").alias("properties"), "value",
    )


def event_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of the event log, created with their first signup."""
    e = events(spark, sf_dir).filter("event_type = 'signup'")
    return e.groupBy("account_id").agg(F.min("occurred_at").alias("created_at"), F.first("locale").alias("locale"), F.first("channel").alias("first_channel"), F.first("environment").alias("environment")).select(
        F.col("account_id").alias("id"), "created_at", "locale", "first_channel", (F.col("environment") == "development").alias("is_test")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as provider attempts. Token counts that a provider did not give are null; a returned line is a duplicate."""
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long")
    return li.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("no"), _pick(F.col("l_suppkey"), "alpha", "beta").alias("provider"), _pick(F.col("l_partkey"), "pdf", "slides", "cv").alias("feature_id"),
        _pick(F.col("l_partkey"), "m1", "m2").alias("requested_model"), _pick(F.col("l_suppkey"), "m1", "m2", "m3").alias("resolved_model"), F.col("l_linestatus").alias("stage"),
        F.when(F.col("l_linenumber") % 5 == 0, "failed").when(F.col("l_linenumber") % 6 == 0, "rejected").otherwise("succeeded").alias("status"),
        (F.col("l_returnflag") == "R").alias("duplicate_response"), F.when(F.col("l_partkey") % 7 != 0, n).alias("input_tokens"), F.when(F.col("l_suppkey") % 11 != 0, n * 3).alias("output_tokens"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"), F.when(F.col("l_suppkey") % 25 == 0, "development").when(F.col("l_suppkey") % 25 == 1, "unknown").otherwise("production").alias("environment"),
        _pick(F.col("l_suppkey"), "en", "uz", "ru").alias("locale"), _pick(F.col("l_orderkey"), "web", "bot", "mini_app").alias("origin_channel"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as payments of whole units; every ninth is a gift, which is no money."""
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.floor("o_totalprice").cast("long").alias("amount"), F.when(F.col("o_orderkey") % 9 == 0, "referral").otherwise("manual").alias("provider"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"))


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return li.select(F.col("l_orderkey").alias("payment_id"), F.floor("l_extendedprice").cast("long").alias("amount"), F.when(F.col("l_linenumber") == 1, "requested").otherwise("confirmed").alias("status"), F.col("l_shipdate").cast("timestamp").alias("confirmed_at"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period of 30 days from each order; every thirteenth was revoked after 10, every ninth is a gift."""
    o = read(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.when(F.col("o_orderpriority") < "3", "premium").otherwise("plus").alias("plan"), ts.alias("starts_at"), (ts + F.expr("INTERVAL 30 DAYS")).alias("ends_at"), F.when(F.col("o_orderkey") % 13 == 0, ts + F.expr("INTERVAL 10 DAYS")).alias("revoked_at"), F.when(F.col("o_orderkey") % 9 == 0, "referral").otherwise("manual").alias("provider"))


#: The features that write documents.
WRITERS = ("1-URGENT", "2-HIGH")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their parameters as JSON; a key that a job doesn't have is absent."""
    n, a = F.col("id"), F.col("account_id")
    text = lambda on, x: F.when(on, x.cast("string"))
    keys = F.struct(
        text(n % 4 != 0, n % 120).alias("category"), F.when(n % 5 == 0, "outline").alias("stage"), F.when(n % 7 == 0, F.lit(True)).alias("revision"), text(n % 7 == 0, a % 10).alias("root_draft_id"),
        text(n % 3 == 0, a % 13).alias("generation_draft_id"), text(n % 8 == 0, a % 11).alias("editor_document_id"),
    )
    return jobs(spark, sf_dir).withColumn("parameters", F.to_json(keys))


#: The same entities for the SQL that queries are held against.
SQL = """
jobs AS (SELECT o_orderkey AS id, o_custkey AS account_id, o_orderpriority AS feature_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status,
  ['web','bot','mini_app'][(o_orderkey % 3 + 1)::INT] AS origin_channel, o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP + INTERVAL 1 HOUR AS started_at,
  CASE WHEN o_orderstatus IN ('F','P') THEN o_orderdate::TIMESTAMP + INTERVAL 1 HOUR + to_minutes(o_orderkey % 97 + 1) END AS completed_at FROM orders),
firsts AS (SELECT o_custkey, min(o_orderdate)::TIMESTAMP AS created_at FROM orders GROUP BY 1),
accounts AS (SELECT c_custkey AS id, c_name AS username, c_mktsegment AS plan, ['en','uz','ru'][(c_nationkey % 3 + 1)::INT] AS locale, ['web','bot','mini_app'][(c_custkey % 3 + 1)::INT] AS first_channel,
  c_custkey % 50 = 0 AS is_test, created_at FROM customer JOIN firsts ON c_custkey = o_custkey),
ev AS (SELECT event_id AS id, user_id AS account_id, event_type, ts::TIMESTAMP AS occurred_at, ['bot','web','mini_app'][(user_id % 3 + 1)::INT] AS channel, ['en','uz','ru'][(user_id % 3 + 1)::INT] AS locale,
  CASE WHEN user_id % 50 = 0 THEN 'development' ELSE 'production' END AS environment, props AS properties, value FROM events),
eacc AS (SELECT account_id AS id, min(occurred_at) AS created_at, any_value(locale) AS locale, any_value(channel) AS first_channel, bool_or(environment = 'development') AS is_test FROM ev WHERE event_type = 'signup' GROUP BY 1),
att AS (SELECT l_orderkey AS job_id, l_linenumber AS no, ['alpha','beta'][(l_suppkey % 2 + 1)::INT] AS provider, ['pdf','slides','cv'][(l_partkey % 3 + 1)::INT] AS feature_id, ['m1','m2'][(l_partkey % 2 + 1)::INT] AS requested_model,
  ['m1','m2','m3'][(l_suppkey % 3 + 1)::INT] AS resolved_model, l_linestatus AS stage, CASE WHEN l_linenumber % 5 = 0 THEN 'failed' WHEN l_linenumber % 6 = 0 THEN 'rejected' ELSE 'succeeded' END AS status,
  l_returnflag = 'R' AS duplicate_response, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity::BIGINT END AS input_tokens, CASE WHEN l_suppkey % 11 <> 0 THEN l_quantity::BIGINT * 3 END AS output_tokens, l_shipdate::TIMESTAMP AS created_at,
  CASE l_suppkey % 25 WHEN 0 THEN 'development' WHEN 1 THEN 'unknown' ELSE 'production' END AS environment, ['en','uz','ru'][(l_suppkey % 3 + 1)::INT] AS locale, ['web','bot','mini_app'][(l_orderkey % 3 + 1)::INT] AS origin_channel FROM lineitem),
pay AS (SELECT o_orderkey AS id, o_custkey AS account_id, floor(o_totalprice)::BIGINT AS amount, CASE WHEN o_orderkey % 9 = 0 THEN 'referral' ELSE 'manual' END AS provider, o_orderdate::TIMESTAMP AS occurred_at FROM orders WHERE o_orderstatus = 'F'),
ref AS (SELECT l_orderkey AS payment_id, floor(l_extendedprice)::BIGINT AS amount, CASE WHEN l_linenumber = 1 THEN 'requested' ELSE 'confirmed' END AS status, l_shipdate::TIMESTAMP AS confirmed_at FROM lineitem WHERE l_returnflag = 'R'),
per AS (SELECT o_orderkey AS id, o_custkey AS account_id, CASE WHEN o_orderpriority < '3' THEN 'premium' ELSE 'plus' END AS plan, o_orderdate::TIMESTAMP AS starts_at, o_orderdate::TIMESTAMP + INTERVAL 30 DAY AS ends_at,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 10 DAY END AS revoked_at, CASE WHEN o_orderkey % 9 = 0 THEN 'referral' ELSE 'manual' END AS provider FROM orders),
reqs AS (SELECT *, CASE WHEN id % 4 <> 0 THEN (id % 120)::VARCHAR END AS category, CASE WHEN id % 5 = 0 THEN 'outline' END AS stage, id % 7 = 0 AS revision, CASE WHEN id % 7 = 0 THEN (account_id % 10)::VARCHAR END AS root_draft_id,
  CASE WHEN id % 3 = 0 THEN (account_id % 13)::VARCHAR END AS generation_draft_id, CASE WHEN id % 8 = 0 THEN (account_id % 11)::VARCHAR END AS editor_document_id, feature_id IN ('1-URGENT', '2-HIGH') AS is_ai FROM jobs)
"""
