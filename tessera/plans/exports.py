"""What reports hand on: recorded events, CSV lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources import views as v
from .filters import Filters
from .registry import WITH, query

_PERIOD = Filters("1998-03-01", "1998-04-01")


@query(
    "s04_recorded_events",
    WITH + """ SELECT 'job.' || status AS event_type, j.account_id, j.id AS job_id, j.feature_id, CASE WHEN j.id % 4 = 0 THEN 'web' ELSE origin_channel END AS channel, a.locale, a.plan AS plan_at_event, CASE WHEN a.is_test THEN 'development' ELSE 'production' END AS environment,
      CASE WHEN j.id % 3 = 0 THEN '{"pages":' || (j.id % 9) || '}' ELSE '{}' END AS properties FROM jobs j JOIN accounts a ON a.id = j.account_id""",
)
def s04(spark, d):
    """What a job's end records: its feature, its channel or the web, and what its account is."""
    j = v.jobs(spark, d)
    n = F.col("id")
    requests = j.select(
        "account_id", F.concat(F.lit("job."), F.col("status")).alias("event_type"), n.alias("job_id"), F.lit(None).cast("string").alias("feature_id"), F.when(n % 4 != 0, F.col("origin_channel")).alias("channel"),
        F.when(n % 3 == 0, F.to_json(F.struct((n % 9).alias("pages")))).alias("properties"),
    )
    return sinks.recorded(requests, v.accounts(spark, d), j)


@query(
    "s07_exported_jobs",
    WITH + """, r AS (SELECT j.*, row_number() OVER (ORDER BY j.created_at DESC, j.id) AS k FROM jobs j JOIN accounts a ON a.id = j.account_id AND NOT a.is_test WHERE j.created_at >= TIMESTAMP '1998-02-28 19:00:00' AND j.created_at < TIMESTAMP '1998-03-31 19:00:00' AND j.status = 'failed'),
    h AS (SELECT unnest(['﻿definitions_version,1.0.0', 'generated_at,2025-01-01 05:00:00+05:00', 'times_timezone,Asia/Tashkent', 'date_from,1998-03-01', 'date_to,1998-04-01', 'timezone,Asia/Tashkent', 'environment,production', 'locale,', 'channel,', 'as_of,2025-01-01 00:00:00', 'id,account_id,feature_id,status,origin_channel,created_at,completed_at,amount,error_code']) AS line, unnest(range(11)) AS no)
    SELECT no::BIGINT AS no, line FROM h UNION ALL SELECT 10 + k, id || ',' || account_id || ',' || feature_id || ',' || status || ',' || origin_channel || ',' || strftime(created_at + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S+05:00') || ',' || strftime(completed_at + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S+05:00') || ',' ||
      CASE WHEN id % 2 = 0 THEN '''-' || (id % 100) ELSE '"' || (id % 100) || ',50"' END || ',' || CASE WHEN id % 5 = 0 THEN '"a ""quoted"" code"' WHEN id % 5 = 1 THEN '''@code' ELSE '' END FROM r""",
)
def s07(spark, d):
    """Failed jobs of a month, the latest first, with cells that a spreadsheet would run and cells that need quotes."""
    jobs = _PERIOD.jobs(v.jobs(spark, d), v.accounts(spark, d)).filter("status = 'failed'")
    n, zone = F.col("id"), _PERIOD.timezone
    amount = F.when(n % 2 == 0, F.concat(F.lit("-"), n % 100)).otherwise(F.concat((n % 100).cast("string"), F.lit(",50")))
    code = F.when(n % 5 == 0, 'a "quoted" code').when(n % 5 == 1, "@code")
    at = lambda c: sinks.local(F.col(c), zone).alias(c)
    rows = jobs.select("id", "account_id", "feature_id", "status", "origin_channel", at("created_at"), at("completed_at"), amount.alias("amount"), code.alias("error_code"))
    return sinks.exported(rows, _PERIOD, [F.desc("created_at"), F.asc("id")], "2025-01-01 05:00:00+05:00", most=None, first="created_at")


@query(
    "s08_report_document",
    WITH + """, f AS (SELECT feature_id, count(*) AS attempts, count(*) FILTER (WHERE status = 'failed') AS failed, count(DISTINCT account_id) AS users FROM jobs GROUP BY 1), c AS (SELECT origin_channel AS channel, count(*) AS jobs, NULL::BIGINT AS refused FROM jobs GROUP BY 1)
    SELECT '{"features":[' || (SELECT string_agg('{"feature_id":"' || feature_id || '","attempts":' || attempts || ',"failed":' || failed || ',"users":' || users || '}', ',' ORDER BY feature_id) FROM f) || '],"channels":['
      || (SELECT string_agg('{"channel":"' || channel || '","jobs":' || jobs || ',"refused":null}', ',' ORDER BY channel) FROM c) || ']}' AS report""",
)
def s08(spark, d):
    j = v.jobs(spark, d)
    features = j.groupBy("feature_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failed"), F.countDistinct("account_id").alias("users"))
    channels = j.groupBy(F.col("origin_channel").alias("channel")).agg(F.count("*").alias("jobs")).withColumn("refused", F.lit(None).cast("long"))
    return sinks.report_json({"features": features, "channels": channels})


@query(
    "s12_unclaimed_files",
    "SELECT p_partkey::VARCHAR || '.pdf' AS key FROM part WHERE TIMESTAMP '1999-01-01 00:00:00' + to_hours(p_size) < TIMESTAMP '1999-01-01 20:00:00' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)",
)
def s12(spark, d):
    """Parts as stored files that lines of few pieces claim."""
    key = F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf"))
    files = v.read(spark, d, "part").select(key.alias("key"), F.timestamp_add("HOUR", "p_size", F.lit("1999-01-01 00:00:00").cast("timestamp")).alias("modified_at"))
    claimed = v.read(spark, d, "lineitem").filter("l_quantity < 10").select(F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("key"))
    return sinks.unclaimed(files, claimed, F.lit("1999-01-02 20:00:00").cast("timestamp")).select("key")
