"""Machines that keep state over the events of deliveries, copies, notices, jobs, paid calls and memberships, held to recursive SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import views as v
from ..streaming import machines
from .registry import query

#: The second up to which leases may run out.
HORIZON = 2_000


def _events(spark, d, kind: Column, n: Column, text: Column) -> DataFrame:
    """Lines as events of their orders, seconds apart; seq tells lines of one second apart."""
    li = v.read(spark, d, "lineitem").withColumn("at", (F.col("l_quantity") * 13 + F.col("l_linenumber")).cast("long")).withColumn("x", (F.col("l_partkey") % 6).cast("int"))
    return li.select(F.col("l_orderkey").cast("string").alias("key"), "at", (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("seq"), kind.alias("kind"), n.cast("long").alias("n"), text.alias("text"), "l_suppkey", "x").distinct()


def _pick(*values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), F.col("x") + 1)


def _sql_pick(*values: str | None) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in values) + "][x + 1]"


def _folded(kind: str, n: str, text: str, state: dict[str, tuple[str, str]], act: str, out: str = "SELECT key, at, seq, act AS said FROM f WHERE rn > 0", events: str | None = None) -> str:
    """Events of a key one after the other: `state` has each column's beginning and what an act makes of it."""
    lines = "(SELECT *, (l_quantity * 13 + l_linenumber)::BIGINT AS at_, (l_partkey % 6)::INT AS x FROM lineitem)"
    events = events or f"SELECT DISTINCT l_orderkey::VARCHAR AS key, at_ AS at, l_partkey * 100000 + l_suppkey AS seq, {kind} AS kind, ({n})::BIGINT AS n, {text} AS text FROM {lines}"
    old = ", ".join(f"f.{c}" for c in state)
    sql = f"""
    WITH RECURSIVE e0 AS ({events}), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at, seq) AS rn FROM e0),
    f AS (
      SELECT DISTINCT key, 0::BIGINT AS rn, 0::BIGINT AS at, NULL::BIGINT AS seq, NULL::VARCHAR AS act, {", ".join(f"{x[0]} AS {c}" for c, x in state.items())} FROM e
      UNION ALL
      SELECT key, rn, at, seq, act, {", ".join(x[1] for x in state.values())} FROM (SELECT *, {act} AS act FROM (SELECT e.*, {old} FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)))
    {out}"""
    return re.sub(r'(?<![\w"])at(?![\w"])', '"at"', sql)  # a word of DuckDB's own


@query(
    "q07_delivery_leases",
    _folded(
        _sql_pick("look", "look", "look", "result", "result", "result"), "CASE WHEN x = 4 THEN 60 END", _sql_pick(None, None, None, "delivered", "retrying", "failed"),
        {
            "status": ("'pending'", "CASE act WHEN 'no' THEN status WHEN 'exhausted' THEN 'failed' WHEN 'taken' THEN 'sending' ELSE act END"), "attempts": ("0::BIGINT", "attempts + (act = 'taken')::BIGINT"),
            "until": ("NULL::BIGINT", "CASE act WHEN 'taken' THEN at + 120 WHEN 'no' THEN until END"), "next": ("0::BIGINT", "CASE WHEN kind = 'result' AND act <> 'no' THEN at + coalesce(n, 0) ELSE next END"),
        },
        "CASE WHEN kind = 'look' THEN CASE WHEN status IN ('delivered', 'failed', 'blocked') OR (status = 'sending' AND until > at) OR next > at THEN 'no' WHEN attempts >= 2 THEN 'exhausted' ELSE 'taken' END WHEN status = 'sending' THEN text ELSE 'no' END",
    ),
)
def q07(spark, d):
    e = _events(spark, d, _pick("look", "look", "look", "result", "result", "result"), F.when(F.col("x") == 4, 60), _pick(None, None, None, "delivered", "retrying", "failed"))
    return machines.over_table(e, machines.deliveries(2), HORIZON)


@query(
    "q08_copy_leases",
    _folded(
        _sql_pick("look", "look", "tap", "result", "result", "pause"), "CASE x WHEN 3 THEN 30 WHEN 5 THEN at_ + 200 END", _sql_pick(None, None, None, "retrying", "failed", None),
        {
            "status": ("'pending'", "CASE WHEN act IN ('no', 'seen', 'paused') THEN status WHEN act = 'arrived' THEN 'delivered' WHEN act = 'interrupted' THEN 'failed' WHEN act = 'taken' THEN 'sending' ELSE act END"),
            "until": ("NULL::BIGINT", "CASE WHEN act = 'taken' THEN at + 120 WHEN act IN ('no', 'seen', 'paused') THEN until END"), "next": ("0::BIGINT", "CASE WHEN kind = 'result' AND act <> 'no' THEN at + coalesce(n, 0) ELSE next END"),
            "seen": ("FALSE", "seen OR kind = 'tap'"), "pause": ("0::BIGINT", "CASE WHEN kind = 'pause' THEN greatest(pause, n) ELSE pause END"),
        },
        """CASE kind WHEN 'tap' THEN CASE WHEN status IN ('retrying', 'failed') THEN 'arrived' ELSE 'seen' END WHEN 'pause' THEN 'paused'
          WHEN 'look' THEN CASE WHEN status NOT IN ('pending', 'retrying', 'sending') OR (status = 'sending' AND until > at) THEN 'no' WHEN status = 'sending' THEN CASE WHEN seen THEN 'arrived' ELSE 'interrupted' END
            WHEN status = 'retrying' AND seen THEN 'arrived' WHEN next > at OR pause > at THEN 'no' ELSE 'taken' END
          ELSE CASE WHEN status <> 'sending' THEN 'no' WHEN seen THEN 'delivered' ELSE text END END""",
    ),
)
def q08(spark, d):
    n = F.when(F.col("x") == 3, 30).when(F.col("x") == 5, F.col("at") + 200)
    e = _events(spark, d, _pick("look", "look", "tap", "result", "result", "pause"), n, _pick(None, None, None, "retrying", "failed", None))
    return machines.over_table(e, machines.copies(), HORIZON)


@query(
    "q11_notice_leases",
    _folded(
        _sql_pick("look", "look", "look", "look", "result", "result"), "CASE WHEN x = 4 THEN 40 END", "(l_suppkey % 2 + 1) || ':' || CASE WHEN x = 4 THEN 'retrying' ELSE 'delivered' END",
        {
            "status": ("'pending'", "CASE act WHEN 'no' THEN status WHEN 'exhausted' THEN 'failed' WHEN 'taken' THEN 'sending' ELSE act END"), "attempts": ("0::BIGINT", "attempts + (act = 'taken')::BIGINT"),
            "until": ("NULL::BIGINT", "CASE act WHEN 'taken' THEN at + 120 WHEN 'no' THEN until END"), "next": ("0::BIGINT", "CASE WHEN kind = 'result' AND act <> 'no' THEN at + coalesce(n, 0) ELSE next END"),
        },
        "CASE WHEN kind = 'look' THEN CASE WHEN status NOT IN ('pending', 'retrying', 'sending') OR (status = 'sending' AND until > at) OR next > at THEN 'no' WHEN attempts >= 2 THEN 'exhausted' ELSE 'taken' END WHEN status = 'sending' AND left(text, 1)::INT = attempts THEN substr(text, 3) ELSE 'no' END",
    ),
)
def q11(spark, d):
    text = F.concat((F.col("l_suppkey") % 2 + 1).cast("string"), F.lit(":"), F.when(F.col("x") == 4, "retrying").otherwise("delivered"))
    e = _events(spark, d, _pick("look", "look", "look", "look", "result", "result"), F.when(F.col("x") == 4, 40), text)
    return machines.over_table(e, machines.notices(2), HORIZON)


@query(
    "q06_lost_workers",
    _folded(
        _sql_pick("start", "start", "beat", "beat", "settle", "settle"), "100 + x * 20", _sql_pick(None, None, None, None, "succeeded", "failed"),
        {"status": ("NULL::VARCHAR", "CASE act WHEN 'no' THEN CASE WHEN status = 'running' AND until <= at THEN 'failed' ELSE status END WHEN 'leased' THEN 'running' ELSE act END"), "until": ("NULL::BIGINT", "CASE WHEN act = 'leased' THEN at + n ELSE until END")},
        "CASE WHEN status IN ('succeeded', 'failed') OR (status = 'running' AND until <= at) THEN 'no' WHEN kind = 'settle' THEN CASE WHEN status IS NULL THEN 'no' ELSE text END WHEN kind = 'start' OR status IS NOT NULL THEN 'leased' ELSE 'no' END",
        f""" SELECT key, at, seq, act AS said FROM f WHERE rn > 0
        UNION ALL SELECT key, until, NULL, 'worker_interrupted' FROM (SELECT *, lead(at) OVER (PARTITION BY key ORDER BY rn) AS later FROM f WHERE rn > 0) WHERE act = 'leased' AND until <= coalesce(later, {HORIZON})""",
    ),
)
def q06(spark, d):
    e = _events(spark, d, _pick("start", "start", "beat", "beat", "settle", "settle"), 100 + F.col("x") * 20, _pick(None, None, None, None, "succeeded", "failed"))
    return machines.over_table(e, machines.workers(), HORIZON)


_CALLS = """SELECT key, at, seq, kind, CASE WHEN kind = 'call' THEN n ELSE max(CASE WHEN kind = 'call' THEN at END) OVER (PARTITION BY key ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS n, NULL::VARCHAR AS text FROM (
      SELECT DISTINCT l_orderkey::VARCHAR AS key, (l_quantity * 13 + l_linenumber)::BIGINT AS at, l_partkey * 100000 + l_suppkey AS seq, ['call','call','call','done','done','error'][(l_partkey % 6 + 1)::INT] AS kind, 300 + l_orderkey % 5 * 100 AS n FROM lineitem)"""


@query(
    "q14_checkpoint_reuse",
    _folded(
        "", "", "",
        {
            "status": ("NULL::VARCHAR", "CASE WHEN act = 'completed' THEN 'completed' WHEN act = 'called' AND n > at THEN 'pending' WHEN gone <= at THEN NULL ELSE status END"), "token": ("NULL::BIGINT", "CASE WHEN act = 'called' AND n > at THEN at ELSE token END"),
            "until": ("NULL::BIGINT", "CASE WHEN act = 'called' AND n > at THEN least(n, at + 360) WHEN act IN ('freed', 'completed') THEN NULL ELSE until END"), "gone": ("NULL::BIGINT", "CASE WHEN act = 'called' AND n > at THEN n ELSE gone END"),
        },
        """CASE kind WHEN 'call' THEN CASE WHEN n <= at THEN 'called' WHEN gone > at AND status = 'completed' THEN 'reused' WHEN gone > at AND until > at THEN 'refused' ELSE 'called' END
          ELSE CASE WHEN gone IS NULL OR gone <= at OR status IS DISTINCT FROM 'pending' OR until IS NULL OR token IS DISTINCT FROM n THEN 'no' WHEN kind = 'error' THEN 'freed' ELSE 'completed' END END""",
        events=_CALLS,
    ),
)
def q14(spark, d):
    """A result's end is its order's; "done" and "error" name the last call before them, refused ones too."""
    e = _events(spark, d, _pick("call", "call", "call", "done", "done", "error"), 300 + F.col("l_orderkey") % 5 * 100, F.lit(None).cast("string"))
    before = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    call = F.col("kind") == "call"
    return machines.over_table(e.withColumn("n", F.when(call, F.col("n")).otherwise(F.max(F.when(call, F.col("at"))).over(before))), machines.checkpoints(), HORIZON)


@query(
    "q24_membership_answers",
    _folded(
        "", "", "", {"status": ("NULL::VARCHAR", "split_part(act, ':', 2)"), "until": ("0::BIGINT", "CASE WHEN act LIKE 'asked%' THEN at + CASE text WHEN 'member' THEN 21600 WHEN 'not_member' THEN 60 ELSE 120 END ELSE until END")},
        "CASE WHEN until > at AND kind <> 'refresh' THEN 'kept:' || status WHEN text = 'not_member' THEN 'asked:out' ELSE 'asked:in' END",
        events="""SELECT user_id || ':' || (event_id % 3) AS key, epoch(ts)::BIGINT // 200 AS at, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'refresh' ELSE 'ask' END AS kind, NULL::BIGINT AS n,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 'member' WHEN event_type = 'click' THEN 'not_member' ELSE 'unknown' END AS text FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)""",
    ),
)
def q24(spark, d):
    e = v.read(spark, d, "events")
    text = F.when(F.col("event_type").isin("purchase", "signup"), "member").when(F.col("event_type") == "click", "not_member").otherwise("unknown")
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 200).cast("long")
    kind = F.when(F.col("event_id") % 50 == 0, "refresh").otherwise("ask")
    rows = e.select(F.concat_ws(":", "user_id", F.col("event_id") % 3).alias("key"), at.alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(None).cast("long").alias("n"), text.alias("text"))
    return machines.over_table(rows, machines.memberships(), HORIZON)
