"""Entitlement as of a moment, weekly quotas, referral tiers and prices."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import json_text, lenient_date, month_start, percent_off, week_start

FREE = "free"
RANK = {"free": 0, "plus": 1, "premium": 2}
#: Friends that make a tier, most that count in one month, and days of a month earned.
STEP, MONTHLY, MONTH_DAYS = 5, 5, 30
#: Days of a bin in which moments and periods meet.
BIN = 32


def in_force(periods: DataFrame, at: Column) -> DataFrame:
    return periods.filter((F.col("starts_at") <= at) & (F.col("ends_at") > at) & F.col("revoked_at").isNull())


def effective_plan(accounts: DataFrame, periods: DataFrame, at: Column) -> DataFrame:
    """A staff plan in force wins, then the period in force that ends last, then free.

    accounts: id, staff_plan, staff_plan_expires_at. One aggregate of the periods in force, one join.
    """
    paid = in_force(periods, at).groupBy("account_id").agg(F.max_by("plan", F.struct("ends_at", "id")).alias("_paid"))
    assigned = (F.coalesce("staff_plan", F.lit("")) != "") & (F.col("staff_plan_expires_at").isNull() | (F.col("staff_plan_expires_at") > at))
    return accounts.join(paid, F.col("id") == F.col("account_id"), "left").select("id", F.when(assigned, F.col("staff_plan")).otherwise(F.coalesce("_paid", F.lit(FREE))).alias("current_plan"))


def as_of(facts: DataFrame, periods: DataFrame, ts: str) -> DataFrame:
    """J10 for a moment of each row: the plan of the latest-ending period that holds it.

    Facts and periods meet on the account and on a bin of BIN days, about a period's length: a period touches two or three
    bins, and a busy account is dealt over its bins.
    """
    bin_ = lambda c: F.floor(F.unix_date(F.to_date(c)) / BIN)
    touched = periods.select("account_id", "plan", "starts_at", "ends_at", F.col("id").alias("_pid"), F.explode(F.sequence(bin_("starts_at"), bin_("ends_at"))).alias("_bin"))
    f = facts.withColumn("_bin", bin_(ts))
    best = f.join(touched, ["account_id", "_bin"]).filter((F.col("starts_at") <= F.col(ts)) & (F.col("ends_at") > F.col(ts))).groupBy("id").agg(F.max_by("plan", F.struct("ends_at", "_pid")).alias("plan"))
    return facts.join(best, "id", "left").withColumn("plan", F.coalesce("plan", F.lit(FREE)))


def ending_last(periods: DataFrame, start: Column, end: Column) -> DataFrame:
    """Accounts whose latest period ends in [start, end): none later follows."""
    return periods.filter("revoked_at IS NULL").groupBy("account_id").agg(F.max("ends_at").alias("ends_at")).filter((F.col("ends_at") >= start) & (F.col("ends_at") < end))


def weekly_usage(jobs: DataFrame, at: Column, limit: int) -> DataFrame:
    """A week's jobs of each account that count, against a limit; unsuccessful ones are free."""
    start = week_start(at)
    used = jobs.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 7 DAYS")) & ~F.col("status").isin("failed", "canceled", "expired", "no_op"))
    return used.groupBy("account_id").agg(F.count("*").alias("used")).select("account_id", F.lit(limit).cast("long").alias("limit"), "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("long").alias("remaining"))


def monthly_counts(friends: DataFrame) -> DataFrame:
    """W10 within a month: of an inviter's friends the oldest MONTHLY count, the others wait. friends: id, inviter, qualified_at."""
    month = month_start(F.col("qualified_at"))
    w = Window.partitionBy("inviter", "_month").orderBy("qualified_at", "id")
    return friends.withColumn("_month", month).withColumn("place", F.row_number().over(w)).select("id", "inviter", F.col("_month").alias("month"), "place", (F.col("place") <= MONTHLY).alias("counts"))


def carried_counts(friends: DataFrame) -> DataFrame:
    """W10 across months: friends over a month's cap wait for the next one. A fold over an inviter's months.

    friends are first summed by inviter and month, so that a group holds months and not friends.
    """
    months = friends.groupBy("inviter", F.date_trunc("month", F.from_utc_timestamp("qualified_at", "Asia/Tashkent")).alias("month")).agg(F.count("*").alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        rows, waiting, last = [], 0, None
        for month, n in zip(pdf.month.dt.to_period("M"), pdf.n, strict=True):
            if last is not None:
                waiting = max(0, waiting - MONTHLY * (month.ordinal - last - 1))
            counted = min(MONTHLY, waiting + n)
            waiting, last = waiting + n - counted, month.ordinal
            rows.append((pdf.inviter.iloc[0], str(month), int(counted), int(waiting)))
        return pd.DataFrame(rows, columns=["inviter", "month", "counted", "waiting"])

    return months.groupBy("inviter").applyInPandas(fold, "inviter long, month string, counted long, waiting long")


def rewards(counted: DataFrame) -> DataFrame:
    """A row for each tier reached; tier n earns n months. counted: inviter, counted, earned (tiers already given)."""
    reached = F.floor(F.col("counted") / STEP).cast("int")
    return counted.filter(reached > F.col("earned")).select("inviter", F.explode(F.sequence(F.col("earned").cast("int") + 1, reached)).alias("tier")).select("inviter", "tier", (F.col("tier") * MONTH_DAYS).cast("long").alias("days"))


def progress(counted: DataFrame) -> DataFrame:
    """Where an inviter stands on the way to the next tier."""
    have = (F.col("counted") % STEP).cast("long")
    return counted.select("inviter", "counted", F.floor(F.col("counted") / STEP).cast("long").alias("tier"), have.alias("have"), (STEP - have).alias("remaining"))


def stacked(purchases: DataFrame) -> DataFrame:
    """When each bought period starts. It follows the account's latest-ending period if that still runs and its plan's rank is as high; else it starts at once.

    purchases: account_id, id, plan, days, bought_at and, if there, revoked_at; a revoked period holds nothing up. Sorted rows
    are folded, one latest end and rank at a time: no account is held.
    """
    p = purchases if "revoked_at" in purchases.columns else purchases.withColumn("revoked_at", F.lit(None).cast("timestamp"))

    def fold(batches):
        who, last, rank = (), None, 0  # no account yet; its latest end and that period's rank
        for batch in batches:
            starts, stops = [], []
            for account, plan, days, at, holds in zip(*(batch.column(c).to_pylist() for c in ("account_id", "plan", "days", "bought_at", "holds")), strict=True):
                if account != who:
                    who, last, rank = account, None, 0
                mine = RANK.get(plan, 0)
                start = last if last is not None and last > at and mine <= rank else at
                end = start + timedelta(days=int(days))
                if holds and (last is None or end >= last):
                    last, rank = end, mine
                starts.append(start)
                stops.append(end)
            kind = batch.column("bought_at").type
            yield pa.RecordBatch.from_arrays([batch.column("account_id"), batch.column("id"), pa.array(starts, kind), pa.array(stops, kind)], ["account_id", "id", "starts_at", "ends_at"])

    p = p.select(F.col("account_id").cast("long"), F.col("id").cast("long"), "plan", "days", F.col("bought_at").cast("timestamp"), F.col("revoked_at").isNull().alias("holds"))
    return p.repartition("account_id").sortWithinPartitions("account_id", "bought_at", "id").mapInArrow(fold, "account_id long, id long, starts_at timestamp, ends_at timestamp")


def referral_standing(referrals: DataFrame, finished: DataFrame, at: Column) -> DataFrame:
    """R25 whole: counted, this month's, whether the month is full, pending ones, and those that finished a task and wait.

    referrals: inviter, invitee, status, counts (boolean), qualified_at. finished: account_id of those with a finished task.
    """
    start = month_start(at)
    end = F.to_utc_timestamp(F.add_months(F.to_date(F.from_utc_timestamp(start, "Asia/Tashkent")), 1).cast("timestamp"), "Asia/Tashkent")
    done = finished.select(F.col("account_id").alias("invitee")).distinct().withColumn("_done", F.lit(True))
    counting = (F.col("status") == "qualified") & F.col("counts")
    rows = referrals.join(done, "invitee", "left").groupBy("inviter").agg(
        F.count_if(counting).alias("counted"), F.count_if(counting & (F.col("qualified_at") >= start) & (F.col("qualified_at") < end)).alias("this_month"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("status") == "pending") & F.coalesce("_done", F.lit(False))).alias("waiting"), F.count_if(F.col("status") == "qualified").alias("qualified"),
    )
    return rows.withColumn("month_full", F.col("this_month") >= MONTHLY)


def price_at(plans: DataFrame, at: Column, zone: str = "Asia/Tashkent") -> DataFrame:
    """The price at a moment. plans: plan, price, reduced, last_day (text).

    A discount holds through its last day in the zone; a malformed day, or a reduced price that is not below the price, is none.
    """
    until = lenient_date(F.col("last_day"))
    ends = F.to_utc_timestamp(F.date_add(until, 1).cast("timestamp"), zone)
    on = F.coalesce((ends > at) & (F.col("reduced") > 0) & (F.col("reduced") < F.col("price")), F.lit(False))
    return plans.select("plan", F.when(on, F.col("reduced")).otherwise(F.col("price")).alias("price"), on.alias("discounted"), F.when(on, percent_off(F.col("price"), F.col("reduced"))).alias("percent"), F.when(on, ends).alias("ends_at"))


def days_bought(amount: Column, price: Column, days: int = 30) -> Column:
    """a month at least, and as many days as an overpayment pays for."""
    return F.greatest(F.lit(days), F.floor(days * amount / price)).cast("long")


def _this_week(jobs: DataFrame, at: Column) -> DataFrame:
    start = week_start(at)
    return jobs.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 7 DAYS")) & ~F.col("status").isin("failed", "canceled", "expired", "no_op"))


def ai_documents_week(jobs: DataFrame, at: Column) -> DataFrame:
    """Documents of a week by account; an outline is a step to one, an edit counts with its file."""
    p = F.col("parameters")
    made = _this_week(jobs, at).filter((json_text(p, "stage", "") != "outline") & (json_text(p, "revision", "false") != "true"))
    return made.groupBy("account_id").agg(F.count("*").alias("used"))


def file_jobs_week(jobs: DataFrame, waiting: DataFrame, at: Column) -> DataFrame:
    """File tasks of a week by account, a stored draft once however often it is sent, and the places that waiting batch items hold."""
    p = F.col("parameters")
    draft = F.struct(json_text(p, "editor_document_id").alias("e"), json_text(p, "generation_draft_id").alias("g"))
    rows = _this_week(jobs, at).withColumn("_draft", F.when(draft["e"].isNotNull() | draft["g"].isNotNull(), draft))
    sent = rows.groupBy("account_id").agg((F.count_if(F.col("_draft").isNull()) + F.count_distinct("_draft")).alias("_sent"))
    held = waiting.groupBy("account_id").agg(F.count("*").alias("_held"))
    return sent.join(held, "account_id", "full_outer").select("account_id", (F.coalesce("_sent", F.lit(0)) + F.coalesce("_held", F.lit(0))).alias("used"))
