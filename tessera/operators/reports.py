"""Filtered reports over accounts, jobs, events, payments and provider attempts.

Every function takes plain DataFrames and a Filters and returns a plan. People are counted exactly, empty denominators give
null, and nothing is brought to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import json_text, local_day, rank_index, rate, seconds, share
from ..plans.filters import CHANNELS, Filters

#: Steps of the funnel over the event log, in order.
FUNNEL = ("signup", "view", "click", "purchase")


def _outcomes():
    return [F.count("*").alias("attempts"), *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "canceled", "no_op")], F.count_distinct("account_id").alias("users")]


def totals(accounts: DataFrame, jobs: DataFrame, f: Filters) -> DataFrame:
    """One row of totals, with the 7-day activation of accounts old enough to have had 7 days."""
    mine = f.accounts(accounts)
    ran = f.jobs(jobs, accounts).agg(
        F.count_distinct("account_id").alias("active_users"), F.count_if(F.col("status") == "succeeded").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("queued", "running", "finalizing")).alias("queued"),
    )
    grown = mine.filter(F.col("created_at") <= f.now() - F.expr("INTERVAL 7 DAYS"))
    first = jobs.filter("status = 'succeeded'").join(grown.select(F.col("id").alias("account_id")), "account_id", "left_semi").groupBy("account_id").agg(F.min("completed_at").alias("first_success"))
    active = grown.join(first, grown["id"] == first["account_id"], "left").agg(F.count("*").alias("mature_cohort"), F.count_if(F.col("first_success") <= F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("activated_users"))
    new = mine.agg(F.count("*").alias("new_users"))
    row = new.crossJoin(ran).crossJoin(active)  # three single rows
    return row.select("*", rate(F.col("completed"), F.col("completed") + F.col("failed")).alias("success_rate"), rate(F.col("activated_users"), F.col("mature_cohort")).alias("activated"))


def daily(rows: DataFrame, ts: str, f: Filters) -> DataFrame:
    """R2: a count for each day of the period, zero-filled, with a height relative to the largest."""
    counts = rows.groupBy(local_day(F.col(ts), f.timezone).alias("date")).agg(F.count("*").alias("n"))
    days = f.spine(rows.sparkSession).join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("count"))
    most = F.greatest(F.max("count").over(Window.partitionBy(F.lit(0))), F.lit(1))  # at most 366 rows
    return days.select("date", F.date_format("date", "dd.MM").alias("label"), "count", F.bround(100.0 * F.col("count") / most, 1).alias("height"))


def features(accounts: DataFrame, jobs: DataFrame, f: Filters) -> DataFrame:
    """R3."""
    return f.jobs(jobs, accounts).groupBy("feature_id").agg(*_outcomes())


def mixes(accounts: DataFrame, f: Filters) -> DataFrame:
    """The three mixes in one scan."""
    dims = ("plan", "first_channel", "locale")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    return f.accounts(accounts).select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("count"))


def nearest_ranks(rows: DataFrame, value: str, quantiles: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles by nearest rank: the value at index min(n - 1, floor(n p)) of the sorted values.

    Equal values are counted first, so that the running sum goes over distinct values only.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_k").over(w))
    found = [F.min(F.when(F.col("_upto") > rank_index(F.col("_n"), p), F.col(value))).alias(name) for name, p in quantiles.items()]
    return placed.groupBy(*keys).agg(*found)


def latency(accounts: DataFrame, jobs: DataFrame, f: Filters) -> DataFrame:
    """Median and 95th percentile of the run time of finished jobs, by feature."""
    done = f.jobs(jobs, accounts).filter("status = 'succeeded' AND started_at IS NOT NULL AND completed_at IS NOT NULL")
    spans = done.select("feature_id", F.bround(seconds(F.col("completed_at"), F.col("started_at")), 2).alias("s"))
    return nearest_ranks(spans, "s", {"median": 0.5, "p95": 0.95}, ("feature_id",))


def acquisition(accounts: DataFrame, events: DataFrame, f: Filters, steps: tuple[str, ...] = FUNNEL) -> DataFrame:
    """The size of the cohort, then its people with each later event in the period."""
    start, end = f.edges()
    cohort = f.accounts(accounts).select(F.col("id").alias("account_id"))
    seen = events.filter((F.col("occurred_at") >= start) & (F.col("occurred_at") < end) & F.col("event_type").isin(*steps[1:])).join(cohort, "account_id", "left_semi")
    later = seen.groupBy("event_type").agg(F.count_distinct("account_id").alias("count"))
    names = events.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "step int, event string")
    size = cohort.agg(F.count("*").alias("size"))
    return names.join(later, F.col("event") == F.col("event_type"), "left").crossJoin(size).select("step", "event", F.when(F.col("step") == 0, F.col("size")).otherwise(F.coalesce("count", F.lit(0))).alias("count"))


def retention(accounts: DataFrame, events: DataFrame, f: Filters, kinds: tuple[str, ...], days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Of accounts whose window has passed, those with an event in [created + d, created + d + 1) days.

    One join on the account with the day in the condition; an account that is too young is in no denominator.
    """
    cohort = f.accounts(accounts).select(F.col("id").alias("account_id"), "created_at")
    cohort = cohort.select("*", F.explode(F.array(*map(F.lit, days))).alias("day")).filter(F.timestamp_add("DAY", F.col("day") + 1, F.col("created_at")) <= f.now())
    # No account of the period is older than it, so no event that counts is before its first day and the least day.
    earliest = F.timestamp_add("DAY", F.lit(min(days)), f.edges()[0])
    acts = events.filter(F.col("event_type").isin(*kinds) & (F.col("occurred_at") < f.now()) & (F.col("occurred_at") >= earliest))
    acts = acts.filter(F.col("channel") == f.channel) if f.channel else acts
    acts = acts.select(F.col("account_id").alias("who"), "occurred_at")
    inside = (F.col("account_id") == F.col("who")) & (F.col("occurred_at") >= F.timestamp_add("DAY", F.col("day"), F.col("created_at"))) & (F.col("occurred_at") < F.timestamp_add("DAY", F.col("day") + 1, F.col("created_at")))
    kept = cohort.join(acts, inside, "left_semi").groupBy("day").agg(F.count("*").alias("retained"))
    return cohort.groupBy("day").agg(F.count("*").alias("eligible")).join(kept, "day", "left").select("day", "eligible", F.coalesce("retained", F.lit(0)).alias("retained"), rate(F.coalesce("retained", F.lit(0)), F.col("eligible")).alias("percent"))


def activity(accounts: DataFrame, events: DataFrame, f: Filters, kinds: tuple[str, ...], days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Distinct people in the last days before the end or as_of. A channel is that of what they did, not the one they came through."""
    who = replace(f, channel="").accounts(accounts, in_period=False).select(F.col("id").alias("account_id"))
    events = events.filter(F.col("channel") == f.channel) if f.channel else events
    acts = events.filter(F.col("event_type").isin(*kinds) & (F.col("occurred_at") < f.now()) & (F.col("occurred_at") >= f.now() - F.make_dt_interval(F.lit(max(days)))))
    acts = acts.join(who, "account_id", "left_semi").groupBy("account_id").agg(F.max("occurred_at").alias("last"))
    back = F.explode(F.array(*map(F.lit, days))).alias("days")
    return acts.select("account_id", "last", back).groupBy("days").agg(F.count_if(F.col("last") >= F.timestamp_add("DAY", -F.col("days"), f.now())).alias("users"))


def step_funnel(events: DataFrame, f: Filters, steps: tuple[str, ...] = FUNNEL, channel: str = "bot") -> DataFrame:
    """People of the bot at each step, whatever channel the filters ask for, and their share of the step before."""
    counts = replace(f, channel=channel).events(events).filter(F.col("event_type").isin(*steps)).groupBy("event_type").agg(F.count_distinct("account_id").alias("count"))
    names = events.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "step int, event string")
    rows = names.join(counts, F.col("event") == F.col("event_type"), "left").select("step", "event", F.coalesce("count", F.lit(0)).alias("count"))
    before = F.lag("count").over(Window.partitionBy(F.lit(0)).orderBy("step"))  # a row a step
    return rows.select("*", rate(F.col("count"), before, 0).cast("long").alias("share"))


def _screen(events: DataFrame, f: Filters, kind: str) -> DataFrame:
    """Openings of the screen: in the bot unless another channel is asked for."""
    return replace(f, channel=f.channel or "bot").events(events).filter(F.col("event_type") == kind)


def by_channel(report: Callable[[str], DataFrame]) -> DataFrame:
    """A report of one channel for each of them: the bot's rows are the reference's, and no event is left out."""
    each = [report(c).select(F.lit(c).alias("channel"), "*") for c in CHANNELS]
    return reduce(DataFrame.unionByName, each)


def screen_views(events: DataFrame, f: Filters, kind: str = "view") -> DataFrame:
    """R11 by source: openings and people; a missing source is `other`."""
    seen = _screen(events, f, kind)
    return seen.groupBy(json_text(F.col("properties"), "k", "other").alias("source")).agg(F.count("*").alias("views"), F.count_distinct("account_id").alias("people"))


def screen_viewers(events: DataFrame, requests: DataFrame, f: Filters, kind: str = "view") -> DataFrame:
    """R11 by person: openings, first and last, last source, and whether a request or payment came after the first.

    requests: account_id, created_at, approved. The latest opening is one max over (time, id).
    """
    seen = _screen(events, f, kind).filter(F.col("account_id").isNotNull())
    people = seen.groupBy("account_id").agg(
        F.count("*").alias("views"), F.min("occurred_at").alias("first_view"), F.max("occurred_at").alias("last_view"),
        F.max_by(json_text(F.col("properties"), "k", "other"), F.struct("occurred_at", "id")).alias("last_source"),
    )
    after = requests.groupBy("account_id").agg(F.max("created_at").alias("_request"), F.max(F.when(F.col("approved"), F.col("created_at"))).alias("_paid"))
    late = lambda c: F.coalesce(F.col(c) >= F.col("first_view"), F.lit(False))
    return people.join(after, "account_id", "left").select("account_id", "views", "first_view", "last_view", "last_source", late("_request").alias("started"), late("_paid").alias("paid"))


def screen_totals(events: DataFrame, requests: DataFrame, f: Filters, kind: str = "view") -> DataFrame:
    """R11 in one row. Views without an account count as views and as no people."""
    views = _screen(events, f, kind).agg(F.count("*").alias("views"), F.count_distinct("account_id").alias("people"))
    then = screen_viewers(events, requests, f, kind).agg(F.count_if("started").alias("started"), F.count_if("paid").alias("paid"))
    return views.crossJoin(then).select("*", rate(F.col("started"), F.col("people"), 0).cast("long").alias("started_share"), rate(F.col("paid"), F.col("people"), 0).cast("long").alias("paid_share"))


def refusals(events: DataFrame, f: Filters, accepted: str = "click", refused: str = "error") -> DataFrame:
    """Refusals by code, as shares of everything tried since the first refusal ever, whatever its channel."""
    since = events.filter((F.col("event_type") == refused) & (F.col("environment") == f.environment)).agg(F.min("occurred_at").alias("since"))
    tried = f.events(events).filter(F.col("event_type").isin(accepted, refused)).crossJoin(since).filter("occurred_at >= coalesce(since, occurred_at)")
    total = tried.agg(F.count("*").alias("tried"))
    rows = tried.filter(F.col("event_type") == refused).groupBy(json_text(F.col("properties"), "k", "unknown").alias("code")).agg(F.count("*").alias("refusals"), F.count_distinct("account_id").alias("people"))
    return rows.crossJoin(total).select("*", rate(F.col("refusals"), F.col("tried")).alias("share"))


def categories(jobs: DataFrame, events: DataFrame, accounts: DataFrame, f: Filters, chosen: str = "click") -> DataFrame:
    """What was made of each category beside how often it was chosen; either side alone keeps its row."""
    made = f.jobs(jobs, accounts).filter("category IS NOT NULL").groupBy("category").agg(*_outcomes())
    picked = f.events(events).filter(F.col("event_type") == chosen).groupBy(json_text(F.col("properties"), "k", "unknown").alias("category")).agg(F.count("*").alias("chosen"), F.count_distinct("account_id").alias("choosers"))
    both = made.join(picked, "category", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chosen", "choosers", "attempts", "succeeded", "failed", "users")]
    return both.select("category", *zero).select("*", rate(F.col("failed"), F.col("succeeded") + F.col("failed")).alias("failure_rate"))


#: The codes whose share is watched. A block's code names the block after a colon.
CODES = ("facts_blanked", "template_fallback", "block_fallback", "repinned")


def code_shares(jobs: DataFrame, accounts: DataFrame, f: Filters) -> DataFrame:
    """Of a category's finished documents the share that carries each watched code; a code counts once a document."""
    done = f.jobs(jobs, accounts).filter("category IS NOT NULL AND status = 'succeeded'")
    named = F.array_distinct(F.transform("warnings", lambda w: F.substring_index(w, ":", 1)))
    shares = [rate(F.count_if(F.array_contains("_named", c)), F.count("*")).alias(c) for c in CODES]
    return done.withColumn("_named", named).groupBy("category").agg(F.count("*").alias("documents"), *shares)


def used(attempts: DataFrame, f: Filters, environment: bool = True) -> DataFrame:
    """Attempts of the period by what they carry themselves: locale, channel and, unless left open, environment."""
    rows = attempts.filter(f.during("created_at"))
    rows = rows.filter(F.col("locale") == f.locale) if f.locale else rows
    rows = rows.filter(F.col("origin_channel") == f.channel) if f.channel else rows
    return rows.filter(F.col("environment") == f.environment) if environment else rows


def unknown_environment(attempts: DataFrame, f: Filters) -> DataFrame:
    """How many attempts of the period don't say where they ran."""
    return used(attempts, f, False).agg(F.count_if(F.col("environment") == "unknown").alias("unknown_environment"))


def usage_totals(attempts: DataFrame, f: Filters, measures: tuple[str, ...] = ("input_tokens", "output_tokens")) -> DataFrame:
    """R14 in one row: an unknown count stays null and is counted as unknown; without responses a sum is 0."""
    rows = used(attempts, f)
    own = ~F.col("duplicate_response")
    n = F.count_if(own)
    sums = [F.when(n == 0, F.lit(0)).otherwise(F.sum(F.when(own, F.col(m)))).cast("long").alias(m) for m in measures]
    unknown = [F.count_if(own & F.col(m).isNull()).alias(f"{m}_unknown") for m in measures]
    return rows.agg(F.count("*").alias("attempts"), F.count_if("duplicate_response").alias("duplicates"), F.count_if(F.col("status").isin("failed", "rejected")).alias("failed"), n.alias("responses"), *sums, *unknown)


def usage_by_model(attempts: DataFrame, f: Filters) -> DataFrame:
    rows = used(attempts, f).filter("NOT duplicate_response")
    return rows.groupBy("provider", "feature_id", "requested_model", "resolved_model", "stage").agg(
        F.count("*").alias("responses"), F.sum("input_tokens").alias("input_sum"), F.sum("output_tokens").alias("output_sum"),
        F.count_if(F.col("input_tokens").isNull()).alias("input_unknown"), F.count_if(F.col("output_tokens").isNull()).alias("output_unknown"),
    )


def finance(accounts: DataFrame, payments: DataFrame, refunds: DataFrame, periods: DataFrame, f: Filters) -> DataFrame:
    """Gifts are no money; a refund counts when it was confirmed, whenever the payment was."""
    start, end = f.edges()
    who = f.accounts(accounts, in_period=False).select(F.col("id").alias("account_id"))
    every = payments.filter("provider != 'referral'").join(who, "account_id", "left_semi")
    inside = f.during("occurred_at")
    got = every.agg(F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).alias("gross"), F.count_distinct(F.when(inside, F.col("account_id"))).alias("payers"))
    back = refunds.filter("status = 'confirmed'").filter(f.during("confirmed_at")).join(every.select(F.col("id").alias("payment_id")), "payment_id", "left_semi").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("refunds"))
    first = every.groupBy("account_id").agg(F.min("occurred_at").alias("first")).filter((F.col("first") >= start) & (F.col("first") < end)).agg(F.count("*").alias("first_time"))
    now = f.now()
    on = periods.filter("provider != 'referral'").filter((F.col("starts_at") <= now) & (F.col("ends_at") > now) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > now)))
    paid = on.join(who, "account_id", "left_semi").agg(F.count_distinct("account_id").alias("paid"))
    return got.crossJoin(back).crossJoin(first).crossJoin(paid).select("gross", "refunds", (F.col("gross") - F.col("refunds")).alias("net"), "payers", "paid", "first_time")


def today(accounts: DataFrame, jobs: DataFrame, payments: DataFrame, f: Filters, day: str) -> DataFrame:
    """A day beside the day before, in one scan of each table."""
    def per_day(rows, ts, *aggs):
        # The two days' edges as instants, so that the filter reaches the scan.
        start, end = (F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), k).cast("timestamp"), f.timezone) for k in (-1, 1))
        return rows.filter((F.col(ts) >= start) & (F.col(ts) < end)).groupBy(local_day(F.col(ts), f.timezone).alias("date")).agg(*aggs)

    mine = accounts.filter(F.col("is_test") == f.is_test)
    ours = jobs.join(mine.select(F.col("id").alias("account_id")), "account_id", "left_semi")
    days = f.spine(accounts.sparkSession).filter(F.col("date").between(F.date_sub(F.lit(day).cast("date"), 1), F.lit(day).cast("date")))
    out = days.join(per_day(mine, "created_at", F.count("*").alias("new_users")), "date", "left")
    out = out.join(per_day(ours, "created_at", F.count_distinct("account_id").alias("active_users"), F.count("*").alias("tasks")), "date", "left")
    out = out.join(per_day(payments.filter("provider != 'referral'"), "occurred_at", F.sum("amount").alias("received")), "date", "left")
    return out.select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new_users", "active_users", "tasks", "received")])


def campaign(recipients: DataFrame) -> DataFrame:
    """R18 for each post: shares are 0 for a post nobody got; test sends are in nothing."""
    c = {s: F.count_if(F.col("status") == s) for s in ("delivered", "failed", "blocked", "skipped")}
    rows = recipients.filter("NOT is_test").groupBy("post_id").agg(
        F.count("*").alias("audience"), *[x.alias(s) for s, x in c.items()], F.count_if(F.col("viewed_at").isNotNull()).alias("viewed"),
        F.count_if(F.col("status").isin("pending", "retrying", "sending")).alias("waiting"),
    )
    done = F.col("delivered") + F.col("failed") + F.col("blocked")
    return rows.select("*", share(F.col("viewed"), F.col("delivered")).alias("viewed_share"), share(done + F.col("skipped"), F.col("audience")).alias("progress"))


def saved_views(recipients: DataFrame) -> DataFrame:
    """How many of a post's people each saved view shows."""
    unseen = (F.col("status") == "delivered") & F.col("viewed_at").isNull()
    return recipients.filter("NOT is_test").groupBy("post_id").agg(F.count_if(F.col("viewed_at").isNotNull()).alias("viewed"), F.count_if(unseen).alias("not_viewed"), F.count_if(F.col("status").isin("failed", "blocked", "skipped")).alias("not_reached"))


def campaign_list(posts: DataFrame, recipients: DataFrame, page: int = 1, size: int = 30, skip: int = 0, title: int = 80) -> DataFrame:
    """A page of posts, the newest first, with how many got and saw each. Only the page's posts are joined."""
    shown = posts.orderBy(F.desc("created_at"), "id").offset((page - 1) * size + skip).limit(size)
    counts = recipients.filter("NOT is_test").groupBy("post_id").agg(F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("viewed_at").isNotNull()).alias("viewed"))
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    cut = F.when(F.length(line) > title, F.concat(F.rtrim(F.substring(line, 1, title)), F.lit("…"))).otherwise(line)
    return shown.join(counts, F.col("id") == F.col("post_id"), "left").select("id", cut.alias("title"), F.coalesce("delivered", F.lit(0)).alias("delivered"), F.coalesce("viewed", F.lit(0)).alias("viewed"))


def screen_plans(events: DataFrame, f: Filters, kind: str = "view") -> DataFrame:
    """R11 by plan: free, plus, premium, then any other by name."""
    rows = _screen(events, f, kind).groupBy(F.col("plan_at_event").alias("plan")).agg(F.count("*").alias("views"), F.count_distinct("account_id").alias("people"))
    rank = F.when(F.col("plan") == "free", 0).when(F.col("plan") == "plus", 1).when(F.col("plan") == "premium", 2).otherwise(3)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rank, "plan")))  # a row a plan


def screen_days(events: DataFrame, f: Filters, kind: str = "view") -> DataFrame:
    """R11 by day, zero-filled, with a height relative to the day of most views."""
    seen = _screen(events, f, kind)
    counts = seen.groupBy(local_day(F.col("occurred_at"), f.timezone).alias("date")).agg(F.count("*").alias("_v"), F.count_distinct("account_id").alias("_p"))
    days = f.spine(events.sparkSession).join(counts, "date", "left").select("date", F.coalesce("_v", F.lit(0)).alias("views"), F.coalesce("_p", F.lit(0)).alias("people"))
    most = F.greatest(F.max("views").over(Window.partitionBy(F.lit(0))), F.lit(1))  # at most 366 rows
    return days.withColumn("height", F.bround(100.0 * F.col("views") / most, 1))


def named_accounts(typed: DataFrame, accounts: DataFrame) -> DataFrame:
    """Whom each typed entry names. An id is exact; of several accounts with a name the newest is taken and the entry marked.

    typed: pos, entry, kind. The accounts are cut down to those named before they are compared.
    """
    by_id = typed.filter("kind = 'id'").join(accounts.select("id", "created_at", F.col("telegram_user_id").cast("string").alias("entry")), "entry")
    low = typed.filter("kind = 'name'").withColumn("_low", F.lower("entry"))
    by_name = low.join(accounts.select("id", "created_at", F.lower("handle").alias("_low")), "_low").drop("_low")
    best = by_id.unionByName(by_name).groupBy("pos").agg(F.max_by("id", F.struct("created_at", "id")).alias("account_id"), F.count("*").alias("_n"))
    return typed.join(best, "pos", "left").select("pos", "entry", "account_id", "kind", ((F.col("kind") == "name") & (F.coalesce("_n", F.lit(0)) > 1)).alias("ambiguous"))


def batch_outcomes(children: DataFrame) -> DataFrame:
    """A run waits while a child does; then it has succeeded whole, in part, or failed. children: run, status."""
    good, done = F.col("status").isin("succeeded", "no_op"), F.col("status").isin("succeeded", "no_op", "failed", "canceled", "expired")
    return children.groupBy("run").agg(F.when(~F.every(done), "queued").when(F.every(good), "succeeded").when(F.some(good), "partial").otherwise("failed").alias("outcome"))


def storage_totals(objects: DataFrame) -> DataFrame:
    """Files and bytes in the bucket and those that wait. objects: remote, size."""
    there = F.col("remote")
    size = lambda on: F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0))
    return objects.agg(F.count_if(there).alias("remote_files"), size(there).alias("remote_bytes"), F.count_if(~there).alias("waiting_files"), size(~there).alias("waiting_bytes"))


def practice(answers: DataFrame) -> DataFrame:
    """Marks earned and possible, and the topics of wrong answers. answers: project, marks, topic, correct."""
    return answers.groupBy("project").agg(F.coalesce(F.sum(F.when(F.col("correct"), F.col("marks"))), F.lit(0)).alias("score"), F.sum("marks").alias("max_score"), F.array_sort(F.collect_set(F.when(~F.col("correct"), F.col("topic")))).alias("weak"))


def rejections(attempts: DataFrame, f: Filters) -> DataFrame:
    """R14 by reason."""
    return used(attempts, f).filter("status = 'rejected'").groupBy("rejection").agg(F.count("*").alias("responses"))


def system_snapshot(files: DataFrame, jobs: DataFrame, accounts: DataFrame, f: Filters, now) -> DataFrame:
    """Files kept and their bytes, those past their time, and jobs that wait to be sent out."""
    who = accounts.filter(F.col("is_test") == f.is_test).select(F.col("id").alias("account_id"))
    held = files.filter(~F.col("state").isin("deleted", "revoked")).join(who, "account_id", "left_semi")
    row = held.agg(F.count("*").alias("stored_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("storage"), F.count_if(F.col("expires_at") <= now).alias("expired_pending"))
    return row.crossJoin(f.jobs(jobs, accounts).filter("status = 'queued'").agg(F.count("*").alias("outbox_pending")))  # two single rows
