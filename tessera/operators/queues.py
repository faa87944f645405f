"""Fair order of queues, places and waiting times, and the rules of retries and retention, as plans over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import day_start

#: Seconds after which a row goes before all that are younger, and rows looked at in one dispatch.
AGING, WINDOW, ATTEMPTS = 600, 200, 3


def dispatch(queued: DataFrame, served: DataFrame, now: Column, limit: int = 20, window: int = WINDOW, aging: int = AGING) -> DataFrame:
    """Aged rows first, then the accounts in turn, one row a round; the account served longest ago leads a round.

    queued: id, account_id, created_at. served: account_id, served_at. The candidates are taken before the turns, by a
    bounded top-k, so what follows works on `window` rows whatever the queue holds.
    """
    rank = F.when(F.unix_timestamp("created_at") <= F.unix_timestamp(now) - aging, 0).otherwise(1)
    some = queued.withColumn("_rank", rank).orderBy("_rank", "created_at", "id").limit(max(window, limit))
    round_ = F.row_number().over(Window.partitionBy("account_id").orderBy("_rank", "created_at", "id"))
    some = some.withColumn("round", round_).join(served, "account_id", "left")
    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    second = F.when(F.col("_rank") == 0, F.col("created_at")).otherwise(F.coalesce("served_at", never))
    order = ["round", "_rank", second, "created_at", F.col("account_id").cast("string")]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over `window` rows
    return some.withColumn("place", place).filter(F.col("place") <= limit).select("place", "id", "account_id", "round")


def served_at(jobs: DataFrame, published: DataFrame) -> DataFrame:
    """The later of an account's last start and last publication."""
    a = jobs.filter("started_at IS NOT NULL").groupBy("account_id").agg(F.max("started_at").alias("_a"))
    b = published.filter("published_at IS NOT NULL").groupBy("account_id").agg(F.max("published_at").alias("_b"))
    return a.join(b, "account_id", "full_outer").select("account_id", F.greatest("_a", "_b").alias("served_at"))


def fair_order(queued: DataFrame, served: DataFrame, now: Column, aging: int = AGING, window: int = WINDOW) -> DataFrame:
    """Aged rows by age, then a row of each account a round; an account with aged rows takes its turn after the others."""
    some = queued.orderBy("created_at", "id").limit(window)
    old = F.unix_timestamp("created_at") <= F.unix_timestamp(now) - aging
    some = some.withColumn("_old", old)
    everyone = Window.partitionBy(F.lit(0))  # over `window` rows
    some = some.withColumn("_turn", F.when(F.col("_old"), F.row_number().over(everyone.orderBy(~F.col("_old"), "created_at", F.col("id").cast("string")))))
    mine = Window.partitionBy("account_id")
    some = some.withColumn("_last_turn", F.max("_turn").over(mine)).join(served, "account_id", "left")
    young = Window.partitionBy("account_id", "_old").orderBy("created_at", F.col("id").cast("string"))
    some = some.withColumn("_round", F.when(F.col("_old"), 0).otherwise(F.row_number().over(young)))
    some = some.withColumn("_head", F.min("created_at").over(Window.partitionBy("account_id", "_old")))
    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    keys = [
        "_round", F.when(F.col("_old"), F.col("_turn")), F.col("_last_turn").isNotNull(), F.coalesce("_last_turn", F.lit(0)),
        F.coalesce("served_at", never), "_head", F.col("account_id").cast("string"),
    ]
    # The head decides the first round alone; from then on accounts keep the order of that round.
    return some.withColumn("place", F.row_number().over(everyone.orderBy(*keys)) - 1).select("place", "id", "account_id")


def usual_seconds(done: DataFrame, now: Column, last: int = 20, hours: int = 6) -> DataFrame:
    """The mean run time of the latest rows of the last hours."""
    recent = done.filter((F.col("completed_at") >= F.timestamp_add("HOUR", F.lit(-hours), now)) & F.col("started_at").isNotNull()).orderBy(F.desc("completed_at"), F.desc("id")).limit(last)
    return recent.agg(F.avg(F.greatest(F.lit(0.0), (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6)).alias("usual"))


def swept(rows: DataFrame, now: Column, most: int = ATTEMPTS) -> DataFrame:
    """Q5: a lapsed lease puts a row back, or fails it once it has had its attempts."""
    lapsed = (F.col("status") == "reading") & (F.col("lease_expires_at") <= now)
    return rows.withColumn("status", F.when(lapsed & (F.col("attempts") >= most), "failed").when(lapsed, "queued").otherwise(F.col("status")))


def expired(files: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Q20: files past their time that no job in flight uses."""
    used = jobs.filter(F.col("status").isin("queued", "running", "finalizing")).select(F.explode("input_ids").alias("id"))
    return files.filter((F.col("expires_at") <= now) & ~F.col("state").isin("deleted", "revoked")).join(used, "id", "left_anti")


def within_window(actions: DataFrame, hours: int, most: int) -> DataFrame:
    """Q26: an action is let through if fewer than `most` came in the hours before it."""
    w = Window.partitionBy("key").orderBy(F.unix_micros("at")).rangeBetween(-hours * 3_600_000_000, -1)
    return actions.withColumn("before", F.count("*").over(w)).withColumn("allowed", F.col("before") < most)


def settled(posts: DataFrame, recipients: DataFrame) -> DataFrame:
    """Q10: posts with nothing left to send."""
    waiting = recipients.filter(F.col("status").isin("pending", "retrying", "sending")).select(F.col("post_id").alias("id"))
    return posts.join(waiting, "id", "left_anti")


def state_changes(checks: DataFrame) -> DataFrame:
    """Q23: checks whose health differs from the one before. checks: source, at, healthy."""
    w = Window.partitionBy("source").orderBy("at", "id")
    before = F.lag("healthy").over(w)
    return checks.withColumn("_before", before).filter(~F.col("healthy").eqNullSafe(F.col("_before"))).drop("_before")


def canonical_responses(attempts: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """One row a response, the earliest, whose unknown measures later rows fill."""
    w = Window.partitionBy("response_key").orderBy("created_at", "no", *measures)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = [F.first(m, ignorenulls=True).over(whole).alias(m) for m in measures]
    return attempts.select("response_key", F.row_number().over(w).alias("_n"), F.count("*").over(Window.partitionBy("response_key")).alias("seen"), *filled).filter("_n = 1").drop("_n")


def places(queued: DataFrame, served: DataFrame, reading: DataFrame, now: Column, aging: int = AGING, window: int = WINDOW) -> DataFrame:
    """How many finish before each of the first `window` queued rows: those being read, and those that the fair order takes earlier."""
    busy = reading.agg(F.count("*").alias("_busy"))  # one row
    return fair_order(queued, served, now, aging, window).crossJoin(busy).select("id", "account_id", (F.col("place") + F.col("_busy")).alias("place"))


def estimates(queued: DataFrame, placed: DataFrame, reading: DataFrame, now: Column, usual: float | None, allowed: float = 150.0, idle: int = 30) -> DataFrame:
    """account_id and the seconds until its last row is read, for every account with a row that waits or is being read.

    Null without a usual time, and where nothing is being read although a row has waited longer than `idle`. A read that is underway still
    takes the rest of the usual time, or as long as it has taken, up to the time allowed; beyond that, what its lease has left and a
    read anew. A queued row outside the places comes after all of them. queued: id, account_id, created_at; reading: account_id, started_at, lease_expires_at.
    """
    spent = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("started_at")) / 1e6)
    lapses = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros("lease_expires_at") - F.unix_micros(now)) / 1e6, F.lit(0.0)))
    usually = F.lit(usual).cast("double")
    left = F.when(spent < allowed, F.greatest(usually - spent, F.least(spent, allowed - spent))).otherwise(lapses + usually)
    busy = reading.agg(F.count("*").alias("_n"), F.coalesce(F.sum(left), F.lit(0.0)).alias("_left"))
    first = queued.agg(F.min("created_at").alias("_oldest"))
    beyond = placed.agg(F.count("*").alias("_placed"))
    own = reading.groupBy("account_id").agg(F.max(left).alias("_own"))
    rows = queued.select("id", "account_id").join(placed.select("id", "place"), "id", "left").crossJoin(busy).crossJoin(beyond)  # two single rows
    last = rows.groupBy("account_id").agg(F.max(F.coalesce("place", F.col("_placed") + F.col("_n")) - F.col("_n")).alias("_before"))
    every = last.join(own, "account_id", "full_outer").crossJoin(busy).crossJoin(first)
    seconds = F.ceil(F.when(F.col("_before").isNull(), F.col("_own")).otherwise((F.col("_left") + usually * (F.col("_before") + 1)) / F.greatest(F.col("_n"), F.lit(1))))
    stuck = (F.col("_n") == 0) & (F.unix_micros(now) - F.unix_micros("_oldest") > idle * 1_000_000)
    return every.select("account_id", F.when(usually.isNotNull() & ~F.coalesce(stuck, F.lit(False)), F.greatest(F.lit(1), seconds)).cast("long").alias("seconds"))


def final_rejection(attempts: DataFrame, best_effort: tuple[str, ...]) -> DataFrame:
    """Why a job's newest attempt was rejected, or nothing; stages that may fail are left out."""
    newest = attempts.filter(~F.col("stage").isin(*best_effort)).groupBy("job_id").agg(F.max_by(F.struct("status", "rejection"), F.struct("created_at", "no")).alias("_last"))
    return newest.select("job_id", F.when(F.col("_last.status") == "rejected", F.col("_last.rejection")).otherwise("").alias("rejection"))


def outdated(renders: DataFrame, before: Column) -> DataFrame:
    """Renders unused since `before` that are not their draft's last. The last comes from an aggregate, so no draft is held."""
    last = renders.groupBy("draft").agg(F.max("used_at").alias("_last"))
    return renders.filter(F.col("used_at") <= before).join(last, "draft").filter(F.col("used_at") < F.col("_last")).drop("_last")


def submissions(sent: DataFrame) -> DataFrame:
    """The first submission of an account and key makes the job, repeats get it, and one with another request is a conflict."""
    first = sent.groupBy("account_id", "key").agg(F.min_by(F.struct("id", "hash"), F.struct("created_at", "id")).alias("_f"))
    return sent.join(first, ["account_id", "key"]).select("id", F.col("_f.id").alias("first_id"), (F.col("id") == F.col("_f.id")).alias("made"), (F.col("hash") != F.col("_f.hash")).alias("conflict"))


def room(outstanding: DataFrame, limit: int, most: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Q3: how many more may be published, in all or of each group."""
    return outstanding.groupBy(*by).agg(F.greatest(F.lit(0), min(limit, most) - F.count("*")).cast("long").alias("room"))


def delivery_states(attempts: DataFrame, most: int = 10) -> DataFrame:
    """Q7 and Q8: delivered once any attempt was, else blocked, else failed after `most` attempts, else to be tried again."""
    n = F.count("*")
    state = F.when(F.some(F.col("outcome") == "delivered"), "delivered").when(F.some(F.col("outcome") == "blocked"), "blocked").when(n >= most, "failed").otherwise("retrying")
    return attempts.groupBy("job_id").agg(state.alias("state"), n.alias("attempts"))


def settled_once(events: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """Q12: the first terminal state of a job and how many later ones were ignored."""
    return events.filter(F.col("status").isin(*terminal)).groupBy("job_id").agg(F.min_by("status", F.struct("created_at", "no")).alias("status"), (F.count("*") - 1).alias("ignored"))


def lane_budgets(spent: DataFrame, now: Column, budget: Column) -> DataFrame:
    """today's seconds of each account and kind against its budget; at the budget the lane is busy."""
    today = spent.filter((F.col("started_at") >= day_start(now)) & (F.col("spent_seconds") > 0)).groupBy("account_id", "kind").agg(F.sum("spent_seconds").alias("seconds"))
    return today.withColumn("budget", budget).withColumn("over", F.col("seconds") >= F.col("budget"))


def pruned(tasks: DataFrame, now: Column, kept_days: int, row_days: int) -> DataFrame:
    """Q22: finished tasks lose their payload, later their row; one that nobody took for that long goes as well."""
    back = lambda n: now - F.make_dt_interval(F.lit(n))
    stale = (F.col("completed_at") <= back(row_days)) | ((F.col("status") == "queued") & (F.col("created_at") <= back(row_days)))
    gone = F.when(stale, "row").when(F.col("completed_at") <= back(kept_days), "payload")
    return tasks.withColumn("gone", gone).filter("gone IS NOT NULL")


def same_results(jobs: DataFrame, content: int, snapshot: int) -> DataFrame:
    """Q27: whether a draft's last job already holds a request's content; one still to run must have been sent from the same save."""
    last = jobs.filter(F.col("status").isin("succeeded", "queued", "running", "finalizing")).groupBy("account_id", "draft").agg(F.max_by(F.struct("id", "status", "content", "snapshot"), F.struct("created_at", "id")).alias("_l"))
    same = F.when(F.col("_l.status") == "succeeded", F.col("_l.content") == content).otherwise(F.col("_l.snapshot") == snapshot)
    return last.select("account_id", "draft", F.col("_l.id").alias("last_id"), same.alias("same"))


def rate_limited(requests: DataFrame, seconds: int, most: int, nearest: bool = False) -> DataFrame:
    """a request is refused once its key has had `most` in the same fixed window; windows start at multiples of their length.

    A time is of the window that its whole second lies in, or with `nearest` the second nearest to it, the even one of two.
    """
    second = F.rint(F.unix_micros("at") / 1_000_000) if nearest else F.unix_timestamp("at")
    w = Window.partitionBy("key", F.floor(second / seconds)).orderBy("at", "id")
    return requests.select("id", (F.row_number().over(w) > most).alias("refused"))


def unreferenced(keys: DataFrame, *used: DataFrame) -> DataFrame:
    """Stored keys that no record uses. Each of `used` has a column key; none of them is made distinct first, as an anti join needs no such thing."""
    for one in used:
        keys = keys.join(one, "key", "left_anti")
    return keys
