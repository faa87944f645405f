"""Searches, audiences, campaigns, paged and ordered lists, and sets of keys."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import queues, reports, temporal
from ..sources import views as v
from .filters import Filters
from .registry import WITH, query

YEAR = Filters("1998-01-01", "1998-12-31")
DAYS = Filters("2024-01-05", "2024-01-25", as_of="2024-01-24 12:00:00")
NOT_COUNTED = ("failed", "canceled", "expired", "no_op")
_AT = "TIMESTAMP '1999-03-10 12:00:00'"
_Y = "created_at >= TIMESTAMP '1997-12-31 19:00:00' AND created_at < TIMESTAMP '1998-12-30 19:00:00'"
_D = "occurred_at >= TIMESTAMP '2024-01-04 19:00:00' AND occurred_at < TIMESTAMP '2024-01-24 19:00:00'"
_POSTS = "posts AS (SELECT s_suppkey AS id, s_name AS text, TIMESTAMP '1998-01-01 00:00:00' + to_days((s_suppkey % 9)::INT) AS created_at FROM supplier WHERE s_suppkey < 25)"
_RCPT = "rc AS (SELECT l_orderkey * 10 + l_linenumber AS pk, l_suppkey % 20 AS post_id, l_orderkey AS account_id, (l_orderkey + l_linenumber) % 31 = 0 AS is_test, ['delivered','delivered','failed','blocked','pending','skipped','delivered'][((l_orderkey + l_linenumber) % 7 + 1)::INT] AS status, CASE WHEN l_partkey % 3 = 0 THEN l_shipdate::TIMESTAMP END AS viewed_at FROM lineitem)"


def _at():
    return F.lit("1999-03-10 12:00:00").cast("timestamp")


def recipients(spark, d):
    li = v.read(spark, d, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    names = F.array(*map(F.lit, ("delivered", "delivered", "failed", "blocked", "pending", "skipped", "delivered")))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk"), (F.col("l_suppkey") % 20).alias("post_id"), F.col("l_orderkey").alias("account_id"), (n % 31 == 0).alias("is_test"),
        F.element_at(names, (n % 7 + 1).cast("int")).alias("status"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_shipdate").cast("timestamp")).alias("viewed_at"),
    )


def posts(spark, d):
    s = v.read(spark, d, "supplier").filter("s_suppkey < 25")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"), F.timestamp_add("DAY", (F.col("s_suppkey") % 9).cast("int"), F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("created_at"))


def people(spark, d):
    """Accounts as an audience: most have a telegram id, and some asked to be deleted."""
    a = v.accounts(spark, d)
    return a.select("*", F.when(F.col("id") % 10 != 3, F.col("id") * 1000 + 7).alias("telegram_user_id"), F.when(F.col("id") % 23 == 0, F.col("created_at")).alias("deletion_requested_at"), F.concat(F.lit("User"), (F.col("id") % 300).cast("string")).alias("handle"))


_PEOPLE = "people AS (SELECT *, CASE WHEN id % 10 <> 3 THEN id * 1000 + 7 END AS telegram_user_id, id % 23 = 0 AS leaving, 'User' || (id % 300) AS handle FROM accounts)"


def reachable(accounts):
    """P14."""
    return accounts.filter("telegram_user_id IS NOT NULL AND deletion_requested_at IS NULL AND NOT is_test")


@query("p04_account_search", WITH + " SELECT id, username FROM accounts WHERE NOT is_test AND (contains(id::VARCHAR, '12') OR contains(lower(username), '12') OR id + 5 = 12)")
def p04(spark, d):
    """A search leaves the period aside: name and id by part, a number also by telegram id."""
    a = v.accounts(spark, d).filter("NOT is_test")
    q = F.lit("12")
    return a.filter(F.col("id").cast("string").contains(q) | F.lower("username").contains(q) | (F.col("id") + 5 == 12)).select("id", "username")


@query("p05_ai_documents", WITH + f" SELECT feature_id, count(*) AS n FROM reqs WHERE is_ai AND {_Y} AND NOT revision AND (stage IS NULL OR stage <> 'outline') AND account_id IN (SELECT id FROM accounts WHERE NOT is_test) GROUP BY 1")
def p05_ai(spark, d):
    jobs = YEAR.jobs(v.requests(spark, d), v.accounts(spark, d)).filter(F.col("feature_id").isin(*v.WRITERS))
    p = F.col("parameters")
    return jobs.filter(~expr.json_has(p, "revision") & (~expr.json_has(p, "stage") | (expr.json_text(p, "stage") != "outline"))).groupBy("feature_id").agg(F.count("*").alias("n"))


@query("r24_edits_per_draft", WITH + " SELECT account_id, root_draft_id, count(*) AS edits FROM reqs WHERE is_ai AND revision AND status NOT IN ('failed', 'canceled', 'expired', 'no_op') GROUP BY 1, 2")
def r24(spark, d):
    """Nested JSON equality."""
    p = F.col("parameters")
    jobs = v.requests(spark, d).filter(F.col("feature_id").isin(*v.WRITERS) & (expr.json_text(p, "revision") == "true") & ~F.col("status").isin(*NOT_COUNTED))
    return jobs.groupBy("account_id", expr.json_text(p, "root_draft_id").alias("root_draft_id")).agg(F.count("*").alias("edits"))


_WEEK = f"created_at >= date_trunc('week', {_AT} + INTERVAL 5 HOUR) - INTERVAL 5 HOUR AND created_at < date_trunc('week', {_AT} + INTERVAL 5 HOUR) - INTERVAL 5 HOUR + INTERVAL 7 DAY AND status NOT IN ('failed', 'canceled', 'expired', 'no_op')"


@query("r22_ai_documents_week", WITH + f" SELECT account_id, count(*) AS used FROM reqs WHERE is_ai AND {_WEEK} AND coalesce(stage, '') <> 'outline' AND NOT revision GROUP BY 1")
def r22(spark, d):
    return temporal.ai_documents_week(v.requests(spark, d).filter(F.col("feature_id").isin(*v.WRITERS)), _at())


@query("r23_file_jobs_week", WITH + f""", w AS (SELECT * FROM reqs WHERE NOT is_ai AND {_WEEK}), j AS (SELECT account_id, count(*) FILTER (WHERE editor_document_id IS NULL AND generation_draft_id IS NULL) + count(DISTINCT CASE WHEN editor_document_id IS NOT NULL OR generation_draft_id IS NOT NULL THEN coalesce(editor_document_id, '-') || '/' || coalesce(generation_draft_id, '-') END) AS n FROM w GROUP BY 1),
b AS (SELECT o_custkey AS account_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 6 AND o_orderstatus = 'O' GROUP BY 1)
SELECT account_id, (coalesce(j.n, 0) + coalesce(b.n, 0))::BIGINT AS used FROM j FULL JOIN b USING (account_id)""")
def r23(spark, d):
    waiting = v.read(spark, d, "lineitem").filter("l_linenumber = 6").join(v.read(spark, d, "orders").filter("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("account_id"))
    return temporal.file_jobs_week(v.requests(spark, d).filter(~F.col("feature_id").isin(*v.WRITERS)), waiting, _at())


@query("p09_prefix_filter", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'P')")
def p09(spark, d):
    return v.read(spark, d, "part").filter(F.col("p_type").startswith("P")).select("p_partkey", "p_type")


@query("p12_known_reasons", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') THEN p_brand ELSE '' END AS rejection FROM part")
def p12(spark, d):
    """A reason is kept for rejected rows alone and only out of a closed set."""
    return v.read(spark, d, "part").select("p_partkey", F.when((F.col("p_size") % 2 == 0) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23"), F.col("p_brand")).otherwise("").alias("rejection"))


@query("p13_identifiers", "SELECT p_partkey, CASE WHEN length(p_brand) <= 24 AND regexp_matches(p_brand, '^[A-Za-z0-9_.:/-]+$') THEN p_brand ELSE '' END AS brand, CASE WHEN regexp_matches(replace(p_brand, '#', '/'), '^[A-Za-z0-9_.:/-]+$') THEN replace(p_brand, '#', '/') ELSE '' END AS path FROM part")
def p13(spark, d):
    p = v.read(spark, d, "part")
    return p.select("p_partkey", expr.identifier(F.col("p_brand"), 24).alias("brand"), expr.identifier(F.replace("p_brand", F.lit("#"), F.lit("/")), 100).alias("path"))


@query("p15_paid_audience", WITH + f", {_PEOPLE}, q AS (SELECT account_id, arg_max(plan, (ends_at, id)) AS plan FROM per WHERE starts_at <= {_AT} AND ends_at > {_AT} AND revoked_at IS NULL GROUP BY 1) SELECT p.id, coalesce(q.plan, 'free') AS current_plan FROM people p JOIN q ON q.account_id = p.id WHERE telegram_user_id IS NOT NULL AND NOT leaving AND NOT is_test")
def p15(spark, d):
    """Of all that a post can reach, those on a paid plan now."""
    who = reachable(people(spark, d)).select("id", F.lit("").alias("staff_plan"), F.lit(None).cast("timestamp").alias("staff_plan_expires_at"))
    return temporal.effective_plan(who, v.periods(spark, d), _at()).filter(F.col("current_plan").isin("plus", "premium"))


@query("p16_saved_views", f"WITH {_RCPT} SELECT post_id, count(*) FILTER (WHERE viewed_at IS NOT NULL) AS viewed, count(*) FILTER (WHERE status = 'delivered' AND viewed_at IS NULL) AS not_viewed, count(*) FILTER (WHERE status IN ('failed', 'blocked', 'skipped')) AS not_reached FROM rc WHERE NOT is_test GROUP BY 1")
def p16(spark, d):
    return reports.saved_views(recipients(spark, d))


@query("r19_campaign_list", f"WITH {_POSTS}, {_RCPT}, c AS (SELECT post_id, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE viewed_at IS NOT NULL) AS viewed FROM rc WHERE NOT is_test GROUP BY 1) SELECT id, CASE WHEN length(text) > 12 THEN rtrim(text[:12]) || '…' ELSE text END AS title, coalesce(delivered, 0) AS delivered, coalesce(viewed, 0) AS viewed FROM posts LEFT JOIN c ON post_id = id ORDER BY created_at DESC, id OFFSET 5 LIMIT 10")
def r19(spark, d):
    """Every post with its two counts, the newest first, one page."""
    return reports.campaign_list(posts(spark, d), recipients(spark, d), page=1, size=10, skip=5, title=12)


@query("o02_viewers_nulls_last", f"WITH {_RCPT} SELECT pk, viewed_at FROM rc WHERE post_id = 3 AND NOT is_test ORDER BY viewed_at DESC NULLS LAST, pk LIMIT 50")
def o02(spark, d):
    return recipients(spark, d).filter("post_id = 3 AND NOT is_test").orderBy(F.desc_nulls_last("viewed_at"), "pk").limit(50).select("pk", "viewed_at")


@query("o03_recent_with_account", WITH + " SELECT j.id, j.created_at, a.username, a.plan FROM (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 100) j JOIN accounts a ON a.id = j.account_id")
def o03(spark, d):
    """The newest first, then their accounts' rows."""
    jobs = v.jobs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "created_at", "account_id")
    return jobs.join(v.accounts(spark, d).select(F.col("id").alias("account_id"), "username", "plan"), "account_id").drop("account_id")


@query("o05_keyset_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 100")
def o05(spark, d):
    return v.read(spark, d, "part").filter("p_partkey > 50").orderBy("p_partkey").limit(100).select("p_partkey", "p_name")


_PLANS = "['premium','free','plus','trial'][(account_id % 4 + 1)::INT]"


@query("r11_screen_plans", WITH + f", s AS (SELECT channel, {_PLANS} AS plan, count(*) AS views, count(DISTINCT account_id) AS people FROM ev WHERE {_D} AND environment = 'production' AND event_type = 'view' GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY channel ORDER BY CASE plan WHEN 'free' THEN 0 WHEN 'plus' THEN 1 WHEN 'premium' THEN 2 ELSE 3 END, plan)::INT AS place FROM s")
def r11_plans(spark, d):
    """R11 by plan, in the plans' own order."""
    plan = F.element_at(F.array(*map(F.lit, ("premium", "free", "plus", "trial"))), (F.col("account_id") % 4 + 1).cast("int"))
    return reports.by_channel(lambda c: reports.screen_plans(v.events(spark, d).withColumn("plan_at_event", plan), dataclasses.replace(DAYS, channel=c)))


@query("r11_screen_days", WITH + f""", c AS (SELECT channel, (occurred_at + INTERVAL 5 HOUR)::DATE AS date, count(*) AS v, count(DISTINCT account_id) AS p FROM ev WHERE {_D} AND environment = 'production' AND event_type = 'view' GROUP BY 1, 2),
s AS (SELECT channel, unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24', INTERVAL 1 DAY))::DATE AS date FROM (SELECT unnest(['web', 'bot', 'mini_app']) AS channel)), j AS (SELECT channel, date, coalesce(v, 0)::BIGINT AS views, coalesce(p, 0)::BIGINT AS people FROM s LEFT JOIN c USING (channel, date))
SELECT channel, date, views, people, round_even(100.0::DOUBLE * views / greatest(max(views) OVER (PARTITION BY channel), 1), 1) AS height FROM j""")
def r11_days(spark, d):
    return reports.by_channel(lambda c: reports.screen_days(v.events(spark, d), dataclasses.replace(DAYS, channel=c)))


@query("o07_catalogue_order", WITH + ", s AS (SELECT DISTINCT category FROM reqs WHERE category IS NOT NULL), c AS (SELECT unnest(range(20))::INT AS pos, unnest(list_transform(range(20), lambda x: ((x * 7) % 40)::VARCHAR)) AS category) SELECT category, row_number() OVER (ORDER BY pos NULLS LAST, category)::INT AS place FROM s LEFT JOIN c USING (category)")
def o07(spark, d):
    """Known categories in the catalogue's order, then the unknown by name."""
    order = spark.createDataFrame([(k, str(k * 7 % 40)) for k in range(20)], "at int, category string")
    seen = v.requests(spark, d).select(expr.json_text(F.col("parameters"), "category").alias("category")).filter("category IS NOT NULL").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("at"), "category")  # a row a category
    return seen.join(order, "category", "left").select("category", F.row_number().over(w).alias("place"))


@query("o08_oldest_attempts", WITH + " SELECT job_id, no FROM att WHERE created_at < TIMESTAMP '1999-03-10 12:00:00' - INTERVAL 90 DAY ORDER BY created_at, job_id, no LIMIT 1000")
def o08(spark, d):
    """One bounded batch to delete, the oldest first."""
    return v.attempts(spark, d).filter(F.col("created_at") < _at() - F.expr("INTERVAL 90 DAYS")).orderBy("created_at", "job_id", "no").limit(1000).select("job_id", "no")


@query("o09_newest_then_search", WITH + " SELECT id, feature_id FROM (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 3000) WHERE contains(lower(feature_id), 'urgent')")
def o09(spark, d):
    """The search runs over the newest 3000 rows, not before them."""
    return v.jobs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(3000).filter(F.lower("feature_id").contains("urgent")).select("id", "feature_id")


def _sides(spark, d):
    j = v.jobs(spark, d)
    return tuple(j.filter(F.col("status") == s).select("account_id") for s in ("failed", "queued"))


_SIDES = "a AS (SELECT account_id FROM jobs WHERE status = 'failed'), b AS (SELECT account_id FROM jobs WHERE status = 'queued')"


@query("set_union", WITH + f", {_SIDES} SELECT account_id FROM a UNION SELECT account_id FROM b")
def set_union(spark, d):
    a, b = _sides(spark, d)
    return a.unionByName(b).distinct()


@query("set_intersect", WITH + f", {_SIDES} SELECT account_id FROM a INTERSECT SELECT account_id FROM b")
def set_intersect(spark, d):
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("set_except", WITH + f", {_SIDES} SELECT account_id FROM a EXCEPT SELECT account_id FROM b")
def set_except(spark, d):
    a, b = _sides(spark, d)
    return a.subtract(b)


_REFERRALS = "rf AS (SELECT id AS invitee, id % 40 AS inviter, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'qualified' END AS status, id % 5 <> 0 AS counts, created_at AS qualified_at FROM accounts)"


def _referrals(spark, d):
    a = v.accounts(spark, d)
    return a.select(F.col("id").alias("invitee"), (F.col("id") % 40).alias("inviter"), F.when(F.col("id") % 3 == 0, "pending").otherwise("qualified").alias("status"), (F.col("id") % 5 != 0).alias("counts"), F.col("created_at").alias("qualified_at"))


@query("j07_ready_inviters", WITH + f", {_REFERRALS} SELECT DISTINCT inviter FROM rf WHERE status = 'pending' AND EXISTS (SELECT 1 FROM jobs WHERE account_id = invitee AND status = 'succeeded')")
def j07(spark, d):
    done = v.jobs(spark, d).filter("status = 'succeeded'").select(F.col("account_id").alias("invitee"))
    return _referrals(spark, d).filter("status = 'pending'").join(done, "invitee", "left_semi").select("inviter").distinct()


@query("r25_referral_standing", WITH + f""", {_REFERRALS}, x AS (SELECT rf.*, EXISTS (SELECT 1 FROM jobs WHERE account_id = invitee AND status = 'succeeded') AS done FROM rf)
SELECT inviter, count(*) FILTER (WHERE status = 'qualified' AND counts) AS counted, count(*) FILTER (WHERE status = 'qualified' AND counts AND qualified_at >= TIMESTAMP '1995-01-31 19:00:00' AND qualified_at < TIMESTAMP '1995-02-28 19:00:00') AS this_month,
count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'pending' AND done) AS waiting, count(*) FILTER (WHERE status = 'qualified') AS qualified,
count(*) FILTER (WHERE status = 'qualified' AND counts AND qualified_at >= TIMESTAMP '1995-01-31 19:00:00' AND qualified_at < TIMESTAMP '1995-02-28 19:00:00') >= 5 AS month_full FROM x GROUP BY 1""")
def r25_standing(spark, d):
    done = v.jobs(spark, d).filter("status = 'succeeded'").select("account_id")
    return temporal.referral_standing(_referrals(spark, d), done, F.lit("1995-02-10 12:00:00").cast("timestamp"))


@query("j08_settled_posts", f"WITH {_POSTS}, {_RCPT} SELECT id, created_at FROM posts WHERE id NOT IN (SELECT post_id FROM rc WHERE status = 'pending' AND pk % 4 = 0)")
def j08(spark, d):
    """J8 and Q10. Three of four pending copies are those of accounts that have gone: skipped, nothing waits for them."""
    skipped = F.when((F.col("status") == "pending") & (F.col("pk") % 4 != 0), "skipped").otherwise(F.col("status"))
    return queues.settled(posts(spark, d), recipients(spark, d).withColumn("status", skipped)).select("id", "created_at")


@query("j09_unreferenced_keys", """WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'review/a/' || (p_partkey % 50) || '/f' ELSE 'file/' || p_partkey END AS key FROM part),
used AS (SELECT 'file/' || l_partkey AS key FROM lineitem WHERE l_linenumber = 7 UNION SELECT 'file/' || l_partkey FROM lineitem WHERE l_linenumber = 6 AND l_returnflag = 'R' UNION SELECT key FROM k JOIN supplier ON starts_with(key, 'review/') AND split_part(key, '/', 3) = s_suppkey::VARCHAR AND s_suppkey % 2 = 0)
SELECT p_partkey, key FROM k WHERE key NOT IN (SELECT key FROM used)""")
def j09(spark, d):
    n = F.col("p_partkey")
    keys = v.read(spark, d, "part").select("p_partkey", F.when(n % 10 == 0, F.concat(F.lit("review/a/"), (n % 50).cast("string"), F.lit("/f"))).otherwise(F.concat(F.lit("file/"), n.cast("string"))).alias("key"))
    li, file = v.read(spark, d, "lineitem"), F.concat(F.lit("file/"), F.col("l_partkey").cast("string")).alias("key")
    alive = v.read(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("record"))
    records = keys.filter(F.col("key").startswith("review/")).withColumn("record", F.split_part("key", F.lit("/"), F.lit(3))).join(alive, "record", "left_semi").select("key")
    return queues.unreferenced(keys, li.filter("l_linenumber = 7").select(file), li.filter("l_linenumber = 6 AND l_returnflag = 'R'").select(file), records)


TYPED = "@user5, https://t.me/User7;user5 12007\nno_such_one bad! 99 user7/"


@query("r20_audience_preview", WITH + f""", {_PEOPLE}, r AS (SELECT * FROM people WHERE telegram_user_id IS NOT NULL AND NOT leaving AND NOT is_test), e AS (SELECT * FROM (VALUES (0, 'user5', 'name'), (1, 'User7', 'name'), (2, '12007', 'id'), (3, 'no_such_one', 'name'), (4, 'bad!', 'invalid'), (5, '99', 'id')) t(pos, entry, kind)),
m AS (SELECT pos, id, count(*) OVER (PARTITION BY pos) AS n, row_number() OVER (PARTITION BY pos ORDER BY created_at DESC, id DESC) AS k FROM e JOIN r ON (kind = 'id' AND telegram_user_id::VARCHAR = entry) OR (kind = 'name' AND lower(handle) = lower(entry)))
SELECT e.pos::INT AS pos, entry, m.id AS account_id, kind, coalesce(kind = 'name' AND n > 1, false) AS ambiguous FROM e LEFT JOIN m ON m.pos = e.pos AND k = 1""")
def r20(spark, d):
    """What was typed for some people, and whom each entry names; of several with a name the newest."""
    typed = spark.createDataFrame([(TYPED,)], "text string").select(F.posexplode(expr.typed_names(F.col("text"))).alias("pos", "e")).select("pos", "e.entry", "e.kind")
    return reports.named_accounts(typed, reachable(people(spark, d)))


@query("a18_batch_outcomes", "WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber % 5 = 0 THEN 'failed' WHEN l_linenumber % 4 = 0 THEN 'no_op' WHEN l_linenumber % 3 = 0 AND l_partkey % 2 = 0 THEN 'running' WHEN l_partkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS st FROM lineitem) SELECT l_orderkey AS run, CASE WHEN bool_or(st = 'running') THEN 'queued' WHEN bool_and(st IN ('succeeded', 'no_op')) THEN 'succeeded' WHEN bool_or(st IN ('succeeded', 'no_op')) THEN 'partial' ELSE 'failed' END AS outcome FROM s GROUP BY 1")
def a18(spark, d):
    return reports.batch_outcomes(_children(spark, d))


def _children(spark, d):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    status = F.when(n % 5 == 0, "failed").when(n % 4 == 0, "no_op").when((n % 3 == 0) & (p % 2 == 0), "running").when(p % 5 == 0, "failed").otherwise("succeeded")
    return v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), status.alias("status"))


@query("r29_batch_counts", f"WITH {_RCPT} SELECT post_id, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM rc GROUP BY 1")
def r29(spark, d):
    """A histogram of states for each run."""
    kinds = ["delivered", "failed", "blocked", "pending", "skipped"]
    return recipients(spark, d).groupBy("post_id").pivot("status", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query("r26_storage_totals", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS remote_files, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0)::BIGINT AS remote_bytes, count(*) FILTER (WHERE l_returnflag <> 'R') AS waiting_files, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0)::BIGINT AS waiting_bytes FROM lineitem")
def r26(spark, d):
    """A20."""
    return reports.storage_totals(v.read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("remote"), F.col("l_quantity").cast("long").alias("size")))


@query("a21_distinct_sources", WITH + f" SELECT event_type, count(DISTINCT properties->>'$.k') AS sources FROM ev WHERE {_D} GROUP BY 1")
def a21(spark, d):
    e = v.events(spark, d).filter(DAYS.during("occurred_at"))
    return e.groupBy("event_type").agg(F.count_distinct(expr.json_text(F.col("properties"), "k")).alias("sources"))


@query("r32_practice_scores", "WITH q AS (SELECT l_orderkey AS project, l_partkey % 5 + 1 AS marks, l_partkey % 7 AS topic, l_suppkey % 3 <> 0 AS ok FROM lineitem) SELECT project, coalesce(sum(marks) FILTER (WHERE ok), 0)::BIGINT AS score, sum(marks)::BIGINT AS max_score, array_to_string(list_sort(coalesce(list(DISTINCT topic) FILTER (WHERE NOT ok), [])), ',') AS weak FROM q GROUP BY 1")
def r32(spark, d):
    """A22."""
    li = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), (F.col("l_partkey") % 5 + 1).alias("marks"), (F.col("l_partkey") % 7).alias("topic"), (F.col("l_suppkey") % 3 != 0).alias("correct"))
    return reports.practice(li).select("project", "score", "max_score", F.array_join(F.transform("weak", lambda x: x.cast("string")), ",").alias("weak"))


@query("r14_by_rejection", WITH + f" SELECT CASE stage WHEN 'O' THEN 'content' ELSE '' END AS rejection, count(*) AS responses FROM att WHERE {_Y} AND environment = 'production' AND status = 'rejected' GROUP BY 1")
def r14_rejections(spark, d):
    a = v.attempts(spark, d).withColumn("rejection", F.when(F.col("stage") == "O", "content").otherwise(""))
    return reports.rejections(a, YEAR)


@query("r17_system_snapshot", WITH + f""", f AS (SELECT l_orderkey, l_quantity::BIGINT AS size, CASE l_returnflag WHEN 'A' THEN 'deleted' ELSE 'ready' END AS state, l_shipdate::TIMESTAMP AS expires_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT id FROM accounts WHERE NOT is_test)), h AS (SELECT * FROM f WHERE state NOT IN ('deleted', 'revoked'))
SELECT count(*) AS stored_files, coalesce(sum(size), 0)::BIGINT AS storage, count(*) FILTER (WHERE expires_at <= {_AT}) AS expired_pending, (SELECT count(*) FROM jobs WHERE status = 'queued' AND {_Y} AND account_id IN (SELECT id FROM accounts WHERE NOT is_test)) AS outbox_pending FROM h""")
def r17(spark, d):
    files = v.read(spark, d, "lineitem").join(v.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    files = files.select("account_id", F.col("l_quantity").cast("long").alias("size"), F.when(F.col("l_returnflag") == "A", "deleted").otherwise("ready").alias("state"), F.col("l_shipdate").cast("timestamp").alias("expires_at"))
    return reports.system_snapshot(files, v.jobs(spark, d), v.accounts(spark, d), YEAR, _at())


@query("r30_expiring", WITH + f" SELECT account_id, count(*) AS n, max(ends_at) AS last_end FROM per WHERE revoked_at IS NULL GROUP BY 1 HAVING max(ends_at) <= {_AT}")
def r30(spark, d):
    """Accounts whose last period is over; one that runs keeps its account off the list, however many have ended."""
    due = v.periods(spark, d).filter(F.col("revoked_at").isNull())
    return due.groupBy("account_id").agg(F.count("*").alias("n"), F.max("ends_at").alias("last_end")).filter(F.col("last_end") <= _at())


@query("r31_audit_changes", WITH + """, x AS (SELECT id, properties AS after, lag(properties) OVER (PARTITION BY account_id ORDER BY occurred_at, id) AS before FROM ev WHERE event_type IN ('signup', 'purchase'))
SELECT id, 'k' AS key, before->>'$.k' AS before, after->>'$.k' AS after FROM x WHERE (before->>'$.k') IS DISTINCT FROM (after->>'$.k')""")
def r31(spark, d):
    """field by field what changed, for the audit."""
    w = Window.partitionBy("account_id").orderBy("occurred_at", "id")
    e = v.events(spark, d).filter("event_type IN ('signup', 'purchase')").select("id", F.col("properties").alias("after"), F.lag("properties").over(w).alias("before"))
    return e.select("id", F.explode(expr.json_changes(F.col("before"), F.col("after"))).alias("c")).select("id", "c.key", "c.before", "c.after")
