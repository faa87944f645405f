"""Every query over the star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions import expr, text
from ..operators import checks, documents, queues, reports, review, temporal
from ..sources import views as v
from ..streaming import events as streams
from . import amounts, exports, facts, listings, outboxes, registry, scripts, states, values  # noqa: F401  each registers its queries
from .filters import Filters
from .registry import oracle_sql, queries, query  # noqa: F401

YEAR = Filters("1998-01-01", "1998-12-31")
DAYS = Filters("2024-01-05", "2024-01-25", as_of="2024-01-24 12:00:00")
ACTS = ("view", "purchase")
AT = "1999-03-10 12:00:00"


def _moment(text: str):
    """Columns are made inside queries: the module imports before any session."""
    return F.lit(text).cast("timestamp")


# The same bounds in UTC: Tashkent is five hours ahead in all of these years.
_Y = "created_at >= TIMESTAMP '1997-12-31 19:00:00' AND created_at < TIMESTAMP '1998-12-30 19:00:00'"
_D = "occurred_at >= TIMESTAMP '2024-01-04 19:00:00' AND occurred_at < TIMESTAMP '2024-01-24 19:00:00'"
_NOW_D = "TIMESTAMP '2024-01-24 12:00:00'"
_NOW_Y = "TIMESTAMP '1998-12-30 19:00:00'"
_AT = "TIMESTAMP '1999-03-10 12:00:00'"
_WITH = registry.WITH

_OURJ = f"oj AS (SELECT j.* FROM jobs j WHERE {_Y} AND account_id IN (SELECT id FROM accounts WHERE NOT is_test))"
_RATE = "CASE WHEN {1} > 0 THEN round_even(100.0::DOUBLE * {0} / {1}, 1) END"


@query("r01_overview_totals", _WITH + f""", {_OURJ},
mine AS (SELECT * FROM accounts WHERE NOT is_test AND {_Y}),
fs AS (SELECT account_id, min(completed_at) AS s FROM jobs WHERE status = 'succeeded' GROUP BY 1),
g AS (SELECT count(*) AS mature_cohort, count(*) FILTER (WHERE s <= created_at + INTERVAL 7 DAY) AS activated_users FROM mine LEFT JOIN fs ON id = account_id WHERE created_at <= {_NOW_Y} - INTERVAL 7 DAY),
t AS (SELECT count(DISTINCT account_id) AS active_users, count(*) FILTER (WHERE status = 'succeeded') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'queued') AS queued FROM oj)
SELECT (SELECT count(*) FROM mine) AS new_users, t.*, g.*, {_RATE.format('completed', '(completed + failed)')} AS success_rate, {_RATE.format('activated_users', 'mature_cohort')} AS activated FROM t, g""")
def r01(spark, d):
    return reports.totals(v.accounts(spark, d), v.jobs(spark, d), YEAR)


_DAILY = """, c AS (SELECT (occurred_at + INTERVAL 5 HOUR)::DATE AS date, count(*) AS n FROM ev WHERE {w} GROUP BY 1),
s AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24', INTERVAL 1 DAY))::DATE AS date),
j AS (SELECT s.date, coalesce(n, 0)::BIGINT AS count FROM s LEFT JOIN c USING (date))
SELECT date, strftime(date, '%d.%m') AS label, count, round_even(100.0::DOUBLE * count / greatest((SELECT max(count) FROM j), 1), 1) AS height FROM j"""


@query("r02_daily_signups", _WITH + _DAILY.format(w=_D + " AND event_type = 'signup' AND environment = 'production'"))
def r02(spark, d):
    return reports.daily(DAYS.events(v.events(spark, d)).filter("event_type = 'signup'"), "occurred_at", DAYS)


@query("r03_feature_outcomes", _WITH + f""", {_OURJ} SELECT feature_id, count(*) AS attempts, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
count(*) FILTER (WHERE status = 'canceled') AS canceled, count(*) FILTER (WHERE status = 'no_op') AS no_op, count(DISTINCT account_id) AS users FROM oj GROUP BY 1""")
def r03(spark, d):
    return reports.features(v.accounts(spark, d), v.jobs(spark, d), YEAR)


@query("r05_account_mixes", _WITH + f""", m AS (SELECT * FROM accounts WHERE NOT is_test AND {_Y}), x AS (SELECT 'plan' AS dimension, plan AS value FROM m UNION ALL SELECT 'first_channel', first_channel FROM m UNION ALL SELECT 'locale', locale FROM m)
SELECT dimension, value, count(*) AS count FROM x GROUP BY 1, 2""")
def r05(spark, d):
    return reports.mixes(v.accounts(spark, d), YEAR)


@query("r06_latency_ranks", _WITH + f""", {_OURJ}, s AS (SELECT feature_id, round_even((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 2) AS s FROM oj WHERE status = 'succeeded'),
l AS (SELECT feature_id, list_sort(list(s)) AS x, count(*) AS n FROM s GROUP BY 1)
SELECT feature_id, x[least(n - 1, floor(n * 0.5))::INT + 1] AS median, x[least(n - 1, floor(n * 0.95))::INT + 1] AS p95 FROM l""")
def r06(spark, d):
    return reports.latency(v.accounts(spark, d), v.jobs(spark, d), YEAR)


_COHORT = f"cohort AS (SELECT id AS account_id, created_at FROM eacc WHERE NOT is_test AND created_at >= TIMESTAMP '2024-01-04 19:00:00' AND created_at < TIMESTAMP '2024-01-24 19:00:00')"


@query("r07_acquisition", _WITH + f""", {_COHORT}, st AS (SELECT unnest([0, 1, 2, 3])::INT AS step, unnest(['signup', 'view', 'click', 'purchase']) AS event),
c AS (SELECT event_type, count(DISTINCT account_id) AS n FROM ev WHERE {_D} AND account_id IN (SELECT account_id FROM cohort) GROUP BY 1)
SELECT step, event, CASE WHEN step = 0 THEN (SELECT count(*) FROM cohort) ELSE coalesce(n, 0) END::BIGINT AS count FROM st LEFT JOIN c ON event = event_type""")
def r07(spark, d):
    return reports.acquisition(v.event_accounts(spark, d), v.events(spark, d), DAYS)


@query("r08_retention", _WITH + f""", {_COHORT}, m AS (SELECT account_id, created_at, day FROM cohort, (SELECT unnest([1, 7, 30])::INT AS day) WHERE created_at + to_days(day + 1) <= {_NOW_D}),
k AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE ev.account_id = m.account_id AND event_type IN ('view', 'purchase') AND occurred_at < {_NOW_D} AND occurred_at >= m.created_at + to_days(day) AND occurred_at < m.created_at + to_days(day + 1)) AS r FROM m)
SELECT day, count(*) AS eligible, count(*) FILTER (WHERE r) AS retained, round_even(100.0::DOUBLE * count(*) FILTER (WHERE r) / count(*), 1) AS percent FROM k GROUP BY 1""")
def r08(spark, d):
    return reports.retention(v.event_accounts(spark, d), v.events(spark, d), DAYS, ACTS)


@query("r09_activity", _WITH + f""", w AS (SELECT account_id, max(occurred_at) AS last FROM ev WHERE event_type IN ('view', 'purchase') AND occurred_at < {_NOW_D} AND occurred_at >= {_NOW_D} - INTERVAL 30 DAY
AND account_id IN (SELECT id FROM eacc WHERE NOT is_test AND created_at < TIMESTAMP '2024-01-24 19:00:00') GROUP BY 1)
SELECT days, count(*) FILTER (WHERE last >= {_NOW_D} - to_days(days)) AS users FROM w, (SELECT unnest([1, 7, 30])::INT AS days) GROUP BY 1""")
def r09(spark, d):
    return reports.activity(v.event_accounts(spark, d), v.events(spark, d), DAYS, ACTS)


@query("r09_activity_of_channel", _WITH + f""", w AS (SELECT account_id, max(occurred_at) AS last FROM ev WHERE event_type IN ('view', 'purchase') AND channel = 'web' AND occurred_at < {_NOW_D} AND occurred_at >= {_NOW_D} - INTERVAL 30 DAY
AND account_id IN (SELECT id FROM eacc WHERE NOT is_test AND created_at < TIMESTAMP '2024-01-24 19:00:00') GROUP BY 1)
SELECT days, count(*) FILTER (WHERE last >= {_NOW_D} - to_days(days)) AS users FROM w, (SELECT unnest([1, 7, 30])::INT AS days) GROUP BY 1""")
def r09_channel(spark, d):
    """What people did in one channel, whichever they came through."""
    return reports.activity(v.event_accounts(spark, d), v.events(spark, d), dataclasses.replace(DAYS, channel="web"), ACTS)


def _of_channel(c: str) -> Filters:
    return dataclasses.replace(DAYS, channel=c)


@query("r10_step_funnel", _WITH + f""", st AS (SELECT channel, unnest([0, 1, 2, 3])::INT AS step, unnest(['signup', 'view', 'click', 'purchase']) AS event FROM (SELECT unnest(['web', 'bot', 'mini_app']) AS channel)),
c AS (SELECT channel, event_type, count(DISTINCT account_id) AS n FROM ev WHERE {_D} AND environment = 'production' GROUP BY 1, 2), r AS (SELECT st.channel, step, event, coalesce(n, 0)::BIGINT AS count FROM st LEFT JOIN c ON event = event_type AND st.channel = c.channel)
SELECT channel, step, event, count, CASE WHEN lag(count) OVER o > 0 THEN round_even(100.0::DOUBLE * count / lag(count) OVER o, 0)::BIGINT END AS share FROM r WINDOW o AS (PARTITION BY channel ORDER BY step)""")
def r10(spark, d):
    return reports.by_channel(lambda c: reports.step_funnel(v.events(spark, d), DAYS, channel=c))


@query("r11_screen_sources", _WITH + f""" SELECT channel, coalesce(properties->>'$.k', 'other') AS source, count(*) AS views, count(DISTINCT account_id) AS people FROM ev WHERE {_D} AND environment = 'production' AND event_type = 'view' GROUP BY 1, 2""")
def r11_sources(spark, d):
    return reports.by_channel(lambda c: reports.screen_views(v.events(spark, d), _of_channel(c)))


def _requests(spark, d):
    return v.events(spark, d).filter("event_type IN ('click', 'purchase')").select("account_id", F.col("occurred_at").alias("created_at"), (F.col("event_type") == "purchase").alias("approved"))


_VIEWERS = f""", seen AS (SELECT * FROM ev WHERE {_D} AND environment = 'production' AND event_type = 'view'),
p AS (SELECT channel, account_id, count(*) AS views, min(occurred_at) AS first_view, max(occurred_at) AS last_view, arg_max(coalesce(properties->>'$.k', 'other'), (occurred_at, id)) AS last_source FROM seen GROUP BY 1, 2),
q AS (SELECT p.*, EXISTS (SELECT 1 FROM ev r WHERE r.account_id = p.account_id AND event_type IN ('click', 'purchase') AND occurred_at >= first_view) AS started,
EXISTS (SELECT 1 FROM ev r WHERE r.account_id = p.account_id AND event_type = 'purchase' AND occurred_at >= first_view) AS paid FROM p) """


@query("r11_screen_viewers", _WITH + _VIEWERS + "SELECT * FROM q")
def r11_viewers(spark, d):
    return reports.by_channel(lambda c: reports.screen_viewers(v.events(spark, d), _requests(spark, d), _of_channel(c)))


@query("r11_screen_totals", _WITH + _VIEWERS + """SELECT channel, (SELECT count(*) FROM seen WHERE seen.channel = q.channel) AS views, count(*) AS people, count(*) FILTER (WHERE started) AS started, count(*) FILTER (WHERE paid) AS paid,
round_even(100.0::DOUBLE * count(*) FILTER (WHERE started) / count(*), 0)::BIGINT AS started_share, round_even(100.0::DOUBLE * count(*) FILTER (WHERE paid) / count(*), 0)::BIGINT AS paid_share FROM q GROUP BY channel""")
def r11_totals(spark, d):
    return reports.by_channel(lambda c: reports.screen_totals(v.events(spark, d), _requests(spark, d), _of_channel(c)))


@query("r12_refusals", _WITH + f""", s AS (SELECT min(occurred_at) AS since FROM ev WHERE event_type = 'error' AND environment = 'production'),
t AS (SELECT * FROM ev, s WHERE {_D} AND environment = 'production' AND event_type IN ('click', 'error') AND occurred_at >= since)
SELECT coalesce(properties->>'$.k', 'unknown') AS code, count(*) AS refusals, count(DISTINCT account_id) AS people, (SELECT count(*) FROM t) AS tried, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t), 1) AS share FROM t WHERE event_type = 'error' GROUP BY 1""")
def r12(spark, d):
    return reports.refusals(v.events(spark, d), DAYS)


_CATEGORY_DAYS = "created_at + INTERVAL 26 YEAR >= TIMESTAMP '2024-01-04 19:00:00' AND created_at + INTERVAL 26 YEAR < TIMESTAMP '2024-01-24 19:00:00'"
_MADE = f"cj AS (SELECT id, status, account_id, CASE WHEN id % 4 <> 0 THEN (id % 12)::VARCHAR END AS category FROM jobs WHERE {_CATEGORY_DAYS} AND account_id IN (SELECT id FROM accounts WHERE NOT is_test))"


@query("r13_categories", _WITH + f""", {_MADE}, made AS (SELECT category, count(*) AS attempts, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(DISTINCT account_id) AS users FROM cj WHERE category IS NOT NULL GROUP BY 1),
ch AS (SELECT coalesce(properties->>'$.k', 'unknown') AS category, count(*) AS chosen, count(DISTINCT account_id) AS choosers FROM ev WHERE {_D} AND environment = 'production' AND event_type = 'click' GROUP BY 1)
SELECT category, coalesce(chosen, 0) AS chosen, coalesce(choosers, 0) AS choosers, coalesce(attempts, 0) AS attempts, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(users, 0) AS users,
CASE WHEN succeeded + failed > 0 THEN round_even(100.0::DOUBLE * failed / (succeeded + failed), 1) END AS failure_rate FROM made FULL JOIN ch USING (category)""")
def r13(spark, d):
    return reports.categories(_made(spark, d), v.events(spark, d), v.accounts(spark, d), DAYS)


def _made(spark, d):
    """Jobs under the period of the events: 26 years later. Three in four have a category, and some carry codes."""
    n = F.col("id")
    codes = [F.when(n % k == 0, c) for k, c in ((3, "facts_blanked"), (5, "block_fallback:table"), (7, "template_fallback"), (11, "repinned"), (2, "other"))]
    moved = F.col("created_at") + F.expr("INTERVAL 26 YEARS")
    return v.jobs(spark, d).withColumn("created_at", moved).withColumn("category", F.when(n % 4 != 0, (n % 12).cast("string"))).withColumn("warnings", F.array_compact(F.array(*codes)))


@query("r13_code_shares", _WITH + f""", {_MADE}, ok AS (SELECT * FROM cj WHERE category IS NOT NULL AND status = 'succeeded')
SELECT category, count(*) AS documents, round_even(100.0::DOUBLE * count(*) FILTER (WHERE id % 3 = 0) / count(*), 1) AS facts_blanked, round_even(100.0::DOUBLE * count(*) FILTER (WHERE id % 7 = 0) / count(*), 1) AS template_fallback,
round_even(100.0::DOUBLE * count(*) FILTER (WHERE id % 5 = 0) / count(*), 1) AS block_fallback, round_even(100.0::DOUBLE * count(*) FILTER (WHERE id % 11 = 0) / count(*), 1) AS repinned FROM ok GROUP BY 1""")
def r13_codes(spark, d):
    return reports.code_shares(_made(spark, d), v.accounts(spark, d), DAYS)


@query("r13_share_of_all", _WITH + f""", {_MADE} SELECT count(category) AS made, count(*) AS every, CASE WHEN count(*) > 0 THEN round_even(100.0::DOUBLE * count(category) / count(*), 1) END AS share FROM cj""")
def r13_share(spark, d):
    return DAYS.jobs(_made(spark, d), v.accounts(spark, d)).agg(F.count("category").alias("made"), F.count("*").alias("every")).select("*", expr.rate(F.col("made"), F.col("every")).alias("share"))


@query("r14_usage_totals", _WITH + f""" SELECT count(*) AS attempts, count(*) FILTER (WHERE duplicate_response) AS duplicates, count(*) FILTER (WHERE status IN ('failed', 'rejected')) AS failed, count(*) FILTER (WHERE NOT duplicate_response) AS responses,
CASE WHEN count(*) FILTER (WHERE NOT duplicate_response) = 0 THEN 0 ELSE sum(input_tokens) FILTER (WHERE NOT duplicate_response) END::BIGINT AS input_tokens, CASE WHEN count(*) FILTER (WHERE NOT duplicate_response) = 0 THEN 0 ELSE sum(output_tokens) FILTER (WHERE NOT duplicate_response) END::BIGINT AS output_tokens,
count(*) FILTER (WHERE NOT duplicate_response AND input_tokens IS NULL) AS input_tokens_unknown, count(*) FILTER (WHERE NOT duplicate_response AND output_tokens IS NULL) AS output_tokens_unknown FROM att WHERE {_Y} AND environment = 'production'""")
def r14(spark, d):
    return reports.usage_totals(v.attempts(spark, d), YEAR)


@query("r14_usage_of_channel", _WITH + f""" SELECT count(*) FILTER (WHERE environment = 'production') AS attempts, count(*) FILTER (WHERE environment = 'unknown') AS unknown_environment FROM att WHERE {_Y} AND locale = 'uz' AND origin_channel = 'web'""")
def r14_channel(spark, d):
    """A locale's attempts of one channel, and those that don't say where they ran."""
    f = dataclasses.replace(YEAR, locale="uz", channel="web")
    a = v.attempts(spark, d)
    return reports.usage_totals(a, f).select("attempts").crossJoin(reports.unknown_environment(a, f))  # two single rows


@query("r14_usage_by_model", _WITH + f""" SELECT provider, feature_id, requested_model, resolved_model, stage, count(*) AS responses, sum(input_tokens)::BIGINT AS input_sum, sum(output_tokens)::BIGINT AS output_sum, count(*) FILTER (WHERE input_tokens IS NULL) AS input_unknown, count(*) FILTER (WHERE output_tokens IS NULL) AS output_unknown
FROM att WHERE {_Y} AND environment = 'production' AND NOT duplicate_response GROUP BY ALL""")
def r14_models(spark, d):
    return reports.usage_by_model(v.attempts(spark, d), YEAR)


_PY = _Y.replace("created_at", "{0}")


@query("r15_finance", _WITH + f""", who AS (SELECT id FROM accounts WHERE NOT is_test AND created_at < {_NOW_Y}), e AS (SELECT * FROM pay WHERE provider <> 'referral' AND account_id IN (SELECT id FROM who)),
g AS (SELECT coalesce(sum(amount), 0)::BIGINT AS gross, count(DISTINCT account_id) AS payers FROM e WHERE {_PY.format('occurred_at')}),
b AS (SELECT coalesce(sum(amount), 0)::BIGINT AS refunds FROM ref WHERE status = 'confirmed' AND {_PY.format('confirmed_at')} AND payment_id IN (SELECT id FROM e)),
f AS (SELECT count(*) AS first_time FROM (SELECT account_id, min(occurred_at) AS m FROM e GROUP BY 1) WHERE {_PY.format('m')}),
p AS (SELECT count(DISTINCT account_id) AS paid FROM per WHERE provider <> 'referral' AND starts_at <= {_NOW_Y} AND ends_at > {_NOW_Y} AND (revoked_at IS NULL OR revoked_at > {_NOW_Y}) AND account_id IN (SELECT id FROM who))
SELECT gross, refunds, gross - refunds AS net, payers, paid, first_time FROM g, b, f, p""")
def r15(spark, d):
    return reports.finance(v.accounts(spark, d), v.payments(spark, d), v.refunds(spark, d), v.periods(spark, d), YEAR)


_L = "({0} + INTERVAL 5 HOUR)::DATE"


@query("r16_today", _WITH + f""", days AS (SELECT unnest([DATE '1998-06-14', DATE '1998-06-15']) AS date), mine AS (SELECT * FROM accounts WHERE NOT is_test)
SELECT date, (SELECT count(*) FROM mine WHERE {_L.format('created_at')} = date) AS new_users, (SELECT count(DISTINCT account_id) FROM jobs WHERE account_id IN (SELECT id FROM mine) AND {_L.format('created_at')} = date) AS active_users,
(SELECT count(*) FROM jobs WHERE account_id IN (SELECT id FROM mine) AND {_L.format('created_at')} = date) AS tasks, coalesce((SELECT sum(amount) FROM pay WHERE provider <> 'referral' AND {_L.format('occurred_at')} = date), 0)::BIGINT AS received FROM days""")
def r16(spark, d):
    return reports.today(v.accounts(spark, d), v.jobs(spark, d), v.payments(spark, d), YEAR, "1998-06-15")


def _recipients(spark, d):
    li = v.read(spark, d, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    names = F.array(*map(F.lit, ("delivered", "delivered", "failed", "blocked", "pending", "skipped", "delivered")))
    return li.select((F.col("l_suppkey") % 20).alias("post_id"), (n % 31 == 0).alias("is_test"), F.element_at(names, (n % 7 + 1).cast("int")).alias("status"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_shipdate")).alias("viewed_at"))


@query("r18_campaigns", """WITH x AS (SELECT l_suppkey % 20 AS post_id, (l_orderkey + l_linenumber) % 31 = 0 AS is_test, ['delivered','delivered','failed','blocked','pending','skipped','delivered'][((l_orderkey + l_linenumber) % 7 + 1)::INT] AS status, l_partkey % 3 = 0 AS seen FROM lineitem),
c AS (SELECT post_id, count(*) AS audience, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE seen) AS viewed, count(*) FILTER (WHERE status = 'pending') AS waiting FROM x WHERE NOT is_test GROUP BY 1)
SELECT *, CASE WHEN delivered > 0 THEN round_even(100.0::DOUBLE * viewed / delivered, 0)::BIGINT ELSE 0 END AS viewed_share, CASE WHEN audience > 0 THEN round_even(100.0::DOUBLE * (delivered + failed + blocked + skipped) / audience, 0)::BIGINT ELSE 0 END AS progress FROM c""")
def r18(spark, d):
    return reports.campaign(_recipients(spark, d))


@query("r21_weekly_usage", _WITH + f""" SELECT account_id, 3::BIGINT AS "limit", count(*) AS used, greatest(3 - count(*), 0)::BIGINT AS remaining FROM jobs WHERE status NOT IN ('failed', 'canceled', 'expired', 'no_op')
AND created_at >= date_trunc('week', {_AT} + INTERVAL 5 HOUR) - INTERVAL 5 HOUR AND created_at < date_trunc('week', {_AT} + INTERVAL 5 HOUR) - INTERVAL 5 HOUR + INTERVAL 7 DAY GROUP BY 1""")
def r21(spark, d):
    return temporal.weekly_usage(v.jobs(spark, d), _moment(AT), 3)


def _counted(spark, d):
    return v.jobs(spark, d).groupBy(F.col("account_id").alias("inviter")).agg(F.count_if(F.col("status") == "succeeded").alias("counted")).withColumn("earned", F.lit(0))


@query("r25_referral_progress", _WITH + " SELECT account_id AS inviter, count(*) FILTER (WHERE status = 'succeeded') AS counted, count(*) FILTER (WHERE status = 'succeeded') // 5 AS tier, count(*) FILTER (WHERE status = 'succeeded') % 5 AS have, 5 - count(*) FILTER (WHERE status = 'succeeded') % 5 AS remaining FROM jobs GROUP BY 1")
def r25(spark, d):
    return temporal.progress(_counted(spark, d))


def _prices(spark, d):
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("plan"), F.floor("p_retailprice").cast("long").alias("price"), F.floor(F.col("p_retailprice") * F.col("p_size") / 40).cast("long").alias("reduced"), F.concat(F.lit("1999-03-"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0")).alias("last_day"))


@query("r28_plan_offers", f"""WITH p AS (SELECT p_partkey AS plan, floor(p_retailprice)::BIGINT AS price, floor(p_retailprice * p_size / 40)::BIGINT AS reduced, try_cast('1999-03-' || lpad((p_partkey % 40)::VARCHAR, 2, '0') AS DATE) AS day FROM part),
o AS (SELECT *, coalesce(day::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 5 HOUR > {_AT} AND reduced > 0 AND reduced < price, false) AS discounted FROM p)
SELECT plan, CASE WHEN discounted THEN reduced ELSE price END AS price, discounted, CASE WHEN discounted THEN floor((price - reduced) * 100 / price)::BIGINT END AS percent, CASE WHEN discounted THEN day::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 5 HOUR END AS ends_at FROM o""")
def r28(spark, d):
    return temporal.price_at(_prices(spark, d), _moment(AT))


_FORCE = f"starts_at <= {_AT} AND ends_at > {_AT} AND revoked_at IS NULL"


@query("j11_effective_plan", _WITH + f""", q AS (SELECT account_id, arg_max(plan, (ends_at, id)) AS plan FROM per WHERE {_FORCE} GROUP BY 1)
SELECT a.id, CASE WHEN a.id % 17 = 0 THEN 'premium' ELSE coalesce(q.plan, 'free') END AS current_plan FROM accounts a LEFT JOIN q ON a.id = q.account_id""")
def j11(spark, d):
    a = v.accounts(spark, d).select("id", F.when(F.col("id") % 17 == 0, "premium").otherwise("").alias("staff_plan"), F.lit(None).cast("timestamp").alias("staff_plan_expires_at"))
    return temporal.effective_plan(a, v.periods(spark, d), _moment(AT))


@query("j10_plan_as_of_job", _WITH + """, f AS (SELECT id, account_id, completed_at FROM jobs WHERE completed_at IS NOT NULL), b AS (SELECT f.id, arg_max(p.plan, (p.ends_at, p.id)) AS plan FROM f JOIN per p ON p.account_id = f.account_id AND p.starts_at <= f.completed_at AND p.ends_at > f.completed_at GROUP BY 1)
SELECT f.id, f.account_id, f.completed_at, coalesce(b.plan, 'free') AS plan FROM f LEFT JOIN b USING (id)""")
def j10(spark, d):
    return temporal.as_of(v.jobs(spark, d).filter("completed_at IS NOT NULL").select("id", "account_id", "completed_at"), v.periods(spark, d), "completed_at")


@query("j12_renewals_due", _WITH + f" SELECT account_id, max(ends_at) AS ends_at FROM per WHERE revoked_at IS NULL GROUP BY 1 HAVING max(ends_at) >= {_AT} AND max(ends_at) < {_AT} + INTERVAL 60 DAY")
def j12(spark, d):
    return temporal.ending_last(v.periods(spark, d), _moment(AT), _moment(AT) + F.expr("INTERVAL 60 DAYS"))


def _friends(spark, d):
    return v.jobs(spark, d).filter("status = 'succeeded'").select("id", (F.col("account_id") % 40).alias("inviter"), F.col("created_at").alias("qualified_at"))


@query("w10_monthly_counts", _WITH + """, f AS (SELECT id, account_id % 40 AS inviter, created_at AS qualified_at, date_trunc('month', created_at + INTERVAL 5 HOUR) - INTERVAL 5 HOUR AS month FROM jobs WHERE status = 'succeeded'),
r AS (SELECT id, inviter, month, row_number() OVER (PARTITION BY inviter, month ORDER BY qualified_at, id)::INT AS place FROM f) SELECT *, place <= 5 AS counts FROM r""")
def w10(spark, d):
    return temporal.monthly_counts(_friends(spark, d))


@query("w10_carried_counts")
def w10_carried(spark, d):
    return temporal.carried_counts(_friends(spark, d))


@query("w11_tier_rewards", _WITH + """, c AS (SELECT account_id AS inviter, count(*) FILTER (WHERE status = 'succeeded') // 5 AS t FROM jobs GROUP BY 1) SELECT inviter, unnest(generate_series(1, t))::INT AS tier, unnest(generate_series(1, t)) * 30 AS days FROM c WHERE t > 0""")
def w11(spark, d):
    return temporal.rewards(_counted(spark, d))


@query("w12_period_stacking", "WITH RECURSIVE " + v.SQL + """, p AS (SELECT account_id, id, revoked_at IS NULL AS holds, CASE plan WHEN 'premium' THEN 2 WHEN 'plus' THEN 1 ELSE 0 END AS rk, starts_at AS bought, row_number() OVER (PARTITION BY account_id ORDER BY starts_at, id) AS n FROM per),
s AS (SELECT account_id, id, n, bought AS starts_at, bought + INTERVAL 30 DAY AS ends_at, CASE WHEN holds THEN bought + INTERVAL 30 DAY END AS last_end, CASE WHEN holds THEN rk END AS last_rk FROM p WHERE n = 1
UNION ALL SELECT x.account_id, x.id, x.n, x.at, x.at + INTERVAL 30 DAY, CASE WHEN x.holds AND (x.last_end IS NULL OR x.at + INTERVAL 30 DAY >= x.last_end) THEN x.at + INTERVAL 30 DAY ELSE x.last_end END, CASE WHEN x.holds AND (x.last_end IS NULL OR x.at + INTERVAL 30 DAY >= x.last_end) THEN x.rk ELSE x.last_rk END
FROM (SELECT p.*, s.last_end, s.last_rk, CASE WHEN s.last_end > p.bought AND p.rk <= s.last_rk THEN s.last_end ELSE p.bought END AS at FROM s JOIN p ON p.account_id = s.account_id AND p.n = s.n + 1) x)
SELECT account_id, id, starts_at, ends_at FROM s""")
def w12(spark, d):
    p = v.periods(spark, d).select("account_id", "id", "plan", F.lit(30).alias("days"), F.col("starts_at").alias("bought_at"), "revoked_at")
    return temporal.stacked(p)


def _queued(spark, d):
    return v.jobs(spark, d).filter("status = 'queued'").select("id", (F.col("account_id") % 50).alias("account_id"), "created_at")


def _served(spark, d):
    return v.jobs(spark, d).filter("status = 'succeeded'").groupBy((F.col("account_id") % 50).alias("account_id")).agg(F.max("started_at").alias("served_at"))


_QNOW = "1995-03-01 00:00:00"


@query("w01_fair_dispatch", _WITH + """, q AS (SELECT id, account_id % 50 AS account_id, created_at, CASE WHEN created_at <= TIMESTAMP '1995-02-15 00:00:00' THEN 0 ELSE 1 END AS rk FROM jobs WHERE status = 'queued'),
s AS (SELECT account_id % 50 AS account_id, max(started_at) AS served_at FROM jobs WHERE status = 'succeeded' GROUP BY 1), c AS (SELECT * FROM q ORDER BY rk, created_at, id LIMIT 200),
r AS (SELECT c.*, served_at, row_number() OVER (PARTITION BY c.account_id ORDER BY rk, created_at, id) AS round FROM c LEFT JOIN s ON s.account_id = c.account_id),
o AS (SELECT row_number() OVER (ORDER BY round, rk, CASE WHEN rk = 0 THEN created_at ELSE coalesce(served_at, TIMESTAMP '0001-01-01') END, created_at, account_id::VARCHAR) AS place, id, account_id, round FROM r)
SELECT place::INT AS place, id, account_id, round::INT AS round FROM o WHERE place <= 50""")
def w01(spark, d):
    return queues.dispatch(_queued(spark, d), _served(spark, d), _moment(_QNOW), limit=50, aging=14 * 86400)


_FAIR = f"""q AS (SELECT id, account_id % 50 AS account_id, created_at FROM jobs WHERE status = 'queued'), s AS (SELECT account_id % 50 AS account_id, max(started_at) AS served_at FROM jobs WHERE status = 'succeeded' GROUP BY 1),
{registry.fair_sql("TIMESTAMP '1995-02-15 00:00:00'")}"""


@query("w02_fair_order", _WITH + f", {_FAIR} SELECT place::INT AS place, id, account_id FROM fair")
def w02(spark, d):
    return queues.fair_order(_queued(spark, d), _served(spark, d), _moment(_QNOW), aging=14 * 86400)


@query("a13_usual_seconds", _WITH + f", r AS (SELECT epoch_us(completed_at) - epoch_us(started_at) AS u FROM jobs WHERE completed_at >= {_AT} - INTERVAL 48 HOUR AND started_at IS NOT NULL ORDER BY completed_at DESC, id DESC LIMIT 20) SELECT avg(greatest(0.0::DOUBLE, u / 1e6)) AS usual FROM r")
def a13(spark, d):
    return queues.usual_seconds(v.jobs(spark, d), _moment(AT), hours=48)


@query("q26_rolling_brake", _WITH + """, c AS (SELECT id, account_id AS key, occurred_at AS "at", count(*) OVER (PARTITION BY account_id ORDER BY occurred_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS before FROM ev)
SELECT id, key, "at", before, before < 3 AS allowed FROM c""")
def q26(spark, d):
    return queues.within_window(v.events(spark, d).select("id", F.col("account_id").alias("key"), F.col("occurred_at").alias("at")), 24, 3)


@query("q23_health_changes", _WITH + """, c AS (SELECT id, account_id AS source, occurred_at AS "at", event_type <> 'error' AS healthy, lag(event_type <> 'error') OVER (PARTITION BY account_id ORDER BY occurred_at, id) AS b FROM ev) SELECT id, source, "at", healthy FROM c WHERE healthy IS DISTINCT FROM b""")
def q23(spark, d):
    return queues.state_changes(v.events(spark, d).select("id", F.col("account_id").alias("source"), F.col("occurred_at").alias("at"), (F.col("event_type") != "error").alias("healthy")))


@query("w13_canonical_responses", _WITH + """, k AS (SELECT job_id AS response_key, count(*) AS seen FROM att GROUP BY 1)
SELECT response_key, seen, (SELECT a.input_tokens FROM att a WHERE a.job_id = response_key AND a.input_tokens IS NOT NULL ORDER BY created_at, no, input_tokens LIMIT 1) AS input_tokens, (SELECT a.output_tokens FROM att a WHERE a.job_id = response_key AND a.output_tokens IS NOT NULL ORDER BY created_at, no, input_tokens NULLS FIRST, output_tokens LIMIT 1) AS output_tokens FROM k""")
def w13(spark, d):
    return queues.canonical_responses(v.attempts(spark, d).withColumnRenamed("job_id", "response_key"), ("input_tokens", "output_tokens"))


@query("s05_once_a_day", _WITH + " SELECT event_type, account_id, occurred_at::DATE AS day, count(*) > 0 AS kept FROM ev GROUP BY 1, 2, 3")
def s05(spark, d):
    return streams.once_a_day(v.events(spark, d)).select("event_type", "account_id", "day", F.lit(True).alias("kept"))


@query("s06_debounced_taps", "WITH RECURSIVE " + v.SQL + """, t AS (SELECT id, account_id, occurred_at, account_id || ':' || coalesce(properties->>'$.k', '') AS tap FROM ev WHERE event_type = 'view'), o AS (SELECT *, row_number() OVER (PARTITION BY tap ORDER BY occurred_at, id) AS n FROM t),
k AS (SELECT tap, n, id, account_id, occurred_at, occurred_at AS last, true AS kept FROM o WHERE n = 1 UNION ALL SELECT o.tap, o.n, o.id, o.account_id, o.occurred_at, CASE WHEN o.occurred_at - k.last >= INTERVAL 3 DAY THEN o.occurred_at ELSE k.last END, o.occurred_at - k.last >= INTERVAL 3 DAY FROM k JOIN o ON o.tap = k.tap AND o.n = k.n + 1)
SELECT id, tap, occurred_at FROM k WHERE kept""")
def s06(spark, d):
    taps = v.events(spark, d).filter("event_type = 'view'")
    return streams.debounced(taps.withColumn("tap", F.concat_ws(":", F.col("account_id").cast("string"), expr.json_text(F.col("properties"), "k", ""))), 3 * 86_400)


@query("stream_hourly_counts", _WITH + " SELECT date_trunc('hour', occurred_at) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM ev GROUP BY 1, 2")
def hourly(spark, d):
    return streams.hourly(v.events(spark, d)).withColumn("total", F.round("total", 3))


_AWORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+')"


@query("t15_tidy_pages")
def t15(spark, d):
    return v.read(spark, d, "pages").select("page_id", text.tidy(F.coalesce("html", F.lit(""))).alias("text"))


@query("t02_cyrillic_share", r"""SELECT doc_id, CASE WHEN c + l > 0 THEN c / (c + l) ELSE 0.0 END::DOUBLE AS share FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{0400}-\x{052F}\x{1C80}-\x{1C8F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1D2B}\x{1D78}]')) AS c, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS l FROM documents)""")
def t02(spark, d):
    return v.read(spark, d, "documents").select("doc_id", text.cyrillic_share(F.coalesce("text", F.lit(""))).alias("share"))


@query("t03_language_rule")
def t03(spark, d):
    return v.read(spark, d, "documents").select("doc_id", text.written_in(F.col("text")).alias("language"))


@query("t16_word_counts", f"SELECT doc_id, len({_AWORDS})::INT AS n FROM documents")
def t16(spark, d):
    return v.read(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("n"))


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents"


def _alike_sql(size: str, least: int, alike: float, owners: int, parts: str = _LINES) -> str:
    """The first earlier part (doc_id, no, text) of a document that is alike, by runs of words compared pair by pair."""
    return f"""WITH s AS ({parts}),
    w AS (SELECT doc_id, no, {values._WORDS} AS w FROM s), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) >= {min(least, owners)}), z AS (SELECT *, {size} AS z FROM n),
    r AS MATERIALIZED (SELECT doc_id, no, n, list_distinct(list_transform(range(1, greatest(n - z + 1, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + z - 1), ' '))) AS r FROM z),
    p AS (SELECT a.doc_id, a.no, b.no AS owner, len(list_intersect(a.r, b.r)) AS k, len(a.r) AS x, len(b.r) AS y FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.no < a.no WHERE a.n >= {least} AND b.n >= {owners})
    SELECT doc_id, no::INT AS no, min(owner)::INT AS owner FROM p WHERE k > 0 AND k >= {alike}::DOUBLE * (x + y - k) GROUP BY doc_id, no"""


@query("t19_repeated_sections", _alike_sql("CASE WHEN n >= 12 THEN 3 ELSE 2 END", 6, 0.6, 1))
def t19(spark, d):
    return documents.repeated_sections(v.read(spark, d, "documents"))


@query("t20_repeated_paragraphs", _alike_sql("4", 10, 0.8, 10))
def t20(spark, d):
    return documents.repeated_paragraphs(v.read(spark, d, "documents"))


_STEM = "replace(w, '''', '')[:5]"
_SIZE = f"greatest(3, least(length({_STEM}), 5) - 1)"
_REVIEWED = rf"""s AS MATERIALIZED (SELECT doc_id, no, text AS body, CASE no % 4 WHEN 0 THEN 'Head ' || (no % 8) WHEN 1 THEN 'Head ' || ((no - 1) % 8) END AS heading, no % 5 = 2 AS item, trim(regexp_replace(text, '\s+', ' ', 'g')) = '' AS blank FROM ({_LINES})),
x AS MATERIALIZED (SELECT *, blank AND NOT item AS bare, blank AND NOT item AND heading IS NULL AS empty, concat_ws(chr(10), heading, nullif(body, ''), CASE WHEN item THEN 'б' END) AS text FROM s),
h AS (SELECT doc_id, no, bare, lower(heading) AS h, last_value(lower(heading) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM x WHERE NOT empty),
o AS (SELECT *, h IS NOT NULL AND NOT bare AND h IS DISTINCT FROM cur AS own FROM h), f AS (SELECT *, min(CASE WHEN own THEN no END) OVER (PARTITION BY doc_id, h) AS first FROM o),
st AS (SELECT doc_id, no, {values._WORDS} AS ws FROM x),
ot AS (SELECT doc_id, no FROM st WHERE len(ws) >= 25 AND doc_id IN (SELECT doc_id FROM x GROUP BY 1 HAVING count(*) >= 3)
  AND len(list_filter(ws, lambda w: length(w) >= 3 AND NOT list_contains({review.STOP!r}, w) AND left({_STEM}, {_SIZE}) = left('repor', {_SIZE}))) = 0)"""


@query(
    "t24_document_review",
    f"""WITH {_REVIEWED}
    SELECT doc_id, no::INT AS section, 'script' AS code FROM x WHERE item UNION ALL SELECT doc_id, NULL, 'section_count' FROM x GROUP BY 1 HAVING count(*) <> 5 UNION ALL SELECT doc_id, no, 'empty_section' FROM x WHERE bare
    UNION ALL SELECT doc_id, no, 'continued_heading' FROM f WHERE h = cur UNION ALL SELECT doc_id, no, 'repeated_heading' FROM f WHERE own AND no <> first UNION ALL SELECT doc_id, no, 'off_topic' FROM ot
    UNION ALL SELECT doc_id, no, 'duplicate_section' FROM ({_alike_sql("CASE WHEN n >= 12 THEN 3 ELSE 2 END", 6, 0.6, 1, "SELECT doc_id, no, text FROM x WHERE NOT bare")})
    UNION ALL SELECT doc_id, no, 'duplicate_paragraph' FROM ({_alike_sql("4", 10, 0.8, 10, "SELECT doc_id, no, body AS text FROM x")})""",
)
def t24(spark, d):
    """Documents whose lines are sections of quotations, which are judged for no language, some under headings that go on or come again, some with a label in another alphabet."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    null = lambda kind="string": F.lit(None).cast(kind)
    item = F.array(F.struct(F.lit("б").alias("label"), null().alias("text"), null().alias("value")))
    head = lambda i: F.when(i % 4 == 0, F.concat(F.lit("Head "), i % 8)).when(i % 4 == 1, F.concat(F.lit("Head "), (i - 1) % 8))
    section = lambda x, i: F.struct(head(i).alias("heading"), x.alias("body"), null().alias("notes"), F.when(i % 5 == 2, item).alias("items"), null("array<string>").alias("columns"), F.lit("quote").alias("layout"))
    docs = v.read(spark, d, "documents").select(
        "doc_id", F.lit("en").alias("locale"), F.lit("the report is on the and of that").alias("prompt"), null().alias("request"), F.lit(5).alias("expected"), null("array<string>").alias("subtopics"), null().alias("title"),
        F.transform(lines, section).alias("sections"), null("array<struct<stem:string,answer:string,explanation:string,topic:string,options:array<string>>>").alias("questions"),
    )
    return review.check(docs)


@query("t21_headings", """WITH p AS (SELECT conv_id AS doc_id, turn AS no, lower(trim(role)) AS h FROM conversations), w AS (SELECT *, last_value(nullif(h, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY doc_id, h ORDER BY no) > 1 AS s FROM p),
c AS (SELECT *, coalesce(h = b, false) AND h <> '' AS continued FROM w) SELECT doc_id, no, h = '' AS empty, continued, s AND h <> '' AND NOT continued AS repeated FROM c""")
def t21(spark, d):
    return documents.headings(v.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("no"), F.col("role").alias("heading")))


@query("t30_chunks")
def t30(spark, d):
    return text.chunked(v.read(spark, d, "documents"))


@query("t31_surely_over", r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) > 6000 AS over FROM documents")
def t31(spark, d):
    return v.read(spark, d, "documents").select("doc_id", text.surely_over(F.col("text"), 2).alias("over"))


@query("t69_phones")
def t69(spark, d):
    return v.read(spark, d, "documents").select("doc_id", text.possible_phones(F.coalesce("text", F.lit(""))).alias("phones"))


@query("f14_visitors", "SELECT event_id AS id, left(sha256('salt:' || user_id::VARCHAR), 20) AS visitor FROM events")
def f14(spark, d):
    return v.events(spark, d).select("id", expr.visitor(F.lit("salt"), F.col("account_id").cast("string")).alias("visitor"))


@query("f26_csv_cells", "SELECT p_partkey AS id, CASE WHEN regexp_matches(c, '^\\s*[=+\\-@]') THEN '''' || c ELSE c END AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' =' || p_name WHEN p_partkey % 7 = 0 THEN '-' || p_name ELSE p_name END AS c FROM part)")
def f26(spark, d):
    c = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" ="), "p_name")).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("-"), "p_name")).otherwise(F.col("p_name"))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), expr.csv_cell(c).alias("cell"))


@query("p05_json_presence", "SELECT event_id AS id, json_exists(props, '$.k') AS has_k FROM events")
def p05(spark, d):
    return v.events(spark, d).select("id", expr.json_has(F.col("properties"), "k").alias("has_k"))


@query("c02_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c02(spark, d):
    return checks.duplicates(v.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


_TOKENS = "tk AS (SELECT *, CASE WHEN no % 3 <> 0 THEN input_tokens + output_tokens + CASE WHEN job_id % 10 = 0 THEN 1 ELSE 0 END END AS total_tokens, CASE WHEN no % 2 = 0 THEN input_tokens - 5 END AS cached_input_tokens, CASE WHEN job_id % 2 = 0 THEN 7::BIGINT END AS cache_write_input_tokens, CASE WHEN job_id % 3 = 0 THEN 50::BIGINT END AS reasoning_output_tokens FROM att)"


def _tokens(spark, d):
    n, no = F.col("job_id"), F.col("no")
    a = v.attempts(spark, d)
    return a.select(
        "*", F.when(no % 3 != 0, F.col("input_tokens") + F.col("output_tokens") + F.when(n % 10 == 0, 1).otherwise(0)).alias("total_tokens"), F.when(no % 2 == 0, F.col("input_tokens") - 5).alias("cached_input_tokens"),
        F.when(n % 2 == 0, F.lit(7).cast("long")).alias("cache_write_input_tokens"), F.when(n % 3 == 0, F.lit(50).cast("long")).alias("reasoning_output_tokens"),
    )


@query("c09_token_breaks", _WITH + f""", {_TOKENS} SELECT job_id, no FROM tk WHERE coalesce(total_tokens <> input_tokens + output_tokens, false) OR coalesce(cached_input_tokens > input_tokens, false) OR coalesce(cache_write_input_tokens > input_tokens, false)
OR coalesce(reasoning_output_tokens > output_tokens, false) OR coalesce(cached_input_tokens + cache_write_input_tokens > input_tokens, false) OR coalesce(cached_input_tokens < 0, false)""")
def c09(spark, d):
    return checks.breaks(_tokens(spark, d), checks.tokens_hold()).select("job_id", "no")


@query("f29_consistent_tokens", _WITH + f""", {_TOKENS}, s AS (SELECT job_id, no, input_tokens, output_tokens, coalesce(input_tokens + output_tokens, total_tokens) AS total_tokens, CASE WHEN cached_input_tokens BETWEEN 0 AND input_tokens THEN cached_input_tokens END AS c,
CASE WHEN cache_write_input_tokens BETWEEN 0 AND input_tokens THEN cache_write_input_tokens END AS w, CASE WHEN reasoning_output_tokens BETWEEN 0 AND output_tokens THEN reasoning_output_tokens END AS reasoning_output_tokens FROM tk)
SELECT job_id, no, total_tokens, CASE WHEN coalesce(c + w > input_tokens, false) THEN NULL ELSE c END AS cached_input_tokens, CASE WHEN coalesce(c + w > input_tokens, false) THEN NULL ELSE w END AS cache_write_input_tokens, reasoning_output_tokens FROM s""")
def f29(spark, d):
    return expr.consistent_tokens(_tokens(spark, d)).select("job_id", "no", "total_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")


@query("r14_six_sums", _WITH + f""", {_TOKENS}, own AS (SELECT * FROM tk WHERE {_Y} AND environment = 'production' AND NOT duplicate_response) SELECT (SELECT count(*) FROM tk WHERE {_Y} AND environment = 'production') AS attempts, (SELECT count(*) FROM tk WHERE {_Y} AND environment = 'production' AND duplicate_response) AS duplicates, (SELECT count(*) FROM tk WHERE {_Y} AND environment = 'production' AND status IN ('failed', 'rejected')) AS failed, count(*) AS responses, """ + ", ".join(f"CASE WHEN count(*) = 0 THEN 0 ELSE sum({m}) END::BIGINT AS {m}, count(*) FILTER (WHERE {m} IS NULL) AS {m}_unknown" for m in ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")) + " FROM own")
def r14_six(spark, d):
    return reports.usage_totals(_tokens(spark, d), YEAR, ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens"))


@query("c10_orphan_lines", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def c10(spark, d):
    return checks.orphans(v.read(spark, d, "lineitem"), "l_orderkey", v.read(spark, d, "orders").filter("o_orderstatus != 'P'"), "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("j17_duplicate_texts", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1")
def j17(spark, d):
    docs = v.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(first, "sha").select("doc_id", "first_id")
