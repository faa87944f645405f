"""Scalar rules over columns: dates, money, numbers, JSON and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, text
from ..operators import documents, temporal
from ..sources import views as v
from .registry import WITH, query

#: The words of normalised text: one kind of apostrophe, accented o and soft g as letter and apostrophe.
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '‘’ʻʼ`´', repeat('''', 6)), '[óòōŏ]', 'o''', 'g'), '[ÓÒŌŎ]', 'O''', 'g'), 'ğ', 'g''', 'g'), 'Ğ', 'G''', 'g')"
_WORDS = rf"regexp_extract_all(lower({_NORMAL}), '[\p{{L}}\p{{N}}_'']+')"


@query("f05_day_starts", "SELECT event_id AS id, date_trunc('day', ts::TIMESTAMP + INTERVAL 5 HOUR) - INTERVAL 5 HOUR AS day_start FROM events")
def f05(spark, d):
    return v.events(spark, d).select("id", expr.day_start(F.col("occurred_at")).alias("day_start"))


_MONTHS = {
    "en": "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']", "uz": "['yanvar','fevral','mart','aprel','may','iyun','iyul','avgust','sentabr','oktabr','noyabr','dekabr']",
    "ru": "['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря']",
}


@query("f08_day_labels", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN day(x) || ' ' || " + _MONTHS["en"] + "[month(x)] || y WHEN 1 THEN CASE WHEN y = '' THEN '' ELSE year(x) || '-yil ' END || day(x) || '-' || " + _MONTHS["uz"] + "[month(x)] ELSE day(x) || ' ' || " + _MONTHS["ru"] + "[month(x)] || y END AS label FROM (SELECT o_orderkey, o_orderdate::DATE AS x, CASE WHEN year(o_orderdate) = 1998 THEN '' ELSE ' ' || year(o_orderdate) END AS y FROM orders)")
def f08(spark, d):
    locale = F.element_at(F.array(*map(F.lit, ("en", "uz", "ru"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), expr.day_label(F.to_date("o_orderdate"), locale, F.lit(1998)).alias("label"))


@query("f11_days_bought", "SELECT o_orderkey AS id, greatest(30, 30 * floor(o_totalprice)::BIGINT // 20000) AS days FROM orders")
def f11(spark, d):
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), temporal.days_bought(F.floor("o_totalprice").cast("long"), F.lit(20000)).alias("days"))


@query("f12_quota_blocks", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE greatest(0, 25 - p_size) END AS remaining FROM part")
def f12(spark, d):
    limit = F.when(F.col("p_size") % 5 != 0, 25)
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(limit.isNotNull(), F.greatest(F.lit(0), limit - F.col("p_size"))).alias("remaining"))


@query("f13_quote_kinds", WITH + " SELECT id, CASE WHEN NOT is_ai THEN 'file' WHEN revision THEN 'edit' WHEN stage = 'outline' THEN 'outline' ELSE 'ai_document' END AS kind FROM reqs")
def f13(spark, d):
    return v.requests(spark, d).select("id", expr.quote_kind(F.col("feature_id").isin(*v.WRITERS), F.col("parameters")).alias("kind"))


@query("f15_request_hashes", """SELECT p_partkey AS id, sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') AS hash, octet_length(encode('{"brand":"' || p_brand || '","size":' || p_size || '}')) AS bytes FROM part""")
def f15(spark, d):
    """the compact JSON with sorted keys, its hash and its size in UTF-8."""
    body = expr.canonical_json(size=F.col("p_size"), brand=F.col("p_brand"))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2(body, 256).alias("hash"), F.octet_length(body).cast("long").alias("bytes"))


@query("f16_utf16_lengths", "SELECT doc_id, (length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units FROM documents")
def f16(spark, d):
    return v.read(spark, d, "documents").select("doc_id", expr.utf16_length(F.coalesce("text", F.lit(""))).alias("units"))


_SPECS = ["all", "1,3-5", "5-3", " 2 - 4 , 7", "1-3,2", "x", "1-999999", "9", ""]


@query("f19_page_lists", "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '1,2,3,4,5,6,7,8' WHEN 1 THEN '1,3,4,5' WHEN 3 THEN '2,3,4,7' END AS pages FROM part")
def f19(spark, d):
    spec = F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(expr.page_numbers(spec, 8).cast("array<string>"), ",").alias("pages"))


_RANGES = ["Bytes=0-9", "bytes=5-", "bytes=-7", "bytes=9-3", "bytes=-0", "items=1-2", "bytes=0-1,4-5", "bytes=900-", "bytes=-"]


@query("f20_byte_ranges", """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '0-' || least(9, s - 1) WHEN 1 THEN CASE WHEN s > 5 THEN '5-' || (s - 1) ELSE 'none' END WHEN 2 THEN greatest(s - 7, 0) || '-' || (s - 1) WHEN 4 THEN 'none' WHEN 7 THEN 'none' END AS range FROM (SELECT p_partkey, p_size AS s FROM part)""")
def f20(spark, d):
    header = F.element_at(F.array(*map(F.lit, _RANGES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), expr.byte_range(header, F.col("p_size").cast("long")).alias("range"))


@query("f21_excerpts", r"SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(t[:59]) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r\v]+', ' ', 'g')) AS t FROM documents)")
def f21(spark, d):
    return v.read(spark, d, "documents").select("doc_id", expr.excerpt(F.coalesce("text", F.lit("")), 60).alias("excerpt"))


@query("f22_money", "SELECT o_orderkey AS id, replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', ' ') AS money FROM orders")
def f22(spark, d):
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), expr.grouped_thousands(F.floor("o_totalprice").cast("long")).alias("money"))


@query("f24_emails", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'user' || p_partkey || '@example.com' END AS email FROM part")
def f24(spark, d):
    n = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("user"), n, F.lit(" example.com"))).otherwise(F.concat(F.lit("  User"), n, F.lit("@Example.COM ")))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), expr.email(raw).alias("email"))


@query("f30_usage_shapes", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS input_tokens, CASE WHEN l_linenumber % 3 = 0 OR l_suppkey % 3 = 2 THEN NULL WHEN l_partkey % 40 <= l_quantity THEN l_partkey % 40 END AS cached FROM lineitem")
def f30(spark, d):
    """Two providers' shapes of the same usage; a part over its whole is unknown."""
    n, part = F.col("l_quantity").cast("long"), F.col("l_partkey") % 40
    part = F.when(F.col("l_linenumber") % 3 != 0, part)
    one = F.to_json(F.struct(n.alias("input_tokens"), F.struct(part.alias("cached_tokens")).alias("input_tokens_details")))
    two = F.to_json(F.struct(n.alias("input_tokens"), part.alias("cache_read_input_tokens")))
    usage = F.when(F.col("l_suppkey") % 3 == 0, one).when(F.col("l_suppkey") % 3 == 1, two).otherwise(F.to_json(F.struct(n.alias("input_tokens"))))
    return v.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", expr.token_count(F.get_json_object(usage, "$.input_tokens")).alias("input_tokens"), expr.cached_tokens(usage).alias("cached"))


@query("f31_plan_limits", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 7 ELSE CASE c_nationkey % 2 WHEN 0 THEN 3 ELSE 10 END END::BIGINT AS weekly, least(CASE c_nationkey % 2 WHEN 0 THEN 50 ELSE 900 END, 300)::BIGINT AS pages FROM customer")
def f31(spark, d):
    """An override wins by being there, even with null, which is no limit; pages are capped by what the engine reads."""
    even = F.col("c_nationkey") % 2 == 0
    seed = F.to_json(F.struct(F.when(even, 3).otherwise(10).alias("weekly"), F.when(even, 50).otherwise(900).alias("pages")))
    override = F.when(F.col("c_custkey") % 4 == 0, '{"weekly":null}').when(F.col("c_custkey") % 4 == 1, '{"weekly":7}').otherwise("{}")
    return v.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), expr.limit_of(seed, override, "weekly").alias("weekly"), F.least(expr.limit_of(seed, override, "pages"), F.lit(300).cast("long")).alias("pages"))


@query("t18_turn_similarity", """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+') AS x FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN len(x) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(x) - 1, 1)), lambda i: array_to_string(x[i + 1:i + 2], ' '))) END AS g FROM w)
SELECT a.conv_id, a.turn, CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) ELSE 0.0 END AS similarity FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def t18(spark, d):
    """Shingles of two words of a turn and the next."""
    c = v.read(spark, d, "conversations").select("conv_id", "turn", "text")
    a = c.select(F.struct("conv_id", "turn").alias("id"), "text")
    b = c.select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("id"), "text")
    return documents.similarity(a, b, 2).select("id.conv_id", "id.turn", "similarity")


_STOP = ["the", "and", "that", "with", "und", "der", "die", "les", "des", "que", "los"]


@query("t26_stems", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({_WORDS}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP!r}, w) AND NOT regexp_matches(w, '^\\p{{N}}+$')), lambda w: replace(w, '''', '')[:5]))), ' ') AS stems FROM documents WHERE text IS NOT NULL")
def t26(spark, d):
    return v.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(text.stems(F.col("text"), _STOP), " ").alias("stems"))


@query("t32_is_writing", r"SELECT doc_id, NOT contains(text, chr(0)) AND len(regexp_extract_all(text, '[\x01-\x08\x0e-\x19\x1b-\x1f\x7f-\x{9f}]')) * 100 <= length(text) AS writing FROM documents WHERE text IS NOT NULL")
def t32(spark, d):
    return v.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.is_writing(F.col("text")).alias("writing"))


_CELLS = {"$ {}": "usd", "{} dollarlik": "usd", "{} Долларов": "usd", "{}€": "eur", "{} EURO": "eur", "£{}": "gbp", "{} GBP": "gbp", "{} руб.": "rub", "₽ {}": "rub", "{} so‘m": "uzs", "{} сўм": "uzs", "{} UZS": "uzs", "jami {} sum": "uzs", "{} summary": None, "{} eurasia": "eur", "{} pounds": None}


@query("t46_currencies", "SELECT p_partkey AS id, [" + ", ".join("NULL" if c is None else f"'{c}'" for c in _CELLS.values()) + f"][p_partkey % {len(_CELLS)} + 1] AS currency FROM part")
def t46(spark, d):
    """Prices of parts in cells of sixteen ways."""
    ways = F.element_at(F.array(*[F.lit(c.replace("{}", "%d")) for c in _CELLS]), (F.col("p_partkey") % len(_CELLS) + 1).cast("int"))
    cell = F.replace(ways, F.lit("%d"), F.floor("p_retailprice").cast("string"))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.currency(cell).alias("currency"))


#: Sets of tied rows that take exactly the points left, by a bit for each remainder; without one the first rows.
@query(
    "t48_integer_shares",
    """WITH x AS (SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS line, l_quantity::INT % 3 + 1 AS val FROM lineitem), t AS (SELECT *, sum(val) OVER (PARTITION BY l_orderkey)::BIGINT AS tot FROM x),
    y AS (SELECT *, val * 100 // tot AS base, val * 100 % tot AS rest FROM t), z AS (SELECT *, 100 - sum(base) OVER (PARTITION BY l_orderkey)::BIGINT AS lft, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, line) AS k FROM y),
    g AS (SELECT l_orderkey, lft, rest, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest) - 1 AS bit FROM z WHERE rest > 0 GROUP BY l_orderkey, lft, rest),
    m AS (SELECT l_orderkey, lft, mask, sum(n) AS n, sum(n * rest) AS worth FROM g, (SELECT unnest(range(1, 8)) AS mask) WHERE (mask >> bit) & 1 = 1 GROUP BY ALL),
    b AS (SELECT m.l_orderkey, arg_max(mask, (worth, -((mask & 1) * 4 + (mask & 2) + (mask >> 2 & 1)))) AS mask FROM m JOIN (SELECT l_orderkey, max(bit) AS top FROM g GROUP BY 1) USING (l_orderkey) WHERE n = m.lft AND mask < 1 << (top + 1) GROUP BY 1)
    SELECT z.l_orderkey, line, (base + CASE WHEN z.lft = 0 THEN 0 WHEN b.mask IS NULL THEN (k <= z.lft)::INT ELSE coalesce((b.mask >> bit) & 1, 0) END)::BIGINT AS share FROM z LEFT JOIN b ON b.l_orderkey = z.l_orderkey LEFT JOIN g ON g.l_orderkey = z.l_orderkey AND g.rest = z.rest""",
)
def t48(spark, d):
    """Whole shares that add to 100 by largest remainder; rows of one remainder take a point together where that can be."""
    li = v.read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("line"), (F.col("l_quantity").cast("int") % 3 + 1).alias("value"))
    return documents.integer_shares(li, "l_orderkey", "line")


@query("t50_local_numbers", "SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN format('{:,}', x // 100) || '.' || lpad((x % 100)::VARCHAR, 2, '0') ELSE replace(format('{:,}', x // 100), ',', ' ') || ',' || lpad((x % 100)::VARCHAR, 2, '0') END AS number FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS x FROM orders)")
def t50(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.local_number(cents.cast("decimal(20,2)") / 100, F.col("o_orderkey") % 2 == 0).alias("number"))


@query("t53_unchanged_sections", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS no FROM documents WHERE text IS NOT NULL) SELECT doc_id, no, t = CASE WHEN no % 3 = 1 THEN t || '!' ELSE t END AS same FROM s")
def t53(spark, d):
    """Which sections an edit left as they were; it changed every third."""
    parts = documents.sections(v.read(spark, d, "documents").filter("text IS NOT NULL"))
    edited = parts.withColumn("text", F.when(F.col("no") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return documents.unchanged(parts, edited)


@query("t54_letters", r"SELECT doc_id, length(regexp_replace(text, '\P{L}', '', 'g'))::BIGINT AS letters FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '\P{L}', '', 'g')) >= 200")
def t54(spark, d):
    """Texts with too few letters are left out."""
    return v.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters")).filter("letters >= 200")


@query("t56_source_excerpts", "SELECT doc_id, source, length(text)::BIGINT AS taken, count(*) OVER s AS n_pages, sum(length(text)) OVER s::BIGINT AS n_chars, sum(length(text)) OVER s > 100000 AS refused FROM documents WHERE text IS NOT NULL WINDOW s AS (PARTITION BY source)")
def t56(spark, d):
    """Every page that a source gives, whole, and whether its source is more than a request may hold."""
    pages = v.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", "text")
    sources = documents.source_excerpts(pages, "source", 100_000, most=None).withColumnRenamed("source", "_source")
    return pages.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", F.length("text").cast("long").alias("taken"), "n_pages", "n_chars", "refused")


@query(
    "t54_readable_sources",
    r"""WITH f AS (SELECT source, lang, sum(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(regexp_extract_all(text, '\p{L}')) END) AS letters, sum(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE length(text) END) AS n FROM documents GROUP BY ALL)
    SELECT source AS key, CASE WHEN sum(letters) < 40 THEN 'source_unreadable' WHEN sum(n) FILTER (WHERE letters > 0) > 200000 THEN 'generation_limit' END AS refused, count(*) FILTER (WHERE letters = 0) AS unread FROM f GROUP BY 1""",
)
def t54(spark, d):
    """A source's languages as its files: what is unreadable or too much when nothing may be cut."""
    pages = v.read(spark, d, "documents").select(F.col("source").alias("key"), F.col("lang").alias("file"), F.col("doc_id").alias("page"), "text")
    return documents.packed(pages, 200_000, ends=False)[1].select("key", "refused", F.size("unread").cast("long").alias("unread"))


@query("t55_both_ends")
def t55(spark, d):
    """The same where each file keeps its beginning and its end."""
    pages = v.read(spark, d, "documents").select(F.col("source").alias("key"), F.col("lang").alias("file"), F.col("doc_id").alias("page"), "text")
    return documents.packed(pages, 100_000)[0]


@query("t60_call_ranges", "SELECT p_partkey AS id, unnest(range(0, greatest(1, p_size), 12))::INT AS first, least(unnest(range(0, greatest(1, p_size), 12)) + 12, p_size)::INT AS past FROM part")
def t60(spark, d):
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(expr.call_ranges(F.col("p_size"), 12)).alias("r")).select("id", "r.first", "r.past")


@query("t61_call_tokens", "SELECT p_partkey AS id, least(16000, greatest(2000, p_size * 600) + 40 * (p_partkey % 30))::BIGINT AS tokens FROM part")
def t61(spark, d):
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.least(F.lit(16_000), F.greatest(F.lit(2_000), F.col("p_size") * 600) + 40 * (F.col("p_partkey") % 30)).cast("long").alias("tokens"))
