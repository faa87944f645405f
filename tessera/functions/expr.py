"""Column helpers for the rules that every report shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The zone of weekly and monthly limits, for every account.
WEEK_ZONE = "Asia/Tashkent"
#: A part of a list of pages.
PAGES = r"^\s*(\d{1,4})(?:\s*-\s*(\d{1,4}))?\s*$"


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half to even; null for an empty whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def share(part: Column, whole: Column) -> Column:
    """Like rate in whole percent, but zero for an empty whole."""
    return F.coalesce(rate(part, whole, 0), F.lit(0.0)).cast("long")


def json_has(json: Column, key: str) -> Column:
    """The key is present, null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def json_text(json: Column, key: str, default: str | None = None) -> Column:
    found = F.get_json_object(json, f"$.{key}")
    return found if default is None else F.coalesce(found, F.lit(default))


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def week_start(ts: Column, zone: str = WEEK_ZONE) -> Column:
    """Monday 00:00 of the zone, as an instant."""
    return F.to_utc_timestamp(F.date_trunc("week", F.from_utc_timestamp(ts, zone)), zone)


def month_start(ts: Column, zone: str = WEEK_ZONE) -> Column:
    return F.to_utc_timestamp(F.date_trunc("month", F.from_utc_timestamp(ts, zone)), zone)


def rank_index(n: Column, p: float) -> Column:
    """Index from 0 of the nearest-rank quantile p among n sorted values."""
    return F.least(n - 1, F.floor(n * p)).cast("long")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def percent_off(price: Column, reduced: Column) -> Column:
    """Whole percent, rounded down; null without a price."""
    return F.when(price > 0, F.floor((price - reduced) * 100 / price).cast("long"))


def lenient_date(text: Column) -> Column:
    """An ISO day; null for anything else."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd")).cast("date"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as message limits count it."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def visitor(salt: Column, who: Column) -> Column:
    """Twenty hexadecimal digits that stand for a person before an account exists."""
    return F.substring(F.sha2(F.concat(salt, F.lit(":"), who), 256), 1, 20)


def grouped_thousands(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", " ")


def excerpt(text: Column, size: int) -> Column:
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one_line) > size, F.concat(F.rtrim(F.substring(one_line, 1, size - 1)), F.lit("…"))).otherwise(one_line)


def consistent_tokens(usage: DataFrame) -> DataFrame:
    """the total is the sum where both parts are known; a part over its whole is unknown, as are cached and written input that are too much together."""
    c = F.col
    part = lambda name, whole: F.when((c(name) >= 0) & (c(name) <= c(whole)), c(name))
    df = usage.withColumns({
        "total_tokens": F.coalesce(c("input_tokens") + c("output_tokens"), c("total_tokens")), "cached_input_tokens": part("cached_input_tokens", "input_tokens"),
        "cache_write_input_tokens": part("cache_write_input_tokens", "input_tokens"), "reasoning_output_tokens": part("reasoning_output_tokens", "output_tokens"),
    })
    over = F.coalesce(c("cached_input_tokens") + c("cache_write_input_tokens") > c("input_tokens"), F.lit(False))
    return df.withColumn("_over", over).withColumns({k: F.when(~c("_over"), c(k)) for k in ("cached_input_tokens", "cache_write_input_tokens")}).drop("_over")


def page_numbers(spec: Column, count: Column | int = 9999) -> Column:
    """`1,3-5` or `all` as an array of pages of a file of `count`; null if a part is malformed, reversed or beyond it, or a page comes twice."""
    count = F.lit(count) if isinstance(count, int) else count
    parts = F.transform(F.split(spec, ",", -1), lambda p: F.struct(F.regexp_extract(p, PAGES, 1).try_cast("int").alias("a"), F.coalesce(F.regexp_extract(p, PAGES, 2).try_cast("int"), F.regexp_extract(p, PAGES, 1).try_cast("int")).alias("b")))
    good = F.forall(parts, lambda p: F.coalesce((p["a"] >= 1) & (p["a"] <= p["b"]) & (p["b"] <= count), F.lit(False)))
    # Counted before they are made: a list of ranges may name far more pages than the file has.
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"] + 1)
    pages = F.when(good & (F.length(spec) <= 6000), F.when(total <= count, F.flatten(F.transform(parts, lambda p: F.sequence(p["a"], p["b"])))))
    return F.when(F.trim(spec) == "all", F.sequence(F.lit(1), count)).otherwise(F.when(F.size(F.array_distinct(pages)) == F.size(pages), pages))


#: Months as each language writes them after a day.
MONTHS = {
    "en": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "uz": "yanvar fevral mart aprel may iyun iyul avgust sentabr oktabr noyabr dekabr".split(),
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(),
}


def day_start(ts: Column, zone: str = WEEK_ZONE) -> Column:
    """the zone's midnight before, as an instant."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def day_label(day: Column, locale: Column, this_year: Column) -> Column:
    """F8: a day as a language writes it; the year only where it is another one."""
    month = {k: F.element_at(F.array(*map(F.lit, names)), F.month(day)) for k, names in MONTHS.items()}
    number, year = F.dayofmonth(day).cast("string"), F.when(F.year(day) != this_year, F.year(day).cast("string"))
    uzbek = F.concat(F.coalesce(F.concat(year, F.lit("-yil ")), F.lit("")), number, F.lit("-"), month["uz"])
    other = lambda k: F.concat(number, F.lit(" "), month[k], F.coalesce(F.concat(F.lit(" "), year), F.lit("")))
    return F.when(locale == "uz", uzbek).when(locale == "ru", other("ru")).otherwise(other("en"))


def identifier(value: Column, most: int) -> Column:
    """A provider's identifier, or nothing for any other text."""
    return F.when((F.length(value) <= most) & value.rlike(r"^[A-Za-z0-9_.:/-]+$"), value).otherwise("")


def quote_kind(writes: Column, parameters: Column) -> Column:
    """the allowance that a request draws on."""
    return F.when(~writes, "file").when(json_text(parameters, "revision") == "true", "edit").when(json_text(parameters, "stage") == "outline", "outline").otherwise("ai_document")


def canonical_json(**values: Column) -> Column:
    """compact JSON with keys in order, so that equal values have equal texts."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def json_changes(before: Column, after: Column, keys: int = 8, size: int = 60) -> Column:
    """(key, before, after) of the first keys whose values differ or which one side alone has; a value that isn't there is null.

    Values are compared as they are, "1" is not 1, and a null that is there is not one that isn't. What is shown is a string itself or
    else JSON, cut last.
    """
    a, b = (F.coalesce(F.from_json(x, "map<string,variant>"), F.create_map().cast("map<string,variant>")) for x in (before, after))
    a, b = (F.transform_values(x, lambda _, value: F.to_json(value)) for x in (a, b))
    said = lambda raw: F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), "x string")["x"]).otherwise(raw)
    short = lambda x: F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("…"))).otherwise(x)
    listed = F.slice(F.array_union(F.map_keys(a), F.map_keys(b)), 1, keys)
    differ = F.filter(listed, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.transform(differ, lambda k: F.struct(k.alias("key"), short(said(F.try_element_at(a, k))).alias("before"), short(said(F.try_element_at(b, k))).alias("after")))


def byte_range(header: Column, size: Column) -> Column:
    """`first-last` of what a Range header asks, `none` where nothing there can answer it, null where the whole file does."""
    h = F.trim(header)
    first, last = (F.regexp_extract(h, r"(?i)^bytes=([0-9]{0,18})-([0-9]{0,18})$", k).try_cast("long") for k in (1, 2))
    span = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    tail = F.when((last == 0) | (size == 0), "none").otherwise(span(F.greatest(size - last, F.lit(0)), size - 1))
    inside = F.when(first >= size, "none").otherwise(span(first, F.least(F.coalesce(last, size - 1), size - 1)))
    return F.when(first.isNull() & last.isNotNull(), tail).when(first.isNotNull() & (last.isNull() | (last >= first)), inside)


def email(value: Column) -> Column:
    """trimmed and in small letters; null for what is no address."""
    found = F.lower(F.trim(value))
    return F.when((F.length(value) <= 254) & found.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"), found)


def token_count(value: Column) -> Column:
    """a whole number from 0 on, else unknown."""
    n = F.when(value.rlike(r"^\d+$"), value.try_cast("long"))
    return F.when(n >= 0, n)


def cached_tokens(usage: Column) -> Column:
    """the cached part of the input in either provider's shape, unknown where it is more than the whole."""
    path = lambda p: token_count(F.get_json_object(usage, p))
    part = F.coalesce(path("$.input_tokens_details.cached_tokens"), path("$.cache_read_input_tokens"))
    return F.when(part <= path("$.input_tokens"), part)


def limit_of(seed: Column, override: Column, key: str) -> Column:
    """the override's value where it has the key, null meaning no limit, else the seed's."""
    return F.when(json_has(override, key), json_text(override, key)).otherwise(json_text(seed, key)).cast("long")


def call_ranges(count: Column, per_call: int) -> Column:
    """(first, past) of each call over `count` items; one call for none."""
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(per_call))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + per_call, count).alias("past")))


def typed_names(text: Column) -> Column:
    """(entry, kind) of what was typed, without repeats: a telegram id, a name, or invalid, as it was typed."""
    raw = F.filter(F.split(text, r"[\s,;]+"), lambda x: x != "")
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)^(?:https?://)?(?:t\.me|telegram\.me)/", ""), r"^[@/]+", ""), r"[@/]+$", "")
    kind = lambda x: F.when(x.rlike(r"^[0-9]+$") & (x.try_cast("long") > 0), "id").when(x.rlike(r"^[A-Za-z][A-Za-z0-9_]{3,31}$"), "name").otherwise("invalid")
    rows = F.filter(F.transform(raw, lambda x: F.struct(bare(x).alias("entry"), kind(bare(x)).alias("kind"), x.alias("raw"))), lambda r: r["entry"] != "")
    low = F.transform(rows, lambda r: F.lower(r["entry"]))
    first = F.filter(rows, lambda r, i: F.array_position(low, F.lower(r["entry"])) == i + 1)
    return F.transform(first, lambda r: F.struct(F.when(r["kind"] == "invalid", r["raw"]).otherwise(r["entry"]).alias("entry"), r["kind"].alias("kind")))
