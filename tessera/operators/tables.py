"""Arithmetic of typed tables (T45, T47, T49): cells as exact decimals with scale word, unit and currency, all in column expressions.

A cell is one number as someone types it, or nothing. Results take the style of what they are made of: the scale word, unit and sign that all
inputs share, the language's marks, and no rounding that hides behind a scale word.

Left out: total rows that were typed and stay beside lines (they are told and taken out), and what a template says of a result to a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import SCALES
from ..functions.text import currency, let

#: Exact: eight places, thirty digits before them.
AMOUNT = "decimal(38,8)"

# ---- Fixed values: how numbers, scales, currencies' cents and prices for one are written, and the words of totals. ----
_GAP = "[    ]"
NUMBER = (
    rf"[+\-−–]?{_GAP}*(?:\d{{1,3}}(?:{_GAP}\d{{3}})+(?:[.,]\d+)?|\d{{1,3}}(?:\.\d{{3}})+,\d+|\d{{1,3}}(?:,\d{{3}})+\.\d+"
    r"|\d{1,3}(?:\.\d{3}){2,}|\d{1,3}(?:,\d{3}){2,}|\d+(?:[.,]\d+)?)"
)
PREFIX = r"(?i)^(?:\$|€|£|₽|usd|eur|rub|uzs)?$"
SCALE = r"(?iU)^(?:(?:ming|минг|тыс\w*\.?|thousand\w*|mln\.?|млн\.?|million\w*|миллион\w*|mlrd\.?|млрд\.?|milliard\w*|миллиард\w*|billion\w*|trln\.?|трлн\.?|trillion\w*|bn|mn)(?!\w)|k(?!\p{L}))"
CENTS = r"(?iU)\$|€|£|\b(?:usd|eur|gbp|dollar\w*|euro\w*|доллар\w*|долл\.?|евро)\b"
WHOLE = r"(?iU)so[‘'ʻ`’]?m|сум|сўм|uzs|\bsum\b|\bруб\w*|₽|rub\b"
PER_UNIT = r"(?iU)\s*(?:/.*|(?<!\p{L})(?:per|за|har\s+biri|dona\s+narxi|each|apiece|a\s+piece)(?!\p{L}).*)$"
FROM_EACH = r"(?iU)(so[‘'ʻ`’]?m|сўм)dan\b"
TOTAL = {"uz": "Jami", "ru": "Итого", "en": "Total"}
NAMED = {"uz": "Jami (ko‘rsatilgan moddalar)", "ru": "Итого (указанные статьи)", "en": "Total (items listed)"}
_GENERIC = (
    r"oylik|yillik|umumiy|xarajat\w*|summa\w*|daromad\w*|tushum\w*|investitsiya\w*|byudjet\w*|ежемесячн\w*|месячн\w*|годов\w*|общ\w*|расход\w*|затрат\w*|сумм\w*|доход\w*|выручк\w*|инвестиц\w*|"
    r"бюджет\w*|monthly|annual|yearly|overall|costs?|expenses?|amount|sum|revenues?|income|investments?|budget"
)
TOTAL_ROW = rf"(?iU)^\s*(?:jami|жами|итого|всего|total|grand\s+total|subtotal)(?:\s+(?:{_GENERIC})){{0,3}}\s*(?:\([^()]*\))?\s*:?\s*$"
MINUS, DASH = "−", "—"
# ---- End of fixed values. ----


def _stripped(text: Column, marks: str = " .,;:") -> Column:
    return F.regexp_replace(text, rf"^[{marks}]+|[{marks}]+$", "")


def _digits(raw: Column, english: Column) -> Column:
    """Digits with a point for decimals; null where a mark may mean either."""

    def told(plain: Column) -> Column:
        doubtful, comma = plain.rlike(r"^\d{1,3}[.,]\d{3}$"), plain.rlike(r"^\d{1,3},\d{3}$")
        by_points, by_commas = plain.rlike(r"^\d{1,3}(?:\.\d{3}){2,}$|^\d{1,3}(?:\.\d{3})+,\d+$"), plain.rlike(r"^\d{1,3}(?:,\d{3}){2,}$|^\d{1,3}(?:,\d{3})+\.\d+$")
        return F.when(english & comma, F.replace(plain, F.lit(","), F.lit(""))).when(~english & doubtful, None).when(by_points, F.translate(plain, ",.", ".")).when(by_commas, F.translate(plain, ",", "")).otherwise(F.translate(plain, ",", "."))

    return let(F.regexp_replace(raw, rf"[+\-−–]|{_GAP}", ""), told)


def read(cell: Column, locale: Column) -> Column:
    """struct<value, scale, exp, unit, prefix, decimals> of a cell; null for what is not exactly one number with at most a currency before it and a unit after it."""

    def parse(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda found: F.when(F.size(found) == 1, let(F.struct(F.get(found, F.lit(0)).alias("raw"), F.instr(t, F.get(found, F.lit(0))).alias("at")), lambda m: parts(t, m))))

    def parts(t: Column, m: Column) -> Column:
        raw, at = m["raw"], m["at"]
        rest = F.trim(F.substring(t, at + F.length(raw), F.length(t)))
        bits = F.struct(raw.alias("raw"), F.trim(F.substring(t, F.lit(1), at - 1)).alias("prefix"), rest.alias("rest"), F.regexp_extract(rest, SCALE, 0).alias("scale"), _digits(raw, locale == "en").alias("digits"))
        return let(bits, lambda b: let(F.struct(b["raw"].alias("raw"), b["prefix"].alias("prefix"), b["scale"].alias("scale"), power(F.lower(b["scale"])).alias("exp"), b["digits"].alias("digits"), _stripped(F.trim(F.substring(b["rest"], F.length(b["scale"]) + 1, F.length(b["rest"])))).alias("unit")), whole))

    def power(word: Column) -> Column:
        exp = F.lit(0)
        for stem, ten in reversed(SCALES.items()):
            exp = F.when(word.startswith(stem), ten).otherwise(exp)
        return exp

    def whole(b: Column) -> Column:
        value = F.when(b["raw"].rlike(r"^[-−–]"), F.concat(F.lit("-"), b["digits"])).otherwise(b["digits"]).try_cast(AMOUNT)
        times = F.pow(F.lit(10), b["exp"]).cast("decimal(13,0)")
        decimals = F.length(F.regexp_extract(b["digits"], r"\.(\d+)$", 1))
        fits = ~cell.contains("_") & b["prefix"].rlike(PREFIX) & b["digits"].isNotNull() & ~b["unit"].rlike(r"\d") & (F.length(b["unit"]) <= 24)
        return F.when(fits, F.struct((value * times).cast(AMOUNT).alias("value"), b["scale"].alias("scale"), b["exp"].alias("exp"), b["unit"].alias("unit"), b["prefix"].alias("prefix"), decimals.alias("decimals")))

    return let(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " ")), parse)


def once(rows: DataFrame, cells: list[str], **made: Column) -> DataFrame:
    """rows with what is made of `cells` alone, for each distinct choice of them once; a null is a choice like any other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [f"_of_{i}" for i in range(len(cells))]
    distinct = rows.select(*cells).distinct().repartition(n, *cells)
    found = distinct.select(*[F.col(c).alias(o) for c, o in zip(cells, own, strict=True)], *[x.alias(k) for k, x in made.items()])
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(cells, own, strict=True)]
    return rows.join(found, same).drop(*own)


def money(r: Column) -> Column:
    """The currency that a read cell names, null for none."""
    return currency(F.concat_ws(" ", r["prefix"], r["unit"]))


def _rounded(value: Column, places: Column) -> Column:
    """Half up, to 0 to 8 places."""

    def out(v: Column) -> Column:
        found = v
        for p in range(7, -1, -1):
            found = F.when(places == p, F.round(v, p).cast(AMOUNT)).otherwise(found)
        return found.cast(AMOUNT)

    return let(value, out)


def written(value: Column, locale: Column, decimals: Column | None = None, places: Column | int = 2, sign: bool = False) -> Column:
    """A value in a language's marks, half up: at exactly `decimals` places, or without them at up to `places` and no zeros at the end."""
    fixed = F.lit(None).cast("int") if decimals is None else decimals
    places = F.lit(places) if isinstance(places, int) else places

    def show(x: Column) -> Column:
        """x: fixed, the places to write, the rounded value."""
        text = F.call_function("format_number", F.abs(x["v"]), x["p"])
        text = F.when(x["f"].isNull() & text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        text = F.when(locale == "en", text).otherwise(F.translate(text, ",.", " ,"))
        return F.concat(F.when(x["v"] < 0, MINUS).when((x["v"] > 0) & F.lit(sign), "+").otherwise(""), text)

    start = F.struct(fixed.alias("f"), F.coalesce(fixed, places).cast("int").alias("p"), value.alias("v"))
    return let(let(start, lambda x: F.struct(x["f"].alias("f"), x["p"].alias("p"), _rounded(x["v"], x["p"]).alias("v"))), show)


def _styled(value: Column, reads: Column, locale: Column, decimals: Column | None = None, sign: bool = False) -> Column:
    """A value as its inputs are written: with their scale word, unit and sign where all agree, else as a plain number. Under a scale word
    two places at most; what they can't hold is written in full."""
    decimals = F.lit(None).cast("int") if decimals is None else decimals

    def show(x: Column) -> Column:
        """x: the value, the first input, what it is under its scale, whether all are styled alike, the most decimals, the fixed places."""
        first = x["first"]
        short = (first["exp"] > 0) & (x["under"] == F.round(x["under"], 2))
        amount = F.when(short, x["under"].cast(AMOUNT)).otherwise(x["v"])
        text = written(amount, locale, F.when(~short, x["fixed"]), F.when(first["exp"] > 0, 2).otherwise(x["most"]), sign)
        shown = let(text, lambda n: F.when(first["prefix"].isin("$", "€", "£", "₽"), F.concat(first["prefix"], n)).otherwise(F.trim(F.concat_ws(" ", first["prefix"], n))))
        scale = F.when((first["exp"] > 0) & ~short, "").otherwise(first["scale"])
        return F.when(x["alike"], F.rtrim(F.concat_ws(" ", shown, F.nullif(scale, F.lit("")), F.nullif(first["unit"], F.lit(""))))).otherwise(written(x["v"], locale, x["fixed"], 2, sign))

    style = lambda r: F.struct(F.regexp_replace(F.lower(r["scale"]), r"\.+$", ""), r["exp"], F.lower(r["unit"]), F.lower(r["prefix"]))

    def about(y: Column) -> Column:
        first = F.get(y["reads"], F.lit(0))
        return F.struct(
            y["v"].alias("v"), first.alias("first"), (y["v"] / F.pow(F.lit(10), first["exp"]).cast("decimal(13,0)")).cast("decimal(38,14)").alias("under"),
            (F.size(F.array_distinct(F.transform(y["reads"], style))) == 1).alias("alike"), F.array_max(F.transform(y["reads"], lambda r: r["decimals"])).alias("most"), y["fixed"].alias("fixed"),
        )

    return let(let(F.struct(value.alias("v"), reads.alias("reads"), decimals.alias("fixed")), about), show)


def _places(r: Column) -> Column:
    return F.greatest(F.lit(0), r["decimals"] - r["exp"])


def _currency_places(r: Column, paper: Column) -> Column:
    """2 for cents, 0 for whole units, null where nothing tells."""
    marks = F.concat_ws(" ", r["prefix"], r["unit"], paper)
    return F.when(marks.rlike(CENTS), 2).when(marks.rlike(WHOLE), 0)


def _one(r: Column) -> Column:
    """A price without its tail for one: what it is multiplied to is an amount."""
    unit = _stripped(F.regexp_replace(F.regexp_replace(r["unit"], PER_UNIT, ""), FROM_EACH, "$1"))
    return F.struct(r["value"].alias("value"), r["scale"].alias("scale"), r["exp"].alias("exp"), unit.alias("unit"), r["prefix"].alias("prefix"), r["decimals"].alias("decimals"))


def _sum(reads: Column) -> Column:
    return F.aggregate(reads, F.lit(0).cast(AMOUNT), lambda a, r: (a + r["value"]).cast(AMOUNT))


def computed(op: str, inputs: Column, locale: Column, level: Column | None = None, to_currency: bool = False, paper: Column | None = None) -> Column:
    """A computed cell of read inputs (an array): product, sum, difference or percent; null where an input isn't read or a percent has no base.

    `level` marks rows of figures that are percents themselves: their percent is a dash. `to_currency` rounds a product to the smallest unit
    of the price's or the paper's currency, before any scale word.
    """
    paper = F.lit("") if paper is None else F.coalesce(paper, F.lit(""))
    level = F.lit(False) if level is None else level
    head, tail = lambda x: F.get(x, F.lit(0)), lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))

    def product(x: Column) -> Column:
        others, price = F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), _one(F.get(x, F.size(x) - 1))
        result = F.aggregate(tail(x), head(x)["value"], lambda a, r: (a * r["value"]).cast(AMOUNT))
        return let(F.struct(result.alias("v"), price.alias("price"), others.alias("others"), F.exists(x, lambda r: _places(r) > 0).alias("parts")), rounded)

    def rounded(y: Column) -> Column:
        fixed = F.coalesce(_currency_places(y["price"], paper), F.when(y["parts"], 2).otherwise(0)) if to_currency else F.lit(None).cast("int")
        v = let(fixed, lambda p: F.when(p.isNotNull(), _rounded(y["v"], p)).otherwise(y["v"]).cast(AMOUNT))
        return let(F.struct(v.alias("v"), y["price"].alias("price"), y["others"].alias("others"), fixed.alias("fixed")), amount)

    def amount(y: Column) -> Column:
        price, plain, named = y["price"], F.forall(y["others"], lambda r: (r["exp"] == 0) & (r["prefix"] == "")), F.exists(y["others"], lambda r: money(r).isNotNull())
        own = F.length(F.regexp_extract(F.regexp_replace(y["v"].cast("string"), "0+$", ""), r"\.(\d+)$", 1))
        bare = F.struct(price["value"].alias("value"), F.lit("").alias("scale"), F.lit(0).alias("exp"), price["unit"].alias("unit"), price["prefix"].alias("prefix"), F.greatest(_places(price), own).alias("decimals"))
        return F.when(~plain & named, written(y["v"], locale, y["fixed"])).otherwise(_styled(y["v"], F.array(F.when(plain, price).otherwise(bare)), locale, y["fixed"]))

    def percent(x: Column) -> Column:
        base = F.get(x, F.lit(1))["value"]
        share = written((head(x)["value"] * 100 / F.nullif(base, F.lit(0))).cast(AMOUNT), locale, F.lit(1))
        return F.when(F.exists(x, lambda r: r["unit"] == "%") | level, DASH).when(base > 0, F.concat(share, F.lit("%")))

    ways = {
        "product": product, "percent": percent, "sum": lambda x: _styled(_sum(x), x, locale),
        "difference": lambda x: _styled((head(x)["value"] - _sum(tail(x))).cast(AMOUNT), x, locale, sign=True),
    }
    if op not in ways:
        raise ValueError(f"unknown operation {op}")
    return let(inputs, lambda x: F.when((F.size(x) > 0) & F.forall(x, lambda r: r.isNotNull()), ways[op](x)))


def total_rows(cells: DataFrame, key: str = "key", locale: Column | None = None, paper: Column | None = None, stated: Column | None = None, partial: str = "named") -> DataFrame:
    """Key, column, total, label and kind (total or named) of the tables that have a total. cells: key, row, column, label, text and what
    `locale`, `paper` and `stated` read, which are a table's; a column of lines to add up has a row for every line of its table.

    Two lines with a figure at least and one currency, the paper's where a line names none; rows that are totals themselves don't count. Lines
    without a figure make the total one of the items listed, and none at all with `partial` "none"; so does a stated total of the first column that
    the lines don't add up to.
    """
    locale = F.lit("uz") if locale is None else locale
    paper = F.coalesce(F.lit("") if paper is None else paper, F.lit(""))
    own = F.coalesce(currency(paper), F.nullif(F.lower(F.trim(F.regexp_replace(paper, r"(?U)\s+", " "))), F.lit("")), F.lit("uzs"))
    stated = F.lit(None).cast("string") if stated is None else stated
    lines = cells.filter(~F.coalesce("label", F.lit("")).rlike(TOTAL_ROW)).withColumn("_locale", locale).withColumn("_paper", own).withColumn("_stated", stated)
    r = once(lines, ["text", "_locale"], _read=read(F.col("text"), F.col("_locale")))
    r = r.withColumn("_money", F.when(F.col("_read").isNotNull(), F.coalesce(money(F.col("_read")), "_paper")))
    named = (F.trim(F.coalesce("label", F.lit(""))) != "") | (F.trim(F.coalesce("text", F.lit(""))) != "")
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("_read").isNotNull(), F.struct("row", F.col("_read").alias("r"))))), lambda x: x["r"])
    per = r.groupBy(key, "column").agg(
        F.count("*").alias("_lines"), held.alias("_reads"), F.max(F.col("_read").isNull() & named).alias("_missing"), F.count_distinct("_money").alias("_kinds"), F.first("_money", ignorenulls=True).alias("_money"),
        F.first("_locale").alias("_locale"), F.first("_paper").alias("_paper"), F.first("_stated").alias("_stated"),
    )
    adds = (F.size("_reads") >= 2) & (F.col("_kinds") == 1)
    places = F.array_max(F.transform("_reads", _places))
    per = per.withColumn("_sum", _sum(F.col("_reads"))).withColumn("_said", read(F.col("_stated"), F.col("_locale")))
    agrees = (F.col("_said.value") == F.col("_sum")) & (F.coalesce(money(F.col("_said")), "_paper") == F.col("_money"))
    differs = F.coalesce(F.col("_stated"), F.lit("")).rlike(r"[\p{L}\p{N}]") & ~F.coalesce(agrees, F.lit(False))
    columns = Window.partitionBy(key)
    first = F.min("column").over(columns)
    per = per.withColumn("_part", F.max(F.col("_missing") | (adds & differs & (F.col("column") == first))).over(columns)).filter(adds & (F.col("_lines") >= 2))
    words = lambda of: F.when(F.col("_locale") == "en", of["en"]).when(F.col("_locale") == "ru", of["ru"]).otherwise(of["uz"])
    total = _styled(F.col("_sum"), F.col("_reads"), F.col("_locale"), F.nullif(places, F.lit(0)))
    out = per.filter(~F.col("_part") | F.lit(partial != "none"))
    return out.select(key, "column", total.alias("total"), F.when(F.col("_part"), words(NAMED)).otherwise(words(TOTAL)).alias("label"), F.when(F.col("_part"), "named").otherwise("total").alias("kind"))
