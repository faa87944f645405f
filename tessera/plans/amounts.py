"""Typed tables of amounts: cells read, cells computed, total rows, over lines written as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import tables
from ..sources import views as v
from .registry import query


def _grouped(x: Column) -> Column:
    return F.translate(F.format_number(x, 0), ",", " ")


_SPACED = "replace(format('{:,}', %s), ',', ' ')"
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "t45_read_cells",
    f"""SELECT {", ".join(_LINE)}, CASE l_linenumber % 7 WHEN 0 THEN p WHEN 1 THEN p // 100 * 100 WHEN 2 THEN p + 0.5::DOUBLE WHEN 4 THEN -p WHEN 6 THEN p % 100 END::DOUBLE AS value,
      CASE l_linenumber % 7 WHEN 0 THEN 'so‘m' WHEN 1 THEN 'so‘m' WHEN 2 THEN '' WHEN 4 THEN 'dona' WHEN 6 THEN '%' END AS unit, CASE WHEN l_linenumber % 7 IN (3, 5) THEN NULL WHEN l_linenumber % 7 = 1 THEN 3 ELSE 0 END::INT AS exp,
      CASE l_linenumber % 7 WHEN 2 THEN 'usd' WHEN 0 THEN 'uzs' WHEN 1 THEN 'uzs' END AS currency FROM (SELECT *, floor(l_extendedprice)::BIGINT AS p FROM lineitem)""",
)
def t45(spark, d):
    """A line's price in one of seven ways, of which two say no single number."""
    p, n = F.floor("l_extendedprice").cast("long"), F.col("l_linenumber") % 7
    cell = (
        F.when(n == 0, F.concat(_grouped(p), F.lit(" so‘m"))).when(n == 1, F.concat(F.floor(p / 1000).cast("string"), F.lit(","), F.floor(p / 100) % 10, F.lit(" ming so‘m"))).when(n == 2, F.concat(F.lit("$"), p, F.lit(".50")))
        .when(n == 3, F.concat(F.lit("taxminan "), p)).when(n == 4, F.concat(F.lit("−"), p, F.lit(" dona"))).when(n == 5, F.concat(p, F.lit("-"), p + 1)).otherwise(F.concat(p % 100, F.lit(" %")))
    )
    li = v.read(spark, d, "lineitem").select(*_LINE, tables.read(cell, F.lit("uz")).alias("r"))
    return li.select(*_LINE, F.col("r.value").cast("double").alias("value"), F.col("r.unit").alias("unit"), F.col("r.exp").alias("exp"), tables.money(F.col("r")).alias("currency"))


@query(
    "t47_computed_cells",
    f"""SELECT {", ".join(_LINE)}, {_SPACED % "q * p"} || ' so‘m' AS amount, CASE WHEN p - r < 0 THEN '−' WHEN p > r THEN '+' ELSE '' END || {_SPACED % "abs(p - r)"} AS change,
      {_SPACED % "((q * 2000 + l_linenumber) // (2 * l_linenumber)) // 10"} || ',' || (((q * 2000 + l_linenumber) // (2 * l_linenumber)) % 10) || '%' AS share
    FROM (SELECT *, floor(l_extendedprice)::BIGINT AS p, l_quantity::BIGINT AS q, l_quantity::BIGINT * 1000 AS r FROM lineitem)""",
)
def t47(spark, d):
    """Pieces times price, price against a plan, pieces as a percent of the line's number; each pair of cells is computed once."""
    p, q, uz = F.col("_p"), F.col("_q"), F.lit("uz")
    read = lambda x: tables.read(x, uz)
    price, pieces = F.concat(_grouped(p), F.lit(" so‘m/dona")), F.concat(q, F.lit(" dona"))
    bare = lambda x: read(x.cast("string"))
    lines = v.read(spark, d, "lineitem").select(*_LINE, F.floor("l_extendedprice").cast("long").alias("_p"), F.col("l_quantity").cast("long").alias("_q"))
    amount, change = tables.computed("product", F.array(read(pieces), read(price)), uz), tables.computed("difference", F.array(read(_grouped(p)), read(_grouped(q * 1000))), uz)
    lines = tables.once(lines, ["_p", "_q"], amount=amount, change=change)
    lines = tables.once(lines, ["_q", "l_linenumber"], share=tables.computed("percent", F.array(bare(q), bare(F.col("l_linenumber"))), uz))
    return lines.select(*_LINE, "amount", "change", "share")


@query(
    "t49_total_rows",
    f"""WITH c AS (SELECT l_orderkey AS key, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 10 = 0 AND l_linenumber = 1 THEN l_quantity::BIGINT ELSE floor(l_extendedprice)::BIGINT END AS x, l_linenumber < 7 AND l_orderkey % 10 = 0 AND l_linenumber = 1 AS usd FROM lineitem),
    g AS (SELECT key, sum(x)::BIGINT AS s, count(x) AS n, count(DISTINCT CASE WHEN x IS NOT NULL THEN usd END) AS kinds, bool_or(x IS NOT NULL AND usd) AS usd, count(*) > count(x) AS part FROM c GROUP BY 1)
    SELECT key, CASE WHEN usd THEN '$' || {_SPACED % "s"} ELSE {_SPACED % "s"} || ' so‘m' END AS total, CASE WHEN part THEN 'Jami (ko‘rsatilgan moddalar)' ELSE 'Jami' END AS label, CASE WHEN part THEN 'named' ELSE 'total' END AS kind FROM g WHERE n >= 2 AND kinds = 1""",
)
def t49(spark, d):
    """An order as a table: lines without a sum make its total one of those listed, lines in two currencies none."""
    n = F.col("l_linenumber")
    text = F.when(n == 7, "").when((F.col("l_orderkey") % 10 == 0) & (n == 1), F.concat(F.lit("$"), F.col("l_quantity").cast("long"))).otherwise(F.concat(_grouped(F.floor("l_extendedprice").cast("long")), F.lit(" so‘m")))
    cells = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (n * 100_000 + F.col("l_partkey")).alias("row"), F.lit(1).alias("column"), F.concat(F.lit("Qator "), n).alias("label"), text.alias("text"))
    return tables.total_rows(cells).select("key", "total", "label", "kind")
