"""The review of whole documents: every code by a document that has it and one that hasn't."""

import pytest

from tessera.operators import documents, review

SECTION = "struct<heading:string,body:string,notes:string,items:array<struct<label:string,text:string,value:string>>,columns:array<string>,layout:string>"
DOC = f"doc_id long, locale string, prompt string, request string, expected int, subtopics array<string>, title string, sections array<{SECTION}>, questions array<struct<stem:string,answer:string,explanation:string,topic:string,options:array<string>>>"


def section(body=None, heading=None, layout=None, items=None, notes=None):
    return (heading, body, notes, items, None, layout)


EN = "the water of the river is in the valley and it is from the hills that the rain was for this land as well "
RU = "это вода из реки и она не для полей, а также что как у гор по камням от дождя "
UZ = "bu suv daryodan va u tog'lar bilan dalalar uchun kerak ammo shu yerda ham yo'q edi "


def codes(spark, *docs, **more):
    rows = [(i, *d) for i, d in enumerate(docs)]
    found = {}
    for r in review.check(spark.createDataFrame(rows, DOC), **more).collect():
        found.setdefault(r.doc_id, set()).add((r.section, r.code))
    return found


def doc(*sections, locale="en", prompt=None, request=None, expected=None, subtopics=None, title="Water"):
    return (locale, prompt, request, expected, subtopics, title, list(sections), None)


def test_codes(spark):
    got = codes(
        spark,
        doc(section(EN, "One"), section(EN + "quite other words follow here now", "Two"), section(None, "Three"), section(), expected=3),
        doc(section("Кирилл", "x"), section("plain", "y"), title="Сув"),
        doc(section("a", "Same"), section("b", "Same"), section("c", ""), section("d", "Other"), section("e", "same"), section("f", "Same", "cover")),
        doc(section("para " * 3 + "one two three four five six seven eight nine ten\nnew"), section("intro\none two three four five six seven eight nine ten para para para"), section(None, items=[(None, "para " * 3 + "one two three four five six seven eight nine ten", None)])),
        doc(section("clean text", "h")),
        (None, None, None, None, None, None, None, None),
    )
    assert got[0] == {(1, "duplicate_section"), (2, "empty_section"), (3, "empty_section"), (None, "section_count")}
    assert got[1] == {(0, "script"), (None, "script")}
    assert got[2] == {(1, "continued_heading"), (4, "repeated_heading"), (5, "continued_heading")}
    assert {c for c in got[3] if c[1] == "duplicate_paragraph"} == {(2, "duplicate_paragraph")}
    assert 4 not in got and 5 not in got


def test_languages(spark):
    prompt = "это отчёт о воде и о реках для школы"
    got = codes(
        spark,
        doc(section(EN), section(RU), section(UZ)), doc(section(RU), section(EN), prompt="write it in Russian for the class"), doc(section(RU), section(RU + "и горы"), prompt=prompt, request="переведи"), doc(section(RU, layout="quote")), doc(section(EN), locale="uz", prompt="the report of the water and of the river is for school"),
    )
    language = {i: {c for c in got.get(i, ()) if c[1] in ("wrong_language", "foreign_passage")} for i in range(5)}
    assert language == {0: {(1, "wrong_language"), (2, "foreign_passage")}, 1: {(0, "foreign_passage")}, 2: {(0, "foreign_passage"), (1, "foreign_passage")}, 3: set(), 4: {(0, "wrong_language")}}


def test_topics(spark):
    prompt = "the report of the rivers and of the lakes is for the school that was in it"
    stray = "cars and engines with wheels and tyres for roads in towns and cities of many lands where people drive them every day and night without any rest at all "
    got = codes(spark, doc(section("River water " + stray), section(stray), section("x"), prompt=prompt, title="", subtopics=["rivers", "mountain glaciers"]), doc(section(stray), prompt=prompt, title="", subtopics=["road"]))
    assert {c for c in got[0] if c[1] in ("off_topic", "missing_subtopics")} == {(1, "off_topic"), (None, "missing_subtopics")}
    assert not {c for c in got.get(1, ()) if c[1] in ("off_topic", "missing_subtopics")}


@pytest.mark.parametrize(
    "sizes, room, want",
    [
        ([[3, 3, 3, 3]], 12, [[0, 1, 2, 3]]), ([[3, 3, 3, 3]], 9, [[0, 1, 3]]), ([[3, 3, 3, 3]], 6, [[0, 3]]), ([[3, 3, 3, 3]], 5, None), ([[5], [1, 9, 1]], 7, [[0], [0, 2]]), ([[5], [1, 9, 1]], 16, [[0], [0, 1, 2]]),
        ([[1, 8, 1, 1], [1, 1, 1, 1]], 8, [[0, 3], [0, 1, 2, 3]]), ([[4, 4], [4, 4]], 15, None), ([], 5, []),
    ],
)
def test_both_ends(sizes, room, want):
    got = documents.both_ends(sizes, room)
    assert (got and [sorted(x) for x in got]) == want if want else got == want


def test_packed(spark):
    pages = [("a", 1, 1, "x" * 40), ("a", 1, 2, " \n"), ("a", 1, 3, "y" * 40), ("a", 1, 4, "z" * 40), ("a", 2, 1, "12 34"), ("b", 1, 1, "short"), ("c", 1, 1, "w" * 70), ("c", 2, 1, "v" * 70), ("d", 1, 1, "u" * 50), ("d", 2, 1, None)]
    df = spark.createDataFrame(pages, "key string, file int, page int, text string")
    kept, said = documents.packed(df, room=90, least=20)
    assert sorted((r.key, r.file, r.page) for r in kept.collect()) == [("a", 1, 1), ("a", 1, 4), ("d", 1, 1)]
    assert {r.key: (r.refused, r.cut, sorted(r.unread)) for r in said.collect()} == {"a": (None, True, [2]), "b": ("source_unreadable", False, []), "c": ("generation_limit", False, []), "d": (None, False, [2])}
    whole, said = documents.packed(df.filter("key = 'a'"), room=90, least=20, ends=False)
    assert whole.count() == 0 and said.first().refused == "generation_limit"
