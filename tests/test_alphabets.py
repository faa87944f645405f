"""Alphabets: letters and capitals, words that mix them, whole texts and fields of documents."""

from pyspark.sql import functions as F

from tessera.functions import alphabets as a

DOC = "doc_id int, title string, sections array<struct<heading:string,body:string,notes:string,items:array<struct<label:string,text:string,value:string>>,columns:array<string>>>, questions array<struct<stem:string,answer:string,explanation:string,topic:string,options:array<string>>>"


def check(spark, f, cases):
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", f(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in got} == cases


def test_words(spark):
    check(spark, a.to_latin, {"Тошкент": "Toshkent", "Ер": "Yer", "оила": "oila", "поезд": "poyezd", "ЁШЛИК": "YOSHLIK", "Шаҳар": "Shahar", "Ш": "Sh", "ғўза": "g‘o‘za", "Eski": "Eski", "": "", "маъно": "maʼno"})
    check(spark, a.russian_to_latin, {"Ереван": "Yerevan", "Хива": "Khiva", "ЩИ": "SHCHI", "объект": "obekt", "ӷ": "", "Їжак": "Yizhak"})
    check(spark, a.settle, {"Tаққослаш": "Таққослаш", "мaктаб": "мактаб", "mаktab": "maktab", "talabaлар": "talabaлар", "Москва's": "Москва's", "plain": "plain", "кириллча": "кириллча", "Ўзбекистонcha": "Ўзбекистонcha"})


def test_texts(spark):
    check(spark, a.clean, {"Бу «Tаққослаш» bo'limi, 5-сон": "Bu «Taqqoslash» bo‘limi, 5-son", "talabaлар": "talabalar", "it’s o’k": "it’s o‘k", "": ""})
    cases = [("ru", "Pythоn и мaркет", "Python и маркет"), ("en", "Хива ва Ўзбекистон", "Khiva va O‘zbekiston"), ("uz", "Їжак ва мактаб", "Yijak va maktab"), ("fr", "Хива", "Khiva"), ("en", None, None)]
    got = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, l string, t string").select("i", a.to_script(F.col("t"), F.col("l")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got][:2] + [r.x for r in got][3:] == [w for _, _, w in cases][:2] + [w for _, _, w in cases][3:]
    assert not any("Ѐ" <= c <= "ԯ" for c in got[2].x)


def test_fields_of_documents(spark):
    docs = spark.createDataFrame([(1, "Сарлавҳа", [("h", None, "", [("l", None, "v")], ["к", "d"]), (None, "b", None, None, None)], [("s", "a", None, None, ["о", "p"])]), (2, None, None, None)], DOC)
    found = a.fields(docs)
    want = {"title": "Сарлавҳа", "sections/0/heading": "h", "sections/0/notes": "", "sections/0/items/0/label": "l", "sections/0/items/0/value": "v", "sections/0/columns/0": "к", "sections/0/columns/1": "d", "sections/1/body": "b", "questions/0/stem": "s", "questions/0/answer": "a", "questions/0/options/0": "о", "questions/0/options/1": "p"}
    assert {r.path: r.text for r in found.collect()} == want
    assert sorted(r.path for r in a.violations(found, F.lit("en")).collect()) == ["questions/0/options/0", "sections/0/columns/0", "title"] and a.violations(found, F.lit("ru")).count() == 0
    done = {r.path: (r.text, r.fixed, r.wrong) for r in a.enforce(found, F.lit("uz")).collect()}
    assert done["title"] == ("Sarlavha", True, False) and done["sections/0/heading"] == ("h", False, False) and not any(w for _, _, w in done.values())
