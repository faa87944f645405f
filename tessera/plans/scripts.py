"""Texts and fields of documents in the alphabet of their language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import alphabets
from ..sources import views as v
from .registry import query

#: Latin letters that Uzbek Cyrillic has one letter for, and those.
_HERE, _THERE = "abvgdezijklmnoprstufxyhq", "абвгдезижклмнопрстуфхйҳқ"


def _plain(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "cw", "kv")


def _in_cyrillic(text: Column) -> Column:
    return F.translate(_plain(text), _HERE, _THERE)


#: What the same text is in Latin letters: e is ye at the start of a word and after a vowel; three passes, as matches may not overlap.
_SOFT = "translate(lower(coalesce(text, '')), 'cw', 'kv')"
for _ in range(3):
    _SOFT = rf"regexp_replace({_SOFT}, '(^|[^\p{{L}}\p{{N}}_''‘’ʻʼ`]|[aeiou])e', '\1ye', 'g')"
_CLEAN = rf"regexp_replace({_SOFT}, '([og])[''’ʻ`´]([\p{{L}}\p{{N}}_])', '\1‘\2', 'g')"


@query("t09_latin_texts", f"SELECT doc_id, md5({_CLEAN}) AS latin FROM documents")
def t09(spark, d):
    """Texts that were put into Uzbek Cyrillic come back in Latin letters."""
    return v.read(spark, d, "documents").select("doc_id", F.md5(alphabets.clean(_in_cyrillic(F.col("text")))).alias("latin"))


def _nested(spark, d):
    """Documents as titles and sections; of every third line the words are in Cyrillic letters, its number is its label."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    own = lambda x, i: F.when(i % 3 == 1, _in_cyrillic(x)).otherwise(x)
    item = lambda x, i: F.array(F.struct(F.when(i % 2 == 0, F.concat(F.lit("n"), i)).alias("label"), F.substring(own(x, i), 1, 9).alias("text"), F.lit(None).cast("string").alias("value")))
    section = lambda x, i: F.struct(F.lit(None).cast("string").alias("heading"), own(x, i).alias("body"), F.lit(None).cast("string").alias("notes"), item(x, i).alias("items"), F.lit(None).cast("array<string>").alias("columns"))
    questions = F.array(F.struct(F.lit("why").alias("stem"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("topic"), F.array(F.lit("a"), F.lit("б")).alias("options")))
    return v.read(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("T"), F.col("doc_id")).alias("title"), F.transform(lines, section).alias("sections"), questions.alias("questions"))


_LINES = f"l AS (SELECT doc_id, x, i, translate(lower(x), 'cw', 'kv') AS p FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)), m AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN translate(p, '{_HERE}', '{_THERE}') ELSE x END AS x FROM l)"


@query(
    "t12_fields",
    f"""WITH {_LINES} SELECT doc_id, 'title' AS path, md5('T' || doc_id) AS text FROM documents UNION ALL SELECT doc_id, 'sections/' || i || '/body', md5(x) FROM m UNION ALL SELECT doc_id, 'sections/' || i || '/items/0/text', md5(left(x, 9)) FROM m
    UNION ALL SELECT doc_id, 'sections/' || i || '/items/0/label', md5('n' || i) FROM m WHERE i % 2 = 0 UNION ALL SELECT doc_id, unnest(['questions/0/stem', 'questions/0/options/0', 'questions/0/options/1']), unnest([md5('why'), md5('a'), md5('б')]) FROM documents""",
)
def t12(spark, d):
    return alphabets.fields(_nested(spark, d)).select("doc_id", "path", F.md5("text").alias("text"))


@query("t13_wrong_alphabet", f"WITH {_LINES} SELECT doc_id, 'sections/' || i || unnest(['/body', '/items/0/text']) AS path FROM m WHERE regexp_matches(left(x, 9), '[а-яҳқ]') UNION ALL SELECT doc_id, 'sections/' || i || '/body' FROM m WHERE regexp_matches(x, '[а-яҳқ]') AND NOT regexp_matches(left(x, 9), '[а-яҳқ]') UNION ALL SELECT doc_id, 'questions/0/options/1' FROM documents")
def t13(spark, d):
    return alphabets.violations(alphabets.fields(_nested(spark, d)), F.lit("uz"))


@query("t14_enforced_alphabet", f"WITH {_LINES}, f AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(x, '[а-яҳқ]')) + count(*) FILTER (WHERE regexp_matches(left(x, 9), '[а-яҳқ]')) + 1 AS fixed FROM m GROUP BY 1) SELECT doc_id, fixed::BIGINT AS fixed, 0::BIGINT AS wrong FROM f")
def t14(spark, d):
    done = alphabets.enforce(alphabets.fields(_nested(spark, d)), F.lit("uz"))
    return done.groupBy("doc_id").agg(F.count_if("fixed").alias("fixed"), F.count_if("wrong").alias("wrong"))
