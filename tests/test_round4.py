"""What the findings of round 3 left open: space given back."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup
from tessera.llm.common import CLEANUP, dropped, written
from tessera.llm.simhash import components


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}


def test_shuffle_files_of_a_written_table_go_at_once(spark):
    before = shuffle_files(spark)
    out = written(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).count(), "test")
    assert out.count() == 100
    left = shuffle_files(spark) - before
    assert len(left) <= 1  # the count above is all that may have left one
    assert spark.conf.get(CLEANUP, None) in (None, "false")


def test_rounds_of_components_leave_one_table(spark):
    place = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(place.glob("edges-*"))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
    assert len(set(place.glob("edges-*")) - before) == 1


def test_tables_that_are_done_with_go(spark):
    place = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    out = written(spark.range(5), "test-dropped")
    dropped(out)
    assert not list(place.glob("test-dropped-*"))
    dropped(out)  # twice does no harm
    before = {x.name.rpartition("-")[0] for x in place.iterdir()}
    near = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, near), (2, near.replace("lazy", "hazy")), (3, "nothing like it stands here at all")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.report(docs).orderBy("doc_id").collect()] == [0, 1, 0]
    assert not {"line-edges", "line-texts", "line-tested"} & ({x.name.rpartition("-")[0] for x in place.iterdir()} - before)


@pytest.mark.parametrize("words", [1, 8, 64])
def test_pairs_tested_together_are_bounded_by_their_words(words, monkeypatch):
    held = []
    inner = line_dedup._within

    def within(a, b, most):
        held.append(len(a) * ((max(map(len, a)) + 63) // 64))
        return inner(a, b, most)

    monkeypatch.setattr(line_dedup, "_within", within)
    line = "".join(chr(97 + i * 7 % 26) for i in range(64 * words - 2))
    a, b = ["y" + line] * 2100, ["z" + line[:-1] + "_"] * 2100
    ok = line_dedup.all_similar(a, b)
    assert ok.all() == line_dedup.similar(a[0], b[0]) and len(ok) == 2100
    assert max(held, default=0) <= max(line_dedup.HELD, line_dedup.FEW * words * words)


def test_cells_are_computed_once_and_null_is_a_choice(spark):
    from tessera.operators import tables

    rows = spark.createDataFrame([(1, "5"), (2, "5"), (3, None)], "k int, text string")
    out = tables.once(rows, ["text"], n=F.coalesce(F.length("text"), F.lit(-1)))
    assert sorted(map(tuple, out.collect())) == [(1, "5", 1), (2, "5", 1), (3, None, -1)]


def test_small_letters_are_spelled_as_letter_by_letter(spark):
    from tessera.functions import alphabets as al

    words = spark.createDataFrame([(w,) for w in ("елка", "поезд", "ўзбекча", "чўл", "щенок", "объект", "тоғ’е", "ҷӯй", "")], "w string")
    for table, vowels, drop in ((al.UZBEK, al.UZBEK_VOWELS, False), (al.RUSSIAN, al.RUSSIAN_VOWELS, True)):
        got = words.select(al._spelled_small(F.col("w"), table, vowels, drop).alias("a"), al._spelled(F.col("w"), table, vowels, drop).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
