"""Findings of round 3: whole exports, seconds of rate windows, all channels, whole pages, and work that grows with the distinct texts."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tessera.functions.text import jaccard, read_once, shingles, words
from tessera.operators import documents, queues, reports
from tessera.plans.filters import Filters
from tessera.sources import sinks


def test_similarity_of_long_texts_takes_linear_time(spark):
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), i)), " ").alias("t"))
    began = time.time()
    runs = df.select(shingles(words(F.col("t")), 2).alias("r")).select(F.size("r").alias("n"), jaccard(F.col("r"), F.col("r")).alias("same")).first()
    assert (runs.n, runs.same) == (19_999, 1.0) and time.time() - began < 20


def test_an_export_without_a_limit_holds_every_row(spark):
    rows = spark.range(10_500).select("id", (F.col("id") % 7).alias("day"))
    lines = sinks.exported(rows, Filters("2026-10-01", "2026-10-02"), [F.desc("day"), F.asc("id")], "now", most=None, first="day").orderBy("no").collect()
    body = [r for r in lines if r.line[0].isdigit()]
    assert [r.line for r in body] == [f"{i},{day}" for day in range(6, -1, -1) for i in range(day, 10_500, 7)]
    assert [r.no for r in lines] == list(range(len(lines)))


def test_rate_windows_by_the_nearest_second(spark):
    at = [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 23, 59, 59, 700_000), dt.datetime(2024, 1, 1, 23, 59, 59, 400_000)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(at)], "id int, key int, at timestamp")
    refused = lambda nearest: [r.refused for r in queues.rate_limited(df, 86_400, 1, nearest).orderBy("id").collect()]
    assert refused(True) == [False, False, True] and refused(False) == [False, True, True]


def test_reports_by_channel_leave_no_event_out(spark):
    when = dt.datetime(2024, 1, 10)
    rows = [(i, i, "view", when, c, "en", "production", "{}") for i, c in enumerate(["bot", "web", "web", "mini_app"])]
    events = spark.createDataFrame(rows, "id int, account_id int, event_type string, occurred_at timestamp, channel string, locale string, environment string, properties string")
    days = Filters("2024-01-05", "2024-01-25")
    got = {r.channel: r["count"] for r in reports.by_channel(lambda c: reports.step_funnel(events, days, channel=c)).filter("event = 'view'").collect()}
    assert got == {"bot": 1, "web": 2, "mini_app": 1}


def test_pages_without_a_limit_are_whole(spark):
    pages = spark.createDataFrame([("a", "x" * 13_000), ("a", None), ("b", "y")], "g string, text string")
    got = {r.g: (r.n_pages, r.n_chars, r.refused) for r in documents.source_excerpts(pages, "g", 12_500, most=None).collect()}
    assert got == {"a": (1, 13_000, True), "b": (1, 1, False)}


def test_a_text_of_many_rows_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def size(text):
        read.add(1)
        return len(text)

    rows = spark.range(3_000).select("id", F.repeat(F.lit("x"), (F.col("id") % 3).cast("int")).alias("text"))
    got = read_once(rows, "text", F.udf(size, "int")("text").alias("n")).agg(F.sum("n")).first()[0], read.value
    assert got == (3_000, 3)


def test_chunks_come_in_small_batches(spark):
    """A batch of many texts is cut before it is read, and no text is lost."""
    from tessera.functions.text import TEXTS, chunked, chunks, parts

    docs = spark.createDataFrame([(i, f"{i} " + "word. " * 900) for i in range(3 * TEXTS + 5)] + [(10_000, None)], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.part): r.text for r in chunked(docs).collect()}
    assert got == {(r.doc_id, i): p for r in docs.collect() for i, p in enumerate(parts(r.text or ""), 1)}
    one = docs.toArrow().combine_chunks().to_batches()[0]
    sizes = [len({d for d in b.column(0).to_pylist()}) for b in chunks(iter([one]))]
    assert max(sizes) <= TEXTS and sum(sizes) >= len(one) - 1


def test_shards_are_read_a_few_at_a_time(spark):
    from tessera.llm import ranked_search

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with ranked_search._few_rows(spark):
        seen = spark.range(0, 1_000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches if len(b) <= ranked_search.ROWS), "id long").count()
    assert seen == -(-1_000 // ranked_search.ROWS) and spark.conf.get(name) == before
