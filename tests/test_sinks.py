"""Sinks: a replayed batch writes nothing, exports as spreadsheets read them, dimensions and listings."""

import csv
import io
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.plans.filters import Filters
from tessera.sources import sinks

ACCOUNTS = "id long, locale string, plan string, is_test boolean"
REQUESTS = "account_id long, event_type string, job_id long, feature_id string, channel string, properties string"


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([(1, "uz", "free", False), (2, "ru", "plus", True)], ACCOUNTS)


def test_replayed_batches_write_nothing(spark, accounts, tmp_path):
    """A batch run again, a stream that lost the note of its last batch, and one that was cut off before its mark."""
    source, path, check = (str(tmp_path / x) for x in ("in", "out", "c"))
    jobs = spark.createDataFrame([(7, "pdf.merge")], "id long, feature_id string")
    put = lambda *rows: spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        live = spark.readStream.schema(REQUESTS).parquet(source)
        sinks.log_events(live, accounts, jobs, path, check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(path).drop("stream", "batch")

    put((1, "job.accepted", 7, "x", None, None), (2, "file.opened", None, "view", "bot", '{"a":1}'), (99, "nobody", None, None, None, None))
    want = [("file.opened", 2, None, "view", "bot", "ru", "plus", "development", '{"a":1}'), ("job.accepted", 1, 7, "pdf.merge", "web", "uz", "free", "production", "{}")]
    assert sorted(map(tuple, run().collect())) == want
    put((1, "job.done", 7, None, "bot", None))
    assert run().count() == 3
    forget = lambda: [note.unlink() for note in (tmp_path / "c" / "commits").iterdir() if note.name in ("1", ".1.crc")]
    forget()  # the stream does its second batch again
    files = sorted(map(str, tmp_path.glob("out/**/*.parquet")))
    assert run().count() == 3 and sorted(map(str, tmp_path.glob("out/**/*.parquet"))) == files
    write = sinks.once(path, "events")
    write(spark.createDataFrame([], "event_type string"), 0)
    assert spark.read.parquet(path).count() == 3
    Path(tmp_path / "out" / "_ledger" / "events" / "1").unlink()
    forget()  # written, not marked: written over
    assert run().count() == 3


def test_settled_once(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "out", "c"))
    schema = "job_id long, status string, completed_at timestamp"
    for rows in ([(1, "running", datetime(2026, 1, 1)), (1, "failed", datetime(2026, 1, 1, 0, 1)), (2, "succeeded", datetime(2026, 1, 1))], [(1, "succeeded", datetime(2026, 1, 1, 0, 2)), (3, "failed", datetime(2026, 1, 1, 0, 3)), (2, "succeeded", datetime(2026, 1, 1))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(schema).parquet(source)
        sinks.settle(live, path, check, ("succeeded", "failed")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.job_id, r.status) for r in spark.read.parquet(path).collect()) == [(1, "failed"), (2, "succeeded"), (3, "failed")]


def test_csv(spark, tmp_path):
    values = ["=1+1", " -2", "\t@x", "plain", 'a "b", c', "two\nlines", None, "", "+7", "a-b"]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, note string")
    lines = sinks.exported(rows, Filters("2026-10-01", "2026-10-02"), [F.desc("id")], "now")
    sinks.write_csv(lines, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    raw = part.read_bytes()
    assert raw.startswith("﻿definitions_version,1.0.0\r\n".encode())
    read = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert read[3] == ["date_from", "2026-10-01"] and read[10] == ["id", "note"]
    shown = {int(i): n for i, n in read[11:]}
    assert list(shown) == list(range(9, -1, -1))
    for i, x in enumerate(values):
        x = x or ""
        assert shown[i] == ("'" + x if x.lstrip().startswith(("=", "+", "-", "@")) or x.startswith(("\t", "\r", "\n")) else x)
    with pytest.raises(ValueError, match="Narrow filters to at most 9 rows"):
        sinks.exported(rows, Filters("2026-10-01", "2026-10-02"), [F.desc("id")], "now", most=9)


def test_local_times(spark):
    row = spark.sql("SELECT timestamp'2026-09-30 20:00:00' AS a, timestamp'2026-01-01 00:00:00.5' AS b").select(sinks.local(F.col("a"), "Asia/Tashkent"), sinks.local(F.col("b"), "America/St_Johns"))
    assert tuple(row.first()) == ("2026-10-01 01:00:00+05:00", "2025-12-31 20:30:00.500000-03:30")


def test_report_json(spark):
    a, b = spark.createDataFrame([(2, None), (1, "x")], "n long, t string"), spark.createDataFrame([], "k string")
    assert json.loads(sinks.report_json({"a": a, "b": b}).first().report) == {"a": [{"n": 1, "t": "x"}, {"n": 2, "t": None}], "b": []}


def test_dimensions_and_files(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps({"version": 1, "plans": [{"id": "free", "price": 0}, {"id": "plus", "price": 9}]}))
    (tmp_path / "f.csv").write_bytes('﻿feature_id,name\r\npdf.merge,"Merge, ""all"""\r\n'.encode())
    assert [tuple(r) for r in sinks.json_dimension(spark, str(tmp_path / "plan.json"), "plans", "id string, price int").collect()] == [("free", 0), ("plus", 9)]
    features = sinks.csv_dimension(spark, str(tmp_path / "f.csv"))
    assert features.columns == ["feature_id", "name"] and [tuple(r) for r in features.collect()] == [("pdf.merge", 'Merge, "all"')]
    found = sinks.listing(spark, str(tmp_path))
    assert sorted(r.length for r in found.select("length").collect()) == sorted(p.stat().st_size for p in tmp_path.iterdir())
    up = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("b.pdf", b"hello"), ("c.txt", b""), ("d.txt", b"x" * 50), ("e.docx", b"PK\x03\x04")], "path string, content binary")
    got = {r.path: r.refused for r in sinks.stored(up, 20).collect()}
    assert got == {"a.pdf": None, "b.pdf": "file_type_mismatch", "c.txt": "empty_file", "d.txt": "file_too_large", "e.docx": None}
