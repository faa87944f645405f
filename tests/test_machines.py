"""Machines over tables and streams: what each rule says, late and repeated rows, and a restart from the checkpoint."""

import random

import pytest

from tessera.streaming import machines as m

SCHEMA = "key string, at long, seq long, kind string, n long, text string"


def said(spark, machine, *events, until=10**6):
    rows = [("k", at, i, kind, n, text) for i, (at, kind, n, text) in enumerate(events)]
    return [(r.at, r.said) for r in m.over_table(spark.createDataFrame(rows, SCHEMA), machine, until).collect()]


def words(spark, machine, *events, **more):
    return [w for _, w in said(spark, machine, *events, **more)]


def test_deliveries(spark):
    look = lambda at: (at, "look", None, None)
    result = lambda at, text, n=0: (at, "result", n, text)
    assert words(spark, m.deliveries(2), look(0), look(119), look(120), result(130, "retrying", 60), look(150), look(190), look(191)) == ["taken", "no", "taken", "retrying", "no", "exhausted", "no"]
    assert words(spark, m.deliveries(), look(0), result(5, "delivered"), result(6, "failed"), look(300)) == ["taken", "delivered", "no", "no"]


def test_copies(spark):
    look, tap = lambda at: (at, "look", None, None), lambda at: (at, "tap", None, None)
    assert words(spark, m.copies(), look(0), look(120), look(500)) == ["taken", "interrupted", "no"]
    assert words(spark, m.copies(), look(0), tap(3), look(121), look(122)) == ["taken", "seen", "arrived", "no"]
    assert words(spark, m.copies(), look(0), (4, "result", 30, "retrying"), tap(5), look(99)) == ["taken", "retrying", "arrived", "no"]
    assert words(spark, m.copies(), (0, "pause", 50, None), look(49), look(50), tap(51), (52, "result", 0, "failed")) == ["paused", "no", "taken", "seen", "delivered"]


def test_notices(spark):
    look = lambda at: (at, "look", None, None)
    assert words(spark, m.notices(2), look(0), look(121), (122, "result", 0, "1:delivered"), (123, "result", 9, "2:retrying"), look(131), look(132)) == ["taken", "taken", "no", "retrying", "no", "exhausted"]


def test_workers(spark):
    assert said(spark, m.workers(), (0, "start", 60, None), (50, "beat", 60, None), (200, "settle", None, "succeeded"), (201, "beat", 60, None)) == [(0, "leased"), (50, "leased"), (110, "worker_interrupted"), (200, "no"), (201, "no")]
    assert said(spark, m.workers(), (0, "beat", 60, None), (1, "start", 60, None), (9, "settle", None, "succeeded"), (10, "settle", None, "failed")) == [(0, "no"), (1, "leased"), (9, "succeeded"), (10, "no")]
    assert said(spark, m.workers(), (0, "start", 60, None), until=59) == [(0, "leased")]


def test_checkpoints(spark):
    call = lambda at, n=5000: (at, "call", n, None)
    assert words(spark, m.checkpoints(), call(0), call(359), call(360), (361, "done", 0, None), (362, "done", 360, None), call(4999), call(5000, 9000)) == ["called", "refused", "called", "no", "completed", "reused", "called"]
    assert words(spark, m.checkpoints(), call(0), (3, "error", 0, None), call(4), (5000, "done", 4, None), call(5001, 5001)) == ["called", "freed", "called", "no", "called"]


def test_memberships(spark):
    ask = lambda at, text, kind="ask": (at, kind, None, text)
    got = words(spark, m.memberships(), ask(0, "not_member"), ask(59, "member"), ask(60, "unknown"), ask(179, "not_member"), ask(180, "member"), ask(181, "not_member", "refresh"), ask(182, "member"))
    assert got == ["asked:out", "kept:out", "asked:in", "kept:in", "asked:in", "asked:out", "kept:out"]


def _events(seed, n=300):
    """Events of a few keys with ties, repeats, and kinds of every machine."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind, text, number = r.choice([("look", None, None), ("result", r.choice(["retrying", "failed", "delivered"]), r.randrange(90)), ("tap", None, None), ("pause", None, i * 7 + r.randrange(60)), ("start", None, 40), ("beat", None, 40), ("settle", "succeeded", None)])
        rows.append((f"k{r.randrange(6)}", i * 7 + r.randrange(40), i, kind, number, text))
    return rows


@pytest.mark.parametrize("machine", [m.deliveries(3), m.copies(), m.workers()], ids=["deliveries", "copies", "workers"])
def test_stream_equals_table(spark, tmp_path, machine):
    """Late rows within the watermark, repeated rows, and a stop between batches that goes on from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _events(5)
    want = sorted(map(tuple, m.over_table(spark.createDataFrame(rows, SCHEMA), machine, 2_000).collect()), key=repr)
    cuts = [rows[:100], rows[100:200] + rows[95:100], rows[200:] + rows[290:300], [("end", 100_000, 1, "look", None, None)], [("end", 200_000, 2, "look", None, None)]]
    for i, part in enumerate(cuts):
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = m.over_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), machine)
        q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != "end" and r.at <= 2_100), key=repr)
    assert [g for g in got if g[1] <= 2_000] == [w for w in want if w[1] <= 2_000]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
