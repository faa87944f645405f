"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the byte 3- and 4-grams of a text whose letters stand between blanks. A text's vector is the mean of its
subwords' embeddings, over the whole text. As the softmax is linear, a trained model is one row of class scores for each
bucket, and a prediction is a mean of rows. A temperature and a rejection threshold are fitted on training documents that
SGD did not see. Learning reads at most SAMPLE documents, chosen by the hash of doc_id; predictions read every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, pieces, sampled

#: Documents that a model is learnt from, at most.
SAMPLE = 2_000
BUCKETS, DIMENSION = 1 << 13, 16
EPOCHS, BATCH, RATE = 12, 32, 4.0
#: Share of held-back documents that the threshold rejects if their score is right as often as it says.
REJECT = 0.01
UNDETERMINED = "und"
FOLDS, HELD_OUT = 3, 1

_TO = np.full(256, 32, np.uint32)
_TO[97:123] = np.arange(97, 123)
_TO[65:91] = np.arange(97, 123)
_TO[128:] = np.arange(128, 256)


def _subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' subwords, and where each text's begin."""
    raw = b"".join(b" " + t + b"   " for t in texts)
    x = _TO[np.frombuffer(raw, np.uint8)]
    three = (x[:-3] << 16) | (x[1:-2] << 8) | x[2:-1]
    four = (three << 8) | x[3:]
    # A subword begins before or inside a word; one that begins with two blanks says nothing.
    keep = (x[1:-2] != 32) | (x[:-3] != 32)
    start = np.cumsum([0, *[len(t) + 4 for t in texts[:-1]]])
    at = np.concatenate(([0], np.cumsum(keep)))[np.minimum(start, len(keep))]
    pos = np.flatnonzero(keep)
    mix = lambda v, s: ((v * np.uint32(0x9E3779B1) + np.uint32(s)) >> np.uint32(19)).astype(np.int32)  # noqa: E731  19 = 32 - log2(BUCKETS)
    return np.stack([mix(three[pos], 0), mix(four[pos] ^ (four[pos] >> np.uint32(15)), 77)], 1), at


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(np.concatenate((at, [n])))
    out = np.zeros((len(at), values.shape[1]), np.float64)
    if (full := count > 0).any():
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out, count


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        idx, at = _subwords(texts)
        sums, count = _sums(self.scores[idx].sum(1), at, len(idx))
        return sums / np.maximum(2 * count, 1)[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.languages[k] for k in best], p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _features(docs: DataFrame) -> DataFrame:
    """lang, and the buckets and counts of each document: what training collects instead of texts."""

    def run(batches):
        for batch in pieces(batches):
            idx, at = _subwords(as_bytes(batch.column("text")))
            buckets, counts = [], []
            for a, b in zip(at, [*at[1:], len(idx)], strict=True):
                u, c = np.unique(idx[a:b], return_counts=True)
                buckets.append(u.astype(np.int32))
                counts.append((c / max(1, c.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["lang", "buckets", "shares"])

    return arrow(docs.select("text", "lang"), run, "lang string, buckets array<int>, shares array<float>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the non-null lang of documents that aren't held out; None where there is none to learn from."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out()).select("doc_id", "text", "lang")
    rows = _features(sampled(labelled, sample, "doc_id", "lang")).collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    y = np.array([languages.index(r.lang) for r in rows])
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r.buckets] = r.shares
    rng = np.random.default_rng(0)
    back = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~back)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIMENSION, len(languages))).astype(np.float32)
    b = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            h = x[part] @ e
            g = softmax(h @ w + b)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            e -= rate * 20 * (x[part].T @ (g @ w.T))  # a mean of many embeddings moves each of them little
            w -= rate * (h.T @ g)
            b -= rate * 0.1 * g.sum(0)
    scores = e @ w
    test = np.flatnonzero(back) if back.any() else fit
    z = x[test] @ scores + b
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = softmax(z / temperature).max(1)
    return Model(languages, scores.astype(np.float32), b, float(temperature), float(np.quantile(p, REJECT)))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row.

    Null, empty and letterless texts are `und` with score 0 and not accepted, as is everything without a model. Other
    predictions are always a learnt language; accepted says whether the calibrated score reaches the threshold. A null
    doc_id is not held out. lang, source and doc_id take no part in a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            texts = as_bytes(batch.column("text"))
            known = np.array([m is not None and has_letter(t) for t in texts], bool)
            lang, score = ([UNDETERMINED] * len(texts), np.zeros(len(texts))) if m is None else m.predict(texts)
            lang = [a if k else UNDETERMINED for a, k in zip(lang, known, strict=True)]
            score = np.where(known, score, 0.0)
            yes = known & (score >= (m.threshold if m else 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(yes)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    read = docs.select("doc_id", "text", held_out().alias("held_out"))
    schema = read.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return arrow(read, run, schema)


def report(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
