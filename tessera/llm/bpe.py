"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The model is made of merge ranks (or read from the library's own file), with the byte-to-character map that the library
wants. A single blank or line feed between two characters that are no white space always ends a match of the pattern, so
a text is a series of words whose ids don't depend on each other: a worker sends each word through the library once and
keeps its ids. Texts with other white space go through the library whole. Decoding looks up each id's bytes and joins them, so characters whose
bytes fell into several ids come together again before anything is read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow, as_bytes, pieces

#: Words whose ids a worker keeps; past that it starts afresh.
MEMO = 800_000
#: White space, as widely as anything counts it, but for blank and line feed.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]


_CHARACTERS = byte_characters()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token the pair it is merged of: what the merges of lower rank leave of its bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def model_of_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's JSON for a rank file: each match of `pattern` is encoded by itself, without special tokens."""
    char = _CHARACTERS
    spell = lambda b: "".join(char[x] for x in b)
    model = tokenizers.models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)])
    t = tokenizers.Tokenizer(model)
    t.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([
        tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated"),
        tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return t.to_str()


def id_bytes(model: str) -> list[bytes]:
    """The bytes of each id of a byte-level model."""
    byte = {c: b for b, c in enumerate(_CHARACTERS)}
    vocab = json.loads(model)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        out[k] = bytes(byte[c] for c in token)
    return out


class _Words(dict):
    """Ids (as bytes of 32-bit integers) of words that follow `lead`, learnt from the library on first sight."""

    def __init__(self, tokenizer, lead: str):
        self.tokenizer, self.lead = tokenizer, lead
        self.mapped = "".join(_CHARACTERS[x] for x in lead.encode())

    def __missing__(self, word: str) -> bytes:
        last = word[-1:]
        if last in ",." and _plain(word[:-1]):  # a stop is a match of its own
            found = self[word[:-1]] + self.piece(last)
        elif _plain(word):  # letters behind at most one blank are one match
            found = self.piece(self.mapped + "".join([_CHARACTERS[x] for x in word.encode()]))
        else:
            found = b"".join([self.piece(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.lead + word)])
        self[word] = found
        return found

    def piece(self, mapped: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], np.int32).tobytes()


def _plain(word: str) -> bool:
    """Letters below U+0250 alone, whose class no version of Unicode disputes."""
    return word.isalpha() and max(word) < "\u0250"


class Encoder:
    """Ids of whole texts, equal to the library's own encoding of each."""

    def __init__(self, model: str):
        self.tokenizer = tokenizers.Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.first, self.later = _Words(self.tokenizer, ""), _Words(self.tokenizer, " ")
        self.feed = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.later) + len(self.first) > MEMO:
            self.later.clear()
            self.first.clear()
        first, later, feed = self.first, self.later, self.feed
        first[""] = b""
        out = []
        for t in texts:
            if not t or "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n" or _OTHER_SPACE.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32))
                continue
            parts = []
            for line in t.split("\n"):
                words = line.split(" ")
                parts.append(feed)
                parts.append(first[words[0]])
                del words[0]
                parts += [later[w] for w in words]
            del parts[0]
            out.append(np.frombuffer(b"".join(parts), np.int32))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """This worker's encoder of a model."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def spans(ids: np.ndarray, lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token of a text; a character whose bytes fell into several tokens is in each of them."""
    end = np.cumsum(lengths[ids])
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(starts) - 1
    return character[end - lengths[ids]], character[end - 1] + 1


def encode_and_decode(docs: DataFrame, model: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_split of each row; with `keep`, docs' columns and token_ids before them.

    n_split counts the tokens that begin inside a character, by their spans. Null and empty texts have no ids. Repeated rows
    give repeated results. Other columns pass through; one with the name of a result is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "n_split", "token_ids")] if keep else ["doc_id"]

    def run(batches):
        enc, table = encoder(shared.value), id_bytes(shared.value)
        names, lengths = [str(i) for i in range(len(table))], np.array([len(b) for b in table])
        for batch in pieces(batches):
            texts = as_bytes(batch.column("text"))
            ids = enc.encode([b.decode("utf-8", "replace") for b in texts])
            split = []
            for raw, x in zip(texts, ids, strict=True):
                if not len(x) or raw.isascii():
                    split.append(0)
                else:
                    first, past = spans(x, lengths, raw)
                    split.append(int((first[1:] < past[:-1]).sum()))
            digest = [hashlib.sha256(" ".join([names[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(decode(x, table)).hexdigest() for x in ids]
            new = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "n_split": pa.array(split, pa.int64())}
            if keep:
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                new["token_ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], *new.values()], [*cols, *new])

    schema = docs.select(*[f"`{c}`" for c in cols]).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("n_split", "long")
    schema = schema.add("token_ids", T.ArrayType(T.IntegerType())) if keep else schema
    return arrow(docs.select(*[f"`{c}`" for c in dict.fromkeys([*cols, "text"])]), run, schema)
