"""Secret scans by grammar inference.

Fixed patterns find the base spans. Their values are labelled credentials: from a bounded sample of them, one probabilistic
automaton for each kind is inferred by merging, in a prefix tree over character classes, the states whose continuations are
statistically compatible (Hoeffding's bound, red states against blue ones). All text outside base spans is then scored: runs of SHORTEST
or more token characters and every part of them between separators, by the likelihood of their format, per character and relative
to a bigram model of ordinary long tokens; those that score like the labelled values become spans of kind `format`.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nlargest
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, pieces, sampled, written

#: Labelled values of each kind, and ordinary tokens, that the automata are learnt from, at most.
SAMPLE = 400
#: Confidence of the merge test, and the least count of a state that is tested.
ALPHA, LEAST = 0.05, 4
#: Share of the labelled values of a kind that score below the threshold, where they overlap with ordinary tokens.
CUT = 0.05
#: Share of the ordinary tokens that score at most what counts as the highest of them.
PASS = 0.999
KINDS = ("assign", "access", "hex")
FORMAT = "format"

# The three base patterns.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters from which a value is scored: the least of a labelled one.
SHORTEST = 6
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
SEPARATOR = re.compile(r"[=/.]+")
#: Values of a kind in a row that are learnt from, at most.
ROW = 8
#: Ordinary tokens of a row that are learnt from, at most.
PLAIN = 8
#: Stretches that a worker remembers, lengths that are scored beside one another, how many at once, and candidates that wait for it.
MEMO, _WIDTHS, _MANY, _HELD = 1 << 18, (8, 16, 32, 64, 128, 256), 1 << 15, 1 << 17
#: Candidates of a stretch from which it is walked, places of one block of such a walk, and what rounding may do to its sums.
_FEW, _BLOCK, _SLACK = 64, 4096, 1e-6
_ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each base match, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def symbol(c: str) -> str:
    """The class of a character: hexadecimal digit in small letters, other small letter, capital, or the character itself."""
    return "h" if c.isdigit() or "a" <= c <= "f" else "z" if c.islower() else "A" if c.isupper() else c


#: Characters of each class, for the share of one character within it.
_SIZE = {"h": 16, "z": 20, "A": 26}


@dataclass
class _State:
    count: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    passes: Counter = field(default_factory=Counter)


class Automaton:
    """A probabilistic automaton of `values`, by state merging."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.states = [_State()]
        for v in values:
            s = 0
            self.states[0].count += 1
            for c in map(symbol, v):
                if c not in self.states[s].to:
                    self.states[s].to[c] = len(self.states)
                    self.states.append(_State())
                self.states[s].passes[c] += 1
                s = self.states[s].to[c]
                self.states[s].count += 1
            self.states[s].ends += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, r: int, b: int) -> bool:
        stack = [(r, b)]
        while stack:
            x, y = (self.states[i] for i in stack.pop())
            if x.count < LEAST or y.count < LEAST:
                continue
            if self._differ(x.ends, x.count, y.ends, y.count):
                return False
            for c in x.to.keys() | y.to.keys():
                if self._differ(x.passes[c], x.count, y.passes[c], y.count):
                    return False
                if c in x.to and c in y.to and x.to[c] != y.to[c]:
                    stack.append((x.to[c], y.to[c]))
        return True

    def _fold(self, r: int, b: int) -> None:
        """Adds the tree below b to r."""
        stack = [(r, b)]
        while stack:
            i, j = stack.pop()
            x, y = self.states[i], self.states[j]
            x.count += y.count
            x.ends += y.ends
            for c, k in y.to.items():
                x.passes[c] += y.passes[c]
                if c in x.to:
                    stack.append((x.to[c], k))
                else:
                    x.to[c] = k

    def _merge_all(self) -> None:
        red = [0]
        while True:
            blue = sorted({(k, i, c) for i in red for c, k in self.states[i].to.items() if k not in red})
            if not blue:
                break
            k, parent, c = blue[0]
            for r in red:
                if self._compatible(r, k):
                    self.states[parent].to[c] = r
                    self._fold(r, k)
                    break
            else:
                red.append(k)
        place = {k: i for i, k in enumerate(red)}
        self.states = [self.states[k] for k in red]
        for s in self.states:
            s.to = {c: place[k] for c, k in s.to.items()}

    def score(self, value: str) -> float:
        """Log-likelihood of the value, each character at its share of its class. What no labelled value does has half a count."""
        s, total = 0, 0.0
        for ch in value:
            c = symbol(ch)
            state = self.states[s]
            total += math.log((state.passes[c] or 0.5) / (state.count + 0.5) / _SIZE.get(c, 1))
            s = state.to.get(c, s)
        state = self.states[s]
        return total + math.log((state.ends or 0.5) / (state.count + 0.5))


class Ordinary:
    """Character bigrams of tokens that are no credentials, with a little of everything."""

    def __init__(self, tokens: list[str]):
        self.pairs, self.heads = Counter(), Counter()
        for t in tokens:
            for a, b in zip("^" + t, t, strict=False):
                self.pairs[a + b] += 1
                self.heads[a] += 1

    def score(self, value: str) -> float:
        return sum(math.log((self.pairs[a + b] + 0.5) / (self.heads[a] + 0.5 * 67)) for a, b in zip("^" + value, value, strict=False))


class Grammar:
    """Automata of labelled values by kind, and the least score per character that counts as one of them."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.ordinary = Ordinary(ordinary)
        self.kinds = {}
        for kind, values in sorted(labelled.items()):
            automaton = Automaton(sorted(values))
            scores = sorted(self._score(automaton, v) for v in values)
            plain = sorted(self._score(automaton, v) for v in ordinary) or [-math.inf]
            top, least = plain[int((len(plain) - 1) * PASS)], scores[int(len(scores) * CUT)]
            # Midway between the two where no labelled value scores like an ordinary token.
            self.kinds[kind] = (automaton, max(0.0, min(least, (top + scores[0]) / 2) if top < scores[0] else least))

    def _score(self, automaton: Automaton, value: str) -> float:
        return (automaton.score(value) - self.ordinary.score(value)) / len(value)

    def accepts(self, value: str) -> bool:
        return any(self._score(a, value) >= least for a, least in self.kinds.values())

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A grammar as tables, for many values at once. A value is walked once by each automaton, character by character, beside others of its length."""

    def __init__(self, grammar: Grammar):
        self.of = np.full(256, -1, np.int16)
        for k, c in enumerate(_ALPHABET):
            self.of[ord(c)] = k
        classes = sorted({symbol(c) for c in _ALPHABET})
        self.kind_of = np.array([classes.index(symbol(c)) for c in _ALPHABET])
        n, o = len(_ALPHABET), grammar.ordinary
        self.pairs = np.array([[math.log((o.pairs[a + b] + 0.5) / (o.heads[a] + 0.5 * 67)) for b in _ALPHABET] for a in (*_ALPHABET, "^")])
        self.first = n  # the row of what a value begins with
        self.tables = []
        for automaton, least in grammar.kinds.values():
            to = np.array([[s.to.get(c, i) for c in classes] for i, s in enumerate(automaton.states)])
            step = np.array([[math.log((s.passes[c] or 0.5) / (s.count + 0.5) / _SIZE.get(c, 1)) for c in classes] for s in automaton.states])
            end = np.array([math.log((s.ends or 0.5) / (s.count + 0.5)) for s in automaton.states])
            self.tables.append((to, step, end, least))
        self.lists = [(to.tolist(), step.tolist(), end.tolist(), least) for to, step, end, least in self.tables]
        self.one = self._joined() if self.tables else None

    def __call__(self, values: list[str]) -> np.ndarray:
        """Whether each value is accepted."""
        found = np.zeros(len(values), bool)
        lengths = np.array([len(v) for v in values], np.int64)
        for low, high in zip((0, *_WIDTHS), (*_WIDTHS, None), strict=True):
            some = np.flatnonzero((lengths > low) & ((lengths <= high) if high else True))
            for start in range(0, len(some) if high else 0, _MANY):
                found[some[start : start + _MANY]] = self._beside([values[i] for i in some[start : start + _MANY]], lengths[some[start : start + _MANY]])
            if not high:
                for i in some:
                    found[i] = self._alone(values[i])
        return found

    def _beside(self, values: list[str], lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        n = lengths[order]
        codes = self.of[np.array([values[i].encode() for i in order]).view(np.uint8).reshape(len(values), -1)]
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # values longer than each position
        plain = np.zeros(len(values))
        before = np.full(len(values), self.first)
        for at, k in enumerate(active):
            plain[:k] += self.pairs[before[:k], codes[:k, at]]
            before[:k] = codes[:k, at]
        good = np.zeros(len(values), bool)
        for to, step, end, least in self.tables:
            total, state = np.zeros(len(values)), np.zeros(len(values), np.int64)
            for at, k in enumerate(active):
                c = self.kind_of[codes[:k, at]]
                total[:k] += step[state[:k], c]
                state[:k] = to[state[:k], c]
            good |= (total + end[state] - plain) / n >= least
        found = np.empty(len(values), bool)
        found[order] = good
        return found

    def _alone(self, value: str) -> bool:
        codes = self.of[np.frombuffer(value.encode(), np.uint8)]
        plain = self.pairs[np.r_[self.first, codes[:-1]], codes].sum()
        kinds = self.kind_of[codes].tolist()
        for to, step, end, least in self.tables:
            rows, steps, s, total = to.tolist(), step.tolist(), 0, 0.0
            for c in kinds:
                total += steps[s][c]
                s = rows[s][c]
            if (total + end[s] - plain) / len(codes) >= least:
                return True
        return False

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All automata as one: where each begins, by class where each state goes and what that adds to its score over the least one that counts, and what ending in a state adds."""
        first = np.cumsum([0, *(len(end) for *_, end, _ in self.tables)])
        to = np.concatenate([to + k for (to, *_), k in zip(self.tables, first, strict=False)])
        gain = np.concatenate([step - least for _, step, _, least in self.tables])
        return first, to.T.copy(), gain.T.copy(), np.concatenate([end for *_, end, _ in self.tables])

    def _hopeful(self, starts: np.ndarray, codes: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        """The starts from which an end might be accepted, if after SHORTEST characters every step were the best that its class and the one before allow."""
        first, to, gain, end = self.one
        ok = np.zeros(len(starts), bool)
        for a, b in zip(first, first[1:], strict=False):
            state, before, at = np.full(len(starts), a), np.full(len(starts), self.first), np.zeros(len(starts))
            for j in range(SHORTEST):
                c = codes[starts + j]
                at += gain[self.kind_of[c], state] - self.pairs[before, c]
                state, before = to[self.kind_of[c], state], c
            most = np.stack([gain[:, np.unique(x[a:b])].max(1) for x in to])
            ahead = np.r_[0, np.cumsum(np.r_[0, most[kinds[:-1], kinds[1:]]] - pairs)]
            top = np.maximum.accumulate(np.where(is_end, ahead, -np.inf)[::-1])[::-1]
            ok |= at + (top - ahead)[starts + SHORTEST] + end[a:b].max() >= -_SLACK
        return starts[ok]

    def walked(self, value: str, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
        """From the left, the longest part from each start to one of the ends that is accepted; none begins within another.

        The best that any end adds, from a place and a state on, is found backwards for all states at once, so that a start is
        walked only as far as an accepted end is ahead. Of the bests one in _BLOCK places stays; those between are found again.
        """
        if not self.tables:
            return []
        n, codes = len(value), self.of[np.frombuffer(value.encode(), np.uint8)]
        kinds, pairs, is_end = self.kind_of[codes], self.pairs[np.r_[self.first, codes[:-1]], codes], np.zeros(n + 1, bool)
        is_end[ends] = True
        begins = self._hopeful(np.array([s for s in starts if n - s >= SHORTEST], np.int64), codes, kinds, pairs, is_end).tolist()
        if not begins:
            return []
        first, to, gain, end = self.one
        so_far = np.r_[0, np.cumsum(pairs)]  # the bests are held less this, up to their place: a step is then the same for all of a class
        steps, take, maximum = list(zip(to, gain, strict=True)), np.ndarray.take, np.maximum

        def back(best: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
            """The bests from high - 1 down to low."""
            for k, e, p in zip(kinds[low:high][::-1].tolist(), is_end[low:high][::-1].tolist(), so_far[low:high][::-1].tolist(), strict=True):
                next_, more = steps[k]
                best = take(best, next_)
                best += more
                if e:
                    maximum(best, end - p, best)
                yield best

        blocks = -(-n // _BLOCK)
        after = {blocks - 1: end - so_far[n]}  # the bests at the first place after a block
        for b in range(blocks - 1, (begins[0] + SHORTEST) // _BLOCK, -1):
            for best in back(after[b], b * _BLOCK, min(n, (b + 1) * _BLOCK)):
                pass
            after[b - 1] = best
        held: dict[int, np.ndarray] = {}

        def best_at(i: int, state: int) -> float:
            b = i // _BLOCK
            if b not in held:
                held.pop(b - 2, None)
                held[b] = np.array(list(back(after[b], b * _BLOCK, min(n, (b + 1) * _BLOCK)))[::-1])
            return held[b].item(i - b * _BLOCK, state) + before[i]

        out, done = [], -1
        kinds_, pairs_, before, stops = kinds.tolist(), pairs.tolist(), so_far.tolist(), is_end.tolist()
        for s in begins:
            if s < done:
                continue
            longest = -1
            for (to_, step, end_, least), a in zip(self.lists, first.tolist(), strict=False):
                state, total, plain, i = 0, 0.0, 0.0, s
                while True:
                    if i - s == SHORTEST or (stops[i] and i - s > SHORTEST):
                        if stops[i] and (total + end_[state] - plain) / (i - s) >= least:
                            longest = max(longest, i)
                        if i == n or total - plain - least * (i - s) + best_at(i, a + state) < -_SLACK:
                            break
                    k = kinds_[i]
                    plain += pairs_[i] if i > s else self.pairs[self.first, codes[i]]
                    total += step[state][k]
                    state = to_[state][k]
                    i += 1
            if longest > 0:
                out.append((s, longest))
                done = longest
        return out


def _free(n: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What `taken`, sorted, leaves of n characters."""
    at = 0
    for a, b in taken:
        if at < a:
            yield at, a
        at = max(at, b)
    if at < n:
        yield at, n


def _cut(value: str) -> tuple[list[int], list[int]]:
    """Where candidates of a stretch begin, at its start and after its separators but never with one, and where they end: before its separators and at its end."""
    cuts = [m.span() for m in SEPARATOR.finditer(value)]
    return [*[0] * (not cuts or cuts[0][0] > 0), *(b for _, b in cuts)], [*(a for a, _ in cuts), len(value)]


def _taken_of(values: set[str], scorer: Scorer) -> dict[str, tuple[tuple[int, int], ...]]:
    """Of each stretch the spans that the grammar takes: from the left, the longest of a start, none begins within another.

    All pairs of a start and an end of SHORTEST characters or more are tried: those of a stretch with few beside those of others,
    those of one with many by a walk that is linear in the stretch.
    """
    told: dict[str, tuple] = dict.fromkeys(values, ())
    whole = [v for v in values if not ("." in v or "/" in v or "=" in v)]
    for k in range(0, len(whole), _HELD):
        told.update((v, ((0, len(v)),)) for v in compress(whole[k : k + _HELD], scorer(whole[k : k + _HELD]).tolist()))
    held: list[tuple[str, list[tuple[int, int]]]] = []
    waiting = 0

    def decide() -> None:
        asked = list({v[s:e] for v, pairs in held for s, e in pairs})
        good = set(compress(asked, scorer(asked).tolist()))
        for v, pairs in held if good else ():
            done = -1
            for s, e in pairs:
                if s >= done and v[s:e] in good:
                    told[v] += ((s, e),)
                    done = e
        held.clear()

    for v in values.difference(whole):
        starts, ends = _cut(v)
        if len(starts) * len(ends) > _FEW or len(v) > _WIDTHS[-1]:
            told[v] = tuple(scorer.walked(v, starts, ends))
            continue
        held.append((v, [(s, e) for s in starts for e in reversed(ends) if e - s >= SHORTEST]))
        waiting += len(held[-1][1])
        if waiting >= _HELD:
            decide()
            waiting = 0
    decide()
    return told


def _formats(texts: list[str], taken: list[list[tuple[int, int]]], scorer: Scorer, known: dict[str, tuple]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text outside `taken` that the grammar takes; none begins within another. `known` remembers short stretches, each of which is decided once."""
    stretches = [{m[0] for a, b in _free(len(t), spans) for m in TOKEN.finditer(t, a, b)} for t, spans in zip(texts, taken, strict=True)]
    told = _taken_of(set().union(*stretches).difference(known), scorer)
    hits = {v: spans for v, spans in told.items() if spans}
    hits |= {v: spans for v, spans in known.items() if spans}
    out: list[list[tuple[int, int, str]]] = []
    for text, spans, own in zip(texts, taken, stretches, strict=True):
        out.append([])
        if not own.isdisjoint(hits):
            for m in (m for a, b in _free(len(text), spans) for m in TOKEN.finditer(text, a, b)):
                out[-1] += [(m.start() + s, m.start() + e, FORMAT) for s, e in hits.get(m[0], ())]
    if len(known) > MEMO:
        known.clear()
    known.update((v, spans) for v, spans in told.items() if len(v) <= _WIDTHS[2])
    return out


def plain_tokens(text: str, base: list[tuple[int, int, str, str]], most: int = PLAIN) -> list[str]:
    """Ordinary tokens of a text: of those that touch no base span the first with a digit and the longest, half of each."""
    found = [m[0] for m in TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, b, *_ in base)] if base else TOKEN.findall(text)
    digits = [t for t in found if not t.isalpha() and any(c.isdigit() for c in t)][: most // 2]
    rest, left = set(found).difference(digits), most - len(digits)
    least = nlargest(left, map(len, rest))[-1:]
    return digits + sorted((t for t in rest if len(t) >= least[0]), key=lambda t: (-len(t), t))[:left]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and a few ordinary tokens (both JSON) of every row; null where there are none."""

    def run(batches):
        for batch in pieces(batches):
            base, plain = [], []
            for raw in as_bytes(batch.column("text")):
                text = raw.decode("utf-8", "replace")
                found = base_spans(text)
                base.append(json.dumps(found) if found else None)
                tokens = plain_tokens(text, found)
                plain.append(json.dumps(tokens) if tokens else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(plain, pa.string())], ["doc_id", "base", "ordinary"])

    read = docs.select("doc_id", "text")
    return arrow(read, run, read.select("doc_id").schema.add("base", "string").add("ordinary", "string"))


def learn(scanned: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar from the first ROW values of a kind in each of at most `sample` rows, and the ordinary tokens of as many, chosen by the hash of doc_id."""
    labelled = {}
    for kind in KINDS:
        rows = sampled(scanned.filter(F.col("base").contains(f'"{kind}"')).select("doc_id", "base"), sample, "doc_id", "base").collect()
        values = sorted({v for r in rows for v in [v for _, _, k, v in json.loads(r.base) if k == kind][:ROW]})
        if values:
            labelled[kind] = values
    rows = sampled(scanned.filter("ordinary IS NOT NULL").select("doc_id", "ordinary"), sample, "doc_id", "ordinary").collect() if labelled else []
    return Grammar(labelled, sorted({t for r in rows for t in json.loads(r.ordinary)}))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (base and format) of every row.

    Null and empty texts have no spans; without labelled values nothing is added to the base. Repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(written(scan(docs), "secret-scan")))

    def run(batches):
        scorer, known = shared.value.scorer(), {}
        for batch in pieces(batches):
            texts = [raw.decode("utf-8", "replace") for raw in as_bytes(batch.column("text"))]
            base = [[x[:3] for x in base_spans(t)] for t in texts]
            more = _formats(texts, [sorted((a, b) for a, b, _ in x) for x in base], scorer, known)
            counts = [pa.array([sum(x[2] == k for x in spans) for spans in base], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            spans = [_joined(sorted([*x, *y], key=lambda s: (s[0], (*KINDS, FORMAT).index(s[2])))) for x, y in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    read = docs.select("doc_id", "text")
    schema = read.select("doc_id").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return arrow(read, run, schema.add("base_sha256", "string").add("spans", "string"))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
