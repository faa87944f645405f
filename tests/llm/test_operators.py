"""The training-data operators against brute force, on small tables with nulls, empty texts, ties, repeats and odd columns."""

import base64
import collections
import hashlib
import itertools
import json
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tessera.llm import bpe, decontaminate, language_id, line_dedup, quality, secret_scan, simhash, suffix_dedup, token_output, warc
from tessera.llm.common import new_path, sampled

RND = random.Random(5)
VOCAB = [a + b for a in "lo ne ra ti mus".split() for b in "ka dor fi shen".split()]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


ODD = [
    (1, prose(60, 1)), (2, prose(60, 1)), (3, None), (4, ""), (5, " \n\t"), (6, prose(60, 1).replace("loka", "LOKA", 1)), (7, "x" * 3000), (8, prose(3000, 2)),
    (9, "é\U0001f600 ñandú — ß " * 20), (10, "\x00\x1c a b\r\n  c "), (11, prose(60, 1) + "\n" + prose(30, 3)), (12, prose(30, 3)), (12, prose(30, 3)),
    (13, "don't I'll <|endoftext|> 123 45,6"), (14, "a"), (15, "ab" * 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that results use."""
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}", len(t or ""), "mine", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, _gone int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def union(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_quality(docs, none):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed

    small = [(i, t) for i, t in ODD if len(t or "") < 5000] + [(50, "a b c d e f g h " * 9), (51, "one two\n" * 3 + "#|")]
    df = docs.sparkSession.createDataFrame(small, "doc_id long, text string")
    got = rows(quality.measures(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted([(i, *brute(t)) for i, t in small], key=repr)
    kept = {r.doc_id for r in quality.measures(docs).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept and quality.keep_good(docs).columns == docs.columns
    assert {1, 2, 12} <= kept and not kept & {3, 4, 5, 7, 14}
    assert quality.measures(none).count() == quality.keep_good(none).count() == 0


def test_quality_order_changes_no_verdict(docs):
    def verdict(order):
        return {r.doc_id for r in quality.cascade(docs, order).filter("_kept").collect()}

    assert verdict(quality.rules()) == verdict(quality.rules()[::-1])


def test_decontamination(docs, none):
    spark = docs.sparkSession
    items = [(1, prose(60, 1)), (2, "Loka nedor"), (3, None), (4, "..."), (5, prose(12, 9)), (5, prose(12, 9)), (10, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def brute(t):
        w, hit, found = words(t), set(), set()
        for item, x in items:
            x = words(x)
            for i in range(max(1, len(x) - 9) if x else 0):
                p = x[i : i + 10]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        found.add(str(item))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = sorted([(i, *brute(t)) for i, t in ODD], key=repr)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.report(docs, bench), *cols) == want
    assert rows(decontaminate.report(docs, bench, nbytes=40), *cols) == want  # blocks of one or two items, written between passes
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in want if not x[5])
    assert decontaminate.report(none, bench).count() == 0 and not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


def test_wu_manber_long_and_repeated():
    text = " ".join(VOCAB) * 400
    item = " ".join(VOCAB[3:16])
    n, hit, found = next(decontaminate.Searcher([(1, item.encode())]).search([text.encode()]))
    w = decontaminate.words(text.encode())
    assert n == len(w) and found == {1} and hit.sum() >= 10 * 400 - 20


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    fp = [fingerprint(t) for _, t in ODD]
    root = union(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    want = sorted([(i, f"{f:016x}", min(ODD[k][0] for k in range(len(fp)) if root[k] == r)) for (i, _), f, r in zip(ODD, fp, root, strict=True)], key=repr)
    assert rows(simhash.report(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[2] for w in want}
    assert simhash.report(none).count() == 0


@pytest.mark.parametrize("large", [2_000, 4])
def test_simhash_links(spark, monkeypatch, large):
    """Fingerprints around few centres: many links, chains, and buckets above the limit."""
    r = random.Random(large)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    root = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash._links(df, large)
    links = found.filter("kind = 0").select("a", "b").unionByName(simhash._balls(found.filter("kind = 1").selectExpr("a AS fp").distinct()))
    of = {r.node: r.root for r in simhash.components(links).collect()}
    groups = {}
    for x, k in zip(signed, root, strict=True):
        groups.setdefault(k, []).append(x)
    assert all(of.get(x, x) == min(g) for g in groups.values() for x in g)
    assert large == 2_000 or found.filter("kind = 1").count()


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(500):
        a, b = ("".join(RND.choice("abc") for _ in range(RND.randrange(15))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == slow(a, b)


def test_line_dedup(docs, none):
    spark = docs.sparkSession
    base = [prose(16, s) for s in range(30, 36)]
    r = random.Random(1)
    texts = list(ODD)
    for k in range(40):
        lines = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(base).split()
            for _ in range(r.randrange(2)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            lines.append(" ".join(w))
        texts.append((100 + k, "\n".join(lines)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = {}
    for i, t in texts:
        for no, part in enumerate((t or "").split("\n")):
            if key := plain_words(part):
                nodes[key] = min(nodes.get(key, (i, no)), (i, no))
    names = sorted(nodes, key=lambda k: nodes[k])
    alike = lambda x, y: abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and slow_distance(x, y) <= 0.2 * max(len(x), len(y))
    root = union(len(names), [(x, y) for x in range(len(names)) for y in range(x) if alike(names[x], names[y])])
    stays = {names[k]: nodes[names[root[k]]] for k in range(len(names))}

    def brute(i, t):
        parts = [] if t is None else t.encode().split(b"\n")
        keep = [p for no, p in enumerate(parts) if not (key := plain_words(p.decode())) or stays[key] == (i, no)]
        return len(parts), len(parts) - len(keep), hashlib.sha256(b"\n".join(keep)).hexdigest()

    got = rows(line_dedup.report(df), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == sorted([(i, *brute(i, t)) for i, t in texts], key=repr)
    assert any(x != y for x, y in zip(root, range(len(root)), strict=True))  # some lines are near and not equal
    kept = line_dedup.keep_lines(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id = 1").count() == 1
    assert line_dedup.report(none).count() == 0


def plain_words(line):
    """The normal form, written anew: words of ASCII letters and digits, and of other characters, with ASCII letters in lower case."""
    return " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def slow_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def test_line_dedup_small_edits(spark):
    """Nine in ten lines of 3 words and more are found with one word replaced or one letter mistyped, where that is similar."""
    r = random.Random(9)
    planted = {}
    for k in range(720):
        n = (3, 5, 8, 15, 30, 70)[k % 6]
        words = prose(n, 5_000 + k).split()
        copy, at = list(words), r.randrange(n)
        if k // 6 % 2:
            copy[at] = r.choice(VOCAB)
        else:
            i = r.randrange(len(copy[at]))
            copy[at] = copy[at][:i] + r.choice("aeioust") + copy[at][i + 1 :]
        x, y = " ".join(words), " ".join(copy)
        if x != y and slow_distance(words[at], copy[at]) <= 0.2 * max(len(x), len(y)):
            planted[k] = (n, k // 6 % 2, f"{x}\n{y}")
    got = {x.doc_id: x.n_removed for x in line_dedup.report(spark.createDataFrame([(k, t) for k, (*_, t) in planted.items()], "doc_id long, text string")).collect()}
    found = {}
    for k, (n, how, _) in planted.items():
        found.setdefault((n, how), []).append(got[k] >= 1)
    assert all(sum(v) >= 0.9 * len(v) for v in found.values()), {k: sum(v) / len(v) for k, v in found.items()}


def test_edit_test_in_bulk():
    r = random.Random(3)
    a, b = [], []
    for k in range(400):
        n = r.choice((1, 5, 40, 64, 65, 130))
        x = "".join(r.choice("abcdeéж") for _ in range(n))
        y = edited(x, r.choice((0, 0.1, 0.18, 0.25, 0.5)), r)
        a.append(x)
        b.append(y)
    want = [slow_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert line_dedup.all_similar(a, b).tolist() == want == [line_dedup.similar(x, y) for x, y in zip(a, b, strict=True)]
    assert 50 < sum(want) < 380


def test_line_dedup_rows(spark):
    """Rows that share a doc_id keep their own lines; repeated rows fare alike; a row without doc_id stays whole."""
    x, y, z = prose(12, 1), prose(12, 2), prose(12, 3)
    texts = [(1, f"{x}\n{y}"), (1, f"{z}\n{x}"), (2, y), (2, y), (None, x), (3, None), (3, "")]
    got = rows(line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "text", "_n_lines", "_n_removed")
    kept = {t for i, t, *_ in got if i == 1}
    assert kept in ({f"{x}\n{y}", z}, {y, f"{z}\n{x}"})
    assert [r for r in got if r[0] != 1] == sorted([(2, "", 1, 1), (2, "", 1, 1), (None, x, 1, 0), (3, None, 0, 0), (3, "", 1, 0)], key=repr)


def edited(line, share, r):
    """`line` with about so large a share of its characters replaced, inserted or taken out, at random places."""
    s = list(line)
    for _ in range(int(len(line) * share)):
        i, how = r.randrange(len(s)), r.randrange(3)
        s[i : i + 1] = [r.choice("abcdefghij")] if how == 0 else [r.choice("abcdefghij"), s[i]] if how == 1 else []
    return "".join(s)


def test_line_dedup_recall(spark):
    """Pairs by edit similarity alone, whatever their SimHashes: planted typos in lines of any length."""
    r = random.Random(4)
    planted = {}
    for k in range(600):
        n = (1, 2, 6, 12, 30, 80)[k % 6]
        share = (0.05, 0.1, 0.2)[k // 6 % 3]
        line = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 9))) for _ in range(n))
        copy = edited(line, max(share, 1.01 / len(line)), r)
        if copy != line and line_dedup.similar(line, copy):
            planted[k] = (n, share, line, copy)
    docs = spark.createDataFrame([(k, f"{x}\n{y}") for k, (_, _, x, y) in planted.items()], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in line_dedup.report(docs).collect()}
    found = {}
    for k, (n, share, *_) in planted.items():
        found.setdefault((n if n < 8 else 8, share), []).append(got[k] == 1)
    found = {k: sum(v) / len(v) for k, v in found.items()}
    assert found[8, 0.05] >= 0.98 and found[8, 0.1] >= 0.85 and found[8, 0.2] >= 0.25, found
    assert all(v == 1 for (n, _), v in found.items() if n == 1) and all(found[n, 0.05] >= 0.9 for n in (2, 6)), found


def test_line_dedup_retest():
    """Buckets taken one by one join what all pairs that may be similar by some key and pass the edit test join, whatever is joined before."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    shared = [word() for _ in range(12)]
    bases = [" ".join([*(word() for _ in range(4)), *shared, *(word() for _ in range(4))]) for _ in range(4)]
    normal = sorted({edited(b, share, r) for b in bases for share in (0.02, 0.1, 0.15, 0.2) for _ in range(4)} | {edited("shorttitle", 0.1, r) for _ in range(4)})
    raw = [x.encode() for x in normal]
    row, key, place = line_dedup.keys(raw)
    sketch = line_dedup.sketches(raw)
    buckets = {}
    for i, k, at in zip(row.tolist(), key.tolist(), place.tolist(), strict=True):
        buckets.setdefault(k, {}).setdefault(i, at)

    def joined(edges):
        group = list(range(len(normal)))
        for a, b in edges:
            group = [group[a] if g == group[b] else g for g in group]
        return {frozenset(i for i in range(len(normal)) if group[i] == g) for g in group}

    good = set()
    for k, at in buckets.items():
        for i, j in itertools.combinations(sorted(at), 2):
            where = np.array([at[i], at[j]], np.int32)
            if line_dedup._compared(np.array([k, k]), sketch[[i, j]], where, np.array([0]), np.array([1]))[0] and line_dedup.similar(normal[i], normal[j]):
                good.add((i, j))
    for known in ([], sorted(good)[::5]):
        group = np.arange(len(normal))
        for a, b in known:
            group[group == group[b]] = group[a]
        found = list(known)
        for k, at in buckets.items():
            n = np.array(sorted(at))
            found += line_dedup._unite(k, n, group[n], sketch[n], np.array([at[i] for i in n.tolist()], np.int32), [normal[i] for i in n])
        assert len(good) > len(normal) and joined(found) == joined(good)


def test_line_dedup_numbers(spark):
    """Numbers of one shape aren't copies; equal ones are, and similar ones by the edit test."""
    texts = [(1, "2021 45 17\n42"), (2, "2019 88 32\n17"), (3, "2021 45 17"), (4, "2021 45 18"), (5, "2,021 45 17")]
    got = rows(line_dedup.report(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "n_removed")
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]


def tiktoken_encoding():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none):
    ranks, ref = tiktoken_encoding()
    model = bpe.model_of_ranks(ranks, P.PATTERN)

    def brute(t):
        ids = ref.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    want = sorted([(i, *brute(t)) for i, t in ODD], key=repr)
    assert rows(bpe.encode_and_decode(docs, model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    full = bpe.encode_and_decode(docs, model, keep=True)
    assert rows(full, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want and "_gone" in full.columns
    assert bpe.encode_and_decode(none, model).count() == 0


def test_bpe_spans():
    """Tokens' characters against a decoder that reads one byte at a time."""
    ranks, ref = tiktoken_encoding()
    model = bpe.model_of_ranks(ranks, P.PATTERN)
    table = bpe.id_bytes(model)
    lengths = np.array([len(b) for b in table])
    split = 0
    for text in ("plain words, 12", "é\U0001f600 ñandú — ß 漢字かな \U0001f9d1\u200d\U0001f680", "a", "\u0e01\u0e33\U00010348"):
        raw, ids = text.encode(), np.array(ref.encode_ordinary(text))
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        first, past = bpe.spans(ids, lengths, raw)
        at = 0
        for k, a, b in zip(ids.tolist(), first.tolist(), past.tolist(), strict=True):
            assert (a, b) == (owner[at], owner[at + lengths[k] - 1] + 1)
            split += bool(at) and owner[at] == owner[at - 1]
            at += lengths[k]
        assert at == len(raw)
    assert split > 0


def test_token_output(docs, none):
    path = P.path("byte_bpe_50k.json")
    with open(path) as f:
        model = f.read()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want, start = [], 0
    for i, x in sorted(ODD, key=lambda r: r[0]):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows(token_output.report(docs, model), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    manifest = token_output.write(docs, model, new_path(docs.sparkSession, "t"))
    only = token_output.read(manifest, ("doc_id", "n_tokens"))
    assert rows(only, "doc_id", "n_tokens") == sorted([(w[0], w[2]) for w in want], key=repr)
    assert token_output.report(none, model).count() == 0


def test_token_output_ranges(spark, tmp_path, monkeypatch):
    """Reads by token range and by doc_id give what a filter gives, and leave the other files and row groups alone."""
    with open(P.path("byte_bpe_50k.json")) as f:
        model = f.read()
    docs = spark.createDataFrame([(i, prose(30, i)) for i in range(400)], "doc_id long, text string")
    manifest = token_output.write(docs, model, str(tmp_path), row_group=500, file=5_000)
    whole = {r.doc_id: (r.start, r.n_tokens, list(r.ids)) for r in token_output.read(manifest).collect()}
    total = sum(n for _, n, _ in whole.values())
    assert len(whole) == 400 and manifest.count() > 4
    for a, b in ((0, 1), (total // 3, total // 3 + 700), (total - 1, total), (total, total + 5), (0, total)):
        got = {r.doc_id: (r.start, list(r.ids)) for r in token_output.read(manifest, ("doc_id", "ids"), tokens=(a, b)).withColumnRenamed("start", "start").collect()}
        assert set(got) == {i for i, (s, n, _) in whole.items() if s < b and s + n > a}
        assert all(got[i] == (whole[i][0], whole[i][2]) for i in got)
    got = {r.doc_id: r.n_tokens for r in token_output.read(manifest, ("doc_id", "n_tokens"), doc_ids=(100, 120)).collect()}
    assert got == {i: whole[i][1] for i in range(100, 121)}
    import pyarrow.parquet as pq

    one = manifest.filter("first_doc <= 100 AND last_doc >= 100").first()
    file = pq.ParquetFile(one.path)
    every, some = token_output.groups_in(file, None, None), token_output.groups_in(file, None, (100, 100))
    assert len(every) > 4 and len(some) == 1 and len(token_output.groups_in(file, (0, 1), None)) == 1
    ids = file.metadata.row_group(0).column(3)
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index and "DELTA_BINARY_PACKED" in file.metadata.row_group(0).column(0).encodings


def test_warc(spark):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "é" * 900_000), (6, "u", "é" * 900_000), (7, "u", "WARC/1.1\r\n\r\n" * 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for least in (0, 5):
        want = []
        for i, _, h in pages:
            b = (h or "").encode()
            top = max(j for j, _, g in pages if (g or "").encode() == b) if len(b) >= least else i
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top == i else "revisit", None if top == i else top))
        assert rows(warc.report(df, least), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    odd = [(None, "u", "same"), (None, None, None), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "twice")]
    got = rows(warc.report(spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "'x' AS rec", "1 AS digest")), "page_id", "record_type", "refers_to")
    assert got == sorted([(None, "response", None), (None, "response", None), (8, "revisit", 9), (8, "revisit", 9), (9, "response", None)], key=repr)
    table = warc.chunks(df).filter("page_id = 5").orderBy("chunk_no").collect()
    body = ("é" * 900_000).encode()
    assert [(c.chunk_no, c.payload_bytes, c.digest) for c in table] == [(0, 1 << 20, hashlib.sha1(body[: 1 << 20]).hexdigest()), (1, len(body), hashlib.sha1(body).hexdigest())]
    manifest = warc.write(df, new_path(spark, "w"))
    chunks = warc.read(manifest).filter("page_id = 6").orderBy("chunk_no").collect()
    assert [base64.b32decode(c.payload_digest).hex() for c in chunks] == [c.digest for c in table]
    assert len(chunks) == 2 and b"".join(bytes(c.data) for c in chunks) == ("é" * 900_000).encode() and [c.last for c in chunks] == [False, True]
    assert warc.report(df.limit(0)).count() == 0


def test_suffix_dedup(spark, none):
    r = random.Random(1)
    base = "".join(r.choice("abcdeé ") for _ in range(700))
    texts = [*dict(ODD).items(), (20, base), (21, base[50:400] + "X" + base[300:]), (22, "Y" + base[100:260] * 2), (23, "q" * 99 + base[:100]), (24, base[:99])]
    for k in range(40):
        a = r.randrange(500)
        texts.append((30 + k, "".join(r.choice("xyz") for _ in range(r.randrange(60))) + base[a : a + r.randrange(50, 300)] + "".join(r.choice("xyz") for _ in range(r.randrange(60)))))
    seen, want = set(), []
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(suffix_dedup.report(df), *cols) == sorted(want, key=repr)
    assert rows(suffix_dedup.report(df, most=300), *cols) == sorted(want, key=repr)  # anchors too large for a text
    assert suffix_dedup.report(none).count() == 0


def test_suffix_dedup_indexes_what_may_repeat():
    """Segments of one anchor that share no window don't reach the index, those that share one all do."""
    r = random.Random(3)
    draw = lambda n: "".join(r.choice("abcdefgh") for _ in range(n)).encode()
    common, passage = draw(40), draw(240)
    texts = [draw(150) + common + draw(150) for _ in range(60)] + [draw(120) + passage[r.randrange(60) :][: r.randrange(90, 180)] + draw(120) for _ in range(60)]
    found = {}
    for text, ok, *_ in suffix_dedup._spans(texts):
        for s, n, a, c in zip(*suffix_dedup._segments(text, ok), strict=True):
            found.setdefault(int(a), {})[int(c)] = text[s : s + n + 99].tobytes()
    segments, anchors = zip(*[(x, a) for a, of in found.items() if len(of) > 1 for x in of.values()], strict=True)
    meets = suffix_dedup.meeting(list(segments), np.array(anchors, np.uint64).view(np.int64))
    windows = collections.Counter(x[k : k + 100] for x in segments for k in range(len(x) - 99))
    shares = np.array([any(windows[x[k : k + 100]] > 1 for k in range(len(x) - 99)) for x in segments])
    assert shares.sum() > 20 and not (shares & ~meets).any() and meets.mean() < 0.9
    again = [x.any() for x in suffix_dedup.repeats([x for x, m in zip(segments, meets, strict=True) if m])]
    assert sum(again) == sum(x.any() for x in suffix_dedup.repeats(list(segments)))


def test_run_index():
    text = np.frombuffer(b"abracadabra\xffabracadabra!\xff", np.uint8)
    length, where = suffix_dedup.RunIndex(text).statistics()
    order = sorted(range(len(text)), key=lambda i: text[i:].tobytes())
    for a, b in zip(order, order[1:], strict=False):
        x, y = text[a:].tobytes(), text[b:].tobytes()
        same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert (length[b], where[b]) == (same, a)


def test_secret_scan(spark, none):
    r = random.Random(2)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [(i, f"some words Password = \"{key(18)}\" and AKIA{''.join(r.choice('ABCDEFGHIJ0123456789') for _ in range(16))} or {key(32)} end") for i in range(60)]
    lone = key(18)
    texts += [(100, "token: abc"), (101, "AKIA123"), (102, None), (103, ""), (104, f"é\U0001f600 {lone} here"), (105, "mail7.example.com and ordinaryword-of-length 2024-01-01T00:00:00"), (106, 'ſecret=abcdef12 api_key: "a=b=c=d"')]
    df = spark.createDataFrame(texts, "doc_id long, text string")

    def brute(t):
        t, out = t or "", []
        for kind, pattern, least, g in (("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)):
            out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[g]) >= least]
        return [x[2] for x in sorted(out)]

    got = {r.doc_id: r for r in secret_scan.find(df).collect()}
    for i, t in texts:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("format")] == want
    assert got[104].spans == f"format:3:{3 + 18}" and got[105].spans == ""
    assert secret_scan.find(none).count() == 0


def test_secret_scan_outside_base_spans(spark):
    """Values after a name of their own, short ones, letters alone, what follows a base span, and kinds at the end of rows."""
    r = random.Random(5)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [(i, f"some words Password = \"{key(r.choice((8, 12, 18)))}\" and {key(32)} internationalisation") for i in range(80)]
    a, b, c = key(18), key(12), key(18)
    texts += [(100, f"x sig={a} y"), (101, f"x {b} y"), (102, f"{'0123456789abcdef' * 2}={c}"), (103, "ordinary words, letters alone, internationalisation.")]
    got = {x.doc_id: x.spans for x in secret_scan.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[100] == "format:6:24" and got[101] == "format:2:14"
    assert got[102] == "hex:0:32,format:33:51" and got[103] == ""


class Listed:
    """A scorer that takes the values of a list."""

    longest = 10

    def __init__(self, *values):
        self.values = values

    def __call__(self, values):
        return np.array([v in self.values for v in values], bool)


def test_secret_candidates():
    def spans(text, *values, taken=()):
        return [(a, b) for a, b, _ in secret_scan._formats([text], [list(taken)], Listed(*values), {})[0]]

    assert spans("ab=abcdef.ghijkl", "abcdef", "ghijkl") == [(3, 9), (10, 16)]
    assert spans("ab=abcdef.ghijkl", "abcdef.ghijkl", "abcdef") == [(3, 16)] and spans("x" * 90, "x" * 90) == [(0, 90)]
    assert spans("abcdef.ghijkl", "ghijkl", taken=[(0, 3), (2, 7)]) == [(7, 13)] and spans("a" * 50 + ".abcdef", "abcdef") == [(51, 57)]


def test_secret_scorer_equals_grammar():
    r = random.Random(4)
    values = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (40, 40, 24, 32) * 40]
    grammar = secret_scan.Grammar({"hex": values}, [prose(3, s).replace(" ", "") for s in range(200)])
    scorer = grammar.scorer()
    asked = [*values[:20], *["".join(r.choice("0123456789abcdefxyzAB+/_.=-") for _ in range(r.randrange(1, 300))) for _ in range(300)], values[0] * 9]
    assert scorer(asked).tolist() == [grammar.accepts(v) for v in asked] and scorer(values).mean() > 0.9


def test_secret_scan_is_linear():
    r = random.Random(4)
    values = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    scorer = secret_scan.Grammar({"hex": values}, [prose(3, s).replace(" ", "") for s in range(100)]).scorer()
    texts = [base64.b64encode(r.randbytes(750_000)).decode(), "ab.cd" * 200_000, "a/" * 500_000, "9f8a7c6d5e4b3a2f1d." * 50_000, "=" * 1_000_000, "a" * 1_000_000]
    began = time.time()
    for text in texts:
        secret_scan._formats([text], [[]], scorer, {})
    assert time.time() - began < 60


def test_secret_candidates_have_no_cap():
    """Values of more than 16 separators inside a longer run, and walks against all pairs of a start and an end tried one by one."""
    r = random.Random(7)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    grammar = secret_scan.Grammar({"hex": [".".join(key(4) for _ in range(20)) for _ in range(80)], "assign": [key(18) for _ in range(80)]}, [prose(3, s).replace(" ", "") for s in range(200)])
    def each(v, starts, ends):
        out, done = [], -1
        for s in starts:
            if s >= done and (e := next((e for e in reversed(ends) if e - s >= 6 and grammar.accepts(v[s:e])), None)):
                out.append((s, e))
                done = e
        return out

    scorer, some = grammar.scorer(), 0
    v = ".".join(key(4) for _ in range(24)) + "/" + ".".join(["ordinarywords"] * 40)
    ((a, b, _),) = secret_scan._formats([f"x {v} y"], [[]], scorer, {})[0]
    assert a == 2 and v[: b - a].count(".") >= 23
    for _ in range(40):
        v = "".join(r.choice((key(4), key(18), "words", "ordinary")) + r.choice(("=", ".", "/", "==", ".")) for _ in range(25))
        want = each(v, *secret_scan._cut(v))
        assert scorer.walked(v, *secret_scan._cut(v)) == want
        some += len(want)
    assert some > 40


def test_secret_scan_learns_each_kind(spark):
    late = spark.createDataFrame([(1, json.dumps([*[[0, 1, "hex", str(k)] for k in range(20)], [5, 6, "assign", "abcdef"]]), None)], "doc_id long, base string, ordinary string")
    assert secret_scan.learn(late).kinds.keys() == {"assign", "hex"}


def test_language_id(spark, none):
    sets = {"en": "the of and with house from walking", "de": "der und nicht straße über gehen zwischen", "fr": "le être dans garçon une où maison"}
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(sets[k].split()) for _ in range(30)), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    docs += [(900, None, "en"), (901, "", "de"), (902, "123 !?", "fr"), (903, "der und nicht", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.report(df).collect()}
    assert len(got) == len(docs)
    for i, t, lang in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        if t and any(c.isalpha() for c in t):
            assert got[i].lang_pred == (lang or "de")
        else:
            assert got[i].lang_pred == "und"
    assert all(got[i].accepted <= (got[i].lang_pred != "und") for i, *_ in docs)
    clear = [got[i] for i, t, lang in docs if t and lang and i < 900]
    assert sum(r.accepted for r in clear) >= 0.9 * len(clear)
    mixed = spark.createDataFrame([(1, "zq xw kj vv pq qx", None), (2, "der und nicht straße über gehen zwischen der und", None)], "doc_id long, text string, lang string")
    shown = {r.doc_id: r for r in language_id.identify(mixed, language_id.train(df)).collect()}
    assert shown[2].score > shown[1].score
    assert language_id.report(none).count() == 0
    assert {r.lang_pred for r in language_id.report(df.withColumn("lang", df.lang.substr(0, 0)).filter("lang = 'x' OR doc_id > 899").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language_id.report(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.97 * len(both)


@pytest.mark.parametrize("name", ["op9_benchmark_decontamination", "op10_quality_rules"])
def test_sql(spark, name):
    from tessera.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert rows(queries.queries()[name](spark, d), *names) == sorted(found.fetchall(), key=repr)


def test_sampled(spark):
    """n rows by the hash of the key, whatever the partitions; all rows where there are no more."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "id % 7 AS x").repartition(16)
    want = df.selectExpr("xxhash64(doc_id) AS h", "doc_id").orderBy("h").limit(300).select("doc_id")
    got = sampled(df, 300, "doc_id", "x").select("doc_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
    assert sampled(df, 50_000, "doc_id").count() == 20_000 and sampled(df.limit(0), 5, "doc_id").count() == 0
    assert sampled(df.withColumn("doc_id", df.x), 300, "doc_id").count() == 300  # few keys that many rows share


def test_secret_scan_held_out():
    """Learnt from half of the labelled values, the formats find the other half and few ordinary tokens."""
    r = random.Random(8)
    draw = lambda alphabet, sizes: "".join(r.choice(alphabet) for _ in range(r.choice(sizes)))
    kinds = {
        "hex": [draw("0123456789abcdef", (32, 40)) for _ in range(160)], "access": ["AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", (16,)) for _ in range(160)],
        "assign": [draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", (24, 28)) for _ in range(160)],
    }
    plain = [draw(VOCAB, (2, 3)) for _ in range(300)] + [f"mail{r.randrange(100)}.example.com" for _ in range(60)] + [f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}" for _ in range(60)]
    plain += [f"{draw(VOCAB, (2,))}.{r.randrange(100)}" for _ in range(80)]
    grammar = secret_scan.Grammar({k: v[:80] for k, v in kinds.items()}, plain[::2])
    for k, v in kinds.items():
        assert sum(map(grammar.accepts, v[80:])) >= 0.9 * 80, k
    assert sum(map(grammar.accepts, set(plain[1::2]) - set(plain[::2]))) <= 2
