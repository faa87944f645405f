"""Clustering, HTML extraction and ranked search against brute force, with nulls, ties, repeats, long rows and odd columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import clustering, html_text, ranked_search

from .test_operators import ODD, prose


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def vectors(n, dim=64, seed=3):
    r = np.random.default_rng(seed)
    centers = r.normal(0, 1, (5, dim))
    found = [[float(np.float32(x)) for x in centers[i % 5] + r.normal(0, 0.3, dim)] for i in range(n)]
    same = [0.5] * dim
    found += [same] * n + [[-x for x in same]] * 3  # one common vector
    return found


def lloyd(kept, k=16, rounds=3):
    """(cluster, distance) of each (id, vector) and the centroids, in whole numbers."""
    pts = [[math.floor(64 * x) for x in v] for _, v in kept]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cent = [p for _, p in sorted(((name(i), p) for (i, _), p in zip(kept, pts, strict=True)))[:k]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(cent)) for p in pts]

    for _ in range(rounds):
        of = near()
        for j in range(len(cent)):
            mine = [p for p, (_, c) in zip(pts, of, strict=True) if c == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return near(), cent


@pytest.mark.parametrize("chunk", [1_024, 7])
def test_clustering(spark, chunk):
    good = list(enumerate(vectors(60)))
    good += [good[0], (None, good[1][1]), (5, good[9][1])]  # a repeated row, a null id, a repeated id
    bad = [(900, None), (901, [1.0] * 63), (902, [*[1.0] * 63, None]), (903, [*[1.0] * 63, float("nan")]), (904, [*[1.0] * 63, float("-inf")]), (905, [])]
    df = spark.createDataFrame([(i, v, "mine", 1) for i, v in good + bad], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    of, cent = lloyd(good)
    inertia = Counter()
    for d, c in of:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    want = sorted([(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(good, of, strict=True)], key=repr)
    assert rows(clustering.report(df, chunk=chunk), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == want
    assert clustering.report(df.limit(0)).count() == 0
    few = clustering.report(spark.createDataFrame(good[:3], df.select("vec_id", "embedding").schema))
    assert [r.distance for r in few.collect()] == [0, 0, 0]


def test_clustering_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [3e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit a long"):
        clustering.report(df).collect()


def test_cover_tree_and_pruning():
    r = np.random.default_rng(2)
    pts = np.unique(np.concatenate([r.integers(-3, 4, (400, 6)) + 40 * i for i in range(8)]), axis=0)
    tree, order = clustering.cover_tree(pts)
    assert sorted(order) == list(range(len(pts))) and (tree.points == pts[order]).all()
    for i in range(len(tree.low)):
        own = tree.points[tree.low[i] : tree.high[i]]
        away = np.sqrt(((own - tree.points[tree.center[i]]) ** 2).sum(1))
        assert away.max() <= tree.radius[i] + 1e-9
        kids = range(tree.first[i], tree.first[i] + tree.n_children[i])
        assert (tree.n_children[i] == 0) == (len(own) == 1)
        if kids:
            assert tree.center[kids[0]] == tree.center[i] and sum(int(tree.high[k] - tree.low[k]) for k in kids) == len(own)
            centers = tree.points[tree.center[list(kids)]]
            gaps = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))[np.triu_indices(len(kids), 1)]
            assert not len(gaps) or gaps.min() > 2.0 ** (np.ceil(np.log2(tree.radius[i])) - 1)
    cent = np.array([pts[0], pts[0], pts[-1], pts[len(pts) // 2], (pts[0] + 1)])  # equal centroids: the smaller number
    ctree, number = clustering._of_centroids(cent.tolist())
    got, runs = np.full(len(pts), -1), 0
    for low, high, n in clustering.nearest(tree, ctree, number):
        for a, b, c in zip(low, high, n, strict=True):
            assert (got[a:b] == -1).all()
            got[a:b], runs = c, runs + 1
    d = ((tree.points[:, None] - cent[None]) ** 2).sum(2)
    assert (got == d.argmin(1)).all()
    assert runs < len(pts) / 2  # whole subtrees are assigned


class Article(HTMLParser):
    """The text of <article> by another parser: what stands in the elements of the test's pages that are not its text goes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.found = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        cls = dict(attrs).get("class") or ""
        if tag == "article":
            self.inside += 1
        if tag in ("aside", "form", "script", "style", "nav", "footer") or cls in ("ad", "cookie-notice"):
            self.skip += 1
        if tag not in ("b", "i", "a"):
            self.found.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        if tag in ("aside", "form", "script", "style", "nav", "footer", "div"):
            self.skip -= 1
        if tag not in ("b", "i", "a"):
            self.found.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.found[-1] += data


def page(r):
    some = lambda n: " ".join(r.choice(["lorka", "née", "a&amp;b", "x &lt; y", "<b>dor</b>", "<i>fi</i>shen", "&#233;t&eacute;", "&nbsp;"]) for _ in range(n))
    beside = [f'<div class="ad">{some(9)}</div>', f"<aside><p>{some(40)}</p></aside>", f"<form><label>{some(3)}</label><input></form>", "<script>if (a<b) t='</p>';</script>", "<!-- <p>no</p> -->", "<style>p>b{}</style>", f'<div class="cookie-notice">{some(5)}</div>']
    inner = [f"<h1>{some(r.randrange(1, 9))}</h1>"] + [r.choice([f"<p>{some(r.randrange(1, 60))}</p>", f"<p>{some(3)}<br>{some(2)}</p>", f"<ul><li>{some(2)}</li><li>{some(4)}</li></ul>", *beside]) for _ in range(r.randrange(12))]
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>{some(1)}</a></li></ul></nav>{r.choice(beside)}<article>{''.join(inner)}</article>{r.choice(beside)}<footer>&copy; {some(4)}</footer></body></html>"


def test_html_against_another_parser():
    r = random.Random(4)
    for _ in range(300):
        html = page(r)
        parser = Article()
        parser.feed(html)
        want = " ".join(x for x in (" ".join(t.split()) for t in parser.found) if x)
        assert html_text.main_text(html) == want


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>just <b>te</b>xt</p>", "just text"), ("<nav>only</nav><footer>this</footer>", ""),
        ("<article><header><h1>Title</h1></header><p>One &amp; two</p></article><header>H</header>", "Title One & two"),
        ("<article><p>a</p><section id='comments'><article class=x>nice!</article></section></article>", "a"),
        ("<article><p>a</p></article><ol class=commentlist><li><article>b</article></ol>", "a"),
        ("<body class='has-sidebar menu-open'><div class=with-sidebar><main><p>a<p>b</main></div>", "a b"),
        ("<div class=sidebar><article>wholly in such a name</article></div>", "wholly in such a name"),
        ("<article><p>a<div class=promo>buy<p>now</div><p>b", "a b"), ("<article>a<p hidden>no<p style='display : none'>no<p>b", "a b"),
        ("<article>1 < 2 <b>and</b> 3 > 2</article>", "1 < 2 and 3 > 2"), ("<article title='a>b'>x<!-- > y --><!-->z</article>", "xz"),
        ("<article>a<script>x</article>", "a"), ("<article>a <unclosed", "a"), ("<article>&ampb &am &#0; &#xD800;</article>", "&b &am � �"),
        ("<div><a href=1>Home</a> <a href=2>Far</a></div><div id=x><h2>T</h2><p>" + "word " * 40 + "</p><p>end.</p></div><div class=copyright>c</div><p>x</p>", "T " + "word " * 40 + "end."),
    ],
)
def test_html_cases(html, text):
    assert html_text.main_text(html) == text


def test_html_is_linear():
    began = time.time()
    for part in ("<a", "<div>", "<li>", "<p title='", "<!--", "<", "<b class=x", "&", "<script>", "</p>", "<div class=ad>x", '<p a="b\'', "<p a "):
        html_text.main_text(part * (400_000 // len(part)))
    assert time.time() - began < 30


def test_html_table(spark):
    pages = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (2, None, None), (None, "v", ""), (3, "w", "<article>é😀</article>"), (4, "x", "<article>" + "<p>word" * 50_000)]
    df = spark.createDataFrame([(*p, "mine", 9) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    want = sorted([(i, u, t := html_text.main_text(h), len(t)) for i, u, h in pages], key=repr)
    assert rows(html_text.extract(df), "page_id", "url", "text", "n_chars") == want
    assert html_text.extract(df.limit(0)).count() == 0


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(t):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, top=10):
    """Every score in whole numbers, then the best by score and doc_id."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = []
    for item, text in items:
        want = Counter(terms(text))
        hits = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in want.items() if t in b)
            if s > 0:
                hits.append((-s, i is not None, i or 0))
        found += [(item, r + 1, i if some else None, -s) for r, (s, some, i) in enumerate(sorted(hits)[:top])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:  # shards of three documents, blocks of two items, groups of two shards
        for name, value in (("SHARD", 3), ("CHUNK", 12), ("BLOCK", 2), ("GROUP", 2), ("FIRST", 1), ("SHARD_POSTINGS", 40)):
            monkeypatch.setattr(ranked_search, name, value)
    docs = [*ODD, (None, prose(60, 1)), (20, prose(60, 1)), (20, prose(60, 1)), *((100 + i, prose(5 + i % 9, i % 40)) for i in range(80)), (300, "Straße 42 don't ÀB àb")]
    items = [(1, prose(6, 3)), (2, prose(60, 1)), (2, prose(60, 1)), (3, None), (4, " . "), (5, "unknownterm"), (6, "x-y strasse STRASSE straße don 42"), (7, "loka loka loka"), (8, prose(900, 8))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score int").repartition(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert rows(ranked_search.report(df, bench), "item_id", "rank", "doc_id", "score") == ranked(docs, items)
    assert ranked_search.report(df.limit(0), bench).count() == ranked_search.report(df, bench.limit(0)).count() == 0


def test_terms_in_slices(monkeypatch):
    monkeypatch.setattr(ranked_search, "_SLICE", 50)
    for _, t in ODD:
        assert ranked_search.counted((t or "").encode()) == Counter(x.encode() for x in terms(t))


def test_bisection_brings_alike_documents_together():
    """Four topics of own words, dealt in turn: in the found order a document's neighbour is of its topic."""
    r = random.Random(1)
    n = 256
    pairs = sorted({(d, 100 * (d % 4) + r.randrange(60)) for d in range(n) for _ in range(20)} | {(d, 400 + r.randrange(10)) for d in range(n) for _ in range(5)})
    doc, term = np.array(pairs).T
    order = ranked_search.bisected(doc, term, n, leaf=8)
    assert sorted(order) == list(range(n))
    same = np.mean([a % 4 == b % 4 for a, b in zip(order, order[1:], strict=False)])
    assert same > 0.9
    assert list(ranked_search.bisected(np.zeros(0, int), np.zeros(0, int), 5, leaf=2)) == [0, 1, 2, 3, 4]


def test_no_document_beats_its_shards_bound():
    r = random.Random(2)
    found = [Counter({f"t{r.randrange(30)}".encode(): r.randrange(1, 9) for _ in range(r.randrange(1, 12))}) for _ in range(50)]
    block = ranked_search._Block([1], "int", [Counter({f"t{k}".encode(): 1 + k % 3 for k in range(20)})])
    block.weigh(50, 900, dict(Counter(t for c in found for t in c)))
    chunk = ranked_search._Chunk()
    for i, c in enumerate(found):
        chunk.add(i, c, 1)
    for batch in ranked_search._shards(chunk, iter(range(99))):
        v = lambda n: ranked_search._values(batch, n, 0)  # noqa: E731, B023
        bound = block.bounds(block.rows(batch.column("terms")[0].values), v("most"), v("shortest"))[0]
        for i in v("doc_ids"):
            m = 25 + 75 * sum(found[i].values()) * 50 // 900
            w = dict(zip(block.names, block.weight, strict=True))
            assert sum(w[t] * (10**9 * n // (1000 * n + 8 * m)) for t, n in found[i].items() if t in w) <= bound
