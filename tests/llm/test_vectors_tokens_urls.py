"""Whitening, token alignment and URL filters against brute force and hand-made corner cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle import connect
from verspan.llm import alignment, url_filter, whitening

EMBEDDINGS = "vec_id long, embedding array<double>, x string, n int, id string, component string"
DOCS = "doc_id long, text string, row string, codes int, n long, code string"
PAGES = "page_id long, url string, html string, host string, rule int, verdict string, id int"


# 11

def vectors_of(spark, rows):
    """With extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, "x", 1, "i", "c") for i, v in rows], EMBEDDINGS)


def whitened(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r["vec_id"]), r["component"])):
        out[r["vec_id"]].append(r)
    return out


def expected(rows, k=4):
    """x, sums and the first components by a full decomposition of the covariance."""
    x = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    u = np.unique(np.array(list(x.values())), axis=0)
    z = u - u.mean(0)
    v = z.T @ z / len(u)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    return x, u, v, values[order], vectors[:, order]


@pytest.mark.parametrize("d,decay", [(3, 0.5), (12, 0.9), (40, 0.98), (40, 0.3)])
def test_whitening(spark, d, decay):
    """Steep and flat spectra: the search ends early or expands to the whole space; both are exact."""
    rng = np.random.default_rng(d)
    rows = [(i, (rng.standard_normal(d) * decay ** np.arange(d)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies count once
    x, u, v, values, vectors = expected(rows)
    got = whitened(whitening.whiten(vectors_of(spark, rows)))
    c = min(4, d)
    assert got.keys() == x.keys() and all([r["component"] for r in g] == list(range(1, c + 1)) for g in got.values())
    want = {i: (y - u.mean(0)) @ vectors / np.sqrt(values) for i, y in x.items()}
    turn = [np.sign(sum(got[i][j]["whitened"] * want[i][j] for i in x)) for j in range(c)]
    for i, y in x.items():
        assert {r["n"] for r in got[i]} == {len(u)} and {r["deviation"] for r in got[i]} == {int(((len(u) * y - u.sum(0)) ** 2).sum())}
        for j, r in enumerate(got[i]):
            assert abs(r["whitened"] * turn[j] - want[i][j]) < 1e-8
            assert abs(r["explained"] / (values[j] / np.trace(v)) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_whitening_early_end(spark):
    """A steep spectrum needs no expansion; a flat one does."""
    rng, widths = np.random.default_rng(1), []
    real = whitening._ritz
    whitening._ritz = lambda *a: widths.append(a[0].shape[1]) or real(*a)
    try:
        for spectrum, expands in ((10.0 ** -np.arange(30), False), (np.ones(30), True)):
            widths.clear()
            whitening.whiten(vectors_of(spark, [(i, (rng.standard_normal(30) * spectrum * 1e4).tolist()) for i in range(100)])).count()
            assert widths[0] == whitening.K + whitening.OVERSAMPLE and (widths[-1] == 30) == expands
            assert len(widths) == whitening.POWER + 2 if expands else len(widths) <= whitening.POWER + 1
    finally:
        whitening._ritz = real


def test_whitening_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.25]), (2, [0.25, 1.0]), (None, [0.125, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (2, [0.25, 1.0])]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2}  # one vector of three entries has no component
    assert {r["n"] for r in got} == {3}
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    line = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in line)  # rank one
    far = whitening.whiten(vectors_of(spark, [(1, [1e300, 1.0]), (2, [-1e300, 3.0]), (3, [1e15, 2.0]), (4, [0.0, 5.0])])).collect()
    assert {r["deviation"] for r in far} == {None} and all(np.isfinite(r["whitened"]) for r in far)
    big = [[1e9, 1.0], [-1e9, 3.0], [2e8, 7.0]]  # beyond what longs hold while computing
    x = [[int(256 * c) for c in v] for v in big]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors_of(spark, list(enumerate(big)))).collect()}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()}


# 12

@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(*alignment.paths())


def brute_alignment(rows, tok):
    """Groups by common ends, links by comparing ranges, counts over all documents."""
    from tokenizers import Tokenizer

    import public_tokenizers

    of_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of_a.encode_special_tokens = True
    found, count = [], Counter()
    for i, t in rows:
        a, b = (of_a.encode(" " + t, add_special_tokens=False).ids, tok._b.encode(t)) if t else ([], [])
        sides = [[tok.a_bytes[x] for x in a], [tok.b_bytes[x] for x in b]]
        if not t or any(b"".join(s) != b" " + t.encode() for s in sides):
            found.append((i, 0, 0, 0, Counter(), ""))
            continue
        ranges = []
        for s in sides:
            ends = np.cumsum([len(x) for x in s]).tolist()
            ranges.append(list(zip([0, *ends[:-1]], ends)))
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = [[[x for x, (_, e) in zip(ids, r) if low < e <= high] for ids, r in zip((a, b), ranges)] for low, high in zip([0, *cuts], cuts)]
        links = Counter((x, y) for x, (p, q) in zip(a, ranges[0]) for y, (u, v) in zip(b, ranges[1]) if max(p, u) < min(q, v))
        count.update(links.keys())
        written = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return sorted((str(i), a, b, g, sum(m.values()), sum(n for p, n in m.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in m.items()), h) for i, a, b, g, m, h in found)


ODD = [
    "", " ", "  ", "\n", "a\n b  c   d\t e \x1c f", "x▁y", "▁", "<s> </s> <0x41> <|endoftext|> <unk>", "漢字 かな 😀😀 é è é", "\x00\x00 \x00", " lead", "tail  ", "　 x   y\x85 z \xa0 q",
    "a " * 40, "don't I'll we've", "1234567 89 0x1F", "ab" * 300, " " * 50, "ﬁ ½ Ⅷ", "!!!???...", "a  b\r\n\r\n  c", "ӝӟ ъ", "﻿bom", "x​y",
]


def test_alignment(spark, tok):
    rng = random.Random(4)
    signs = "ab cde  fg\n\t.,'é漢😀 0189 ▁\xa0"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (7, None), (7, "the same id"), (7, "the same id")]
    rows += [(100 + i, "".join(rng.choices(signs[: rng.choice([9, 20, len(signs)])], k=rng.randrange(60)))) for i in range(150)]
    rows += [(300 + i, " ".join(rng.choices(["the", "token", "Überall", "naïve", "aligned,", "groups", "of", "42"], k=30))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "r", 1, 2, "c") for i, t in rows], DOCS)
    want = brute_alignment(rows, tok)
    for most in (1 << 20, 100, 0):  # all pairs frequent, some, none: the shuffled way must give the same
        got = alignment.align(docs, *alignment.paths(), most=most).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in got) == want
    assert alignment.align(docs.limit(0), *alignment.paths()).count() == 0


def test_alignment_windows_and_cache(tok, monkeypatch):
    """Windows and a cache that starts anew all the time change nothing; long texts of any kind end soon."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdé.", k=rng.randrange(1, 9))) + rng.choice(["", "", " ", "\n"]) for _ in range(3000))
    plain = lambda found: [x.tolist() if isinstance(x, np.ndarray) else x for x in found]
    want = plain(next(alignment.Aligner(tok).texts([text])))
    monkeypatch.setattr(alignment, "WINDOW", 500)
    monkeypatch.setattr(alignment, "CACHE_BYTES", 2000)
    small = alignment.Aligner(tok)
    assert [plain(x) for x in small.texts([text, "short", text])][::2] == [want, want]
    monkeypatch.undo()
    for long in ("a" * 300_000, " " * 300_000, "漢" * 300_000, "! " * 300_000, "\n" * 300_000):
        a, b, groups, n = next(alignment.Aligner(tok).texts([long]))[:4]
        assert a and b and max(a, b) <= n < a + b


def test_components():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(50))]
        parent = list(range(n))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for u, v in edges:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert alignment.components(n, u, v).tolist() == [find(x) for x in range(n)]


# 13

def link(*hosts):
    return "".join(f'<a class="x" href="http://{h}/p">t</a>' for h in hosts)


def judged_plainly(pages, rules):
    """Host, path, rule and verdict by loops; trust and distrust by solving for the walks' ends."""
    import re

    rows = []
    for i, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = "".join(c.lower() if c.isascii() else c for c in re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host):])[0] if rest else ""
        fit = [(v, r) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        v, r = max(fit, key=lambda f: len(f[1]), default=(None, None))
        rows.append((i, host, path, r, v, html))
    hosts = sorted({h for _, h, *_ in rows} | {h for *_, html in rows for h in re.findall(r'href="?(?:http:)?//([^/">]+)', html or "")})
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for _, h, _, _, _, html in rows:
        for to in set(re.findall(r'href="?(?:http:)?//([^/">]+)', re.sub("<!--.*?-->|<script.*?</script", "", html or ""))):
            if h and to != h:
                w[at[h], at[to]] += 1
    w /= np.maximum(w.sum(1, keepdims=True), 1)
    def best(host, path):
        fit = [(v, r) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fit, key=lambda f: len(f[1]), default=(None, None))

    seed = {v: np.array([np.mean([x[4] == v for x in rows if x[1] == h] or [best(h, "/")[0] == v]) for h in hosts]) for v in ("allow", "block")}
    stop = np.where(w.sum(1) > 0, 1 - url_filter.DAMPING, 1.0)  # where no link leads on, the walk ends
    on = np.eye(len(hosts)) - url_filter.DAMPING * w
    distrust = w @ np.linalg.solve(on, stop * seed["block"])
    trust = stop * np.linalg.solve(on.T, w.T @ seed["allow"])
    bad = (distrust >= url_filter.THRESHOLD) & (distrust > trust)
    return sorted((str(i), h, p, str(r), v or ("block" if bad[at[h]] else "allow")) for i, h, p, r, v, _ in rows)


def pages_of(spark, pages):
    return spark.createDataFrame([(*p, "h", 1, "v", 3) for p in pages], PAGES)


def shown(df):
    return sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in df.collect())


CASES = [
    (1, "http://bad.net/x", None), (2, "http://Farm.Example/a?b#c", link("bad.net", "worse.net")), (3, "http://outer.example/", link("farm.example", "farm.example")), (4, "http://far.example", link("outer.example")),
    (5, "https://good.org/fr/1", link("kept.example", "good.org")), (6, "http://kept.example/", link("bad.net")), (7, "http://mixed.example/", link("bad.net", "a.example", "b.example", "c.example")),
    (8, "http://a.example.net/en/", link("cited.example")), (9, "http://a.example.net/de/", ""), (10, "http://example.com/de/q", ""), (11, "http://example.com/en/q", ""), (12, "http://notexample.com/de/q", ""),
    (13, None, link("bad.net")), (14, "no scheme.net/", link("bad.net")), (15, "ftp://net", ""), (16, "http://net/", ""), (17, "http://net?x=http://org/fr/", ""), (18, "http://x.net#://y.org/fr/", ""), (None, "http://Ä.NET/Ö", ""),
    (20, "http://hidden.example/", "<!-- " + link("bad.net") + " --><script>" + link("bad.net") + "</script>"), (21, "http://self.example/", link("self.example")), (22, "http://bare.example/", "<A HREF=//bad.net/1>x</A>"), (1, "http://bad.net/x", None),
    (23, "http://loop1.example/", link("loop2.example")), (24, "http://loop2.example/", link("loop1.example", "bad.net")), (25, "://odd.net/", ""), (26, "", ""), (27, "http://", ""), (28, "http://user@bad.net:80/x", ""),
]


def test_url_filter(spark):
    got = shown(url_filter.judge(pages_of(spark, CASES)))
    plain = [(i, u, h.replace("HREF", "href") if h else h) for i, u, h in CASES]
    assert got == judged_plainly(plain, url_filter.RULES)
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[str(i)] for i in (2, 3, 4, 6, 7, 11, 12, 20, 21, 22, 24)] == ["block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "block"]


def test_url_filter_sql(spark, tmp_path):
    import duckdb

    pages_of(spark, CASES).select("page_id", "url", "html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(url_filter.ORACLE)
    names = [c[0] for c in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in rows) == shown(url_filter.judge(pages_of(spark, CASES)))


def test_url_filter_random_graph(spark):
    rng = random.Random(6)
    hosts = [f"h{i}.{rng.choice(['net', 'org', 'example', 'example.com', 'info'])}" for i in range(40)]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}", link(*rng.sample(hosts, rng.choice([0, 0, 1, 2, 6])))) for i in range(400)]
    got = shown(url_filter.judge(pages_of(spark, pages)))
    assert got == judged_plainly(pages, url_filter.RULES)
    assert {r[4] for r in got if r[3] == "None"} == {"allow", "block"}


def test_url_filter_many_rules(spark):
    """Beyond the inline bound rules are joined; the same rows come of it."""
    rng = random.Random(7)
    rules = [(rng.choice(["allow", "block"]), f"{rng.choice(['a', 'b', 'c.b', 'net', 'x.net', 'd.c.b'])}/{'/'.join(rng.choices('pq', k=rng.randrange(3)))}") for _ in range(40)]
    rules = list({r: (v, r) for v, r in rules}.values())
    urls = [(i, f"http://{rng.choice(['a', 'b', 'c.b', 'z.c.b', 'net', 'y.x.net', 'd.c.b', 'other'])}/{'/'.join(rng.choices('pq', k=rng.randrange(4)))}", None) for i in range(200)]
    want = shown(url_filter.judge(pages_of(spark, urls), rules))
    assert len({r[3] for r in want}) > 8
    old, url_filter.MAX_INLINE = url_filter.MAX_INLINE, 0
    try:
        assert shown(url_filter.judge(pages_of(spark, urls), rules)) == want
    finally:
        url_filter.MAX_INLINE = old
    assert url_filter.judge(pages_of(spark, [])).count() == 0


def test_links_are_linear(spark):
    """Unclosed tags, comments and scripts in long pages end soon."""
    import time

    bad = ["<a " * 300_000, "<!--" * 200_000, "<script" * 100_000, "<a href=" + " " * 300_000, '<a href="//' * 100_000]
    began = time.time()
    assert url_filter.judge(pages_of(spark, [(i, "http://x.example/", h) for i, h in enumerate(bad)])).count() == 5
    assert time.time() - began < 30


def test_native(spark):
    plan = url_filter.judge(pages_of(spark, CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
