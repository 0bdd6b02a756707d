"""Page text, URL filters and nearest neighbours."""

import math
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html, urls, vptree


def test_layout():
    page = """<!doctype html><title>no</title><script>if(a<b){}</script><p>a <b>b</b>c<ul><li>one<li>two<ol start=3><li>x<li value=7>y</ol></ul>t
    <table><caption>cap<tr><th>A<th>Bbb<tr><td>long cell<td>2<tr><td colspan=2>wide</table><pre>
 a
   b</pre><div hidden>no</div><div style="display: none">no</div>e &amp; f<br>g"""
    assert html.visible_text(page) == "a bc\n\n- one\n- two\n  3. x\n  7. y\n\nt\n\ncap\nA          Bbb\nlong cell  2\nwide\n\n a\n   b\n\ne & f\ng"


def test_trees_of_broken_pages():
    assert html.visible_text("<p>one<div>two</p>three") == "one\n\ntwo\n\nthree"
    assert html.visible_text("x<!-- never closed <p>y") == "x"
    assert html.visible_text("<style>a{}") == ""
    assert html.visible_text("a < b <1> c") == "a < b <1> c"
    assert html.visible_text('<a title="x>y">z</a>') == "z"
    assert html.visible_text("<table><tr><td><table><tr><td>in</table><td>out</table>") == "in  out"
    assert html.visible_text("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n  d\nu\n  e"
    assert html.visible_text("<div>" * 5000 + "deep") == "deep"
    assert html.visible_text("<table><tr><td>" * 300 + "x").endswith("x")
    assert html.visible_text("<select><option>a<option>b</select><details><summary>s</summary>hid</details>") == "a\nb\ns"
    assert html.visible_text("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>") == "r  1\n   2"


def test_page_rows(spark):
    table = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (None, "u", ""), (3, "u", "w " * 100_000)], "page_id long, url string, html string").selectExpr("*", "'clash' AS text")
    rows = html.extract_text(table).collect()
    assert sorted((r.page_id or -1, r.text[:3], r.n_lines) for r in rows) == [(-1, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0), (3, "w w", 1)]
    assert html.extract_text(table.where("false")).count() == 0


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host = m.group().translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^?#]*", rest[m.end() :], re.S).group()
    best = None
    for said, name, start in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
        if best is None and (host == name or host.endswith("." + name)) and path.startswith(start):
            best = (name + start, said)
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http://Net/x", "https://A.Example.NET/en/1", "https://a.example.net/en", "http://example.com/de/1?x#y", "http://notexample.com/de/1", "http://x.org/fr/", "http://x.org?/fr/", "http://org#/", "a://b://c/d", "http://É.org/fr/", "http://a.net\nb/c"]


def test_hosts_paths_and_rules(spark):
    table = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS u", "3 AS m")
    for r in urls.with_rules(table).collect():
        host, path, best = brute_url(r.url)
        assert (r.host, r.path) == (host, path), r.url
        assert (r.rule, r.rule_verdict) == (best or (None, None))


def brute_ratio(train, u, order=urls.ORDER, weight=4.0):
    """The models with exact contexts instead of hashed ones."""
    counts = {}
    for good, x in train:
        x = "^" * order + x.lower() + "$"
        for i in range(order, len(x)):
            for n in range(order + 1):
                for key in ((x[i - n : i],), (x[i - n : i], x[i])):
                    counts[good, key] = counts.get((good, key), 0) + 1
    x = "^" * order + u.lower() + "$"
    total = 0.0
    for i in range(order, len(x)):
        p = {}
        for good in (True, False):
            q = 1 / 256
            for n in range(order + 1):
                q = (counts.get((good, (x[i - n : i], x[i])), 0) + weight * q) / (counts.get((good, (x[i - n : i],)), 0) + weight)
            p[good] = q
        total += math.log(p[True]) - math.log(p[False])
    return total / (len(x) - order)


def test_ratio_against_brute_force(spark):
    taught = [(True, "http://a.org/fr/1"), (True, "http://bb.org/fr/27"), (False, "http://c.net/x"), (False, "http://dd.net/yy")]
    decided = spark.createDataFrame([(u, "allow" if g else "block") for g, u in taught], "url string, rule_verdict string")
    asked = ["http://e.org/en/3", "http://f.com/", "", "ftp://z"]
    rows = urls.score(spark.createDataFrame([(u,) for u in asked], "url string"), urls.train(decided)).collect()
    for r in rows:
        assert r.ratio == pytest.approx(brute_ratio(taught, r.url), abs=0.05)


def test_ratio_is_exact_with_many_windows(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789-_")
    taught = [(k % 2 == 0, "http://" + "".join(rng.choice(letters, 30)) + "/x") for k in range(1500)]
    decided = spark.createDataFrame([(u, "allow" if g else "block") for g, u in taught], "url string, rule_verdict string")
    asked = [taught[0][1], taught[1][1], "http://never-seen.org/", taught[2][1]]
    rows = urls.score(spark.createDataFrame([(u,) for u in asked], "url string"), urls.train(decided)).collect()
    assert sorted(r.url for r in rows) == sorted(asked)
    for r in rows:
        assert r.ratio == pytest.approx(brute_ratio(taught, r.url), abs=1e-9)


def test_url_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = urls.op8_urls(spark, sf)
    rows = out.collect()
    assert len(rows) == pages.count() and {r.verdict for r in rows} <= {"allow", "block"}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(None, None, None), (1, "", None), (2, "x.y", None)], "page_id long, url string, html string")
    assert {r.verdict for r in urls.filter_urls(odd).collect() if r.page_id != 2} == {"allow"}
    assert urls.filter_urls(odd.where("false")).count() == 0


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 8)).round(1)
    v[50] = v[51] = v[100]
    rows = [(k, [float(x) for x in row], 0) for k, row in enumerate(v)]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0), (1150, [None] * 8, 0), (1200, [], 0), (None, [1.0] * 8, 0), (1250, [1.0, 2.0], 0), (1251, [2.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS score", "2 AS rank", "3 AS query_id").repartition(5)
    out = {}
    for r in vptree.nearest(table, F.col("vec_id") % 50 == 0, shard=150).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert out.keys() == {*range(0, 700, 50), 1250}
    for q, got in out.items():
        if q == 1250:
            assert [x[1] for x in sorted(got)] == [1251]
            continue
        score = {k: float(np.dot(v[q], v[k]) / np.sqrt((v[q] ** 2).sum()) / np.sqrt((v[k] ** 2).sum())) for k in range(700) if k != q}
        want = sorted(score, key=lambda k: (-round(score[k], 12), k))[:5]
        assert [x[1] for x in sorted(got)] == want
        assert [x[2] for x in sorted(got)] == pytest.approx([score[k] for k in want], abs=1e-12)
    assert vptree.nearest(table.where("false"), F.lit(True)).count() == 0


def test_relaxed_pruning_has_recall():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((4000, 6))
    ids = np.arange(4000)
    exact, fast = (vptree.Search(ids[::40], v[::40], 5, f) for f in (1.0, 1.5))
    for s in (exact, fast):
        s.add(ids, v)
    pairs = [set(zip(s.found[0], s.found[1])) for s in (exact, fast)]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[0])


def brute_nearest(rows, k=5):
    """Every query row against every other row."""
    out = []
    for x, (q, v) in enumerate(rows):
        if q % 50:
            continue
        v = np.array(v) / np.abs(v).max()
        found = []
        for y, (i, w) in enumerate(rows):
            if x != y:
                w = np.array(w) / np.abs(w).max()
                found.append((-round(float(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w)), 12), i))
        out += [(q, n + 1, i, -score) for n, (score, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_neighbours_of_extreme_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.standard_normal(3)]) for k in range(60)]
    rows += [(100, [1e200, 1.0, 0.0]), (101, [1e-200, 1e-210, 0.0]), (150, [5e-324, 0.0, 0.0]), (102, [1e308, 1e308, -1e308])]
    rows += [(50, [1.0, 2.0, 3.0])] * 3 + [(50, [3.0, 2.0, 1.0]), (7, [1.0, 2.0, 3.0])] + [(200 + k, [1.0, 1.0, 1.0]) for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"rows_a_task": 40, "queries_a_task": 3, "shard": 16}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(table, F.col("vec_id") % 50 == 0, **options).collect())
        want = brute_nearest(rows)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-11)


def test_many_neighbours_in_several_tasks(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((100_000, 12))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    got = {}
    for r in vptree.nearest(table, F.col("vec_id") % 500 == 0, rows_a_task=30_000, queries_a_task=80).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sims = unit[::500] @ unit.T
    sims[np.arange(200), np.arange(0, 100_000, 500)] = -2
    for k, row in enumerate(sims):
        assert [x for _, x in sorted(got[500 * k])] == np.argsort(-row, kind="stable")[:5].tolist()


@pytest.mark.parametrize("page", ['<a xxxx"' + "y" * 100_000, "<a '" * 30_000, '<a "> ' * 30_000, '<a b="x' * 20_000, "<!--" * 30_000, "<a" * 50_000, "<a b=\"'>" * 30_000, "<div>" * 50_000, "<a><table>" + "<div>" * 2000 + "</a>" * 20_000, "<li>" * 50_000, "<p a" + " " * 100_000 + ">x"])
def test_pages_that_misuse_quotes_and_tags_take_linear_time(page):
    start = time.process_time()
    html.visible_text(page)
    assert time.process_time() - start < 20


def test_comments_and_spaces_as_in_browsers():
    assert html.visible_text("a<!-->b-->c <!--->d<!-- x --!>e<!-- > -- -->f") == "ab-->c def"
    assert html.visible_text("a\u00a0 b\u3000c \t d") == "a\u00a0 b\u3000c d"
    assert html.visible_text('<a title="x>y">z</a> <b c=">q</b>w') == "z qw"
    assert html.visible_text('<b c=">q</b>w <i class=a"b>v</i>') == "v"
    assert html.visible_text("x <a href=y") == "x"


class Slow(HTMLParser):
    """The words of a page by another parser, for pages with paired tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in html.VOID:
            gone = tag in html.HIDDEN or "hidden" in a or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""))
            self.hidden.append((tag, gone))
        if tag not in ("a", "b", "i", "em", "strong", "span", "code", "small"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.hidden):
            if self.hidden.pop()[0] == tag:
                break
        if tag not in ("a", "b", "i", "em", "strong", "span", "code", "small"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not any(gone for _, gone in self.hidden):
            self.parts.append(data)


def test_words_of_pages_against_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert len(pages) > 200
    mark = re.compile(r"(?m)^\s*(?:- |\d+\. )")
    differ = []
    for page in pages:
        slow = Slow()
        slow.feed(page or "")
        slow.close()
        letters = lambda t: re.sub(r"[ \t\n\r\f]+", "", t)
        if letters(mark.sub("", html.visible_text(page))) != letters(mark.sub("", "".join(slow.parts))):
            differ.append(page)
    assert len(differ) == 0, differ[0]


def test_a_very_long_url(spark):
    long = "http://a.org/x?" + "é1b2" * 250_000
    table = spark.createDataFrame([(k, u) for k, u in enumerate([long, long + "z", "http://a.org/fr/1", "http://b.net/x"])], "page_id long, url string")
    start = time.monotonic()
    assert len(urls.filter_urls(table).collect()) == 4
    assert time.monotonic() - start < 120
