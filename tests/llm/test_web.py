"""Language ID, HTML text and URL filters."""

import os
import re
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewarden.llm import htmltext, langid, urlfilter

DOCS = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": "the and ing tion er wh", "bb": "ção ões ão lh nh que", "cc": "sch ung keit ich ein au"}


def written(lang, i, words=60):
    r = np.random.default_rng([len(lang), ord(lang[0]), i])
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(words))


def test_tables_are_the_network():
    r = np.random.default_rng(0)
    codes = r.integers(0, langid.CLASSES, (5, langid.WINDOW + 3)).astype(np.uint8)
    f = 6
    net = langid.Network(["a", "b"], r.normal(size=(langid.CLASSES, 4)).astype(np.float32), [r.normal(size=(w * 4, f)).astype(np.float32) for w in langid.WIDTHS], [r.normal(size=f).astype(np.float32) for _ in langid.WIDTHS], r.normal(size=(3 * f, 2)).astype(np.float32), np.zeros(2, np.float32))
    pooled = []
    for w, weights, bias in zip(langid.WIDTHS, net.filters, net.biases, strict=True):
        view = np.concatenate([net.embedding[codes][:, i : i + langid.WINDOW] for i in range(w)], axis=2)
        pooled.append(np.maximum((view @ weights + bias).max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ net.output
    want = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.score(codes), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_identify(spark):
    rows = [(i, written(lang, i), lang, "x") for k, lang in enumerate(SYLLABLES) for i in range(k * 100, k * 100 + 60)]
    odd = [(900, None, "aa", None), (901, "", "bb", None), (902, "123 !!", "cc", None), (None, written("aa", 999), None, None), (903, written("cc", 903, 30000), None, None), (0, rows[0][1], "aa", "x")]
    out = langid.identify(spark.createDataFrame(rows + odd, DOCS)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by if i is not None) and by[None].held_out is False
    right = [by[i].lang_pred == lang for i, _, lang, _ in rows if by[i].held_out]
    assert len(right) > 30 and np.mean(right) >= 0.97
    assert {(by[i].lang_pred, by[i].score) for i in (900, 901, 902)} == {("und", 0.0)}
    assert by[None].lang_pred == "aa" and by[903].lang_pred == "cc" and all(0 <= r.score <= 1 for r in out)
    kept = langid.accepted(spark.createDataFrame(rows + odd, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {r.doc_id for r in kept.collect()} == set(by) - {900, 901, 902}


def test_sample_is_bounded_and_has_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    rows = [(None if i % 2 else 7, f"text {i} " * 40, "aa", None) for i in range(3000)] + [(8, "one text " * 50, "bb", None)] * 2000 + [(9, f"t {i}", f"l{i}", None) for i in range(250)]
    df = spark.createDataFrame(rows, DOCS).where(~langid.held_out())
    found = langid.sample(df)
    assert found == langid.sample(df.repartition(5, "text").unionByName(df.limit(500)))
    by = {}
    for lang, codes in found:
        by.setdefault(lang, []).append(codes)
    kept = {r.lang for r in df.select("lang").distinct().collect()}
    assert set(by) == kept and len(kept) > 200
    assert 20 * 3 <= len(by["aa"]) <= 20 * 4  # texts of three or four windows
    if "bb" in kept:
        assert len(by["bb"]) <= 4
    monkeypatch.setattr(langid, "SAMPLE_ALL", 100)
    with pytest.raises(ValueError):
        langid.sample(df)


def test_prediction_is_the_mean_over_all_windows(spark, monkeypatch):
    """Against plain evaluation of every window, whatever the slices."""
    rows = [(i, written(lang, i), lang, "x") for lang in SYLLABLES for i in range(30)]
    network = langid.fit(spark.createDataFrame(rows, DOCS))
    texts = [written("aa", 500, 900) + written("cc", 501, 300), "é", "x", written("bb", 502, 25), "", "12", written("cc", 503, 2000)]
    want = []
    for text in texts:
        data = text.encode()
        padded = [int(langid._CLASS[b]) for b in data] + [langid.PAD] * (langid.WINDOW + 3)
        total = np.zeros(3)
        count = max(1, -(-len(data) // langid.WINDOW))
        for n in range(count):
            at = network.embedding[padded[n * langid.WINDOW : (n + 1) * langid.WINDOW + 3]]
            at = np.concatenate([at, np.tile(network.embedding[langid.PAD], (langid.WINDOW + 3 - len(at), 1))])
            pooled = [np.maximum(np.max([np.concatenate(at[i : i + w]) @ f + b for i in range(langid.WINDOW)], axis=0), 0) for w, f, b in zip(langid.WIDTHS, network.filters, network.biases, strict=True)]
            z = np.concatenate(pooled) @ network.output + network.output_bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want.append((network.languages[int(total.argmax())], total.max() / count) if any(c.isalpha() for c in text) else ("und", 0.0))
    for together in (1, 3, 2048):
        monkeypatch.setattr(langid, "TOGETHER", together)
        got = langid.Predictor(network).predict(texts)
        assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-4)


def test_identify_without_labels(spark):
    out = langid.identify(spark.createDataFrame([(1, "abc", None, None)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_lines(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    kept = htmltext.common_lines(a, b)
    assert len(kept) == table[-1][-1]
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in sorted(kept))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu-page">
<header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>\n two&nbsp;three<p>Open &lt;tag&gt; &#233;<br>next<ul><li>i1<li>i2</ul>
<aside>Side</aside><form><label>Mail</label><input></form><div hidden>gone</div><section id="comments"><article class="comment">first!</article></section></article>
<div class="sidebar">Side</div><footer>&copy; x</footer></body></html>"""


def texts(page):
    return [t for t, kind in htmltext.blocks(page) if kind != htmltext.RULED_OUT]


def test_blocks():
    assert texts(PAGE) == ["Head & line", "One bold two three", "Open <tag> é next", "i1", "i2"]
    assert [t for t, kind in htmltext.blocks(PAGE) if kind == htmltext.RULED_OUT] == ["Site", "Home", "We use cookies", "Buy", "Side", "Mail", "gone", "first!", "Side", "© x"]
    for text in ("", "<", "<p", "a<b", '<p class="x', "<!-- x", "<script>x", "</p></p>", "<p>a &am"):
        htmltext.blocks(text)
    assert htmltext.blocks("<p>a &am") == [("a &am", 0)] and htmltext.blocks("1 < 2 <p>b") == [("1 < 2", 0), ("b", 0)]
    assert texts("<nav>x<p>y</nav><p>z<p class=ad>q<p>w") == ["z", "w"]
    assert texts("<ul><li class=ad>a<div><div><div>b<li>c<ul><li>d</ul>e<li class=ad>f</ul>g") == ["c", "d", "e", "g"]
    assert texts("<table><tr><td class=ad>a<table><tr><td>b</table>c<td>d<tr><td>e</table>") == ["d", "e"]
    assert htmltext.blocks("<template><p>x</template><select><option>y</select>z<span class=ad>q</span>w") == [("z w", 0), ("q", 2)]


@pytest.mark.parametrize("page", [lambda n: "<div>" * n + "</p>" * n, lambda n: "<nav>" * n + "x<article>y" * n, lambda n: "<ul><li><div>" * n + "<li>" * n, lambda n: "<ul><li>" + "<div>" * n + "<li></li>" * n, lambda n: "<div hidden>a<b>" * n + "</div>" * n, lambda n: '<a "' * n])
def test_time_in_proportion(page):
    def took(n):
        start = time.process_time()
        htmltext.blocks(page(n))
        return time.process_time() - start

    took(1000)
    assert min(took(32_000) for _ in range(2)) < 40 * max(0.02, min(took(2_000) for _ in range(3)))  # 16 times the page


def test_long_alignment_in_bounded_memory():
    own, other = [str(i * 7 % 9001) for i in range(12_000)], [str(i * 5 % 8009) for i in range(12_000)]
    tracemalloc.start()
    kept = htmltext.common_lines(own, other)
    assert tracemalloc.get_traced_memory()[1] < 12_000**2 / 8 / 2  # bits of the whole table
    tracemalloc.stop()
    rest = iter(other)
    assert len(kept) > 100 and all(any(own[i] == y for y in rest) for i in sorted(kept))


def test_differencing():
    lines = [("Site name", 0), ("Story one", 0), ("More", 0), ("Imprint", 0)]
    assert htmltext.main_text(lines, ["Site name", "Other", "Imprint"]) == "Story one\nMore"
    assert htmltext.main_text(lines, [t for t, _ in lines]) == "\n".join(t for t, _ in lines)  # a copy says nothing
    assert htmltext.main_text([("Menu", 0), ("A", 1), ("B", 1)], ["A", "Menu"]) == "A\nB"
    assert htmltext.main_text([]) == "" and htmltext.main_text([("Menu", 2), ("x", 2)]) == ""
    # An article is kept whole; what is around it goes if shared, whatever the markup calls it.
    page = [("Menu", 2), ("Top", 0), ("Often said", 1), ("Two and more", 1), ("Own", 0), ("Ad", 2)]
    assert htmltext.frame(page, [["Menu", "Top", "Often said", "Three"]]) == {0, 1}
    assert htmltext.main_text(page, ["Menu", "Top", "Often said", "Three"]) == "Often said\nTwo and more\nOwn"
    copy = [t for t, _ in page]
    assert htmltext.frame(page, [copy]) == set() and htmltext.frame(page, [copy, ["Top", "x"]]) == {1}


class Plain(HTMLParser):
    """Lines of a page as (text, kind), for well-formed pages without inline exclusions."""

    LINES = {"p", "div", "article", "main", "nav", "footer", "h1", "h2", "ul", "li", "body", "html", "head", "aside", "section", "header", "form", "br"}
    OUT = {"nav", "footer", "aside", "form", "head", "script", "style", "title"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.line, self.lines = [], [], []
        self.feed(page)
        self.close()
        self.end_line()

    def end_line(self):
        text = " ".join("".join(self.line).split())
        if text and not {"head", "script", "style", "title"} & {t for t, _ in self.open}:
            ruled_out = any(t in self.OUT or c == "ad" for t, c in self.open)
            self.lines.append((text, 2 if ruled_out else 1 if any(t in ("article", "main") for t, _ in self.open) else 0))
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.line.append(" ")
        elif tag in self.LINES:
            self.end_line()
            if tag == "p" and "p" in [t for t, _ in self.open]:
                self.handle_endtag("p")
        if tag not in ("br", "meta", "b", "a", "link", "img"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in self.LINES:
            self.end_line()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.line.append(data)


def plain_alignment(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_extract(rows):
    """The whole method once more, over all pages at once and with nothing of the module."""

    def order(row):
        page, url, _ = row
        host, path = re.match(r"(?:.*?://([^/?#]*)([^?#]*))?", url or "", re.S).groups(default="")
        return host.lower(), path, url or "", page is not None, page or 0

    def near(x, y):
        a, b = ("\0".join(map(str, order(r)[:3])) + ("\0" if r[0] is None else f"\0{r[0] + 2**63:020d}") for r in (x, y))
        return len(os.path.commonprefix([a, b]))

    rows = sorted(rows, key=order)
    lines = [Plain(html or "").lines for _, _, html in rows]
    out = []
    for i, (page, url, _) in enumerate(rows):
        own = lines[i]
        beside = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and order(rows[j])[0] == order(rows[i])[0]]
        beside.sort(key=lambda j: (-near(rows[i], rows[j]), j))
        content = 1 if any(k == 1 for _, k in own) else 0
        shared = [plain_alignment([t for t, _ in own], [t for t, _ in lines[j]]) for j in beside if lines[j]]
        size = sum(len(t) for t, k in own if k == content)
        shared = [s for s in shared if sum(len(own[n][0]) for n in s if own[n][1] == content) <= 0.9 * size]
        gone = {n for n in (shared or [()])[0] if own[n][1] != 1}
        out.append((page, url, "\n".join(t for n, (t, k) in enumerate(own) if k != 2 and n not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_a_range", [1, 3, 1000])
def test_extract_rows(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(htmltext, "RANGE_ROWS", rows_a_range)

    def bare(i):
        return f"<body><p>Top of the site</p><p>Story {i} {'word ' * (i % 5)}</p><p>Imprint and contact</p></body>"

    def full(i):
        return f"<head><title>T{i}</title></head><body><nav><ul><li>Home</li><li>N{i % 4}</li></ul></nav><div class=ad>Buy {i % 3}</div><div>Top of it</div><article><h1>Head {i}</h1><p>Often said</p><p>Body &lt;{i}&gt;<br>end</p><p>Often said</p><p>Close {i}</p><p>Write to us</p></article><footer>Imprint</footer></body>"

    rows = [(i, f"http://h{i % 3}.x/en/{i:03d}", bare(i)) for i in range(30)] + [(200 + i, f"http://full.x/{i * i % 17}/{i}?q#t", full(i)) for i in range(20)]
    rows += [(100, "http://H0.x/a", full(99)), (101, "http://h0.x/a", full(99)), (102, None, full(3)), (103, "http://lone.x/", bare(7)), (104, "http://h0.x/z", None), (None, "nothing", ""), (0, rows[0][1], rows[0][2]), (105, "http://long.x/", "<p>" + "<p>long line ".join(map(str, range(30_000))))]
    out = htmltext.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, range int")).collect()
    assert all(r.n_chars == len(r.text) for r in out)
    assert sorted(((r.page_id, r.url, r.text) for r in out), key=str) == plain_extract(rows)
    by = {r.page_id: r.text for r in out}
    assert by[5].startswith("Story 5") and "Imprint" not in by[5] and by[103].startswith("Top") and by[104] == ""
    assert by[205] == "Head 5\nOften said\nBody <5> end\nOften said\nClose 5\nWrite to us"
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_driver_pages(spark):
    """On the given pages: the brute force, the articles whole, and what the alignment deletes."""
    place = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(place):
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(place).select("page_id", "url", "html").collect()]
    got = {r.page_id: r.text for r in htmltext.extract(spark.read.parquet(place)).collect()}
    assert len(got) == len(rows) and {p: t for p, _, t in plain_extract(rows)} == got
    for page, _, html in rows:
        assert got[page] == "\n".join(t for t, k in Plain(html).lines if k == 1)
    ordered = sorted(rows, key=lambda r: htmltext._key(r[1], r[0]))
    found = [htmltext.blocks(r[2]) for r in ordered]
    deleted = [htmltext.frame(a, [[t for t, _ in b]]) for x, y, a, b in zip(ordered, ordered[1:], found, found[1:], strict=False) if htmltext.split_url(x[1])[0] == htmltext.split_url(y[1])[0]]
    assert sum(map(bool, deleted)) > 0


def plain_rule(host, path):
    found = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[1:] if found else None


def test_url_rows(spark):
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/2?x=1", "http://a.net/es/", "http://a.net/es", "http://xnet/fr/", "http://net/fr/a#b", "http://b.com", "http://b.com?x=/", None, "", "no scheme", "a://b://c/d", "http://u@h.org:80/p?q#r", "http://casino-win.example.org/en/5?a=1&b=2", "http://" + "x" * 5000 + ".org/", "http://é.net/fr/1", "http://h.org/'q'", "http://h.org/a\nb"]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(None, urls[0], "v"), (0, urls[0], "v")]
    out = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()}
    trees = urlfilter.default_trees()
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[re.match(r"[^/?#]*", rest).end() :]).group()
        assert (out[i].host, out[i].path) == (host, path), url
        rule = plain_rule(host, path)
        assert out[i].rule == (rule and rule[0]), url
        assert out[i].verdict == (rule[1] if rule else "block" if trees.score(url or "") > urlfilter.BLOCK_ABOVE else "allow"), url
        assert abs(out[i].score - 1 / (1 + np.exp(-trees.score(url or "")))) < 1e-4, url
    assert {out[i].verdict for i in range(len(urls)) if out[i].rule is None} <= {"allow", "block"}
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_trees_learn_and_hold_out():
    labelled = urlfilter.labelled_urls()
    assert 60 < len(labelled) < 400
    train, held = labelled[::2], labelled[1::2]
    trees = urlfilter.Trees(train)
    assert np.mean([(trees.score(u) > 0) == bool(y) for u, y in held]) > 0.85
    assert urlfilter.Trees([]).score("http://a.b/") <= 0


def test_fit_takes_a_bounded_sample(spark):
    labelled = urlfilter.labelled_urls()
    df = spark.createDataFrame([(u, y, "x") for u, y in labelled] * 3 + [(None, 1, "x"), ("http://a.b/", None, "x"), ("http://a.b/", 7, "x")], "url string, label int, h string")
    trees = urlfilter.fit(df)
    assert np.mean([(trees.score(u) > 0) == bool(y) for u, y in labelled]) > 0.95
    assert trees.trees == urlfilter.fit(df.repartition(7)).trees
    small = urlfilter.fit(df, each=20)
    assert small.trees != trees.trees and np.mean([(small.score(u) > 0) == bool(y) for u, y in labelled]) > 0.7
    none = urlfilter.fit(df.where("false"))
    out = urlfilter.judge(spark.createDataFrame([(1, "http://x.biz/win?a=1"), (2, "http://x.net/es/1")], "page_id int, url string"), trees=none).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["allow", "block"]


def test_labels_are_not_from_the_tables(spark):
    place = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(place):
        pytest.skip("no test data")
    hosts = {label for r in spark.read.parquet(place).select("url").collect() for label in htmltext.split_url(r.url)[0].split(".")}
    assert not hosts & {*urlfilter.BLOCKED_NAMES, *urlfilter.ALLOWED_NAMES}
