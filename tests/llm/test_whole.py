"""Cases in which an operator once did less than its whole job."""

import random
import string

import numpy as np

from tidewarden.llm import fingerprints, htmltext, secret_scan, urlfilter


def test_trees_use_the_dealt_features():
    labelled = urlfilter.labelled_urls()
    trees = urlfilter.default_trees()
    rows = [urlfilter.features(u, trees.suffix_rates) for u, _ in labelled]
    for f, name in enumerate(urlfilter.FEATURES):  # no feature separates the classes by itself
        for bound in {r[f] for r in rows}:
            right = sum((r[f] < bound) == bool(y) for r, (_, y) in zip(rows, labelled, strict=True)) / len(rows)
            assert 0.1 < right < 0.9, name

    def used(tree):
        return {urlfilter.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert {"length", "digits", "entropy", "parameters", "suffix"} <= set().union(*map(used, trees.trees))
    assert len({trees.score(u) for u, _ in labelled}) > 20
    assert trees.score("https://www.saint-mary-hospital.org/opening-hours") < 0 < trees.score("http://luckyprize.top/go/x81kd0?id=58113&aff=2&u=x81kd0")


def test_repeated_lines_keep_their_weight():
    errors = []
    for seed in range(30):
        r = random.Random(seed)
        line = " ".join(f"l{seed}x{i}" for i in range(5)) + " "
        texts = [line * n + " ".join(r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(150)) for n in (60, 40 + seed)]
        x, y = (dict(zip(*(v.tolist() for v in fingerprints.terms(t)), strict=True)) for t in texts)
        keys = set(x) | set(y)
        exact = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
        errors.append(fingerprints.likeness(*map(fingerprints.signature, texts)) - exact)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.18


def test_markup_keeps_the_article():
    def lines(page):
        return [t for t, kind in htmltext.blocks(page) if kind != htmltext.RULED_OUT]

    for wrapper in ("class='content has-sidebar'", "class=no-sidebar", "id='with-comments'", "title='hidden gems'", "data-x=hidden", "class='widget'", "hidden"):
        assert lines(f"<div {wrapper}><p>a</p><article><p>b</p></article></div>") == ["a", "b"], wrapper
    assert lines("<form><main>x</main></form><div class='cookie-notice'>y</div><div hidden>z</div><template><article>t</article></template>") == ["x"]
    assert lines("<p title='class=ad'>a<span class=ad>b</span> c<p class='not-hidden'>d") == ["a c", "d"]


def test_differencing_decides_outside_the_article(spark):
    def page(i):
        return f"<body><p>Share this page<div><p>Before the story {i}</div><main><h1>Head {i}</h1><p>Often said<p>Body {i}</main><p>Write to us"

    rows = [(i, f"http://a.x/{i}", page(i)) for i in (1, 2, 3)] + [(4, "http://a.x/3b", page(3))]
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = htmltext.main_text(htmltext.blocks(page(3)))
    assert "Share this page" in whole and out == {i: f"Before the story {i}\nHead {i}\nOften said\nBody {i}" for i in (1, 2, 3)} | {4: whole}


def test_random_keys_are_found():
    r = random.Random(5)
    for n, least in ((20, 0.8), (22, 0.85), (24, 0.9), (40, 0.98)):
        keys = ["".join(r.choices(string.ascii_letters + string.digits, k=n)) for _ in range(500)]
        for before in ("", "/services/T0/B0/", "https://h.io/hooks/www/"):
            hit = np.mean([any(b > len(before) for _, b, _ in secret_scan.method_spans(f"{before}{k} end")) for k in keys])
            assert hit > least, (n, before, hit)
    for fine in ("/usr/share/documents/of/many/words", "ALongCamelCaseIdentifierName", "internationalisierungsmassnahmen", "state_of_the_art_in_deep_water"):
        assert secret_scan.method_spans(fine) == []
