"""Fingerprints, near-duplicates and top-k against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewarden.llm import fingerprints, queries, simhash, topk

SCHEMA = "doc_id long, text string, fingerprint string, fp int"
WORDS = [f"w{i}" for i in range(400)]


def jaccard(a, b):
    x, y = (dict(zip(*(v.tolist() for v in fingerprints.terms(t)), strict=True)) for t in (a, b))
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    r = random.Random(4)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(12):
            a = [r.choice(WORDS[:40]) for _ in range(900)]
            b = a[: int(900 * share)] + [r.choice(WORDS[:40]) for _ in range(900 - int(900 * share))]
            a, b = " ".join(a + a[:200]), " ".join(b + b[100:150])
            errors.append(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_samples_are_consistent_and_weighted():
    n = 20000
    hashes = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a1, t1 = fingerprints.samples(hashes, np.full(n, 3.0))
    a2, t2 = fingerprints.samples(hashes, np.full(n, 4.0))
    same = (a1 == a2) & (t1 == t2)
    # ln a is decreasing in the weight, and a term keeps its sample with a probability near 3/4 of the time it would win.
    assert (a2 <= a1).all() and 0.5 < same.mean() < 0.95
    for w in (1.0, 5.0):
        a, _ = fingerprints.samples(hashes, np.full(n, w))
        assert abs(np.exp(a).mean() * w - 1) < 0.05  # exponential with the weight as its rate


ROWS = [(5, "a b c d e f g", "x", 1), (9, "h i j k l m n o p", "x", 1), (7, None, None, None), (3, "", None, None), (5, "z z z z z z", None, None), (5, "a b c d e f g", "x", 1), (None, "é🎉 n m", None, None), (1, "q w e r t y " * 3000, None, None)]


def plain_terms(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    size = min(5, len(words))
    return Counter(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def plain_jaccard(a, b):
    x, y = plain_terms(a), plain_terms(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def expected(rows):
    """In driver order: doc_id descending, null last, ties by the text's hash as Spark has it; exact similarities."""
    n = len(rows)
    for i, (doc_id, text) in enumerate(rows):
        own, after = text or "", rows[(i + 1) % n][1] or ""
        k = len(own) // 3
        edited = own[: len(own) - k] + after[:k]
        yield doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), plain_jaccard(own, edited), plain_jaccard(own, after)


def spread(j, places=fingerprints.PLACES):
    return (j * (1 - j) / places) ** 0.5


@pytest.mark.parametrize("rows_a_range", [1, 2, 1000])
def test_fingerprint_rows(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows_a_range)
    r = random.Random(1)
    many = [(100 + i, " ".join(r.choices(WORDS[:30], k=60)) + f" text {i} " * (i % 7), None, None) for i in range(40)]
    same_id = [(77, f"row {i} " + "a b c d e f g " * 9, None, None) for i in range(25)] + [(77, "again", None, None)] * 9
    df = spark.createDataFrame(ROWS + many + same_id, SCHEMA)
    out = fingerprints.fingerprint_pairs(df).collect()
    ordered = df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text", F.col("text").isNull()).desc()).select("doc_id", "text").collect()
    want = sorted(expected(ordered), key=str)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out), key=str)
    # Rows of one id and edited text differ in their likeness at most, so they are told apart by the texts alone.
    assert [x[:3] for x in got] == [x[:3] for x in want]
    by = {x[:3]: x for x in want}
    exact = [by[x[:3]] for x in got]
    errors = [(x[i] - y[i], y[i]) for x, y in zip(got, exact, strict=True) for i in (3, 4)]
    assert all(abs(e) <= 5 * spread(j) for e, j in errors) and sum(e != 0 for e, _ in errors) > 20
    assert len({r.fingerprint for r in out if (r.doc_id, r.n_chars) == (77, 5)}) == 1
    for r in out:  # what is written is what is compared
        x, y = ([f[i : i + 8] for i in range(0, len(f), 8)] for f in (r.fingerprint, r.edited_fingerprint))
        assert len(x) == fingerprints.PLACES and r.near_edited == sum(a == b for a, b in zip(x, y, strict=True)) / len(x)


@pytest.mark.parametrize(("times", "own"), [(1000, 100), (300, 300), (100, 600)])
def test_a_heavy_term_keeps_its_weight(times, own):
    """One run of five words very often, and other words of each text's own."""
    errors = []
    for seed in range(150):
        r = random.Random(seed)
        run = " ".join(f"s{seed}x{i}" for i in range(5))
        a, b = (" ".join([run] * times + [f"{side}{r.random()}" for _ in range(own)]) for side in "ab")
        errors.append(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - plain_jaccard(a, b))
    exact = plain_jaccard(a, b)
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 1.2 * spread(exact)


def test_likeness_on_the_driver_documents(spark):
    if not os.path.exists("/root/testdata/sf0.001/documents.parquet"):
        pytest.skip("no test data")
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()), reverse=True)
    out = {r.doc_id: r for r in queries.op2_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    errors, exact = [], []
    for doc_id, _, sha, near_edited, near_next in expected(rows):
        assert out[doc_id].edited_sha256 == sha
        errors += [out[doc_id].near_edited - near_edited, out[doc_id].near_next - near_next]
        exact += [near_edited, near_next]
    assert np.sqrt(np.mean(np.square(errors))) < 1.2 * np.sqrt(np.mean([spread(j) ** 2 for j in exact]))


def test_fingerprint_edges(spark):
    assert fingerprints.fingerprint_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, "abcdef", None, None)], SCHEMA)).collect()
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in one] == [(6, 1.0, hashlib.sha256(b"abcdab").hexdigest())]
    same = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, "a b", None, None)] * 3, SCHEMA)).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    counts = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum((2 * counts[b] > len(runs)) << b for b in range(64))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \t\n\x0b\u2003é\x1c.", max_size=60))
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def parts_of(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize(("crowd", "bucket", "rows"), [(150, 2048, 100), (150, 8, 100), (400, 20, 100), (400, 20, 0)])
def test_links_lose_none(spark, monkeypatch, crowd, bucket, rows):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "CROWDED", bucket)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
    r = random.Random(crowd + bucket)
    bases = [r.getrandbits(64) for _ in range(30)]
    fps = [b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))}) for b in bases for _ in range(4)]
    fps += [bases[0] ^ sum({1 << r.randrange(33) for _ in range(r.randint(0, 7))}) for _ in range(crowd)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {x.node % 2**64: x.root % 2**64 for x in simhash.connected(simhash.links(df)).collect()}
    want = parts_of(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_connected_parts(spark, edges):
    root = {i: i for i in range(26)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in {x for a, b in edges if a != b for x in (a, b)}}


def test_long_chain(spark):
    edges = [(i + 1, i) for i in range(60)]
    random.Random(2).shuffle(edges)
    assert {r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}


def test_near_duplicate_rows(spark):
    base = " ".join(random.Random(1).choices(WORDS, k=400))
    near = base + " w1"
    rows = [(9, base, "a", 1), (9, base, "a", 1), (4, near, "a", 1), (6, "other text of words " * 5, None, None), (7, None, None, None), (8, " \n", None, None), (None, base, None, None), (2, "x", None, None)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = parts_of([plain_fingerprint(t or "") for _, t, *_ in rows])
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            p = want[plain_fingerprint(text or "")]
            least[p] = min(least.get(p, 99), doc_id)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == sorted((str(d), f"{plain_fingerprint(t or ''):016x}", least[want[plain_fingerprint(t or '')]]) for d, t, *_ in rows)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "fp"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(d), dict((a, b) for a, b, *_ in rows)[d]) for d in set(least.values()))


def test_near_duplicates_of_the_driver_documents(spark):
    if not os.path.exists("/root/testdata/sf0.001/documents.parquet"):
        pytest.skip("no test data")
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    part, least = parts_of([f for _, f in rows]), {}
    for doc_id, f in rows:
        least[part[f]] = min(least.get(part[f], doc_id), doc_id)
    out = queries.op4_simhash_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, out)) == sorted((i, f"{f:016x}", least[part[f]]) for i, f in rows) and len(least) < len(rows)


@pytest.mark.parametrize("swap", [False, True])
def test_one_of_each_keeps_every_text(spark, monkeypatch, swap):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0 if swap else 100)
    a, b, c = (" ".join(random.Random(i).choices(WORDS, k=300)) for i in (1, 2, 3))
    a, b = (b, a) if swap else (a, b)
    schema = "doc_id int, id string, h1 string, text string, n string, H2 string"

    def kept(*rows):
        out = simhash.one_of_each(spark.createDataFrame([(i, "x", "y", t, "n", "z") for i, t in rows], schema))
        assert out.columns == [x.split()[0] for x in schema.split(", ")]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    assert kept((3, a), (5, a), (5, b)) == [(3, a), (5, b)]
    assert kept((5, a), (5, b), (9, b), (9, b)) == sorted([(5, a), (5, b)])
    assert kept((7, b), (7, b), (7, b), (9, c)) == [(7, b), (9, c)]
    assert kept((None, a), (None, a + " w1"), (None, c), (8, c)) in ([(8, c), (None, a)], [(8, c), (None, a + " w1")])
    assert kept((4, None), (2, ""), (None, " "), (3, a)) == [(2, ""), (3, a)]
    assert kept() == []


def plain_top(rows, asked, k):
    """Every row but the query's own, by plain whole numbers."""
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(fine):
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for n, (i, v) in enumerate(fine) if n != at and len(v) == len(own))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def odd_rows(n, dims, levels):
    r = np.random.default_rng(n + dims)
    rows = [(i, (r.integers(-levels, levels + 1, dims) / levels).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [None] * dims), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims), (None, [0.5] * dims), (n + 4, [0.5]), (40, []), (41, [])]
    # Repeated ids: the same vector, another one, and as queries.
    return rows + [rows[0], rows[0], (0, rows[1][1]), (1, rows[2][1]), rows[2], *[(7, [1.0] * dims)] * 30]


@pytest.mark.parametrize(("n", "dims", "levels"), [(3, 4, 3), (60, 5, 2), (300, 16, 1000), (300, 3, 4)])
def test_top_k(spark, monkeypatch, n, dims, levels):
    monkeypatch.setattr(topk, "CANDIDATES", 70)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows = odd_rows(n, dims, levels)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("h", F.lit(1))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 10).collect())
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain_top(single, lambda q: q % 20 == 0, 10)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0, 10).collect() == []


def test_top_k_is_its_sql(spark, tmp_path):
    rows = [(i, v) for i, v in odd_rows(250, 6, 3) if v != []]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, queries.op5_top_k(spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert got == sorted(db.execute(queries.oracle_sql()["op5_top_k"]).fetchall()) and len(got) > 40


def test_huge_components(spark):
    rows = [(0, [1e15, 3.0]), (1, [1e15, 2.0]), (2, [1e15, 1.0]), (3, [-1e15, 5.0]), (4, [2e17, 0.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 10).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 2, 4, 3] and out[0].score == 2**63 - 1 and out[3].score == -(2**63)


@pytest.mark.parametrize("shape", ["even", "sparse", "one list", "ties"])
def test_reading_stops_before_the_end(shape):
    """No vector is scored that bounds rule out, and the answer is that of scoring all."""
    r = np.random.default_rng(3)
    v = np.floor(r.normal(size=(4000, 16)) * 1024).astype(np.int64)
    if shape == "sparse":
        v[r.random(v.shape) < 0.9] = 0
    elif shape == "one list":
        v[:, 1:] //= 500
    elif shape == "ties":
        v = np.sign(v)
    asked = v[::40]
    lists = topk.Lists(np.arange(4000), v)
    scored = []
    plain = lists.resolved
    lists.resolved = lambda q, rows, k: scored.append(len(rows)) or plain(q, rows, k)
    for q, best in zip(asked, lists.top(asked, 10), strict=True):
        scores = v @ q
        order = np.lexsort((np.arange(4000), -scores))[:10]
        assert [(int(scores[i]), int(i)) for i in order] == best
    assert len(lists.depths) == len(asked)
    if shape != "ties":
        assert np.median(scored) <= 80  # a query of zeros alone has all vectors tied
        assert np.mean(lists.depths) < {"even": 1, "sparse": 1, "one list": 0.6}[shape]
