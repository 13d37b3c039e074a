"""The pipeline's stages on a small table."""

import os
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_similarity import parts_of, plain_fingerprint
from tokenizers import Tokenizer

from tidewarden.llm import common, langid, queries, secret_scan

SYLLABLES = {"aa": "the and ing tion er wh", "bb": "ção ões ão lh nh que", "cc": "sch ung keit ich ein au"}


def written(lang, i):
    r = np.random.default_rng([len(lang), ord(lang[0]), i])
    return " ".join("".join(r.choice(SYLLABLES[lang].split(), r.integers(1, 4))) for _ in range(60))


def test_stages(spark, tmp_path):
    rows = [(i, written(lang, i), lang, "s", 1) for k, lang in enumerate(("aa", "bb", "cc")) for i in range(k * 100, k * 100 + 25)]
    rows += [(500, rows[3][1], "aa", "s", 1), (501, rows[3][1] + " the", "aa", "s", 1), (502, "12 34", "aa", "s", 1), (503, None, None, None, None), (504, written("aa", 77) + " token=abcdefgh12345", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {502, 503}
        if name == "near_duplicates":
            ids = {r.doc_id for r in kept.collect()}
            assert 3 in ids and 500 not in ids and ids | {500, 501} == {r[0] for r in rows} - {502, 503}
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "secrets":
            texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
            assert texts[504][0].endswith("token=[secret]") and texts[504][1] == len(texts[504][0])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, (t, _) in texts.items()}
    assert {r.doc_id: r.doc_tokens for r in kept.collect()} == want
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in ran) == sorted((r.doc_id, r.start, r.ids_crc32) for r in kept.collect())


def test_stages_of_odd_tables(spark, tmp_path):
    texts = [written("aa", i) for i in range(6)]
    rows = [(i, written(lang, 100 + i), lang, 1) for k, lang in enumerate(("aa", "bb", "cc")) for i in range(1000 + k * 100, 1000 + k * 100 + 25)]
    rows += [(7, texts[0], "aa", 1), (7, texts[1], "aa", 2), (8, texts[1], "aa", 3), (None, texts[2], "aa", 4), (None, texts[2] + " the", None, 5), (None, texts[3], None, 6), (9, texts[4], None, 7), (9, texts[4], None, 7), (10, None, None, None), (11, "", "aa", None), (12, texts[5] * 300, "aa", 0)]
    schema = "doc_id long, text string, lang string, h1 int"
    for name, given in (("odd", rows), ("none", [])):
        place = tmp_path / name
        docs = spark.createDataFrame([(*r, "x", "y", "z", 3) for r in given], schema + ", id string, n string, deal string, n_chars int")
        docs.write.parquet(str(place / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(place)).collect()
        if not given:
            assert out == []
            continue
        kept = sorted({(r.doc_id, r.doc_tokens) for r in out}, key=str)
        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        size = {t: len(library.encode(t, add_special_tokens=False).ids) + 1 for t in [r[1] for r in rows if r[1]] + [texts[2]]}
        odd = [(d, n) for d, n in kept if d is None or d < 1000]
        want = [(7, size[texts[0]]), (7, size[texts[1]]), (None, size[texts[3]]), (9, size[texts[4]]), (12, size[texts[5] * 300])]
        assert [x for x in odd if x not in want] in ([(None, size[texts[2]])], [(None, size[texts[2] + " the"])]) and set(want) <= set(odd)
        assert len({d for d, _ in kept if d and d >= 1000}) == 75


def test_run_by_brute_force(spark):
    """The driver's documents through plain forms of the four stages, a document at a time."""
    place = "/root/testdata/sf0.001"
    if not os.path.exists(f"{place}/documents.parquet"):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    predictor = langid.Predictor(langid.fit(docs))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows for lang, score in predictor.predict([t]) if lang != "und" and score >= 0.4]
    part = parts_of([plain_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in sorted(rows):
        least.setdefault(part[plain_fingerprint(t)], (i, t))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in least.values():
        ids = [*library.encode(secret_scan.redact(t), add_special_tokens=False).ids, 1]
        want += [(i, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    out = corpus_pipeline.run(spark, place).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    assert 50 < len(least) < len(rows)
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and sum(filled.values()) > 0.9 * 2048 * len(filled)


def test_the_shared_folder_is_asked_for():
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        common.shared_folder(Far)


def test_names():
    assert len(corpus_pipeline.STAGES) == 4
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
