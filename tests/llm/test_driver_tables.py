"""The queries over the driver's small tables, against plain forms of their contracts."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_scans import plain_base, plain_secrets
from tokenizers import Tokenizer

from tidewarden.llm import queries

PLACE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PLACE), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{PLACE}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_licenses(spark, docs):
    out = queries.op1_license_scan(spark, PLACE).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        n, found = plain_base(docs[r.doc_id].text or "")
        places = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in out) > 2


def test_secrets(spark, docs):
    out = queries.op3_secret_scan(spark, PLACE).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        base = plain_secrets(docs[r.doc_id].text or "")
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), sha(base))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_encoding(spark, docs, library):
    out = queries.op6_bpe(spark, PLACE).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        ids = library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_languages(spark, docs):
    out = queries.op7_language_id(spark, PLACE).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    learned = {d.lang for i, d in docs.items() if d.lang and d.text and zlib.crc32(str(i).encode()) % 3 != 1}
    right = []
    for r in out:
        text = docs[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in (learned if any(c.isalpha() for c in text) else {"und"})
        if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und":
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(right) > 40 and np.mean(right) > 0.95


def test_packing(spark, docs, library):
    out = queries.op10_packing(spark, PLACE).collect()
    want = []
    for i, d in docs.items():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        want += [(i, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(x[2] for x in want) // 2048) * 1.05 + 1
