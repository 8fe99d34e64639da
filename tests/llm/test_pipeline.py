"""The pipeline's result on the smallest tables against a plain version of its stages."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from chronopanel.llm import secrets, simhash
from chronopanel.llm.queries import RADIUS, SHINGLE

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are absent")
def test_pipeline(spark):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {i: t for i, t in texts.items() if t is not None and any(c.isalpha() for c in t)}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    ids = sorted(first.values())
    prints = {i: simhash.fingerprint(texts[i], SHINGLE) % 2**64 for i in ids}
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= RADIUS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: model.encode(secrets.cleared(texts[i]), add_special_tokens=False).ids + [1] for i in ids if find(i) == i}
    got, sequences = defaultdict(list), defaultdict(int)
    for p in corpus_pipeline.run(spark, SF).collect():
        got[p.doc_id].append((p.start, p.ids))
        sequences[p.sequence_id] += p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert {i: [x for _, part in sorted(v) for x in part] for i, v in got.items()} == want
    assert max(sequences.values()) <= 2048


def test_documents_stay_where_no_language_is_known(spark):
    rows = [(0, "a clean text", None), (1, "123 !", None), (2, None, None), (3, "", "en"), (4, "日本語", None)]
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows.append((held, "labelled but held out", "en"))
    docs = spark.createDataFrame([(i, t, lang, "s", 3) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, SF)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert sorted((x.doc_id, x.lang) for x in out.collect()) == [(0, None), (4, None), (held, "en")]


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_duplicates", "near_duplicates", "secrets", "packing"]
