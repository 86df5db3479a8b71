from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from edge import ODD, documents
from test_near_copies import survivors
from test_tokens import check_packing
from tokenizers import Tokenizer

from terravane.llm import quality_rules, suffix_dedup
from terravane.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, near, passages, pack = (f for _, f in corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = quality(spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept and not any(labels.get(d) == 0 for d in kept)
    single = near(spark, good, SF).cache()
    left = {r.doc_id for r in single.collect()}
    assert sorted((d is None, d or 0) for d in left) == survivors([(r.doc_id, r.text) for r in good.collect()])
    cut = passages(spark, single, SF).cache()
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    spans = {r.doc_id: r for r in suffix_dedup.digest(single).collect()}
    whole = {r.doc_id: r.text for r in single.collect()}
    for d in left:
        if not spans[d].n_removed:
            assert texts[d] == whole[d]
        else:
            assert len(texts.get(d, "").encode()) >= spans[d].n_bytes - spans[d].n_removed
    rows = pack(spark, cut, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.length <= 2048 for r in rows)


def without_repeats(rows, threshold=100):
    """doc_id to text without the bytes of strings that start earlier too, whole characters only; byte by byte."""
    first = {}
    for d, t in sorted(rows):
        b = t.encode()
        for i in range(len(b) - threshold + 1):
            first.setdefault(b[i : i + threshold], (d, i))
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if first[b[i : i + threshold]] < (d, i):
                gone[i : i + threshold] = b"\x01" * threshold
        at, left = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        if left or not t:
            out[d] = "".join(left)
    return out


def test_whole_pipeline_against_brute_force(spark):
    """The quality verdicts are op6's own (tested there); every later stage and its rows are redone in plain Python."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    stay = {d for none, d in survivors(sorted((d, docs[d]) for d in good)) if not none}
    texts = without_repeats([(d, docs[d]) for d in stay])
    assert 0 < len(texts) <= len(stay) < len(good) < len(docs) and any(texts[d] != docs[d] for d in texts)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    built = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == len(built.get(r.doc_id, ())) and len(r.ids) == 4 * r.length
        built.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert built == ids
    sequences = check_packing(rows, [(d, k) for d, x in ids.items() for k in range(-(-len(x) // 2048))], 2048)
    assert sequences <= 1 + -(-sum(map(len, ids.values())) // 2048)


def test_run_sweeps_its_scratch(spark):
    where = Path(shared_dir(spark).removeprefix("file://"))
    inner = lambda: {p.name for p in where.iterdir() if p.name.split("-")[0] in ("votes", "texts", "signatures", "repeats")}
    before = inner() if where.exists() else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert inner() == before


def test_odd_documents_pass_through(spark):
    docs = documents(spark, ODD)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 3:
            assert docs.columns == documents(spark, ODD).columns
    assert docs.count() > 0


def test_empty_table(spark):
    docs = documents(spark, ODD).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
