"""The pipeline against a plain version of each stage, written apart from the operators."""

import zlib

import numpy as np

import corpus_pipeline
from flatscan.llm import queries
from flatscan.llm.decontamination import shingles, weighted_jaccard
from flatscan.llm.pieces import vocabulary
from test_archive_and_pieces import plain_pieces
from test_dedup import brute_groups, brute_runs
from test_filters import plain_scores

SF = "/root/testdata/sf0.001"


def plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = dict(docs)
    sample = [(r.doc_id, texts[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts]
    kept = [d for d, x in zip(docs, plain_scores([t for _, t in docs], sample), strict=True) if x >= 0.3]
    yield kept
    kept = [(i, t) for i, t, _, _ in brute_runs(kept)]
    yield kept
    groups = {i: c for i, c, _, _ in brute_groups(kept)}
    kept = [(i, t) for i, t in kept if groups[i] == i]
    yield kept
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(s := shingles(r.text.encode()))]
    clean = []
    for i, t in kept:
        s = shingles(t.encode())
        if all(weighted_jaccard(s[k : k + len(x)], x) < 0.8 for x in items if np.isin(s, x).any() for k in range(len(s) - len(x) + 1)):
            clean.append((i, t))
    yield clean
    v = vocabulary(queries.PIECE_MODEL)
    yield [(i, plain_pieces(t.encode(), i, v)) for i, t in clean]


def test_stages_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain(spark), strict=True):
        out = stage(spark, docs, SF)
        got = sorted((r.doc_id, list(r.pieces) if "pieces" in out.columns else r.text) for r in out.collect())
        assert got == sorted(want), name
        sizes.append(len(got))
        if "pieces" not in out.columns:
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert sizes[0] < 200 and sizes[0] == sizes[1] > sizes[2] >= sizes[3] == sizes[4]


def test_n_chars_follows_the_text(spark):
    out = corpus_pipeline.lines(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert all(r.n_chars == len(r.text) for r in out)
