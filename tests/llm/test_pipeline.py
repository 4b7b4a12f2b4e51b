"""The pipeline's stages, each against brute force on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomdex.llm import quality_rules

from .test_ops import WORDS, brute_components, brute_contamination, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    bench = [(k, prose(r, 14)) for k in range(6)]
    passage, rows = prose(r, 60), []
    for k in range(150):
        lines = [prose(r, r.choice([12, 25, 40])) for _ in range(5)]
        if k % 6 == 0:
            lines.insert(2, passage)
        if k % 10 == 3:
            lines[1] += " " + r.choice(bench)[1]
        rows.append((k, "\n".join(lines), "en", "abc"[k % 3]))
    for k in range(150, 180):  # near copies of single lines, so that line dedup leaves them
        w = rows[k - 150][1].replace("\n", " ").split()
        w[7] = "edited"
        rows.append((k, " ".join(w), "en", "a"))
        rows.append((k + 100, " ".join(w[:-1]), "en", None))
    rows += [(300, rows[1][1], "en", "a"), (301, "short", "en", "a"), (302, " ".join(f"{r.choice(WORDS)}###" for _ in range(90)), "en", "a"), (303, None, None, None), (304, "", "en", "a")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, t, g, s, len(t or "")) for k, t, g, s in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, bench


def test_stages(spark, corpus):
    d, _, bench = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, d), "test")
        after = {x.doc_id: x for x in docs.collect()}
        seen[name] = (before, after)
        if name != "mixing":
            assert docs.schema.simpleString() == spark.read.parquet(f"{d}/documents.parquet").schema.simpleString()
    before, after = seen["quality"]
    ref = quality_rules.references(spark.read.parquet(f"{d}/documents.parquet"))
    assert set(after) == {k for k, x in before.items() if quality_rules.judge([x.text], ref, quality_rules.Lexicon(ref[2]))[0][6]}
    assert set(before) - set(after) == {301, 302, 303, 304}
    before, after = seen["line_dedup"]
    held = set()
    for k in sorted(before):  # whole lines of 50 words and exact copies are the only repeated runs here
        lines = before[k].text.split("\n")
        left = [x for x in lines if not (len(x.split()) >= 50 and x in held)]
        if k == 300:
            left = []
        held |= {x for x in lines if len(x.split()) >= 50}
        assert ("\n".join(left) == after[k].text and after[k].n_chars == len(after[k].text)) if left else k not in after
    before, after = seen["near_duplicates"]
    comp = brute_components([(k, x.text) for k, x in before.items()])
    assert set(after) == {k for k, (_, c) in comp.items() if c == k} and len(after) < len(before)
    before, after = seen["decontamination"]
    ks = sorted(before)
    bad = brute_contamination([before[k].text for k in ks], bench)
    assert set(after) == {k for k, b in zip(ks, bad, strict=True) if not b[4]} and len(after) < len(before)
    before, after = seen["mixing"]
    assert set(before) == set(after) and abs(sum(x.taken for x in after.values()) - 1.5 * sum(x.size for x in after.values())) <= 4


def test_run(spark, corpus):
    d, *_ = corpus
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 100 and out.agg(F.sum("taken")).first()[0] > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
