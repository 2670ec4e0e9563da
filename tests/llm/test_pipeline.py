"""The pipeline's stages on the smallest tables, and its registration."""

from __future__ import annotations

import random

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "packing"]


def test_stages_narrow_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    tokens = pieces.groupBy("doc_id").sum("length").collect()
    assert all(r[1] > 0 for r in tokens)


def test_awkward_rows_go_through_the_chain(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, clashing columns, and empty tables."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("river", "stone", "meadow", "cloud", "bridge", "narrow", "golden", "quiet") for b in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = text(120)
    texts = [None, "", " \n ", "short", base, base, base + " one more", "w " * 3000, " ".join(text(200) for _ in range(150)), f"mail jane.roe@x.org now {text(90)}", *(text(rng.randint(60, 200)) for _ in range(40))]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 4 else None, len(t or ""), 1, 2, "k") for i, t in enumerate(texts)]
    rows += [rows[4], (None, text(80), "en", "s", 9, 1, 2, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, g int, key string"
    leak = (1, " ".join(texts[12].split()[:40]))
    for name, docs, bench in (("some", rows, [leak, (2, None), (None, "x")]), ("none", [], [])):
        spark.createDataFrame(docs, schema).repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/some").cache()
        assert kept.columns == columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert not left.keys() & {0, 1, 2, 3, 5, 6, 7, 12} and left.keys() >= {4, 9, None} and "[EMAIL]" in left[9]
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/some").groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == left.keys()
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
