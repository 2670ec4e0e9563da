"""Intermediate tables have as many files as their rows need, however many shuffle partitions there are."""

from __future__ import annotations

import random

import pytest

from sitecast.llm import common, ngram_join, quality
from sitecast.llm import components as stars


@pytest.fixture
def wide(spark, monkeypatch):
    """Many shuffle partitions that stay as they are; gives the files of each intermediate table, by name."""
    files: dict[str, list[int]] = {}

    def seen(df, name, *args, **options):
        out = common.materialize(df, name, *args, **options)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    for module in (ngram_join, stars, quality):
        monkeypatch.setattr(module, "materialize", seen)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield files
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_write_few_files(spark, wide):
    edges = [(i, i + 1) for i in range(300) if i % 10]
    found = dict(stars.components(spark.createDataFrame(edges, "a long, b long"), rows=len(edges)).collect())
    assert found == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 301)}
    assert len(wide["edges"]) > 2 and max(wide["edges"] + wide["roots"]) == 1


def test_near_duplicates_write_few_files(spark, wide):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(12)]
    docs = [(i, " ".join(f"n{i}" if j == (7 * i) % 200 else w for j, w in enumerate(base[i % 12]))) for i in range(240)]
    found = ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 12 for i in range(240)}
    most = {name: max(wide[name]) for name in ("pairs", "sets", "links", "edges", "roots", "entries")}
    assert max(most.values()) <= 4, most


def test_quality_writes_few_files(spark, wide):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(("stone", "river", "of", "meadow", "cloud")) + str(rng.randrange(90)) for _ in range(80)), f"l{i % 20}", "s") for i in range(400)]
    assert quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).count() == 400
    assert max(wide["estimates"][1:]) <= 2
