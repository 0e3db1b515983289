"""Nulls, empty and very long texts, ties, repeated rows, empty tables, other id types and clashing columns, through every operator and stage."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palaver.llm import cotraining, html_text, language_id, link_graph, near_texts, packing, quality_rules, sharding, simhash, suffix_dedup
from tests.llm.test_corpus_operators import prose

CLASH = "k1 k2 key size part place number node fp bands bucket at item hits words quality cut less a b x y id rank bin kept m counted w h count".split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(21)
    same = prose(rng, 80)
    texts = [None, "", "   ", same, same, prose(rng, 40_000), "ü" * 2000, "1 2 3 " * 30, "\x00 zero", prose(rng, 60), prose(rng, 60), same + " more"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(3, same, "en", "s", 1), (None, same, None, None, None), (None, None, None, None, None), (9, prose(rng, 70), "en", "s", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})


def test_stages_take_anything(spark, odd, tmp_path):
    item = "quark lepton boson hadron meson photon gluon graviton neutrino electron muon tauon axion proton"
    spark.createDataFrame([(0, item), (1, None), (2, ""), (None, "one two")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0)):
        at = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{len(docs.columns)}-{docs.count()}")
            stage(spark, at, str(tmp_path)).write.parquet(path)
            at = spark.read.schema(at.schema).parquet(path) if k < 4 else spark.read.parquet(path)
            assert k == 4 or at.columns == docs.columns
        assert at.count() > 0 if docs.count() else at.count() == 0


def test_near_copies_keep_one_row_of_each_group(spark, odd):
    kept = near_texts.keep_one(odd)
    assert kept.columns == odd.columns
    got = Counter((r.doc_id, (r.text or "")[:20]) for r in kept.collect())
    assert max(got.values()) == 1
    same = [r for r in kept.collect() if r.text and r.text.startswith(odd.where("doc_id = 4").first().text)]
    assert [r.doc_id for r in same] == [3]
    assert sum(not (r.text or "").split() for r in kept.collect()) == 1  # those without a word are one group
    assert sum(r.doc_id == 9 for r in kept.collect()) == 2  # one id, two texts


def test_large_buckets_are_dealt_into_parts(spark):
    rng = random.Random(5)
    words = prose(rng, 120).split()
    rows = []
    for k in range(60):  # one group of near copies, all different
        own = list(words)
        own[rng.randrange(len(own))] = f"w{k}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, prose(rng, 100)) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for limit in (4, 2048):
        kept = sorted(r.doc_id for r in near_texts.keep_one(df, limit=limit).collect())
        assert kept == [0, *range(100, 110)]


def test_operators_take_clashing_columns(spark, odd):
    n = odd.count()
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert simhash.near_groups(odd).count() == n
    assert sharding.shard(odd).count() == n and set(odd.columns) <= set(sharding.shard(odd).columns)
    assert language_id.identify(odd, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert packing.pack(odd, path, ranks).select("doc_id", "start", "ids_crc32").count() >= n
    assert quality_rules.judge(odd).count() == n
    out = suffix_dedup.drop_repeats(odd, words=True)
    assert out.columns == odd.columns and out.count() == n
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (9, 0, 1), (None, 1, None), (77, None, None)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    assert cotraining.classify(odd, labels).count() == n


def test_operators_take_ids_of_other_types(spark, odd):
    named = odd.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(named).collect()}
    assert got["d4"] == got["d3"] <= "d3"
    assert suffix_dedup.drop_repeats(named).count() == near_texts.keep_one(named).count() + named.count() - near_texts.keep_one(named).count()
    assert sharding.shard(named, shards=3).select("slot").count() == named.count()


def test_pages_take_anything(spark):
    rows = [(0, None, None), (1, "", ""), (2, "http://a.org/", "<a href='http://b.org/'>x</a>"), (2, "http://a.org/", "<a href='http://b.org/'>x</a>"), (None, "HTTP://A.ORG", "<p>" + "x" * 100_000), (3, "b.org", "<" * 100)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("host", "kind", "a", "b", "n", "text", "bad", "ruled")})
    assert link_graph.judge(df).count() == len(rows) and html_text.main_text(df).count() == len(rows)
    assert link_graph.judge(df.limit(0)).count() == 0 and html_text.main_text(df.limit(0)).count() == 0
