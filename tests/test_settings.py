"""Settings, log and prompts; a growing conversation; a chunk index that is opened again; blocks of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.conversation import Conversation
from palaver.operators import rag, store, vector_index
from palaver.settings import Debug, ExtractorSettings
from palaver.sources import corpora

D = "/root/testdata/sf0.001"


def test_debug_writes_only_when_on(tmp_path):
    said = []
    off, on = Debug(False, str(tmp_path / "a"), said.append), Debug(True, str(tmp_path / "a"), said.append)
    off.say("no"), on.say("yes")
    assert said == ["yes"] and off.prompt("x") is None
    with open(on.prompt("what is asked")) as f:
        assert f.read() == "what is asked"


def test_settings_merge_or_leave(spark):
    knowledge = corpora.event_knowledge(spark, D).limit(5).withColumn("inverse_actions", F.col("actions"))
    assert ExtractorSettings().merged(knowledge).select(F.max(F.size("actions"))).head()[0] == 2
    assert ExtractorSettings(merge_actions=False).merged(knowledge).select(F.max(F.size("actions"))).head()[0] == 1


def test_conversation_grows(spark, tmp_path):
    knowledge = corpora.event_knowledge(spark, D)
    parts = [knowledge.where(F.col("message_ordinal").between(a, a + 9)) for a in (0, 10, 20)]
    made = Conversation.kept(store.Store(spark, str(tmp_path / "index")).add(parts[0])).add(parts[1]).add(parts[2])
    whole = Conversation.of(knowledge.where("message_ordinal < 30"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(made.refs, "semantic_ref_ordinal", "knowledge_json") == rows(whole.refs, "semantic_ref_ordinal", "knowledge_json")
    assert rows(made.index, "term", "semantic_ref_ordinal") == rows(whole.index, "term", "semantic_ref_ordinal")
    assert made.messages.count() == 30


def test_removed_ids_may_come_back_and_an_index_is_opened(spark, tmp_path):
    index = rag.RagIndex(spark, str(tmp_path / "chunks"))
    index.add_texts(["one text", "two texts"])
    first = [r.id for r in index.chunks().orderBy("chunk_pos").collect()]
    assert index.remove(first[:1]) == 1 and index.size() == len(first) - 1
    index.add_texts(["one text"])
    assert first[0] in [r.id for r in index.chunks().collect()]
    index.save(str(tmp_path / "saved"))
    again = rag.RagIndex.open(spark, str(tmp_path / "saved"))
    rows = lambda x: sorted((r.id, r.text, r.embedding) for r in x.chunks().collect())
    assert rows(again) == rows(index)


def test_queries_go_in_blocks(spark, monkeypatch):
    chunks = corpora.vectors(spark, D)
    asked = chunks.select(F.col("chunk_pos").alias("query_id"), "embedding")
    rows = lambda: sorted((r.query_id, r.chunk_pos, r["rank"]) for r in vector_index.join_nearest(asked, chunks, 3).collect())
    whole = rows()
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    assert rows() == whole
