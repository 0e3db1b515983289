"""Hand-derived cases: the small conversation, time, chunks, vectors, tools, files, streams."""

from __future__ import annotations

import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver import providers, tools
from palaver.functions import chunking, temporal, vectors
from palaver.operators import collections, expand, ingest, postings, rag, vector_index
from palaver.plans import context, query_ir, scope
from palaver.schemas import ACTION, ENTITY, TOPIC
from palaver.sources import documents
from palaver.streaming.ingest import append_batches, event_postings, next_ordinals

FACET = lambda n, v: {"name": n, "value_text": v}


def act(verbs, subject, obj, indirect="none", facet=None):
    return {"verbs": verbs, "verb_tense": "past", "subject": subject, "object": obj, "indirect_object": indirect, "params": [], "subject_facet": facet}


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (0, 0, ["m0"], datetime(2024, 1, 5, 10), [{"name": "Alice", "type": ["person"], "facets": [FACET("role", "engineer")]}], [act(["tell"], "Alice", "deadline", "Bob")], [{"text": "project deadline"}]),
        (0, 1, ["m1"], datetime(2024, 1, 20, 9), [{"name": "bicycle", "type": ["vehicle"], "facets": [FACET("color", "red")]}], [act(["buy"], "Bob", "bicycle")], []),
        (0, 2, ["m2"], None, [], [], [{"text": "gardening"}]),
    ]
    schema = f"conv_id bigint, message_ordinal bigint, text_chunks array<string>, ts timestamp, entities array<{ENTITY}>, actions array<{ACTION}>, topics array<{TOPIC}>"
    knowledge = spark.createDataFrame(rows, schema)
    refs = ingest.populate(knowledge)
    return knowledge, refs, postings.of(refs)


def scores(talk, terms, index=None, span=None, refers=False):
    knowledge, refs, own = talk
    found = context.ranked(context.scored(index or own, refs, knowledge, terms, span, refers))
    return [(r.semantic_ref_ordinal, round(r.score, 6)) for r in found.orderBy("rank").collect()]


def test_index(talk):
    _, refs, index = talk
    by_term = {}
    for r in index.orderBy("semantic_ref_ordinal").collect():
        by_term.setdefault(r.term, []).append(r.semantic_ref_ordinal)
    assert index.count() == 18 and len(by_term) == 15
    assert by_term["alice"] == [0, 1] and by_term["bob"] == [1, 4] and by_term["bicycle"] == [3, 4]
    assert [r.knowledge_type for r in refs.orderBy("semantic_ref_ordinal").collect()] == ["entity", "action", "topic", "entity", "action", "topic"]


def test_scores(talk, spark):
    assert scores(talk, ["alice", "deadline"]) == [(1, 2.0), (0, 1.0)]
    assert scores(talk, ["project deadline"]) == [(2, 0.0)]
    table = spark.createDataFrame([("engineer", "developer", "synonym", 1), ("buy", "acquire", "synonym", 1)], "term string, related string, relation string, rank int")
    index = expand.with_synonyms(talk[2], table)
    assert scores(talk, ["developer"], index) == [(0, 0.0)]
    assert scores(talk, ["developer", "alice"], index) == [(0, 1.0), (1, 1.0)]
    assert scores(talk, ["acquire", "past"], index) == [(4, 0.9)]


def test_time_weights(talk):
    span = temporal.range_of("bob, last week", date(2024, 1, 22))
    assert span == (datetime(2024, 1, 15), datetime(2024, 1, 22, 23, 59, 59, 999000))
    assert scores(talk, ["bob"], span=span, refers=True) == [(4, 1.5), (1, 0.3)]
    assert scores(talk, ["bob"], refers=temporal.refers("bob when")) == [(1, 1.1), (4, 1.1)]


def test_context_document(talk):
    knowledge, refs, index = talk
    kept = context.within_budget(context.ranked(context.scored(index, refs, knowledge, ["alice", "gardening"])))
    text = json.loads(context.document(kept, context.selected_messages(kept)).collect()[0][0])
    assert len(text["entities"]) == 2 and text["topics"] == [{"knowledge": {"text": "gardening"}}]
    assert [m["messageText"] for m in text["messages"]] == [["m0"], ["m2"]]
    none = context.within_budget(context.ranked(context.scored(index, refs, knowledge, ["nobody"])))
    assert json.loads(context.document(none, context.selected_messages(none)).collect()[0][0]) == {"entities": [], "topics": [], "messages": []}


def test_parse():
    at = date(2024, 3, 31)
    want = {
        "last month": (date(2024, 3, 2), at), "this week": (at, at), "last 3 days": (date(2024, 3, 28), at),
        "january 2023": (date(2023, 1, 1), date(2023, 1, 31)), "maybe": (date(2024, 5, 1), date(2024, 5, 31)), "yesterday": (date(2024, 3, 30),) * 2,
    }
    for text, (begin, end) in want.items():
        assert temporal.parse(text, at) == temporal.day(begin, end)
    assert temporal.parse("last month", date(2024, 1, 15))[0] == datetime(2023, 12, 15)
    assert temporal.parse("soon", at) is None
    assert temporal.refers("in 1999?") and temporal.refers("3/4") and temporal.refers("agora") and not temporal.refers("who is it")


def test_chunks(spark):
    assert chunking.by_sentence("Aa bb. Cc dd! tail words", 10) == ["Aa bb.", " Cc dd!"]
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrst"), (2, ""), (3, None), (4, " ab ")], "doc_id bigint, text string")
    assert [(r.doc_id, r.text) for r in chunking.fixed(df, 10, 2).orderBy("doc_id", "chunk").collect()] == [(1, "abcdefghij"), (1, "ijklmnopqr"), (1, "qrst"), (4, " ab ")]
    with pytest.raises(ValueError):
        chunking.fixed(df, 10, 10)
    assert "".join(chunking.by_sentence("One two. " * 40 + "x" * 30 + ".", 20)).replace(" ", "") == ("One two. " * 40 + "x" * 30 + ".").replace(" ", "")


def test_vectors(spark):
    chunks = spark.createDataFrame([(0, "chunk-0", [1.0, 0.0]), (1, "chunk-1", [0.0, 1.0]), (2, "chunk-2", [-1.0, 0.0])], "chunk_pos bigint, id string, embedding array<double>")
    default = [(r.chunk_pos, round(r.score, 4)) for r in vector_index.query(chunks, [1.0, 0.0]).collect()]
    assert default == [(0, 1.0), (1, 0.5), (2, 0.3333)]
    assert [r.chunk_pos for r in vector_index.query(chunks, [1.0, 0.0], least=0.4).collect()] == [0, 1]
    assert [r.chunk_pos for r in vector_index.query(chunks, [1.0, 0.0], where=F.lit(True)).collect()] == [0, 1]
    left, gone = vector_index.remove(chunks, ["chunk-1", "x"])
    assert gone == 1 and left.count() == 2
    zero = chunks.limit(1).select(vectors.cosine(F.col("embedding"), vectors.literal([0.0, 0.0])).alias("c"))
    assert zero.collect()[0].c == 0.0
    with pytest.raises(Exception, match="dimensions"):
        chunks.select(vectors.cosine(F.col("embedding"), vectors.literal([1.0]))).collect()


def test_cells_find_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_pos bigint, embedding array<double>")
    index = vector_index.CellIndex(cells=8, probes=5).fit(chunks)
    held = index.assign(chunks).cache()
    met = 0
    for q in x[::80]:
        exact = {r.chunk_pos for r in vector_index.nearest(chunks, q.tolist(), 10).collect()}
        met += len(exact & {r.chunk_pos for r in index.search(held, q.tolist(), 10).collect()})
    assert met >= 0.8 * 50


def test_merges(spark, talk):
    knowledge = talk[0].withColumn("inverse_actions", F.col("actions"))
    merged = ingest.merge_inverse(knowledge).orderBy("message_ordinal").collect()
    assert [len(r.actions) for r in merged] == [2, 2, 0] and all(not r.inverse_actions for r in merged)


def test_collections(spark):
    df = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [r.v for r in collections.get_many(df, "k", [3, 1, 3]).orderBy("pos").collect()] == [6, 2, 6]
    with pytest.raises(IndexError):
        collections.get_many(df, "k", [3, 99])
    with pytest.raises(IndexError):
        collections.get(df, "k", 99)


def test_groups(talk):
    index = talk[2]
    group = scope.Group("and", ("alice", scope.Group("or", ("tell", "engineer"))))
    assert {r.semantic_ref_ordinal for r in scope.search(index, group).collect()} == {0, 1}
    assert {r.semantic_ref_ordinal for r in scope.search(index, scope.Group("or_max", ("bob", "buy"))).collect()} == {4}


def test_query_terms():
    q = query_ir.Query((query_ir.Filter(action=query_ir.ActionTerm(("Tell",), (query_ir.EntityTerm("Alice", ("person",)),)), entities=(query_ir.EntityTerm("Bob"),), search_terms=("deadline", "bob")),))
    assert query_ir.terms(q) == ["bob", "tell", "alice", "person", "deadline"]


def test_tools():
    text, calls = tools.parse_calls('Look. <tool_call>{"name": "s", "arguments": {"q": "a } b"}}</tool_call> Done.')
    assert text == "Look.\nDone." and calls == [{"name": "s", "arguments": {"q": "a } b"}}]
    assert tools.parse_calls('<invoke>```json\n{"function": {"name": "f", "arguments": "{\\"x\\": 1}"}}\n```</invoke>')[1] == [{"name": "f", "arguments": {"x": 1}}]
    assert tools.parse_calls("a <toolcall>never") == ("a\n<toolcall>never", [])
    assert tools.parse_calls("<tool-call>{bad}</tool-call>") == ("", [])
    registry = tools.Registry()
    registry.register(tools.Tool("add", "Adds.", {"x": tools.Parameter("number", "a number")}, lambda x: x + 1))
    with pytest.raises(ValueError):
        registry.register(registry.get("add"))
    assert registry.execute("add", {"x": 1}).output == "2"
    assert not registry.execute("add", {}).success and registry.execute("no", {}).error == "Unknown tool: no"
    assert "- `x` (number) (required): a number" in registry.docs()
    answers = iter(['<tool_call>{"name": "add", "arguments": {"x": 4}}</tool_call>', "It is five."])
    assert tools.Agent(lambda m: next(answers), registry).run("4 + 1?") == "It is five."
    with pytest.raises(RuntimeError):
        tools.Agent(lambda m: '<tool_call>{"name": "add", "arguments": {"x": 4}}</tool_call>', registry, most_rounds=2).run("?")


def test_providers():
    assert providers.hashed(["a b", "a b"]).tolist()[0] == providers.hashed(["a b"]).tolist()[0]
    assert providers.Function(lambda p: p.upper()).complete(["x", {"text": "y"}]).output == "X\nY"
    assert not providers.Function(lambda p: 1 / 0, times=1, pause=0).complete("x").success


def test_knowledge_file(spark, tmp_path):
    section = lambda text, k: text + "\n" + (k if isinstance(k, str) else json.dumps(k))
    good = {"entities": [{"name": "Ann", "type": ["person"]}], "actions": [], "inverseActions": [], "topics": ["tea"]}
    no_actions = {"entities": [{"name": "Bo", "type": ["person"]}], "topics": ["lost"]}
    parts = [section("A message long enough", good), section("short", good), "no json in this section at all", section("Another long message", '{"entities": [bad'), section("The third long message", no_actions)]
    path = tmp_path / "talk.txt"
    path.write_text(("\n" + "=" * 80 + "\n").join(parts))
    knowledge, losses = documents.knowledge_file(spark, str(path))
    assert losses.count() == 1
    refs = ingest.populate(knowledge).orderBy("semantic_ref_ordinal").collect()
    assert [(r.message_ordinal, r.knowledge_type) for r in refs] == [(0, "entity"), (0, "topic"), (1, "entity")]


def test_export_round_trip(spark, talk, tmp_path):
    knowledge, refs, index = talk
    documents.write_export(str(tmp_path / "a"), knowledge, refs, index)
    messages, back, items = documents.read_export(spark, str(tmp_path / "a"))
    assert messages.count() == 3 and back.count() == 6
    assert {tuple(r) for r in postings.load(items).select("term", "semantic_ref_ordinal").collect()} == {tuple(r) for r in index.select("term", "semantic_ref_ordinal").collect()}


def test_chunk_files(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "chunk-0", "a", {"k": "v"}, [0.5, 1.0])], "chunk_pos bigint, id string, text string, metadata map<string,string>, embedding array<double>")
    documents.write_chunks(str(tmp_path / "c"), chunks, {"batchSize": 100})
    back, config = documents.read_chunks(spark, str(tmp_path / "c"))
    assert back.collect() == chunks.collect() and config == {"batchSize": 100}


def test_stream_twice_gives_no_copies(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.limit(300).write.parquet(str(tmp_path / "in"))
    want = event_postings(spark.read.parquet(str(tmp_path / "in"))).count()
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        append_batches(stream, event_postings, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_ordinals_in_state(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, f"t{k}") for k in range(20)], "conv_id bigint, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = next_ordinals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("conv_id").agg(F.sort_array(F.collect_list("message_ordinal")).alias("o")).collect()
    assert sorted(len(r.o) for r in got) == [6, 7, 7] and all(list(r.o) == list(range(len(r.o))) for r in got)


def test_chunk_index(spark, talk, tmp_path):
    index = rag.RagIndex(spark, str(tmp_path / "rag"), size=14, overlap=0)
    assert index.size() == 0 and index.query("x").count() == 0
    index.add_texts(["Red apples. Green pears.", "A boat."])
    index.add_messages(talk[0], {"kind": "talk"})
    rows = index.chunks().orderBy("chunk_pos").collect()
    assert [r.id for r in rows] == ["text-0-0", "text-0-1", "text-1-0", "msg-0-0", "msg-1-0", "msg-2-0"]
    assert [r.chunk_pos for r in rows] == list(range(6)) and rows[3].metadata == {"messageOrdinal": "0", "kind": "talk"}
    assert index.query("Red apples.", 1).collect()[0].id == "text-0-0"
    assert {r.id for r in index.query("m1", 5, 0.5, F.col("metadata")["kind"] == "talk").collect()} == {"msg-1-0"}
    assert index.remove(["text-0-0", "none"]) == 1 and index.size() == 5
    index.save(str(tmp_path / "saved"))
    assert documents.read_chunks(spark, str(tmp_path / "saved"))[0].count() == 5
    index.clear()
    assert index.size() == 0


def test_message_likeness(spark, talk):
    assert rag.lookup_messages(talk[0], "m2", 1).collect()[0].message_ordinal == 2
    some = spark.createDataFrame([(0,), (1,)], "message_ordinal bigint")
    assert {r.message_ordinal for r in rag.lookup_messages(talk[0], "m2", 3, subset=some).collect()} <= {0, 1}
