"""Commands over a conversation: python -m palaver.cli FILE."""

from __future__ import annotations

import sys
from datetime import date

from pyspark.sql import SparkSession

from palaver.conversation import Conversation
from palaver.operators import ingest
from palaver.sources import documents


def command(spark: SparkSession, talk: Conversation, line: str, today: date, relations=None) -> tuple[Conversation, str]:
    """The conversation after a command, and what to print."""
    name, *words = line.split()
    if name in ("@entity", "@action", "@topic"):
        kind = name[1:]
        rows = talk.lookup(words[0], kind) if words else ingest.topics_of(talk.refs) if kind == "topic" else talk.refs.limit(0)
        if kind == "topic" and words and rows.isEmpty():
            rows = ingest.topics_of(talk.refs)
        return talk, "\n".join(r.knowledge_json for r in rows.limit(100).collect())
    if name == "@term":
        return talk, str(talk.query_terms(words, today).get("answer"))
    if name == "@load":
        return Conversation.from_file(spark, words[0]), "loaded"
    if name == "@export":
        documents.write_export(words[0], talk.messages, talk.refs, talk.index)
        return talk, "exported"
    if name in ("@lemmatize", "@related", "@wordnet"):
        kind = {"@lemmatize": "lemma", "@related": "llm", "@wordnet": "synonym"}[name]
        return talk.expand(relations, kind), "expanded"
    result = talk.query(line, today)
    return talk, result.get("answer") or result.get("why", "")


def main(path: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    talk = Conversation.from_file(spark, path)
    for line in sys.stdin:
        if (line := line.strip()) in ("quit", "exit"):
            break
        if line:
            talk, text = command(spark, talk, line, date.today())
            print(text, flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
