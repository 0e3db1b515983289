"""A conversation: messages, refs and index together, and questions to it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver import providers
from palaver.functions import temporal
from palaver.operators import expand, ingest, postings, store
from palaver.plans import context, query_ir
from palaver.sources import corpora, documents


class Conversation:
    def __init__(self, messages: DataFrame, refs: DataFrame, index: DataFrame):
        self.messages, self.refs, self.index = messages, refs, index
        self.tables: store.Store | None = None

    @classmethod
    def of(cls, knowledge: DataFrame) -> Conversation:
        refs = ingest.populate(knowledge)
        return cls(corpora.messages(knowledge), refs, postings.of(refs))

    @classmethod
    def kept(cls, tables: store.Store) -> Conversation:
        """Over written tables; ``add`` appends to them."""
        made = cls(tables.messages, tables.refs, tables.postings)
        made.tables = tables
        return made

    def add(self, knowledge: DataFrame) -> Conversation:
        """With further messages and their knowledge: only these are read, numbered after the refs there are, and indexed."""
        if self.tables is None:
            raise ValueError("only a conversation over written tables can grow; see Conversation.kept")
        return Conversation.kept(self.tables.add(knowledge))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Conversation:
        return cls.of(documents.knowledge_file(spark, path)[0])

    def expand(self, relations: DataFrame, kind: str) -> Conversation:
        return Conversation(self.messages, self.refs, expand.expand(self.index, relations, kind, 1.0 if kind == "lemma" else expand.WEIGHT))

    def context(self, query: query_ir.Query, reference: date) -> tuple[DataFrame, DataFrame]:
        """(refs, messages) that answer a query, within the budgets."""
        span = temporal.range_of(query.question, reference, query_ir.time_range(query))
        found = context.scored(self.index, self.refs, self.messages, query_ir.terms(query), span, temporal.refers(query.question))
        kept = context.within_budget(context.ranked(found))
        return kept, context.selected_messages(kept)

    def query_terms(self, terms: list[str], reference: date, model=None) -> dict:
        return self._answer(query_ir.of_terms(terms), reference, model)

    def query(self, question: str, reference: date, model=None) -> dict:
        return self._answer(providers.translate(question), reference, model)

    def _answer(self, query: query_ir.Query, reference: date, model) -> dict:
        text = context.document(*self.context(query, reference)).collect()[0][0]  # within the budgets
        return providers.answer(query.question, text, model) | {"context": text}

    def lookup(self, term: str, kind: str) -> DataFrame:
        hits = postings.lookup(self.index, term.lower())
        return self.refs.where(F.col("knowledge_type") == kind).join(hits.select("semantic_ref_ordinal"), "semantic_ref_ordinal", "left_semi")
