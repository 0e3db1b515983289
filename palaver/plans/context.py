"""From query terms to a context: hits, scores, ranks, and what fits the budget, as one lazy plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import store

#: Characters of the serialized context that refs, and messages, may reach.
REF_BUDGET = 15_000
MESSAGE_BUDGET = 15_000
#: Characters of the empty wrappers around refs and messages.
REF_BASE = 27
MESSAGE_BASE = 16
#: Characters that a ref takes at least; so no more than the budget's share of them can fit, and ranks beyond it needn't be ordered.
LEAST_REF = 16
IN_RANGE, OUT_OF_RANGE, TIMED = 1.5, 0.3, 1.1
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def hit(terms: list[str], value: Column) -> Column:
    return F.coalesce(F.lower(value).isin(*terms), F.lit(False)).cast("int") if terms else F.lit(0)


def facet_score(terms: list[str], f: Column) -> Column:
    return F.when(f["name"].isNull(), 0).otherwise(hit(terms, f["name"]) + hit(terms, f["value_text"]))


def _sum(array: Column, f) -> Column:
    return F.coalesce(F.aggregate(array, F.lit(0), lambda s, x: s + f(x)), F.lit(0))


def entity_score(terms: list[str], e: Column) -> Column:
    """One for the name, for each type, for each facet's name and value."""
    return hit(terms, e["name"]) + _sum(e["type"], lambda t: hit(terms, t)) + _sum(e["facets"], lambda f: facet_score(terms, f))


def action_score(terms: list[str], a: Column) -> Column:
    """One each for indirect object, object, subject, tense and every verb, and the subject's facet; parameters don't count."""
    single = hit(terms, a["indirect_object"]) + hit(terms, a["object"]) + hit(terms, a["subject"]) + hit(terms, a["verb_tense"])
    return single + F.when(a["subject_facet"].isNull(), 0).otherwise(facet_score(terms, a["subject_facet"])) + _sum(a["verbs"], lambda v: hit(terms, v))


def topic_score(terms: list[str], t: Column) -> Column:
    """One for each word; the phrase as a whole doesn't count."""
    return _sum(F.split(t["text"], " "), lambda w: hit(terms, w))


def base_score(terms: list[str]) -> Column:
    kind = F.col("knowledge_type")
    scores = F.when(kind == "entity", entity_score(terms, F.col("entity"))).when(kind == "action", action_score(terms, F.col("action")))
    return F.coalesce(scores.when(kind == "topic", topic_score(terms, F.col("topic"))), F.lit(0)).cast("double")


def hits(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(conv_id, ref, weight, term_pos): the largest weight and the first query term of each ref found.

    The terms become a filter at the scan of the index and a lookup of their positions; the maximum is combined before the shuffle.
    """
    if not terms:
        return postings.select("conv_id", "semantic_ref_ordinal", F.lit(0.0).alias("weight"), F.lit(0).alias("term_pos")).limit(0)
    place = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")).cast("int")
    found = postings.where(F.col("term").isin(*terms)).withColumn("term_pos", place)
    return found.groupBy("conv_id", "semantic_ref_ordinal").agg(F.greatest(F.lit(0.0), F.max("score")).alias("weight"), F.min("term_pos").alias("term_pos"))


def scored(postings: DataFrame, refs: DataFrame, messages: DataFrame, terms: list[str], span: tuple[datetime, datetime] | None = None, refers: bool = False, score_expanded: bool = False) -> DataFrame:
    """The refs found, with score: what they match literally times the weight, re-weighted by time."""
    found = hits(postings, terms).join(refs, ["conv_id", "semantic_ref_ordinal"])
    times = messages.select("conv_id", "message_ordinal", "ts", "text_chunks")
    found = found.join(times, ["conv_id", "message_ordinal"], "left")
    base = base_score(terms)
    if score_expanded:
        base = F.greatest(base, F.lit(1.0))
    factor = F.lit(1.0)
    if span is not None:
        inside = F.coalesce(F.col("ts").between(F.lit(span[0]), F.lit(span[1])), F.lit(False))
        factor = F.when(inside, IN_RANGE).otherwise(OUT_OF_RANGE if refers else 1.0)
    elif refers:
        factor = F.when(F.col("ts").isNotNull(), TIMED).otherwise(1.0)
    return found.withColumn("score", base * F.col("weight") * factor)


def _order() -> list[Column]:
    return [F.desc("score"), F.col("term_pos"), F.col("semantic_ref_ordinal")]


def ranked(found: DataFrame, budget: int = REF_BUDGET) -> DataFrame:
    """The best refs with ``rank`` from 1, as many as can fit the budget: by score, then as they were found. A bounded top list, then numbers."""
    best = found.orderBy(*_order()).limit(budget // LEAST_REF + 1)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_order())).cast("bigint"))


def ranked_all(found: DataFrame) -> DataFrame:
    """All refs with ``rank`` from 1, whatever their number: ranges of the order are written, numbered each, and begin after the rows of those before."""
    ranges = store.written(found.repartitionByRange(*_order()).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*_order()))
    return ranges.withColumn("__own", own).join(base, "__range").withColumn("rank", (F.col("__base") + F.col("__own")).cast("bigint")).drop("__range", "__own", "__base")


def ref_json() -> Column:
    stamp = F.date_format("ts", STAMP)
    timed = F.concat(F.lit('{"knowledge":'), F.col("knowledge_json"), F.lit(',"timeRange":{"start":"'), stamp, F.lit('","end":"'), stamp, F.lit('"}}'))
    return F.when(F.col("ts").isNotNull(), timed).otherwise(F.concat(F.lit('{"knowledge":'), F.col("knowledge_json"), F.lit("}")))


def utf16(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def within_budget(best: DataFrame, budget: int = REF_BUDGET) -> DataFrame:
    """Ranked refs up to and with the one that makes the serialized context reach the budget; topics and others are two lists."""
    rows = best.withColumn("json", ref_json())
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    topic = (F.col("knowledge_type") == "topic").cast("int")
    sums = rows.withColumn("__len", F.coalesce(F.sum(utf16(F.col("json"))).over(before), F.lit(0)))
    sums = sums.withColumn("__t", F.coalesce(F.sum(topic).over(before), F.lit(0))).withColumn("__e", F.coalesce(F.sum(1 - topic).over(before), F.lit(0)))
    used = REF_BASE + F.col("__len") + F.greatest(F.col("__t") - 1, F.lit(0)) + F.greatest(F.col("__e") - 1, F.lit(0))
    return sums.where((F.col("rank") == 1) | (used < budget)).drop("__len", "__t", "__e")


def message_json() -> Column:
    text = F.concat(F.lit('{"messageText":'), F.to_json("text_chunks"))
    return F.when(F.col("ts").isNotNull(), F.concat(text, F.lit(',"timestamp":"'), F.date_format("ts", STAMP), F.lit('"}'))).otherwise(F.concat(text, F.lit("}")))


def selected_messages(kept: DataFrame, budget: int = MESSAGE_BUDGET) -> DataFrame:
    """Messages of the kept refs, by the first ref of each, while what is before them fits the budget."""
    first = kept.groupBy("conv_id", "message_ordinal").agg(F.min("rank").alias("first_rank"), F.first("ts").alias("ts"), F.first("text_chunks").alias("text_chunks"))
    rows = first.withColumn("json", message_json())
    before = Window.orderBy("first_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(before)).withColumn("__len", F.coalesce(F.sum(utf16(F.col("json"))).over(before), F.lit(0)))
    used = MESSAGE_BASE + F.col("__len") + F.greatest(F.col("__n") - 1, F.lit(0))
    return rows.where(used <= budget).drop("__n", "__len")


def document(kept: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: the context as JSON. Both inputs fit their budgets, so the lists are short."""
    def listed(rows: DataFrame, by: str, name: str) -> DataFrame:
        sorted_list = F.array_sort(F.collect_list(F.struct(F.col(by).alias("r"), "json")))
        return rows.agg(F.array_join(F.transform(sorted_list, lambda x: x["json"]), ",").alias(name))

    entities = listed(kept.where(F.col("knowledge_type") != "topic"), "rank", "e")
    topics = listed(kept.where(F.col("knowledge_type") == "topic"), "rank", "t")
    texts = listed(messages, "first_rank", "m")
    whole = entities.crossJoin(topics).crossJoin(texts)  # three single rows
    return whole.select(F.concat(F.lit('{"entities":['), "e", F.lit('],"topics":['), "t", F.lit('],"messages":['), "m", F.lit("]}")).alias("context"))
