"""Queries by name over the driver's tables, and the SQL that DuckDB answers them with."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import chunking, temporal, values, vectors
from palaver.operators import collections, expand, ingest, postings, rag, store, vector_index
from palaver.plans import context, query_ir, scope
from palaver.sources import corpora

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TERMS = ["customer", "building", "place", "1-urgent", "order", "nation_3", "past"]
SPAN = (datetime(1997, 3, 1), datetime(1997, 3, 31, 23, 59, 59, 999000))
REFERENCE = date(2024, 3, 31)
#: (term, related, relation, rank)
RELATIONS = [
    ("building", "construction", "synonym", 1), ("building", "edifice", "synonym", 2), ("building", "office_block", "synonym", 3),
    ("machinery", "equipment", "synonym", 1), ("place", "put", "synonym", 1), ("place", "set", "synonym", 7), ("customer", "client", "synonym", 1),
    ("client", "patron", "synonym", 1), ("customer", "building", "llm", 1), ("household", "home", "llm", 1), ("priority", "urgency", "llm", 1),
    ("furniture", "furnish", "lemma", 1), ("building", "build", "lemma", 1), ("place", "customer", "lemma", 1),
]
EXPRESSIONS = ["today", "yesterday", "last week", "last month", "last 3 days", "this week", "this month", "january 2023", "maybe", "2024-02-10", "someday"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- shared pieces

M = """m AS (SELECT o_orderkey AS message_ordinal, o_orderdate AS ts, c_name || ' placed order ' || o_orderkey AS text, c_name,
 lower(c_mktsegment) AS seg, n_name, o_orderpriority AS pr, o_orderstatus AS st
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
R = (
    M
    + """, r AS (
 SELECT message_ordinal * 3 AS ref, message_ordinal, 'entity' AS kind,
  '{"name":"' || c_name || '","type":["' || seg || '","customer"],"facets":[{"name":"nation","value":"' || n_name || '"}]}' AS json FROM m
 UNION ALL SELECT message_ordinal * 3 + 1, message_ordinal, 'action',
  '{"verbs":["place"],"verbTense":"past","subjectEntityName":"' || c_name || '","objectEntityName":"order ' || message_ordinal || '","indirectObjectEntityName":"none","params":[{"name":"priority","value":"' || pr || '"},{"name":"status","value":"' || st || '"}]}' FROM m
 UNION ALL SELECT message_ordinal * 3 + 2, message_ordinal, 'topic', '{"text":"' || lower(pr) || ' order"}' FROM m)"""
)
P = (
    M
    + """, p AS (SELECT DISTINCT lower(term) AS term, ref, 1.0::DOUBLE AS score FROM (
 SELECT unnest([c_name, seg, 'customer', 'nation', n_name]) AS term, message_ordinal * 3 AS ref FROM m
 UNION ALL SELECT unnest(['place', 'order ' || message_ordinal, 'none', c_name, 'priority', pr, 'status', st]), message_ordinal * 3 + 1 FROM m
 UNION ALL SELECT lower(pr) || ' order', message_ordinal * 3 + 2 FROM m))"""
)
TERM_LIST = "(" + ", ".join(f"('{t}', {k + 1})" for k, t in enumerate(TERMS)) + ")"


def _in(terms: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


#: Scores of all refs by kind, and of those found with weight 1.
S = (
    P
    + f""", b AS (
 SELECT message_ordinal * 3 AS ref, message_ordinal, ts, text, 'entity' AS kind, ((lower(c_name) IN {_in(TERMS)})::INT + (seg IN {_in(TERMS)})::INT + ('customer' IN {_in(TERMS)})::INT
  + ('nation' IN {_in(TERMS)})::INT + (lower(n_name) IN {_in(TERMS)})::INT)::DOUBLE AS base FROM m
 UNION ALL SELECT message_ordinal * 3 + 1, message_ordinal, ts, text, 'action', (('none' IN {_in(TERMS)})::INT + (('order ' || message_ordinal) IN {_in(TERMS)})::INT
  + (lower(c_name) IN {_in(TERMS)})::INT + ('past' IN {_in(TERMS)})::INT + ('place' IN {_in(TERMS)})::INT)::DOUBLE FROM m
 UNION ALL SELECT message_ordinal * 3 + 2, message_ordinal, ts, text, 'topic', len(list_filter(string_split(lower(pr) || ' order', ' '), lambda w: w IN {_in(TERMS)}))::DOUBLE FROM m),
 h AS (SELECT ref, max(score) AS weight, min(place) AS term_pos FROM p JOIN (SELECT * FROM (VALUES {TERM_LIST[1:-1]}) v(term, place)) USING (term) GROUP BY ref)"""
)
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_ms(ts) % 1000)::VARCHAR, 3, '0') || 'Z'"
K = (
    S.replace("m AS (SELECT o_orderkey", "m AS MATERIALIZED (SELECT o_orderkey", 1)
    + ", "
    + R[len(M) + 2 :]
    + f""", k AS (SELECT b.ref, b.message_ordinal, b.ts, b.text, b.kind, b.base * h.weight * CASE WHEN b.ts BETWEEN TIMESTAMP '{SPAN[0]}' AND TIMESTAMP '{SPAN[1]}' THEN 1.5 ELSE 0.3 END AS score, h.term_pos, r.json
  FROM b JOIN h USING (ref) JOIN r USING (ref)),
 ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, term_pos, ref) AS rank FROM k QUALIFY rank <= 1000),
 j AS (SELECT *, '{{"knowledge":' || json || ',"timeRange":{{"start":"' || {STAMP} || '","end":"' || {STAMP} || '"}}}}' AS item FROM ranked),
 w AS (SELECT *, coalesce(sum(length(item)) OVER before, 0) AS used, coalesce(sum((kind = 'topic')::INT) OVER before, 0) AS nt, coalesce(sum((kind <> 'topic')::INT) OVER before, 0) AS ne
  FROM j WINDOW before AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 kept AS (SELECT * FROM w WHERE rank = 1 OR 27 + used + greatest(ne - 1, 0) + greatest(nt - 1, 0) < 15000),
 f AS (SELECT message_ordinal, min(rank) AS first_rank, any_value(ts) AS ts, any_value(text) AS text FROM kept GROUP BY message_ordinal),
 g AS (SELECT *, '{{"messageText":["' || text || '"],"timestamp":"' || {STAMP} || '"}}' AS item FROM f),
 msgs AS (SELECT * FROM (SELECT *, coalesce(sum(length(item)) OVER b2, 0) AS used, count(*) OVER b2 AS n FROM g WINDOW b2 AS (ORDER BY first_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE 16 + used + greatest(n - 1, 0) <= 15000)"""
)


def order_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, refs and postings of the orders corpus. Refs are numbered by their place: three a message."""
    knowledge = corpora.order_knowledge(spark, sf_dir)
    refs = ingest.populate(knowledge)
    return corpora.messages(knowledge), refs, postings.of(refs)


_KEPT: dict[tuple[str, str], store.Store] = {}


def kept_index(spark: SparkSession, sf_dir: str) -> store.Store:
    """The orders corpus as a written index, made once an application and path."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = store.Store(spark, f"{store.folder(spark)}/index-{uuid.uuid4().hex}").add(corpora.order_knowledge(spark, sf_dir))
    return _KEPT[key]


def kept_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = kept_index(spark, sf_dir)
    return kept.messages, kept.refs, kept.postings


def found(spark: SparkSession, sf_dir: str, span=None, refers: bool = False) -> DataFrame:
    messages, refs, index = kept_parts(spark, sf_dir)
    return context.scored(index, refs, messages, TERMS, span, refers)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked context for query terms: what fits the budget, best first."""
    messages, refs, index = order_parts(spark, sf_dir)
    asked = query_ir.of_terms(["customer", "building", "last month"])
    span = temporal.range_of(asked.question, date(1997, 4, 1))
    kept = context.within_budget(context.ranked(context.scored(index, refs, messages, query_ir.terms(asked), span, temporal.refers(asked.question))))
    return kept.select("rank", "semantic_ref_ordinal", "knowledge_type", "score", "message_ordinal", F.array_join("text_chunks", "").alias("text"))


# ---------------------------------------------------------------- scans


@query(f"WITH {R} SELECT ref AS semantic_ref_ordinal, message_ordinal, kind AS knowledge_type, json AS knowledge_json FROM r")
def s_scan_refs(spark, d):
    return order_parts(spark, d)[1].select("semantic_ref_ordinal", "message_ordinal", "knowledge_type", "knowledge_json")


@query("SELECT pos, o_orderkey, o_totalprice FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 11)) v(pos, k) JOIN orders ON o_orderkey = k")
def s_multiget(spark, d):
    rows = corpora.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return collections.get_many(rows, "o_orderkey", [7, 3, 7, 11])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 5")
def s_lookup(spark, d):
    return collections.get(corpora.read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 250")
def s_slice(spark, d):
    return collections.part(corpora.read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 250)


@query("SELECT o_orderkey AS ordinal, o_orderdate AS ts FROM orders UNION ALL SELECT (SELECT max(o_orderkey) + 1 FROM orders) + event_id, ts FROM events")
def s_append_ordinals(spark, d):
    orders = corpora.read(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("ts"))
    out = collections.append(orders, corpora.read(spark, d, "events").select("event_id", "ts"), "ordinal", "event_id")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---------------------------------------------------------------- ingest


@query(
    """WITH t AS (SELECT event_id, ts, 'user ' || user_id AS u, event_type, json_extract_string(props, '$.k') AS k FROM events)
 SELECT event_id * 2 AS semantic_ref_ordinal, event_id AS message_ordinal, 'entity' AS knowledge_type, '{"name":"' || u || '","type":["user"]}' AS knowledge_json FROM t
 UNION ALL SELECT event_id * 2 + 1, event_id, 'action', '{"verbs":["' || event_type || '"],"verbTense":"past","subjectEntityName":"' || u || '","objectEntityName":"none","indirectObjectEntityName":"none","params":[{"name":"k"' || coalesce(',"value":"' || k || '"', '') || '}]}' FROM t"""
)
def i_populate_refs(spark, d):
    refs = ingest.populate(corpora.event_knowledge(spark, d))
    return refs.select("semantic_ref_ordinal", "message_ordinal", "knowledge_type", "knowledge_json")


@query(f"WITH {R} SELECT ref AS semantic_ref_ordinal, json AS knowledge_json FROM r WHERE kind = 'topic'")
def i_all_topics(spark, d):
    return ingest.topics_of(order_parts(spark, d)[1]).select("semantic_ref_ordinal", "knowledge_json")


@query("SELECT event_id AS message_ordinal, event_type || ',' || 'was ' || event_type AS verbs, 0::BIGINT AS n_inverse FROM events")
def i_merge_inverse(spark, d):
    knowledge = corpora.event_knowledge(spark, d)
    passive = F.transform("actions", lambda a: a.withField("verbs", F.transform(a["verbs"], lambda v: F.concat(F.lit("was "), v))))
    merged = ingest.merge_inverse(knowledge.withColumn("inverse_actions", passive))
    verbs = F.array_join(F.flatten(F.transform("actions", lambda a: a["verbs"])), ",")
    return merged.select("message_ordinal", verbs.alias("verbs"), F.size("inverse_actions").cast("bigint").alias("n_inverse"))


@query("SELECT event_id AS message_ordinal, CASE WHEN user_id % 2 = 0 THEN 'kind=' || event_type ELSE '' END AS facets, 0::BIGINT AS n_left FROM events")
def i_merge_facets(spark, d):
    facet = F.struct(F.lit("kind").alias("name"), F.element_at("verbs", 1).alias("value_text"))
    knowledge = corpora.event_knowledge(spark, d)
    told = F.transform("actions", lambda a: a.withField("subject_facet", F.struct(F.lit("kind").alias("name"), a["verbs"][0].alias("value_text"))))
    # odd users' actions name somebody who is not among the entities
    other = F.transform(told, lambda a: a.withField("subject", F.when(F.substring_index(a["subject"], " ", -1).cast("bigint") % 2 == 0, a["subject"]).otherwise("nobody")))
    merged = ingest.merge_facets(knowledge.withColumn("actions", other))
    listed = F.array_join(F.flatten(F.transform("entities", lambda e: F.transform(e["facets"], lambda f: F.concat(f["name"], F.lit("="), f["value_text"])))), ",")
    left = F.size(F.filter("actions", lambda a: a["subject_facet"].isNotNull())).cast("bigint")
    return merged.select("message_ordinal", listed.alias("facets"), left.alias("n_left"))


# ---------------------------------------------------------------- index


def _index_query(kind: str, remainder: int):
    @query(f"WITH {P} SELECT term, ref AS semantic_ref_ordinal, score FROM p WHERE ref % 3 = {remainder}")
    def run(spark, d):
        return postings.of(order_parts(spark, d)[1], (kind,)).select("term", "semantic_ref_ordinal", "score")

    sql = ORACLE.pop("run")
    QUERIES.pop("run")
    run.__name__ = f"x_postings_{kind}"
    QUERIES[run.__name__], ORACLE[run.__name__] = run, sql


for _kind, _remainder in (("entity", 0), ("action", 1), ("topic", 2)):
    _index_query(_kind, _remainder)


@query(f"WITH {P} SELECT term, ref AS semantic_ref_ordinal, score FROM p")
def x_build_index(spark, d):
    return order_parts(spark, d)[2].select("term", "semantic_ref_ordinal", "score")


@query(f"WITH {P} SELECT term, min(ref) AS first_ref FROM p GROUP BY term")
def x_terms(spark, d):
    return postings.terms(kept_parts(spark, d)[2])


@query(f"WITH {P} SELECT term, ref AS semantic_ref_ordinal FROM p WHERE term = 'building'")
def x_lookup_term(spark, d):
    return postings.lookup(kept_parts(spark, d)[2], "building").select("term", "semantic_ref_ordinal")


@query(f"WITH {P} SELECT term, count(*) AS n FROM p WHERE term <> 'customer' GROUP BY term")
def x_remove_term(spark, d):
    return postings.remove(kept_parts(spark, d)[2], "customer").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH i AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS term FROM orders)
 SELECT lower(term) AS term, max(pos) * 3 AS semantic_ref_ordinal, 1.0::DOUBLE AS score FROM i GROUP BY lower(term)"""
)
def x_load_export_lastwins(spark, d):
    orders = corpora.read(spark, d, "orders")
    term = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    refs = F.array(F.struct((F.col("o_orderkey") * 3).alias("semanticRefOrdinal"), F.lit(1.0).alias("score")))
    return postings.load(orders.select(F.col("o_orderkey").alias("item_pos"), term.alias("term"), refs.alias("semanticRefOrdinals")))


def _relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "term string, related string, relation string, rank int")


_VALUES = ", ".join(str(r) for r in RELATIONS)
_STOPS = _in(expand.STOP_WORDS)


def _expanded_sql(kind: str, weight: float, most: str, stops: bool) -> str:
    fits = f"length(term) >= 3 AND NOT contains(term, ' ')" + (f" AND term NOT IN {_STOPS}" if stops else "")
    related = "lower(replace(related, '_', ' '))"
    single = "WHERE NOT contains(rel, ' ')" if kind == "synonym" else ""
    return f"""WITH {P}, v AS (SELECT term, {related} AS rel FROM (VALUES {_VALUES}) x(term, related, relation, rank) WHERE relation = '{kind}' AND term <> related AND {most}),
 n AS (SELECT rel AS term, ref, max(score) * {weight} AS score FROM (SELECT * FROM v {single}) JOIN p USING (term) WHERE {fits} GROUP BY rel, ref)
 SELECT term, ref AS semantic_ref_ordinal, score FROM p UNION ALL SELECT term, ref, score FROM n WHERE (term, ref) NOT IN (SELECT (term, ref) FROM p)"""


@query(_expanded_sql("lemma", 1.0, "true", False))
def x_lemmatize(spark, d):
    return expand.lemmatize(kept_parts(spark, d)[2], _relations(spark)).select("term", "semantic_ref_ordinal", "score")


@query(_expanded_sql("synonym", 0.9, "rank <= 5", True))
def x_expand_synonyms(spark, d):
    return expand.with_synonyms(kept_parts(spark, d)[2], _relations(spark)).select("term", "semantic_ref_ordinal", "score")


@query(_expanded_sql("llm", 0.9, "true", True))
def x_expand_related(spark, d):
    return expand.with_related(kept_parts(spark, d)[2], _relations(spark)).select("term", "semantic_ref_ordinal", "score")


@query(
    f"""WITH {P} SELECT term, string_agg(rel, ',' ORDER BY rel) AS related, count(*) AS n_related FROM (SELECT DISTINCT term, lower(replace(related, '_', ' ')) AS rel
 FROM (VALUES {_VALUES}) x(term, related, relation, rank) WHERE relation = 'synonym' AND rank <= 5 AND term IN (SELECT term FROM p)) WHERE NOT contains(rel, ' ') GROUP BY term"""
)
def x_expand_stats(spark, d):
    return expand.statistics(kept_parts(spark, d)[2], _relations(spark), "synonym", 5)


# ---------------------------------------------------------------- filters

_TURN_TERMS = "t AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM conversations)"


@query(f"WITH {_TURN_TERMS} SELECT term FROM t WHERE length(term) >= 3 AND NOT contains(term, ' ') AND term NOT IN {_STOPS}")
def f_eligible_terms(spark, d):
    words = corpora.read(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    return words.where(expand.eligible(F.col("term")))


_REFERS = (
    "regexp_matches(lower(text), '\\b(19|20)\\d{2}\\b') OR regexp_matches(lower(text), '\\b\\d{1,2}/\\d{1,2}(/\\d{2,4})?\\b') OR "
    + " OR ".join(f"contains(lower(text), '{k}')" for k in temporal.KEYWORDS)
)


@query(f"SELECT conv_id, turn, ({_REFERS}) AS refers FROM conversations")
def f_temporal_reference(spark, d):
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", temporal.refers_column(F.col("text")).alias("refers"))


@query(f"WITH {R} SELECT kind AS knowledge_type, count(*) AS n FROM r WHERE kind IN ('entity', 'action') GROUP BY kind")
def f_knowledge_type(spark, d):
    refs = kept_parts(spark, d)[1].where(F.col("knowledge_type").isin("entity", "action"))
    return refs.groupBy("knowledge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, text FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10")
def f_short_content(spark, d):
    rows = corpora.read(spark, d, "conversations").select("conv_id", "turn", "text")
    return rows.where(F.char_length(chunking.trim(F.col("text"))) >= 10)


# ---------------------------------------------------------------- time


def _events(spark, d):
    return corpora.messages(corpora.event_knowledge(spark, d))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT event_id AS message_ordinal, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:59:59.999'")
def t_range(spark, d):
    return _plain(temporal.between(_events(spark, d), *temporal.day(date(2024, 1, 10), date(2024, 1, 12))), "ts").select("message_ordinal", "ts")


@query("SELECT event_id AS message_ordinal, ts FROM events WHERE ts::DATE = DATE '2024-01-15'")
def t_on_day(spark, d):
    return _plain(temporal.on_day(_events(spark, d), date(2024, 1, 15)), "ts").select("message_ordinal", "ts")


@query("SELECT event_id AS message_ordinal, ts FROM events WHERE ts < TIMESTAMP '2024-01-03 12:00:00'")
def t_before(spark, d):
    return _plain(temporal.before(_events(spark, d), datetime(2024, 1, 3, 12)), "ts").select("message_ordinal", "ts")


@query("SELECT event_id AS message_ordinal, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00'")
def t_after(spark, d):
    return _plain(temporal.after(_events(spark, d), datetime(2024, 1, 30, 12)), "ts").select("message_ordinal", "ts")


@query("SELECT event_id AS message_ordinal, ts FROM events ORDER BY ts, event_id")
def t_sorted(spark, d):
    return _plain(temporal.indexed(_events(spark, d)).orderBy("ts", "message_ordinal"), "ts").select("message_ordinal", "ts")


@query("SELECT min(ts) AS earliest, max(ts) AS latest, count(ts) AS n FROM events")
def t_date_range(spark, d):
    return _plain(temporal.extent(_events(spark, d)), "earliest", "latest")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_messages, min(event_id) AS first_message, max(event_id) AS last_message FROM events GROUP BY 1")
def t_day_index(spark, d):
    return temporal.by_day(_events(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT user_id, arg_min(ts, event_id) AS \"begin\", arg_max(ts, event_id) AS \"end\" FROM events GROUP BY user_id")
def t_conversation_range(spark, d):
    rows = corpora.read(spark, d, "events").select("user_id", F.col("event_id").alias("message_ordinal"), "ts")
    return _plain(temporal.conversation_extent(rows, "user_id"), "begin", "end")


@query(
    """SELECT expression, CASE WHEN b IS NULL THEN NULL ELSE b::TIMESTAMP END AS "begin", CASE WHEN e IS NULL THEN NULL ELSE e::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND END AS "end" FROM (VALUES
 ('today', DATE '2024-03-31', DATE '2024-03-31'), ('yesterday', DATE '2024-03-31' - 1, DATE '2024-03-31' - 1), ('last week', DATE '2024-03-31' - 7, DATE '2024-03-31'),
 ('last month', DATE '2024-02-01' + 30, DATE '2024-03-31'), ('last 3 days', DATE '2024-03-31' - 3, DATE '2024-03-31'), ('this week', DATE '2024-03-31' - dayofweek(DATE '2024-03-31')::INT, DATE '2024-03-31'),
 ('this month', DATE '2024-03-01', DATE '2024-03-31'), ('january 2023', DATE '2023-01-01', DATE '2023-01-31'), ('maybe', DATE '2024-05-01', DATE '2024-05-31'), ('2024-02-10', DATE '2024-02-10', DATE '2024-02-10'),
 ('someday', NULL, NULL)) v(expression, b, e)"""
)
def t_parse_expression(spark, d):
    rows = [(x, *(temporal.parse(x, REFERENCE) or (None, None))) for x in EXPRESSIONS]
    return spark.createDataFrame(rows, "expression string, begin timestamp_ntz, end timestamp_ntz")


# ---------------------------------------------------------------- joins


@query(f"WITH {P} SELECT term, ref AS semantic_ref_ordinal FROM p WHERE ref // 3 % 10 = 0")
def j_dangling_postings(spark, d):
    _, refs, index = kept_parts(spark, d)
    some = refs.where(F.col("message_ordinal") % 10 != 0)
    return collections.dangling(index, some, "semantic_ref_ordinal").select("term", "semantic_ref_ordinal")


@query(f"WITH {R} SELECT ref AS semantic_ref_ordinal, text FROM r JOIN m USING (message_ordinal)")
def j_refs_messages(spark, d):
    messages, refs, _ = kept_parts(spark, d)
    return refs.join(messages, ["conv_id", "message_ordinal"]).select("semantic_ref_ordinal", F.array_join("text_chunks", "").alias("text"))


# ---------------------------------------------------------------- scores and context


def _score_query(kind: str):
    @query(f"WITH {S} SELECT ref AS semantic_ref_ordinal, base FROM b WHERE kind = '{kind}'")
    def run(spark, d):
        refs = kept_parts(spark, d)[1].where(F.col("knowledge_type") == kind)
        return refs.select("semantic_ref_ordinal", context.base_score(TERMS).alias("base"))

    QUERIES.pop("run")
    sql = ORACLE.pop("run")
    run.__name__ = f"k_score_{kind}"
    QUERIES[run.__name__], ORACLE[run.__name__] = run, sql


for _kind in ("entity", "action", "topic"):
    _score_query(_kind)


@query(f"WITH {S} SELECT ref AS semantic_ref_ordinal, base * weight AS score FROM b JOIN h USING (ref)")
def k_weighted(spark, d):
    return found(spark, d).select("semantic_ref_ordinal", "score")


@query(f"WITH {S} SELECT ref AS semantic_ref_ordinal, round(base * weight * CASE WHEN ts BETWEEN TIMESTAMP '{SPAN[0]}' AND TIMESTAMP '{SPAN[1]}' THEN 1.5 ELSE 0.3 END, 6) AS score FROM b JOIN h USING (ref)")
def k_temporal_range(spark, d):
    return found(spark, d, SPAN, True).select("semantic_ref_ordinal", F.round("score", 6).alias("score"))


@query(f"WITH {S} SELECT ref AS semantic_ref_ordinal, round(base * weight * CASE WHEN ts IS NOT NULL THEN 1.1 ELSE 1 END, 6) AS score FROM b JOIN h USING (ref)")
def k_temporal_norange(spark, d):
    return found(spark, d, None, True).select("semantic_ref_ordinal", F.round("score", 6).alias("score"))


@query(f"WITH {K} SELECT row_number() OVER (ORDER BY score DESC, term_pos, ref) AS rank, ref AS semantic_ref_ordinal, kind AS knowledge_type, round(score, 6) AS score FROM k")
def k_rank(spark, d):
    best = context.ranked_all(found(spark, d, SPAN, True))
    return best.select("rank", "semantic_ref_ordinal", "knowledge_type", F.round("score", 6).alias("score"))


@query(f"WITH {K} SELECT rank, ref AS semantic_ref_ordinal, item AS json FROM kept")
def k_ref_budget(spark, d):
    return context.within_budget(context.ranked(found(spark, d, SPAN, True))).select("rank", "semantic_ref_ordinal", "json")


@query(f"WITH {K} SELECT first_rank, message_ordinal, item AS json FROM msgs")
def k_message_budget(spark, d):
    kept = context.within_budget(context.ranked(found(spark, d, SPAN, True)))
    return context.selected_messages(kept).select("first_rank", "message_ordinal", "json")


@query(
    f"""WITH {K} SELECT '{{"entities":[' || coalesce((SELECT string_agg(item, ',' ORDER BY rank) FROM kept WHERE kind <> 'topic'), '') || '],"topics":[' || coalesce((SELECT string_agg(item, ',' ORDER BY rank) FROM kept WHERE kind = 'topic'), '')
 || '],"messages":[' || coalesce((SELECT string_agg(item, ',' ORDER BY first_rank) FROM msgs), '') || ']}}' AS context"""
)
def k_context(spark, d):
    kept = context.within_budget(context.ranked(found(spark, d, SPAN, True)))
    return context.document(kept, context.selected_messages(kept))


# ---------------------------------------------------------------- chunks

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
 c AS (SELECT doc_id, 0::BIGINT AS chunk, text FROM d WHERE n <= 500 UNION ALL SELECT doc_id, i AS chunk, {_TRIM.format('substring(text, i * 450 + 1, 500)')} FROM (SELECT *, unnest(generate_series(0::BIGINT, greatest(0, ceil((n - 500) / 450.0))::BIGINT)) AS i FROM d WHERE n > 500))
 SELECT doc_id, chunk, text FROM c WHERE text <> ''"""
)
def c_chunk_fixed(spark, d):
    return chunking.fixed(corpora.read(spark, d, "documents"), 500, 50)


@query("SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]+')) AS n, md5(array_to_string(regexp_extract_all(text, '[^.!?]+[.!?]+'), '|')) AS digest FROM documents")
def c_sentences(spark, d):
    found_ = chunking.sentences(F.col("text"))
    return corpora.read(spark, d, "documents").select("doc_id", F.size(found_).cast("bigint").alias("n"), F.md5(F.array_join(found_, "|").cast("binary")).alias("digest"))


@query()
def c_chunk_sentences(spark, d):
    return chunking.packed(corpora.read(spark, d, "documents"), 500, 50)


# ---------------------------------------------------------------- vectors

_Q = "q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0)"
_E = "e AS (SELECT vec_id::BIGINT AS chunk_pos, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _query_vector(spark, d, k: int = 0):
    return corpora.vectors(spark, d).where(F.col("chunk_pos") == k).select("embedding").collect()[0][0]


def _vector_query(name: str, sql: str, value):
    @query(f"WITH {_Q}, {_E} SELECT chunk_pos, round({sql}, 6) AS value FROM e, q")
    def run(spark, d):
        return corpora.vectors(spark, d).select("chunk_pos", F.round(value(F.col("embedding"), vectors.literal(_query_vector(spark, d))), 6).alias("value"))

    QUERIES.pop("run")
    oracle = ORACLE.pop("run")
    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, oracle


_vector_query("v_cosine", "list_cosine_similarity(v, qe)", vectors.cosine)
_vector_query("v_dot", "list_dot_product(v, qe)", vectors.dot)
_vector_query("v_l2", "list_distance(v, qe) ** 2", vectors.squared_distance)


@query(f"WITH {_E} SELECT chunk_pos, round(sqrt(list_dot_product(v, v)), 6) AS size, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM e")
def v_normalize(spark, d):
    n = vectors.normalize(F.col("embedding"))
    return corpora.vectors(spark, d).select("chunk_pos", F.round(vectors.norm(F.col("embedding")), 6).alias("size"), F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.element_at(n, 64), 6).alias("last"))


@query(f"WITH {_Q}, {_E} SELECT chunk_pos, round(1 - list_cosine_similarity(v, qe), 6) AS distance FROM e, q ORDER BY 1 - list_cosine_similarity(v, qe), chunk_pos LIMIT 5")
def v_knn(spark, d):
    return vector_index.nearest(corpora.vectors(spark, d), _query_vector(spark, d)).select("chunk_pos", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q}, {_E} SELECT chunk_pos, round(list_cosine_similarity(v, qe), 6) AS score FROM e, q WHERE label = 3 AND list_cosine_similarity(v, qe) >= 0 ORDER BY list_cosine_similarity(v, qe) DESC, chunk_pos LIMIT 5")
def v_knn_filtered(spark, d):
    best = vector_index.query(corpora.vectors(spark, d), _query_vector(spark, d), where=F.col("metadata")["label"] == "3")
    return best.select("chunk_pos", F.round("score", 6).alias("score"))


@query(f"WITH {_Q}, {_E} SELECT chunk_pos, round(1 / (2 - list_cosine_similarity(v, qe)), 6) AS score FROM e, q ORDER BY list_cosine_similarity(v, qe) DESC, chunk_pos LIMIT 5")
def v_query_default_score(spark, d):
    return vector_index.query(corpora.vectors(spark, d), _query_vector(spark, d)).select("chunk_pos", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_E}, q AS (SELECT list(x ORDER BY i) AS qe FROM (SELECT i, avg(v[i]) AS x FROM e, generate_series(1, 64) s(i) WHERE chunk_pos < 3 GROUP BY i))
 SELECT chunk_pos, round(1 / (2 - list_cosine_similarity(v, qe)), 6) AS score FROM e, q ORDER BY list_cosine_similarity(v, qe) DESC, chunk_pos LIMIT 5"""
)
def v_multi_query(spark, d):
    some = [_query_vector(spark, d, k) for k in range(3)]
    return vector_index.query_many(corpora.vectors(spark, d), some).select("chunk_pos", F.round("score", 6).alias("score"))


@query("SELECT vec_id::BIGINT AS chunk_pos, label::VARCHAR AS label FROM embeddings WHERE vec_id NOT IN (1, 5, 9)")
def v_remove(spark, d):
    left, _ = vector_index.remove(corpora.vectors(spark, d), ["chunk-1", "chunk-5", "chunk-9", "chunk-none"])
    return left.select("chunk_pos", F.col("metadata")["label"].alias("label"))


@query(
    f"""WITH {_E}, b AS (SELECT a.chunk_pos AS query_id, e.chunk_pos, 1 - list_cosine_similarity(a.v, e.v) AS dist FROM e a, e WHERE a.chunk_pos % 100 = 0)
 SELECT query_id, chunk_pos, round(dist, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), chunk_pos) AS rank FROM b) WHERE rank <= 5"""
)
def v_batch_knn(spark, d):
    chunks = corpora.vectors(spark, d)
    asked = chunks.where(F.col("chunk_pos") % 100 == 0).select(F.col("chunk_pos").alias("query_id"), "embedding")
    near = vector_index.join_nearest(asked, chunks, 8).withColumn("d", F.round("distance", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "chunk_pos")).cast("bigint")
    return near.withColumn("rank", rank).where("rank <= 5").select("query_id", "chunk_pos", F.abs(F.round("distance", 6)).alias("distance"), "rank")


@query()
def v_ann_cells(spark, d):
    chunks = corpora.vectors(spark, d)
    asked = chunks.where(F.col("chunk_pos") % 100 == 0).select(F.col("chunk_pos").alias("query_id"), "embedding")
    index = vector_index.create_index("cells", cells=None, recall=0.97).fit(chunks)
    path = f"{store.folder(spark)}/cells-{uuid.uuid4().hex}"
    index.save(index.assign(chunks), path)
    index, assigned = vector_index.CellIndex.load(spark, path)
    return index.search_many(assigned, asked).select("query_id", "chunk_pos", F.abs(F.round("distance", 6)).alias("distance"), "rank")


@query("SELECT o_orderkey AS message_ordinal, 'msg-' || o_orderkey || '-0' AS id, c_name || ' placed order ' || o_orderkey AS text, o_orderkey::VARCHAR AS ordinal, 'orders' AS source FROM orders JOIN customer ON o_custkey = c_custkey")
def i_message_chunks(spark, d):
    rows = rag.from_messages(corpora.messages(corpora.order_knowledge(spark, d)), {"source": "orders"})
    return rows.select("message_ordinal", "id", "text", F.col("metadata")["messageOrdinal"].alias("ordinal"), F.col("metadata")["source"].alias("source"))


@query()
def n_message_text(spark, d):
    turns = corpora.read(spark, d, "conversations")
    numbered = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_ordinal"), F.array("text").alias("text_chunks"))
    asked = " ".join(turns.where("conv_id = 0 and turn = 0").select("text").collect()[0][0].split()[:20])
    return rag.lookup_messages(numbered, asked)


@query()
def n_threads(spark, d):
    threads = rag.Threads(spark)
    for k, name in enumerate(["orders of the building trade", "complaints about late orders", "holiday plans"]):
        threads.add(name, k * 10, k * 10 + 9)
    return threads.lookup("late orders").select("id", "description", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- statistics


@query(f"WITH {P} SELECT count(DISTINCT term) AS term_count, (SELECT count(*) * 3 FROM m) AS ref_count, (SELECT count(*) FROM m) AS message_count FROM p")
def a_index_stats(spark, d):
    messages, refs, index = kept_parts(spark, d)
    parts = index.select(F.lit("t").alias("kind"), "term").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.unionByName(refs.select(F.lit("r").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))).unionByName(messages.select(F.lit("m").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("n")))
    return parts.agg(one("t").alias("term_count"), one("r").alias("ref_count"), one("m").alias("message_count"))


@query(f"WITH {P} SELECT term, count(*) AS n_refs FROM p GROUP BY term")
def a_refs_per_term(spark, d):
    return kept_parts(spark, d)[2].groupBy("term").agg(F.count(F.lit(1)).alias("n_refs"))


@query(f"WITH {S} SELECT message_ordinal, count(*) AS n_hits FROM b JOIN h USING (ref) GROUP BY message_ordinal")
def a_refs_per_message(spark, d):
    return found(spark, d).groupBy("message_ordinal").agg(F.count(F.lit(1)).alias("n_hits"))


@query(
    f"""WITH {P} SELECT CASE ref % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'action' ELSE 'topic' END AS knowledge_type, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM p GROUP BY 1
 UNION ALL SELECT NULL, count(DISTINCT term), count(*) FROM p"""
)
def a_terms_rollup_by_type(spark, d):
    _, refs, index = kept_parts(spark, d)
    typed = index.join(refs.select("semantic_ref_ordinal", "knowledge_type"), "semantic_ref_ordinal")
    return typed.rollup("knowledge_type").agg(F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"))


# ---------------------------------------------------------------- the declared contract

_HITS = f"WITH {P}, t AS (SELECT ref, count(DISTINCT term) AS n, sum(score) AS score FROM p WHERE term IN ('customer', 'building', 'nation_3') GROUP BY ref)"
_GROUP = ["customer", "building", "nation_3"]


@query(f"{_HITS} SELECT ref AS semantic_ref_ordinal, n AS n_terms, score FROM t WHERE n = 3")
def n_and(spark, d):
    return scope.all_of(kept_parts(spark, d)[2], _GROUP).select("semantic_ref_ordinal", "n_terms", "score")


@query(f"{_HITS} SELECT ref AS semantic_ref_ordinal, n AS n_terms, score FROM t")
def n_or(spark, d):
    return scope.any_of(kept_parts(spark, d)[2], _GROUP).select("semantic_ref_ordinal", "n_terms", "score")


@query(f"{_HITS} SELECT ref AS semantic_ref_ordinal, n AS n_terms, score FROM t WHERE n = (SELECT max(n) FROM t)")
def n_or_max(spark, d):
    return scope.most_of(kept_parts(spark, d)[2], _GROUP).select("semantic_ref_ordinal", "n_terms", "score")


@query(f"WITH {M} SELECT message_ordinal * 3 AS semantic_ref_ordinal FROM m WHERE n_name = 'NATION_3' UNION ALL SELECT message_ordinal * 3 + 1 FROM m WHERE pr = '1-URGENT' AND false")
def n_property(spark, d):
    return scope.with_property(scope.properties(kept_parts(spark, d)[1]), "nation", "nation_3").select("semantic_ref_ordinal")


@query(f"WITH {P} SELECT ref AS semantic_ref_ordinal FROM p JOIN m ON message_ordinal = ref // 3 WHERE term = 'place' AND ts BETWEEN TIMESTAMP '{SPAN[0]}' AND TIMESTAMP '{SPAN[1]}' AND message_ordinal IN (SELECT ref // 3 FROM p WHERE term = 'building')")
def n_when_filter(spark, d):
    messages, refs, index = kept_parts(spark, d)
    hits = scope.any_of(index, ["place"])
    when = scope.When(knowledge_type="action", date_range=SPAN, scope_terms=("building",))
    return scope.apply(hits, refs, messages, index, when).select("semantic_ref_ordinal")


@query(
    f"""WITH {P}, t AS (SELECT DISTINCT term FROM p) SELECT asked, term, d AS distance FROM (SELECT asked, term, levenshtein(asked, term) AS d, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, term), term) AS n
 FROM t, (VALUES ('bilding'), ('custmer')) v(asked) WHERE levenshtein(asked, term) <= 3) WHERE n <= 3"""
)
def n_fuzzy_terms(spark, d):
    return scope.fuzzy(kept_parts(spark, d)[2], ["bilding", "custmer"], most=3, distance=3).withColumn("distance", F.col("distance").cast("bigint"))


# ---------------------------------------------------------------- tools and streams

TOOL_TEXT = [
    (0, 'Let me look. <tool_call>{"name": "search", "arguments": {"q": "a } b"}}</tool_call> Done.'),
    (1, '<toolcall>```json\n{"function": {"name": "add", "arguments": "{\\"x\\": 1}"}}\n```</toolcall>'),
    (2, '<tool-call>{"name": broken}</tool-call>text<invoke>{"name": "list"}</invoke>'),
    (3, "before <invoke>never closed"),
    (4, "no call"),
]


@query()
def u_parse_tool_calls(spark, d):
    from palaver.tools import parse_column

    rows = spark.createDataFrame(TOOL_TEXT, "id bigint, text string")
    return rows.select("id", parse_column("text").alias("p")).select("id", "p.text", F.explode_outer("p.calls").alias("c")).select("id", "text", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


@query()
def u_tool_docs(spark, d):
    from palaver.tools import Parameter, Registry, Tool

    registry = Registry()
    registry.register(Tool("search", "Find messages.", {"q": Parameter("string", "what to find")}, lambda q: q))
    return spark.createDataFrame([(registry.docs(),)], "docs string")


@query("SELECT event_id AS message_ordinal, 'user ' || user_id AS term, event_id * 2 AS semantic_ref_ordinal FROM events")
def st_ingest_equivalence(spark, d):
    from palaver.streaming.ingest import stream_postings

    rows = stream_postings(spark, d).where(F.startswith("term", F.lit("user ")) & (F.col("knowledge_type") == "entity"))
    return rows.select("message_ordinal", "term", (F.col("message_ordinal") * 2).alias("semantic_ref_ordinal"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
 SELECT user_id, min(ts) AS "begin", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session"""
)
def st_session(spark, d):
    from palaver.streaming.ingest import sessions

    return _plain(sessions(corpora.read(spark, d, "events"), "6 hours"), "begin", "end")


@query(ORACLE["st_session"])
def st_session_stream(spark, d):
    from palaver.streaming.ingest import stream_sessions

    return _plain(stream_sessions(corpora.read(spark, d, "events"), "6 hours", "30 days"), "begin", "end")


@query(ORACLE["c_chunk_fixed"])
def st_rag_chunks(spark, d):
    from palaver.streaming.ingest import stream_chunks

    return stream_chunks(spark, d, 500, 50).select(*QUERIES["c_chunk_fixed"](spark, d).columns)


# ---------------------------------------------------------------- additions, indexes, scopes, values


@query(ORACLE["i_populate_refs"])
def i_add_message(spark, d):
    """The later half of the events added to a conversation of the earlier half."""
    from palaver.conversation import Conversation

    knowledge = corpora.event_knowledge(spark, d)
    middle = knowledge.agg(F.floor(F.avg("message_ordinal")).alias("m")).collect()[0]["m"]
    early, later = knowledge.where(F.col("message_ordinal") <= middle), knowledge.where(F.col("message_ordinal") > middle)
    whole = Conversation.kept(store.Store(spark, f"{store.folder(spark)}/index-{uuid.uuid4().hex}").add(early)).add(later)
    return whole.refs.select("semantic_ref_ordinal", "message_ordinal", "knowledge_type", "knowledge_json")


def _metric_query(name: str, kind: str, sql: str):
    @query(f"WITH {_Q}, {_E} SELECT chunk_pos, round({sql}, 6) AS distance FROM e, q ORDER BY {sql}, chunk_pos LIMIT 5")
    def run(spark, d):
        index = vector_index.create_index(kind)
        near = index.search(index.assign(corpora.vectors(spark, d)), _query_vector(spark, d))
        return near.select("chunk_pos", F.round("distance", 6).alias("distance"))

    QUERIES.pop("run")
    oracle = ORACLE.pop("run")
    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, oracle


_metric_query("v_knn_l2", "l2", "list_distance(v, qe) ** 2")
_metric_query("v_knn_ip", "ip", "-list_dot_product(v, qe)")


@query(ORACLE["v_batch_knn"])
def v_index_reopened(spark, d):
    """A cell index saved and opened again; with all cells probed it is exact."""
    chunks = corpora.vectors(spark, d)
    index = vector_index.create_index("cells", cells=None).fit(chunks)
    index.probes = index.cells
    path = f"{store.folder(spark)}/cells-{uuid.uuid4().hex}"
    index.save(index.assign(chunks), path)
    again, assigned = vector_index.CellIndex.load(spark, path)
    asked = chunks.where(F.col("chunk_pos") % 100 == 0).select(F.col("chunk_pos").alias("query_id"), "embedding")
    near = again.search_many(assigned, asked, 8).withColumn("d", F.round("distance", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "chunk_pos")).cast("bigint")
    return near.withColumn("rank", rank).where("rank <= 5").select("query_id", "chunk_pos", F.abs(F.round("distance", 6)).alias("distance"), "rank")


@query(
    f"""WITH {P}, o AS (SELECT ref, count(*) AS score FROM p WHERE term IN ('customer', 'nation_3') GROUP BY ref)
 SELECT ref AS semantic_ref_ordinal, 2::BIGINT AS n_terms, (o.score + 1)::DOUBLE AS score FROM o JOIN p USING (ref) WHERE term = 'building'"""
)
def n_nested(spark, d):
    group = scope.Group("and", (scope.Group("or", ("customer", "nation_3")), "building"))
    return scope.search(kept_parts(spark, d)[2], group).select("semantic_ref_ordinal", "n_terms", "score")


@query(
    f"""WITH {P}, v(asked, term, weight) AS (VALUES ('place', 'place', 2.0), ('place', 'customer', 0.5), ('customer', 'customer', 1.0), ('customer', 'client', 0.9), ('customer', 'building', 0.9), ('nation_3', 'nation_3', 1.0)),
 b AS (SELECT ref, asked, max(score * weight) AS score FROM p JOIN v USING (term) GROUP BY ref, asked)
 SELECT ref AS semantic_ref_ordinal, count(*) AS n_terms, round(sum(score)::DOUBLE, 6) AS score FROM b GROUP BY ref"""
)
def n_related_terms(spark, d):
    asked = [scope.SearchTerm("place", 2.0, (("customer", 0.5),)), scope.SearchTerm("customer", 1.0, None), scope.SearchTerm("nation_3")]
    found_ = scope.search_terms(kept_parts(spark, d)[2], asked, _relations(spark))
    return found_.select("semantic_ref_ordinal", "n_terms", F.round("score", 6).alias("score"))


@query(f"WITH {P} SELECT ref AS semantic_ref_ordinal FROM p WHERE term = 'place' AND ref // 3 % 3 = 1 AND (ref // 3 BETWEEN 100 AND 899 OR ref // 3 BETWEEN 2000 AND 2500)")
def n_when_tags(spark, d):
    messages, refs, index = kept_parts(spark, d)
    tagged = messages.withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("message_ordinal") % 3).cast("string"))))
    when = scope.When(tags=("t1", "other"), ranges=((100, 900), (2000, 2501)))
    return scope.apply(scope.any_of(index, ["place"]), refs, tagged, index, when).select("semantic_ref_ordinal")


@query(f"WITH {P} SELECT ref AS semantic_ref_ordinal FROM p WHERE term = 'status' AND ref // 3 IN (SELECT ref // 3 FROM p WHERE term = 'building') AND ref // 3 IN (SELECT ref // 3 FROM p WHERE term = 'nation')")
def n_subquery(spark, d):
    messages, refs, index = kept_parts(spark, d)
    when = scope.When(within=scope.Group("and", ("building", "nation")))
    return scope.apply(scope.any_of(index, ["status"]), refs, messages, index, when).select("semantic_ref_ordinal")


@query(f"WITH {M} SELECT message_ordinal * 3 AS semantic_ref_ordinal FROM m")
def n_wildcard(spark, d):
    return scope.with_property(scope.properties(kept_parts(spark, d)[1]), "nation", "*").select("semantic_ref_ordinal")


@query("SELECT c_custkey, lower(strip_accents(c_mktsegment)) = 'building' AS same FROM customer")
def c_compare_plain(spark, d):
    return corpora.read(spark, d, "customer").select("c_custkey", values.same_name(F.col("c_mktsegment"), F.lit("Búildïng")).alias("same"))


@query("SELECT c_custkey, n_name = 'NATION_3' AS same FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f_facet_equal(spark, d):
    rows = corpora.read(spark, d, "customer").join(corpora.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own, other = corpora.facet("Natión", F.col("n_name")), corpora.facet("nation", F.lit("NATION_3"))
    return rows.select("c_custkey", values.same_facet(own, other).alias("same"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 1000), 150000)::DOUBLE AS price FROM orders")
def c_clamp(spark, d):
    return corpora.read(spark, d, "orders").select("o_orderkey", values.clamp(F.col("o_totalprice").cast("double"), 1000.0, 150000.0).alias("price"))


@query("SELECT o_orderkey, 'order' AS kind, o_orderpriority AS state, o_orderstatus AS extra FROM orders")
def c_object_merge(spark, d):
    base = F.create_map(F.lit("kind"), F.lit("order"), F.lit("state"), F.col("o_orderstatus"))
    m = values.with_entry(values.merged(base, F.create_map(F.lit("state"), F.col("o_orderpriority"))), "extra", F.col("o_orderstatus"))
    return corpora.read(spark, d, "orders").select("o_orderkey", m["kind"].alias("kind"), m["state"].alias("state"), m["extra"].alias("extra"))


@query("SELECT conv_id, turn, contains(text, 'th') OR contains(text, 'ing') AS met FROM conversations")
def c_any_match(spark, d):
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", values.any_of(F.col("text"), ["th", "ing"]).alias("met"))


@query("SELECT count(*) AS n_read, count(*) FILTER (o_orderkey % 7 <> 0) AS n_completed, min(o_orderdate) FILTER (o_orderkey % 7 <> 0) AS earliest FROM orders")
def x_add_timestamps(spark, d):
    """Timestamps given as text; what can't be read isn't added."""
    rows = corpora.read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("no date "), F.col("o_orderkey").cast("string"))).otherwise(F.date_format("o_orderdate", context.STAMP))
    added = rows.select("o_orderkey", temporal.parsed(text).alias("ts"))
    return _plain(added.agg(F.count(F.lit(1)).alias("n_read"), F.count("ts").alias("n_completed"), F.min("ts").alias("earliest")), "earliest")


@query("SELECT event_id, event_id % 9 <> 0 AS good FROM events")
def c_schema_valid(spark, d):
    """Actions as JSON against their schema; every ninth is broken off."""
    rows = corpora.read(spark, d, "events")
    json = values.serialized(F.struct(F.array("event_type").alias("verbs"), F.col("user_id").alias("subject")))
    told = F.when(F.col("event_id") % 9 == 0, F.substring(json, F.lit(1), F.char_length(json) - 1)).otherwise(json)
    return rows.select("event_id", values.fits(told, "verbs array<string>, subject bigint", ("verbs", "subject")).alias("good"))


@query("SELECT event_id, event_type AS verb, user_id AS subject FROM events")
def c_json_round(spark, d):
    rows = corpora.read(spark, d, "events")
    json = values.serialized(F.struct(F.array("event_type").alias("verbs"), F.col("user_id").alias("subject")))
    read = rows.select("event_id", values.deserialized(json, "verbs array<string>, subject bigint").alias("x"))
    return read.select("event_id", F.col("x.verbs")[0].alias("verb"), F.col("x.subject").alias("subject"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1)::BIGINT, 2048)) AS a FROM d)
 SELECT doc_id, a // 2048 AS piece, length(substr(t, a + 1, 2048)) AS n FROM p"""
)
def i_extractor_pieces(spark, d):
    from palaver.settings import ExtractorSettings

    docs = corpora.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = ExtractorSettings().pieces(docs)
    return cut.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.char_length("piece_text").cast("bigint").alias("n"))
