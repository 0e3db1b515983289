"""Table layouts of the engine."""

from __future__ import annotations

FACET = "struct<name:string,value_text:string>"
ENTITY = f"struct<name:string,type:array<string>,facets:array<{FACET}>>"
ACTION = (
    f"struct<verbs:array<string>,verb_tense:string,subject:string,object:string,indirect_object:string,params:array<{FACET}>,subject_facet:{FACET}>"
)
TOPIC = "struct<text:string>"
MESSAGES = "conv_id bigint, message_ordinal bigint, text_chunks array<string>, ts timestamp"
SEMANTIC_REFS = (
    f"conv_id bigint, semantic_ref_ordinal bigint, message_ordinal bigint, knowledge_type string, entity {ENTITY}, action {ACTION}, topic {TOPIC}, knowledge_json string"
)
POSTINGS = "conv_id bigint, term string, semantic_ref_ordinal bigint, score double"
RELATIONS = "term string, related string, relation string, rank int"
CHUNKS = "chunk_pos bigint, id string, text string, metadata map<string,string>, embedding array<double>"

#: The document that an index is exported to and loaded from.
EXPORT = (
    "indexData struct<items:array<struct<term:string,semanticRefOrdinals:array<struct<semanticRefOrdinal:bigint,score:double>>>>>,"
    "semanticRefs array<struct<semanticRefOrdinal:bigint,messageOrdinal:bigint,knowledgeType:string,knowledge:string>>,"
    "messages array<struct<ordinal:bigint,content:string,timestamp:string>>,"
    "stats struct<termCount:bigint,refCount:bigint,messageCount:bigint>"
)
KNOWLEDGE_TYPES = ("entity", "action", "topic")
