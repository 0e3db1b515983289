"""SQL for DuckDB of those corpus queries that SQL can express."""

from __future__ import annotations

from palaver.llm.decontaminate import NEEDED, WINDOW
from palaver.llm.quality_rules import RULES, STOP_WORDS

_BLANK = r"[\x20\x09-\x0D]"
_STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def _kept() -> str:
    """The rule table as one condition."""
    parts = []
    for r in RULES:
        inside = " AND ".join([*([f"{r.measure} >= {r.low}"] if r.low != float("-inf") else []), *([f"{r.measure} <= {r.high}"] if r.high != float("inf") else [])])
        parts.append(f"(n_words < {r.from_words} OR ({inside}))")
    return " AND ".join(parts)


OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_BLANK}', '', 'g')) > 0) AS lines FROM d),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM s)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) x(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^!]', '', 'g')) AS shouts, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS uppers, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters,
  len(list_filter(words, lambda x: lower(x) IN {_STOPS})) AS stops FROM s),
q AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(shouts / nullif(n_words, 0), 0) AS shouts_per_word,
  coalesce(uppers / nullif(letters, 0), 0) AS upper_share, coalesce(letters / nullif(word_chars, 0), 0) AS letter_share, coalesce(stops / nullif(n_words, 0), 0) AS stop_share,
  coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share FROM m LEFT JOIN c ON c.doc_id = m.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_kept()} AS kept FROM f
"""

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
OP3 = rf"""
WITH d AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS} AS words FROM documents)),
b AS (SELECT item_id, n, least(n, {WINDOW}) AS wide, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS ipos FROM (SELECT item_id, words, len(words) AS n FROM (SELECT item_id, {_TOKENS} AS words FROM benchmark))),
e AS (SELECT doc_id, item_id, n, wide, pos - ipos AS shift, ipos FROM d JOIN b USING (w)),
c AS (SELECT doc_id, item_id, n, wide, shift, list(ipos) AS met FROM e GROUP BY ALL HAVING count(*) >= CASE WHEN wide < {WINDOW} THEN wide ELSE {NEEDED} END),
v AS (SELECT *, unnest(range(0, n - wide + 1)) AS s FROM c),
a AS (SELECT doc_id, item_id, wide, shift + s AS place, len(list_filter(met, lambda k: k >= s AND k < s + wide)) AS agree FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, place) AS r FROM a WHERE agree >= CASE WHEN wide < {WINDOW} THEN wide ELSE {NEEDED} END)
SELECT doc_id, item_id, place::BIGINT AS "begin", wide::BIGINT AS length, agree::BIGINT AS agree FROM k WHERE r = 1
"""

ORACLE = {"op3_decontaminate": OP3, "op9_quality_rules": OP9}
