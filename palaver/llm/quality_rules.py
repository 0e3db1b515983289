"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Spark expression over one row, so the plan is a scan and a projection: no
shuffle, no user functions, cost in proportion to the text. Null text counts as empty. Rows are
judged alone, so ties and repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import SPACE, fresh

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne pas pour qui que sur un une "
    "auch auf aus das dem den der die ein eine er es für ist mit nicht sich sie und von zu "
    "con del el ella ha las lo los más no para por se su al como y o"
).split()

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; a document with fewer words than ``from_words`` is not judged by it."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


#: The thresholds in use. Ratios are per word, per line or per character as the measure says.
RULES = (
    Rule("too_long_words", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", high=0.12),
    Rule("marks", "shouts_per_word", high=0.3),
    Rule("capitals", "upper_share", high=0.5, from_words=20),
    Rule("stop_words", "stop_share", low=0.02, from_words=50),
    Rule("repeated_lines", "dup_line_share", high=0.5),
    Rule("few_letters", "letter_share", low=0.5),
)


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _windows(words: Column) -> Column:
    """The 5-word windows of texts in which some window may repeat, sorted, each with its start; else none.

    Hashes decide only that a text has no repeat at all (equal windows have equal hashes);
    where two hashes meet, the windows themselves are compared.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    sorted_windows = F.array_sort(
        F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("w"), i.alias("i")))
    )
    none = F.array().cast("array<struct<w:string,i:int>>")
    return F.when(F.size(words) < 6, none).when(F.size(F.array_distinct(hashes)) == F.size(words) - 4, none).otherwise(sorted_windows)


def _repeated_words(windows: Column) -> Column:
    """Words inside windows that are found twice or more. ``windows`` is a column, so that looking at neighbours is cheap."""
    same = lambda x, k: F.get(windows, k)["w"].eqNullSafe(x["w"])
    repeated = F.filter(windows, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
    return F.aggregate(
        F.array_sort(F.transform(repeated, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def _once(c: Column) -> Column:
    """``c``, computed once for a row: an expression that isn't deterministic is never copied into what reads it.

    Without it a filter on a verdict moves below the projection and takes the word list along, for each word anew.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def measures(df: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """``df`` with one struct column ``into`` of counts and ratios of the text column."""
    words, lines, windows, counted = fresh(df, "words", "lines", "windows", "counted")
    t = F.coalesce(F.col(text), F.lit(""))
    # columns of their own keep a text from being split once for each measure
    base = df.select(
        *[F.col(c) for c in df.columns],
        _once(F.filter(F.split(t, SPACE), lambda w: w != "")).alias(words),
        _once(F.filter(F.split(t, "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)).alias(lines),
    )
    w, lines = F.col(words), F.col(lines)
    counts = base.withColumn(windows, _once(_windows(w))).select(
        *[F.col(c) for c in df.columns],
        _once(F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeated_words(F.col(windows)).cast("long").alias("n_repeat_words"),
            _count(t, "!").cast("long").alias("n_shouts"),
            F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        )).alias(counted),
    )
    c = F.col(counted)
    per = lambda a, b: F.coalesce(c[a] / F.nullif(c[b], F.lit(0)), F.lit(0.0))
    return counts.select(
        *[F.col(x) for x in df.columns],
        F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            per("word_chars", "n_words").alias("mean_word_chars"),
            per("n_symbols", "n_words").alias("symbols_per_word"),
            per("n_shouts", "n_words").alias("shouts_per_word"),
            per("n_upper", "n_letters").alias("upper_share"),
            per("n_letters", "word_chars").alias("letter_share"),
            per("n_stop", "n_words").alias("stop_share"),
            per("n_dup_lines", "n_lines").alias("dup_line_share"),
        ).alias(into),
    )


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """The names of the rules that a row breaks, as an array column."""
    broken = [
        F.when((m["n_words"] >= r.from_words) & ((m[r.measure] < r.low) | (m[r.measure] > r.high)), F.lit(r.name))
        for r in rules
    ]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, quality: str = "quality") -> DataFrame:
    """All rows and columns of ``df`` and a struct ``quality``: counts, ``base_failed``, ``broken`` (rule names), ``kept``.

    A column of ``df`` that has the struct's name is replaced. Null and empty texts have no words and fail the base rule.
    """
    rest = [c for c in df.columns if c != quality]
    own = df.select(*[F.col(f"`{c}`") for c in rest])
    into, failing, breaking = fresh(own, "m", "failed", "broken")
    seen = measures(own, text, into)
    m = F.col(into)
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    judged = seen.select(*rest, into, failed.alias(failing), compile_rules(rules, m).alias(breaking))
    return judged.select(
        *rest,
        F.struct(
            *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            F.col(failing).alias("base_failed"),
            F.col(breaking).alias("broken"),
            (~F.col(failing) & (F.size(breaking) == 0)).alias("kept"),
        ).alias(quality),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs).select("doc_id", *[q[k].alias(k) for k in names])
