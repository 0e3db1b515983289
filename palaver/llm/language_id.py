"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece; the
probability of a word is the sum over all its segmentations into pieces, by the forward algorithm, and a text's
score is the product over its words. The probabilities are fitted by expectation
maximisation (forward and backward sums) on at most about ``TRAIN_DOCS`` labelled documents, taken by a hash of the id.
The model has one number per piece and language, whatever the corpus; every whole text is scored in one scan, without a shuffle.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no row has a language to
learn from. Ties between languages go to the first in the alphabet. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import text_batches

#: Labelled documents that a fit takes, about: the bounded sample.
TRAIN_DOCS = 6000
EM_ROUNDS = 3
#: Longer words are summed one by one, in the fit in logarithms; shorter ones together by length.
LONG = 24
#: Probability of a character that the vocabulary lacks, for any language.
UNKNOWN = 1e-8
#: Word scores that a task keeps.
KEPT_WORDS = 1_000_000
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary: an index for each piece, then one for unknown characters and one for strings that are no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        names = [x for x in dict.fromkeys(names) if x.lower() == x and (LETTERS.fullmatch(x.lstrip("▁")) or x == "▁")]
        self.index = {x: i for i, x in enumerate(names)}
        self.unknown, self.none = len(names), len(names) + 1
        self.longest = max(map(len, names))

    def spans(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: the index of each substring, by begin and end; absent where none of them is a piece."""
        n, get, out = len(words[0]), self.index.get, {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                miss = self.unknown if j == i + 1 else self.none
                at = [get(w[i:j], miss) for w in words]
                if j == i + 1 or any(a != miss for a in at):
                    out[i, j] = np.array(at)
        return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups


def forward(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word (marked as begun) under each language: rows of words, columns of languages."""
    out = np.empty((len(words), table.shape[1]))
    for n, at in by_length(words).items():
        if n > LONG:
            for k in at:
                out[k] = _forward_long(words[k], pieces, table)
            continue
        for k0 in range(0, len(at), 20_000):
            some = at[k0 : k0 + 20_000]
            sums = np.zeros((n + 1, len(some), table.shape[1]))
            sums[0] = 1
            for (i, j), index in sorted(pieces.spans([words[k] for k in some]).items()):
                sums[j] += sums[i] * table[index]
            out[some] = np.log(sums[n])
    return out


def _forward_long(word: str, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """One word of any length, rescaled as it goes."""
    ring = [np.ones(table.shape[1])]  # of the last positions
    scale = np.zeros(table.shape[1])
    for j in range(1, len(word) + 1):
        now = np.zeros(table.shape[1])
        for back in range(1, min(j, pieces.longest) + 1):
            index = pieces.index.get(word[j - back : j], pieces.unknown if back == 1 else pieces.none)
            if index != pieces.none:
                now = now + ring[-back] * table[index]
        ring.append(now)
        ring = ring[-pieces.longest :]
        if j % 8 == 0:
            top = now.copy()
            scale += np.log(top)
            ring = [x / top for x in ring]
    return scale + np.log(ring[-1])


def fit(counts: pd.DataFrame, pieces: Pieces, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and the table of piece probabilities, from rows (lang, word, n)."""
    langs = sorted(counts["lang"].unique())
    size = pieces.none + 1
    table = np.zeros((size, len(langs)))
    for c, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        words, weight = own["word"].tolist(), own["n"].to_numpy(float)
        groups = [(n, pieces.spans([words[k] for k in at]), weight[at]) for n, at in by_length(words).items() if n <= LONG]
        rare = [(w, x) for w, x in zip(words, weight, strict=True) if len(w) > LONG]
        p = np.full(size, 1.0 / size)
        for _ in range(rounds):
            p[pieces.unknown], p[pieces.none] = UNKNOWN, 0
            seen = np.zeros(size)
            for n, spans, w in groups:
                order = sorted(spans)
                ahead, behind = np.zeros((n + 1, len(w))), np.zeros((n + 1, len(w)))
                ahead[0] = behind[n] = 1
                for i, j in order:
                    ahead[j] += ahead[i] * p[spans[i, j]]
                for i, j in reversed(order):
                    behind[i] += behind[j] * p[spans[i, j]]
                for i, j in order:
                    use = w * ahead[i] * p[spans[i, j]] * behind[j] / ahead[n]
                    seen += np.bincount(spans[i, j], weights=use, minlength=size)
            for w, x in rare:
                index, n = _long_pieces(w, pieces, p)
                seen += np.bincount(index, weights=x * n, minlength=size)
            seen[pieces.unknown] = seen[pieces.none] = 0
            p = (seen + 0.05) / (seen.sum() + 0.05 * size)
        p[pieces.unknown], p[pieces.none] = UNKNOWN, 0
        table[:, c] = p
    return langs, table


def letters(text: str) -> list[str]:
    """The text's runs of letters (Unicode's category L), in lower case, marked as begun."""
    found = []
    for w in LETTERS.findall(text.lower()):
        if w.isalpha():
            found.append("▁" + w)
        else:  # numerals that aren't decimal, such as ½
            found += ["▁" + x for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


def _long_pieces(word: str, pieces: Pieces, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each piece of a word of any length is used, expected over its segmentations: indexes and numbers."""
    n, log = len(word), np.full(pieces.none + 1, -np.inf)
    log[p > 0] = np.log(p[p > 0])
    spans = []
    for i in range(n):
        for j in range(i + 1, min(n, i + pieces.longest) + 1):
            k = pieces.index.get(word[i:j], pieces.unknown if j == i + 1 else pieces.none)
            if k != pieces.none:
                spans.append((i, j, k))
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    for i, j, k in spans:
        ahead[j] = np.logaddexp(ahead[j], ahead[i] + log[k])
    for i, j, k in reversed(spans):
        behind[i] = np.logaddexp(behind[i], behind[j] + log[k])
    index = np.array([k for _, _, k in spans])
    return index, np.exp(np.array([ahead[i] + log[k] + behind[j] for i, j, k in spans]) - ahead[n])


def predict(batches: Iterator[pd.DataFrame], path: str, langs: list[str], table: np.ndarray) -> Iterator[pd.DataFrame]:
    pieces = Pieces(path)
    known: dict[str, int] = {}
    scores = np.empty((0, len(langs)))
    for pdf in batches:
        texts = [letters(t or "") for t in pdf["text"]]
        new = list(set().union(*texts) - known.keys()) if texts else []
        if len(known) + len(new) > KEPT_WORDS:
            known, scores = {}, scores[:0]
            new = list(set().union(*texts))
        if new:
            known.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
            scores = np.concatenate((scores, forward(new, pieces, table)))
        pred, sure = [], []
        for w in texts:
            if not w or not langs:
                pred.append("und")
                sure.append(0.0)
                continue
            total = scores[list(map(known.__getitem__, w))].sum(axis=0)
            best = int(np.argmax(total))
            pred.append(langs[best])
            sure.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        rest = pdf.drop(columns="text")
        yield rest.assign(lang_pred=pred, score=np.array(sure, dtype=float))


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """id, held_out, lang_pred, score for each row. Rows that are held out, or have no language, teach nothing."""
    text_batches(docs.sparkSession)
    label = docs.where(F.col(lang).isNotNull() & ~held_out(id))
    n = label.count()
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col(id)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, train_docs / max(n, 1))))
    word = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))
    counts = label.where(part).select(F.col(lang).alias("lang"), word.alias("word")).where(F.col("word") != "")
    counts = counts.groupBy("lang", F.concat(F.lit("▁"), "word").alias("word")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # words of the sample
    langs, table = fit(counts, Pieces(vocabulary)) if len(counts) else ([], np.zeros((0, 0)))
    own = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), F.col(text).alias("text"))
    schema = f"id {dict(docs.dtypes)[id]}, held_out boolean, lang_pred string, score double"
    return own.mapInPandas(lambda it: predict(it, vocabulary, langs, table), schema).withColumnRenamed("id", id)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
