"""Quality classifier by co-training.

Two classifiers look at different sides of a document: its words and their shape, and its metadata (source,
language, length). Both learn from the same labelled sample by logistic regression; then, round by round,
each marks the unlabelled documents it is most sure of and the other learns from those marks as well. What a view
learns from the other's marks is kept only if it then does no worse on labelled documents that it hasn't learnt from (the check fold,
which also calibrates the views); else it takes back the weights it had. The two calibrated views are
combined by a third regression on another fold; the text view alone decides if it does better there.
Every document is scored in one scan over its whole text. If every document has a label the pool is empty and nothing is exchanged.

A document is good if its quality label is 1 and it isn't marked toxic. The fit takes at most about ``LABELLED`` labelled and
``POOL`` unlabelled documents, chosen by a hash of the id; this bound is the only sample.

Null and empty texts have no words and are scored by what that shape means; null metadata is a value of its own.
Without labels of both kinds every score is 0.5 and every document is kept. Repeated rows and ties get equal scores; a text
of any length is read whole. Other columns of the documents are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import text_batches

LABELLED = 6000
POOL = 3000
ROUNDS = 3
#: Confidence from which a mark is handed on, and the share of the pool that a view may mark in a round.
SURE = 0.95
SHARE = 0.2
#: Labelled documents that a word must occur in to count.
RARE = 5
META_BITS = 12
KEEP = 0.5
LETTER = re.compile(r"[^\W\d_]+")


def shape(text: str, words: list[str]) -> list[str]:
    """Marks for a text's shape, in steps."""
    n = max(1, len(words))
    step = lambda x: str(min(9, int(x * 10)))
    letters = sum(map(len, LETTER.findall(text)))
    size = max(1, len(text))
    return [
        f"\x00letters{step(letters / size)}",
        f"\x00upper{step(sum(map(str.isupper, words)) / n)}",
        f"\x00different{step(len(set(words)) / n)}{min(4, n.bit_length() // 3)}",
        f"\x00length{n.bit_length()}",
        f"\x00shout{step(min(1.0, text.count('!') / n))}",
        f"\x00marks{step(min(1.0, sum(map(text.count, '#*$%&|<>')) / n))}",
    ]


def features(text: str | None) -> set[str]:
    """A text's words, without marks around them and in lower case, their first letters, and its shape."""
    text = text or ""
    words = text.split()
    have = {w.strip(".,;:!?\"'()").lower() for w in set(words)}
    have.update({"^" + w[:4] for w in have if len(w) > 4})  # stems: insults are inflected
    have.update(shape(text, words))
    return have


def vocabulary(sets: list[set[str]], least: int = RARE) -> dict[str, int]:
    """A place for each feature that ``least`` documents of the labelled sample have."""
    seen: dict[str, int] = {}
    for s in sets:
        for w in s:
            seen[w] = seen.get(w, 0) + 1
    return {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}


def places(have: set[str], known: dict[str, int]) -> np.ndarray:
    return np.array(sorted(known[w] for w in have if w in known), dtype=np.int64)


def metadata(source, lang, n_chars) -> np.ndarray:
    size = "none" if n_chars is None or n_chars != n_chars else int(n_chars).bit_length()
    found = (f"source {source}", f"lang {lang}", f"size {size}", f"both {source} {lang}", f"lang size {lang} {size}")
    return np.unique([zlib.crc32(x.encode()) & ((1 << META_BITS) - 1) for x in found])


class Logistic:
    """Logistic regression over sparse yes-or-no features: AdaGrad with a penalty that sets rare, useless weights to zero."""

    def __init__(self, size: int, penalty: float):
        self.size, self.penalty = size, penalty
        self.weights, self.bias = np.zeros(size), 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, passes: int = 120, rate: float = 0.5) -> Logistic:
        self.weights, self.bias = np.zeros(self.size), 0.0
        index = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        squares, bias_square, total = np.full(self.size, 1e-8), 1e-8, weight.sum()
        for _ in range(passes):
            score = np.bincount(row, weights=self.weights[index], minlength=len(rows)) + self.bias
            error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / total
            slope = np.bincount(index, weights=error[row], minlength=self.size)
            squares += slope**2
            step = rate / np.sqrt(squares)
            moved = self.weights - step * slope
            self.weights = np.sign(moved) * np.maximum(0, np.abs(moved) - step * self.penalty)
            bias_square += error.sum() ** 2
            self.bias -= rate * error.sum() / np.sqrt(bias_square)
        return self

    def __call__(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows]) + self.bias


def _dense(x: np.ndarray, y: np.ndarray, passes: int = 300, rate: float = 0.3) -> np.ndarray:
    """Weights (the last one is the bias) of a small regression, slightly held towards zero."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, squares = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        slope = (x * (p - y)[:, None]).mean(axis=0) + 1e-4 * w
        squares += slope**2
        w -= rate * slope / np.sqrt(squares)
    return w


def _loss(a: np.ndarray, y: np.ndarray) -> float:
    """Mean logistic loss of scores."""
    return float(np.logaddexp(0, np.where(y > 0.5, -a, a)).mean())


class Model:
    """Both views, their calibrations and the combination."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        self.text, self.meta = Logistic(len(known), 1e-5), Logistic(1 << META_BITS, 1e-4)
        self.calibration = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
        self.combined = np.array([1.0, 0.0, 0.0])
        self.fitted = False

    def fit(self, words: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, fold: np.ndarray, pool_words: list[np.ndarray], pool_meta: list[np.ndarray]) -> Model:
        """``fold``: rows of fold 0 check and calibrate, those of fold 1 combine; the others teach."""
        if not len(y) or y.min() == y.max():
            return self
        both = lambda at: len(np.unique(y[at])) == 2
        learn = np.flatnonzero(fold > 1) if both(fold > 1) else np.arange(len(y))
        check = np.flatnonzero(fold == 0) if both(fold == 0) else learn
        last = np.flatnonzero(fold == 1) if both(fold == 1) else check
        views = [(self.text, words, pool_words), (self.meta, meta, pool_meta)]
        marks: list[dict[int, float]] = [{}, {}]  # what each view has been told
        least, self.taken = [np.inf, np.inf], [0, 0]
        for turn in range(ROUNDS + 1):
            for k, ((view, rows, pool), told) in enumerate(zip(views, marks, strict=True)):
                were = view.weights.copy(), view.bias
                own = [rows[i] for i in learn] + [pool[i] for i in told]
                view.fit(own, np.concatenate((y[learn], list(told.values()))), np.concatenate((np.ones(len(learn)), np.full(len(told), 0.5))))
                raw = view([rows[i] for i in check])
                a = _dense(raw[:, None], y[check])
                if (loss := _loss(a[0] * raw + a[1], y[check])) > least[k]:
                    view.weights, view.bias = were
                else:
                    least[k], self.taken[k] = loss, turn
            if turn == ROUNDS or not pool_words:
                break
            for k, (view, rows, pool) in enumerate(views):
                a = _dense(view([rows[i] for i in check])[:, None], y[check])
                p = 1 / (1 + np.exp(-np.clip(a[0] * view(pool) + a[1], -30, 30)))
                sure = np.maximum(p, 1 - p)
                for i in np.argsort(-sure, kind="stable")[: int(SHARE * len(pool))]:
                    if sure[i] >= SURE:
                        marks[1 - k][int(i)] = float(p[i] > 0.5)
        self.calibration = [_dense(view([rows[i] for i in check])[:, None], y[check]) for view, rows, _ in views]
        raw = [c[0] * view([rows[i] for i in last]) + c[1] for c, (view, rows, _) in zip(self.calibration, views, strict=True)]
        self.combined = _dense(np.stack(raw, axis=1), y[last])
        if _loss(raw[0], y[last]) <= _loss(self.combined[0] * raw[0] + self.combined[1] * raw[1] + self.combined[2], y[last]):
            self.combined = np.array([1.0, 0.0, 0.0])
        self.fitted = True
        return self

    def __call__(self, words: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.fitted:
            return (half := np.full(len(words), 0.5)), half, half
        t, m = (c[0] * view(rows) + c[1] for c, view, rows in zip(self.calibration, (self.text, self.meta), (words, meta), strict=True))
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return logistic(t), logistic(m), logistic(self.combined[0] * t + self.combined[1] * m + self.combined[2])


def _scored(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [places(features(t), model.known) for t in pdf["text"]]
        meta = [metadata(*x) for x in zip(pdf["source"], pdf["lang"], pdf["n_chars"], strict=True)]
        t, m, both = model(text, meta)
        yield pd.DataFrame({"id": pdf["id"], "text_score": t, "meta_score": m, "score": both, "kept": both >= KEEP})


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", labelled: int = LABELLED, pool: int = POOL, text: str = "text") -> DataFrame:
    """id, text_score, meta_score, score and kept for each row of ``docs`` (``text``, source, lang, n_chars; what is absent counts as null)."""
    text_batches(docs.sparkSession)
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")], (F.col("n_chars") if "n_chars" in docs.columns else F.char_length(text)).alias("n_chars"))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    n_known, n_all = known.count(), docs.count()
    place = F.pmod(F.xxhash64(F.lit("co-training"), "id"), F.lit(1 << 30))
    part = lambda n, of: F.lit(int((1 << 30) * min(1.0, n / max(of, 1))))
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")
    sample = known.where(place < part(labelled, n_known)).select("id", good.alias("y"))
    sample = own.where(place < part(labelled, n_known)).join(sample, "id").toPandas()
    ids = known.where(place >= F.lit(1 << 30) - part(pool, n_all)).select("id")
    rest = own.where(place >= F.lit(1 << 30) - part(pool, n_all)).join(ids, "id", "left_anti").toPandas()
    sets = [features(t) for t in sample["text"]]
    known = vocabulary(sets)
    views = lambda pdf, sets: ([places(s, known) for s in sets], [metadata(*x) for x in zip(pdf["source"], pdf["lang"], pdf["n_chars"], strict=True)])
    fold = np.array([zlib.crc32(str(i).encode()) % 8 for i in sample["id"]])
    model = Model(known).fit(*views(sample, sets), sample["y"].to_numpy(float), fold, *views(rest, [features(t) for t in rest["text"]]))
    schema = f"id {dict(docs.dtypes)[id]}, text_score double, meta_score double, score double, kept boolean"
    return own.mapInPandas(lambda it: _scored(it, model), schema).withColumnRenamed("id", id)


def op1_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
