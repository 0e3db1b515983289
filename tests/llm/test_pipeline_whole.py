"""What the pipeline's stages must do in full, against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from palaver.llm import suffix_dedup

WORDS = [a + b for a in "ka lo mi ne pu ra si to ve wu".split() for b in "ban der fil gom hus jin kel lor mat nos".split()]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).repartition(3)


def jaccard(a, b, size=5):
    a, b = ({tuple(x.lower().split()[i : i + size]) for i in range(len(x.split()) - size + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


def edited(rng, words, low):
    """A copy with as many words replaced as leave a similarity of ``low`` or more."""
    new, best = list(words), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        new[at] = "edited"
        if jaccard(" ".join(words), " ".join(new)) < low:
            return best
        best = list(new)
    return best


def test_near_copies_reach_similarity(spark):
    rng = random.Random(31)
    rows, below = [], []
    for k in range(60):
        words = prose(rng, rng.randint(60, 400))
        rows += [(k, " ".join(words)), (1000 + k, " ".join(edited(rng, words, 0.80 + 0.0025 * k)))]
    for k in range(20):
        words = prose(rng, 200)
        assert jaccard(" ".join(words), " ".join(edited(random.Random(k), words, 0.6))) < 0.79
        rows += [(100 + k, " ".join(words)), (2000 + k, " ".join(edited(random.Random(k), words, 0.6)))]
        below += [100 + k, 2000 + k]
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()]
    assert sorted(kept) == sorted([*range(60), *below])


def test_repeats_of_51_words_go(spark):
    rng = random.Random(32)
    rows, want = [], {}
    for k in range(10):
        passage, alone = prose(rng, 51 + k), prose(rng, 50)
        for n in (k, 100 + k):
            before, after = [*prose(rng, 40), f"left{n}"], [f"right{n}", *prose(rng, 40)]  # no chance words in common beside the passage
            rows.append((n, " ".join([*before, *passage, *after])))
            want[n] = f"{' '.join(before)}  {' '.join(after)}"
        for n in (200 + k, 300 + k):
            rows.append((n, " ".join([*prose(rng, 40), f"left{n}", *alone, f"right{n}", *prose(rng, 40)])))
            want[n] = rows[-1][1]
    rows += [(400, None), (401, ""), (402, "x" * 450), (403, "y " + "x" * 450)]
    want |= {400: None, 401: "", 402: "", 403: "y "}
    assert all(len(" ".join(prose(rng, 60))) < 400 for _ in range(20))
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, table(spark, rows), "").collect()}
    assert got == want


def test_op8_text_is_without_short_passages_of_51_words(spark, tmp_path):
    """A repeated passage of 60 words and under 400 bytes leaves ``text``; what the contract counts in bytes stays."""
    rng = random.Random(33)
    passage, long = prose(rng, 60), prose(rng, 90)
    texts = [" ".join([*prose(rng, 30), f"a{k}", *passage, f"b{k}", *prose(rng, 30)]) for k in range(2)]
    texts += [" ".join([f"c{k}", *passage, f"d{k}", *long, f"e{k}"]) for k in range(2)] + [" ".join(prose(rng, 100))]
    assert len(" ".join(passage)) < 390 < 400 < len(" ".join(long))
    table(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    want = suffix_dedup.brute_force([t.encode() for t in texts])
    for k, text in enumerate(texts):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == want[k]
        assert (" ".join(passage) in got[k].text) is False
        assert (got[k].text == text) is (k == 4)
    assert got[0].n_removed == 0 < got[2].n_removed
