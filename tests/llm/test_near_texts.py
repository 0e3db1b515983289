"""The near-copy stage against components of all pairs."""

from __future__ import annotations

import random

from palaver.llm import near_texts


def shingled(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def least_of_groups(rows: list[tuple[int, str]]) -> list[int]:
    """The smallest id of each component of texts whose shingles agree in four fifths."""
    up = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingled(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= 0.8 * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i, _ in rows})


def chains(seed: int, groups: int, length: int) -> list[tuple[int, str]]:
    """Texts that change by a word from one to the next, so that neighbours are similar and ends are not; ids in random order."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(50, 90))]
        for _ in range(length):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_chains_are_one_group(spark):
    rows = chains(1, 6, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_groups(rows)
    assert 6 <= len(want) < 20
    assert sorted(r.doc_id for r in near_texts.keep_one(df).collect()) == want


def test_bucket_joins_groups_through_a_later_node():
    """A node similar to members of two groups joins them, whichever member it is; a node of a known component asks only others."""
    run = lambda begin: near_texts.np.arange(begin, begin + 100, dtype="uint64")
    bucket = near_texts.Bucket()
    assert bucket.add(1, run(0)) == []
    assert bucket.add(2, run(16)) == []
    assert sorted(bucket.add(3, run(8))) == [(1, 3), (2, 3)]
    assert bucket.add(2, run(8)) == []


def test_large_bucket_loses_no_link(spark):
    """Two chains that only a pair of later nodes joins, in a bucket of many more nodes than one task takes."""
    text = lambda *edits: " ".join(edits[i // 5] if i % 5 == 2 and i // 5 < len(edits) and edits[i // 5] else f"w{i}" for i in range(100))
    apart = [text(*[f"x{k}e{j}" for j in range(6)]) for k in range(40)]  # each differs from all others
    chain = [text(*["a" if i >= j else "" for j in range(1, 13)]) for i in range(13)]  # neighbours share a fifth less
    rows = list(enumerate(apart + chain))
    want = least_of_groups(rows)
    assert want == list(range(41))
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_texts.keep_one(whole, limit=4).collect()) == want
    nodes = spark.createDataFrame([(k, (k,), t) for k, t in rows], "node long, at struct<id: long>, text string")
    texts, none = nodes.select("node", "text"), spark.createDataFrame([], "node long, root long")
    met = near_texts._several(nodes.selectExpr("1L AS bucket", "node", "node AS root", "at"))
    roots, left = near_texts._compared(met, texts, none, 4)
    assert left.count() == len(rows)
    roots = near_texts._rest(left.select("node", "at").distinct(), texts, roots, 4)
    found = {r.node: r.root for r in near_texts._rooted(nodes, roots).collect()}
    assert len({found[k] for k in range(40, 53)}) == 1
    assert len({found[k] for k in range(53)}) == 41
