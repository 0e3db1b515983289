"""Decontamination where the benchmark is too large to be sent to every executor: by shuffles, behind a bitmap of its hashes."""

from __future__ import annotations

import random

from palaver.llm import decontaminate

WORDS = [a + b for a in "ka lo mi ne pu ra si to ve wu".split() for b in "ban der fil gom hus jin kel lor mat nos".split()]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [prose(n) for n in (30, 20, 14, 13, 9, 5, 2)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id bigint, text string")
    rows = []
    for k in range(60):
        words = prose(rng.randint(0, 120))
        if k % 3 == 0:
            planted = list(rng.choice(items))
            if len(planted) >= 13:
                planted[rng.randrange(len(planted))] = "other"
            words[5:5] = planted
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame([*rows, (100, None), (None, rows[0][1])], "doc_id bigint, text string").repartition(3)
    want = sorted(map(str, decontaminate.overlaps(docs, benchmark).collect()))
    assert len(want) >= 20
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontaminate, "FILTER_WORDS", 64)
    assert sorted(map(str, decontaminate.overlaps(docs, benchmark).collect())) == want


def test_clean_judges_rows_whatever_their_id(spark):
    item = "quark lepton boson hadron meson photon gluon graviton neutrino electron muon tauon axion proton"
    docs = spark.createDataFrame([(None, f"so {item} it", 1), (1, "plain words", 2), (1, f"here {item}", 3), (1, None, 4), (None, "other", 5)], "doc_id bigint, text string, key int")
    left = decontaminate.clean(docs, spark.createDataFrame([(0, item)], "item_id bigint, text string"))
    assert left.columns == docs.columns and sorted(r["key"] for r in left.collect()) == [2, 4, 5]
