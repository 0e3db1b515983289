"""The registered queries over whole small tables, against plain computations of what each has to return."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest

from palaver.llm import html_text, link_graph, oracle, packing, queries, suffix_dedup
from tests.llm.test_corpus_operators import dense_rank, groups, naive_simhash

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{D}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM '{D}/pages.parquet'").fetchall()


def run(spark, name, schema):
    df = queries.QUERIES[name](spark, D)
    assert schema.items() <= dict(df.dtypes).items()
    return df.collect()


def test_cotraining(spark, docs):
    got = run(spark, "op1_cotraining", {"doc_id": "bigint", "score": "double", "kept": "boolean"})
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in docs)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)


def test_simhash(spark, docs):
    got = run(spark, "op2_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    fp = {i: naive_simhash(t) for i, t, _ in docs}
    root = groups(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least: dict[int, int] = {}
    for i, f in fp.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", least[root[f]]) for i, f in fp.items())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(oracle.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, D).toPandas()[list(want.columns)]
    plain = lambda pdf: sorted(map(str, pdf.itertuples(index=False, name=None)))
    assert plain(got.astype(object)) == plain(want.astype(object))


def test_link_graph(spark, pages):
    got = {r.page_id: r for r in run(spark, "op4_link_graph", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})}
    assert len(got) == len(pages)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url[url.index("://") + 3 :]
        host = re.split("[/?#]", rest)[0]
        return low(host), re.split("[?#]", rest[len(host) :])[0]

    def ruled(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in link_graph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    links, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for _, url, html in pages:
        host, path = parts(url)
        seen = re.sub(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", " ", html or "")
        for href in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]*)""", seen):
            to = parts("http:" + href if href.startswith("//") else href)[0]
            if host and to and host != to:
                links[host, to] += 1
        if v := ruled(host, path)[1]:
            seeds[v][host] += 1
    names = sorted({h for x in links for h in x} | set(seeds["allow"]) | set(seeds["block"]))
    seed = lambda v: [seeds[v][n] / max(1, sum(seeds[v].values())) for n in names]
    ways = [(a, b, n) for (a, b), n in links.items()]
    trust = dense_rank(ways, seed("allow"), names)
    distrust = dense_rank([(b, a, n) for a, b, n in ways], seed("block"), names)
    for i, url, _ in pages:
        host, path = parts(url)
        name, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        k = names.index(host) if host in names else None
        if verdict is None and k is not None and abs(distrust[k] - trust[k]) > 1e-6:
            verdict = "block" if distrust[k] > trust[k] else "allow"
        assert verdict in (None, got[i].verdict)


def test_sharding(spark, docs):
    schema = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = run(spark, "op5_sharding", schema)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, size = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even, longest = sum(size.values()) / 40, max(r["size"] for r in got)
    ends = np.cumsum([size[k] for k in range(40)])
    assert all(abs(ends[k] - even * (k + 1)) <= longest for k in range(40))  # each boundary as near as a whole row lets it be


def test_language_id(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op6_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})}
    assert len(got) == len(docs)
    learned = {lang for i, _, lang in docs if lang and zlib.crc32(str(i).encode()) % 4 != 2}
    right = []
    for i, text, lang in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].lang_pred in learned if any(map(str.isalpha, text or "")) else got[i].lang_pred == "und"
        if got[i].held_out and lang and got[i].lang_pred != "und":
            right.append(got[i].lang_pred == lang)
    assert np.mean(right) > 0.9


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    schema = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got = run(spark, "op7_packing", schema)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, text, _ in docs}
    met, sequences = {i: np.zeros(len(x), int) for i, x in ids.items()}, defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        met[r.doc_id][r.start : r.start + r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all((x == 1).all() for x in met.values())
    for pieces in sequences.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= 2048
    assert len(sequences) <= 1.05 * sum(map(len, ids.values())) / 2048 + 2


def test_ids_are_the_tokenizers_over_all_documents():
    slow = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), None)
    fast = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall():
        assert slow(text) == fast(text)
    assert fast(" " * 300_000 + "x") == slow(" " * 300_000 + "x")


def test_suffix_dedup(spark, docs):
    schema = {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "text": "string"}
    got = {r.doc_id: r for r in run(spark, "op8_suffix_dedup", schema)}
    want = suffix_dedup.brute_force([(t or "").encode() for _, t, _ in docs])
    for (i, _, _), w in zip(docs, want, strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w
        assert len(got[i].text.encode()) <= w[0] - w[1]


class Article(HTMLParser):
    """The headings and paragraphs of the article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if self.inside and tag in ("h1", "p"):
            self.blocks.append("")
        if self.blocks and tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and self.blocks:
            self.blocks[-1] += data


def test_html_text(spark, pages):
    got = {r.page_id: r for r in run(spark, "op10_html_text", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})}
    assert len(got) == len(pages)
    for i, url, html in pages:
        reader = Article()
        reader.feed(html or "")
        reader.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))
    assert html_text.extract(None) == ""
