"""URL filters with link-graph propagation.

Rules name a host and a path; a rule fits its host and all subdomains where the url's path starts with the
rule's path, and the longest rule wins. Where none fits, the host decides: personalised PageRank from
hosts with allowed pages along links gives trust, and from hosts with blocked pages against the links
gives distrust; a host whose distrust is above ``THRESHOLD`` times its trust is blocked, at equality it isn't. A host that
neither reaches is allowed.

Edges are counted per pair of hosts before anything else, so a page's links never travel. Links of a host to itself are
no edges, and neither are those in comments, scripts and styles. Both ranks are moved in one table: in each step they are
joined to the edges and summed per target with a combine before the shuffle; ``STEPS`` of them end in a written table. It goes on until ranks
rest: what moves shrinks by the damping in each step, so the number of steps is bounded. Rank that reaches a host without
links goes back to the seeds, which is the same as scaling the ranks to a sum of one in the end.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed. Null html has no links.
Pages with equal ids or urls are judged each; their links count each. Columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import fresh, stage

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Rank, of a sum of one, that may still move in a step when it ends.
MOVED = 1e-8
#: Steps between two written tables.
STEPS = 3
THRESHOLD = 1.0


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, _fold(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


#: What is read over: comments, scripts and styles, up to the end of the page where they aren't closed.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"


def edges(pages: DataFrame) -> DataFrame:
    """(a, b, n): links from host a to another host b, absolute and protocol-relative."""
    seen = F.regexp_replace("html", HIDDEN, " ")
    found = pages.select("host", F.explode(F.regexp_extract_all(seen, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]*)"""), F.lit(1))).alias("href"))
    plain = F.replace("href", F.lit("&#47;"), F.lit("/"))
    full = F.when(F.startswith(plain, F.lit("//")), F.concat(F.lit("http:"), plain)).otherwise(plain)
    to = F.when(full.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), host(full)).otherwise("")
    return found.select(F.col("host").alias("a"), to.alias("b")).where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, moved: float = MOVED) -> DataFrame:
    """(kind, host, rank): for each ``kind`` of ``seeds`` (kind, host, w summing to one) the personalised PageRank along ``links`` (kind, a, b, n)."""
    out = stage(links.groupBy("kind", "a").agg(F.sum("n").alias("all")))
    share = stage(links.join(out, ["kind", "a"]).select("kind", F.col("a").alias("host"), "b", (F.col("n") / F.col("all") * damping).alias("share")))
    back = stage(seeds.select("kind", "host", (F.col("w") * (1.0 - damping)).alias("rank")))
    rank, zero = seeds.select("kind", "host", F.col("w").alias("rank")), F.lit(0.0)
    while True:
        for k in range(STEPS):
            flow = rank.join(share, ["kind", "host"]).select("kind", F.col("b").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            rows = flow.unionByName(back)
            if k < STEPS - 1:
                rank = rows.groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
                continue
            rows = rows.withColumn("old", zero).unionByName(rank.select("kind", "host", zero.alias("rank"), F.col("rank").alias("old")))
            after = stage(rows.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        change = after.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), zero).alias("x")).collect()[0]["x"]  # one number
        rank = after.select("kind", "host", "rank")
        if change < moved:
            break
    whole = rank.groupBy("kind").agg(F.sum("rank").alias("sum"))
    return rank.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("rank") / F.col("sum")).alias("rank"))  # a row a kind


def pagerank(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, moved: float = MOVED) -> DataFrame:
    """(host, rank) from ``seeds`` (host, w summing to 1) along ``links`` (a, b, n)."""
    kind = F.lit("one").alias("kind")
    return propagate(links.select(kind, "*"), seeds.select(kind, "*"), damping, moved).select("host", "rank")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``pages`` (url, html) with host, path, rule, verdict; columns of these names are replaced."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    seen = pages.select(*own, F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.coalesce(path(F.col("url")), F.lit("")).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    ruled, blocked = fresh(seen.withColumns({"rule": F.lit(0), "verdict": F.lit(0)}), "ruled", "blocked")
    seen = seen.select("*", name.alias("rule"), verdict.alias(ruled))
    links = stage(edges(seen.select("host", "html")))
    seeds = stage(seen.where(F.col(ruled).isNotNull()).groupBy("host").agg(F.count_if(F.col(ruled) == "allow").alias("good"), F.count_if(F.col(ruled) == "block").alias("bad")))
    sums = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).collect()[0]
    part = lambda c: seeds.where(F.col(c) > 0).select(F.lit(c).alias("kind"), "host", (F.col(c) / max(sums[c], 1)).alias("w"))
    ways = links.select(F.lit("good").alias("kind"), "a", "b", "n").unionByName(links.select(F.lit("bad").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    rank = propagate(ways, part("good").unionByName(part("bad")))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    bad = stage(rank.groupBy("host").agg(of("good"), of("bad")).where(F.col("bad") > threshold * F.col("good")).select("host"))
    marked = seen.join(bad.withColumn(blocked, F.lit(True)), "host", "left")
    last = F.coalesce(ruled, F.when(F.col(blocked), "block").otherwise("allow"))
    return marked.select(*own, "host", "path", "rule", last.alias("verdict"))


def op4_link_graph(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
