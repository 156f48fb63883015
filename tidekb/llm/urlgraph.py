"""URL filter: rules by host and path, and trust and distrust that spread over the links between hosts.

Trust starts at the hosts whose pages a rule allows and follows links; distrust starts at the hosts whose pages a rule
blocks and follows links backwards, to those who link there. Both are personalised PageRank by power iteration, done
in one table: (kind, host, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import query, stored, table
from tidekb.session import cut_lineage

#: Fixed values of the contract: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
DAMPING, ROUNDS, RATIO = 0.85, 12, 1.0


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Rules are a parameter of a few entries."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another host. Relative links and links to the own host are no edges."""
    links = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), 1)).alias("link"))
    dst = url_host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select("src", dst.alias("dst")).filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread_trust(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, cut_every: int = 4) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` power iterations.

    edges: (src, dst, n); seeds: (kind, host, n) with kind ``trust`` or ``distrust``; each kind's seeds share a mass of
    one in proportion to n. The score of a host without links onward is not passed on. Hosts that nothing reaches are
    absent. Partial sums precede each shuffle, so that a host with very many links is no burden to one task.
    """
    arcs = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = arcs.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    arcs = stored(arcs.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")), "arcs")
    mass = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    start = stored(seeds.join(mass, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("score")), "seeds")
    restart = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    now = start
    for i in range(0 if arcs.isEmpty() else rounds):
        moved = arcs.join(now.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("w") * F.col("score") * damping).alias("score"))
        now = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            now = cut_lineage(now)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, ratio: float = RATIO) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, with the host's trust and distrust.

    A url that a rule fits gets its verdict. Any other is blocked if its host's distrust is more than ``ratio`` times
    its trust, and else allowed; so are hosts that no link reaches. A url that is null or has no ``://`` has an empty
    host and path and is allowed. Null html has no links. Rows are judged one by one, so repeated rows give repeated results.
    """
    base = pages.select(key, html, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("best.verdict") == "allow", "trust").otherwise("distrust")
    seeds = base.filter("best is not null and host != ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    scores = stored(spread_trust(host_edges(base, "host", html), seeds), "trust")
    own = base.drop(html).join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") > F.lit(ratio) * F.col("trust"), F.lit(False))
    return own.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def _sql() -> str:
    up = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS html, {up.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
j AS (SELECT *, CASE {case} END AS best FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS link FROM p),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {up.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM l) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
a AS (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS w FROM (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e)),
s AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM (SELECT CASE WHEN best.verdict = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE best IS NOT NULL AND host <> '' GROUP BY ALL)),
x AS (SELECT kind, a, b, w * {DAMPING} AS w FROM a UNION ALL SELECT kind, '*', host, score * {1 - DAMPING} FROM s UNION ALL SELECT DISTINCT kind, '*', '*', 1.0::DOUBLE FROM s),
r AS (SELECT 0 AS i, kind, host, score FROM s UNION ALL SELECT DISTINCT 0, kind, '*', 1.0::DOUBLE FROM s
      UNION ALL SELECT r.i + 1, x.kind, x.b, sum(x.w * r.score) FROM r JOIN x ON r.kind = x.kind AND r.host = x.a WHERE r.i < (SELECT CASE WHEN count(*) > 0 THEN {ROUNDS} ELSE 0 END FROM a) GROUP BY r.i, x.kind, x.b),
t AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM r WHERE i = (SELECT max(i) FROM r) GROUP BY host)
SELECT page_id, j.host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN t.distrust > {RATIO} * t.trust THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN t ON j.host = t.host
"""


@query("op2_url_filter", _sql())
def op2_url_filter(spark, sf):
    return judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")
