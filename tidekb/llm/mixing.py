"""Mixing sources to target weights by minimum-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to (their pattern). A flow network routes words from
patterns to source quotas; each repetition of a pattern's words costs more than the one before, so that the costs are
convex and repetitions are used only where quotas can't be met otherwise. Only the network, one node per pattern and
source, is solved on the driver; documents are then selected in seeded hash order by Spark.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekb.llm.common import BLANKS, located, numbered, query, stored, table

HASH_BITS = 60


def word_count(text: str | Column) -> Column:
    """Number of blank-separated words; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def water_fill(sizes: dict, weights: dict, repeats: int) -> dict:
    """Share the sum of all sizes by weight; nobody gets more than ``repeats`` times its size, the excess is reshared.

    >>> water_fill({"a": 90, "b": 10}, {"a": 1, "b": 3}, 3)
    {'a': 70.0, 'b': 30.0}
    """
    rest, open_, out = sum(sizes.values()), dict(weights), {}
    while True:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if rest * w > repeats * sizes[s] * total]
        if not over:
            return {s: out[s] if s in out else rest * open_[s] / total for s in sizes}
        for s in over:
            del open_[s]
            out[s] = float(repeats * sizes[s])
            rest -= repeats * sizes[s]


def cheapest_flow(supply: list[int], links: list[list[int]], quotas: list[int], repeats: int) -> list[int]:
    """Words to take from each pattern so that as much quota as possible is met at the least repetition cost.

    ``links[p]`` lists the sources that pattern ``p`` may serve. The k-th repetition of a pattern's words costs k a
    word. Successive shortest paths with queue-based relaxation; each path saturates an arc or a quota.
    """
    n_p, n_s = len(supply), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    arcs: list[list[int]] = []  # to, capacity left, cost
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, cap, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for p, words in enumerate(supply):
        for k in range(repeats):
            arc(start, p, words, k)
        for s in links[p]:
            arc(p, n_p + s, repeats * words, 0)
    for s, q in enumerate(quotas):
        arc(n_p + s, end, q, 0)
    while True:
        dist, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for i in out[a]:
                b, cap, cost = arcs[i]
                if cap > 0 and dist[a] + cost < dist.get(b, math.inf):
                    dist[b], via[b] = dist[a] + cost, i
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if end not in dist:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push
    return [sum(arcs[i ^ 1][1] for i in out[start] if arcs[i][0] == p) for p in range(n_p)]


def cycling_weights(sources: list) -> dict:
    """Weights 1, 2, 3, 1, ... of the sources in code point order, null last."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


@dataclass
class Plan:
    """What to take of each pattern. ``rows``: one row per pattern, at most ``max_patterns``; ``edge``: the rows in the
    buckets in which flows end, with all columns of the planned table and ``_more``: whether they are taken once more."""

    rows: DataFrame
    edge: DataFrame
    key: str
    members: Column
    seed: int

    def placed(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the plan of their pattern, ``_inside`` (the row is in ``edge``) and ``_more`` of the others."""
        dealt = _dealt(docs, self.members, self.key, self.seed).join(F.broadcast(self.rows), F.col("_pattern").eqNullSafe(F.col("_p")))
        bucket = F.expr("_h div width")
        inside = (bucket == F.col("edge_bucket")) & (F.col("rest") > 0)
        return dealt.withColumn("_inside", inside).withColumn("_more", (F.col("rest") > 0) & (bucket < F.col("edge_bucket")))


def _dealt(docs: DataFrame, members: Column, key: str, seed: int) -> DataFrame:
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), text_key)), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.withColumn("_pattern", F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})).withColumn("_h", digest)


def plan_mix(docs: DataFrame, members: Column, size: str, key: str, weights=cycling_weights, repeats: int = 3, seed: int = 7,
             max_patterns: int = 5_000, bucket_rows: int = 4_096) -> Plan:
    """The plan for ``docs``, whose columns must not begin with ``_`` or be named like those of the plan (see ``numbered``).

    Patterns are summed by Spark, flows found on the driver (one node per pattern and source); rows of a pattern are dealt
    by hash into buckets of about ``bucket_rows`` rows, and only the bucket in which the flow ends is ordered row by row.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_members", members)
    dealt = _dealt(docs, F.col("_members"), key, seed)
    per_pattern = dealt.groupBy("_pattern").agg(F.sum(size).alias("words"), F.count("*").alias("n"), F.first("_members").alias("m")).limit(max_patterns + 1).collect()
    if len(per_pattern) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    rows = sorted(per_pattern, key=lambda r: r["_pattern"] or "")
    sizes: dict = {}
    for r in rows:
        for s in set(r["m"] or ()):
            sizes[s] = sizes.get(s, 0) + r["words"]
    total = sum(r["words"] for r in rows if r["m"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    scale = total / max(1, sum(sizes.values()))  # overlapping sources count a document once each; shares are of all words
    targets = {s: t * scale if scale != 1 else t for s, t in water_fill(sizes, weights(names), repeats).items()} if names else {}
    place = {s: i for i, s in enumerate(names)}
    links = [sorted({place[s] for s in r["m"] or ()}) for r in rows]
    flows = cheapest_flow([r["words"] for r in rows], links, [math.floor(targets[s] + 0.5) for s in names], repeats)
    plan = []
    for r, f in zip(rows, flows):
        words, own = max(1, r["words"]), set(r["m"] or ())
        width = (1 << HASH_BITS) // math.ceil(r["n"] / bucket_rows) + 1
        plan.append((r["_pattern"], r["words"], f // words, f % words, width, float(sum(targets[s] for s in own)), int(sum(sizes[s] for s in own))))
    schema = "_p string, pattern_size long, times long, rest long, width long, target_sum double, source_sum long"
    first = spark.createDataFrame(plan, schema)
    buckets = dealt.join(F.broadcast(first), F.col("_pattern").eqNullSafe(F.col("_p"))).filter("rest > 0")
    buckets = buckets.groupBy("_p", F.expr("_h div width").alias("_bucket")).agg(F.sum(size).alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("_p").orderBy("_bucket"))
    edge = buckets.withColumn("upto", running).filter("upto >= rest and upto - words < rest and words > 0")
    edges = edge.groupBy("_p").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge")).collect()  # one row a pattern
    where = {r["_p"]: (r["edge"]["_bucket"], r["edge"]["before"]) for r in edges}
    full = Plan(spark.createDataFrame([(*p, *where.get(p[0], (-1, 0))) for p in plan], schema + ", edge_bucket long, before long"), first, key, F.col("_members"), seed)
    order = Window.partitionBy("_pattern").orderBy("_h", F.col(key), F.col(size)).rowsBetween(Window.unboundedPreceding, 0)
    more = F.col("before") + F.sum(size).over(order) - F.col(size) / 2.0 <= F.col("rest")
    inside = full.placed(docs).filter("_inside").withColumn("_more", more)
    return Plan(full.rows, inside.drop("_inside", "_members"), key, members, seed)


MIXED = ["taken", "pattern_size", "target_sum", "source_sum"]


def mix_to_targets(docs: DataFrame, members: str, size: str = "size", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``taken``, ``pattern_size``, ``target_sum`` and ``source_sum``: the words that the mix takes from each
    document, repeats counted, and the sums of its pattern's words, its sources' targets and its sources' words.

    members: array column of the sources a document belongs to (null is a source of its own name; an empty array serves
    none, so nothing is taken). A document is taken a whole number of times, at most ``repeats``. All documents of a
    pattern are taken equally often, but for a seeded choice that is taken once more to meet the pattern's flow to within
    half a document. Documents with null or repeated keys are ordered by hash, key and size; equal rows are
    interchangeable. An empty table gives no rows. ``max_patterns`` bounds what reaches the driver (one row a pattern) and
    is an error when passed, never a cut. Columns named like the new ones are replaced, others pass through whatever their
    names. options: those of ``plan_mix``.
    """
    docs = docs.drop(*MIXED)
    plain, names = numbered(docs)
    plan = plan_mix(plain, F.col(names[members]), names[size], names[key], **options)
    taken = (F.col(names[size]) * (F.col("times") + F.col("_more").cast("long"))).alias("taken")
    out = [*names.values(), taken, *MIXED[1:]]
    both = plan.placed(plain).filter(~F.col("_inside")).select(*out).unionByName(plan.edge.select(*out))
    return both.toDF(*docs.columns, *MIXED)


def repeat_to_targets(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: rows without words and those not chosen go; all columns stay.

    Words are counted once, on thin rows that carry their place in the Parquet files; texts are read again only to be
    written out, with the plan (a row a pattern) and the choice in the edge buckets (at most ``bucket_rows`` or so rows a
    pattern) joined to them, and are never sorted or shuffled.
    """
    plain, names = numbered(docs)
    at = located(plain)
    thin = stored(at.select("at_file", "at_row", F.col(names[key]).alias("key"), F.col(names[source]).alias("source"), word_count(names[text]).alias("size")), "sizes")
    plan = plan_mix(thin, F.array("source"), "size", "key", **options)
    # stored, so that Spark knows its size before it plans the join with the texts
    edge = stored(plan.edge.select("at_file", "at_row", F.col("_more").alias("chosen")), "edge")
    own = Plan(plan.rows, plan.edge, names[key], F.array(names[source]), plan.seed)
    times = F.col("times") + F.coalesce(F.col("chosen"), F.col("_more")).cast("long")
    times = F.when(F.col(names[text]).rlike(f"[^{BLANKS}]"), times).otherwise(0).cast("int")
    placed = own.placed(at).join(edge, ["at_file", "at_row"], "left").withColumn("_times", times).filter("_times > 0")
    return placed.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*names.values()).toDF(*docs.columns)


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size`` and ``members``, an array of its one source."""
    return docs.withColumn("size", word_count(text)).withColumn("members", F.array(source))


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+'))::BIGINT AS size,
                  ('0x' || md5('7|' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER b, 0) AS capped, sum(w) OVER a AS open_w, sum(source_size) OVER () AS total FROM s
      WINDOW b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             a AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT total - capped AS rest, open_w FROM o WHERE (total - capped) * w <= 3 * source_size * open_w ORDER BY capped LIMIT 1),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (f.rest * w)::DOUBLE / f.open_w) AS target FROM o, f),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS flow FROM t),
c AS (SELECT doc_id, size, source_size, target, flow, flow % greatest(1, source_size) AS rest, flow // greatest(1, source_size) AS times,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@query("op5_mixing", SQL)
def op5_mixing(spark, sf):
    thin = stored(table(spark, sf, "documents").select("doc_id", "text", "source").transform(sized).select("doc_id", "size", "source", "members"), "sizes")
    out = mix_to_targets(thin, "members")
    return out.select("doc_id", "size", F.col("source_sum").alias("source_size"), F.col("target_sum").alias("target"), "taken")
