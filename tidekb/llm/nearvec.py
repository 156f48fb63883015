"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised in double precision, so that a cosine is a Euclidean distance. A table's key is a row of
quantised random projections, floor((a.x + b) / w). The number of projections grows with the logarithm of the number
of vectors, so that chance meetings per bucket stay few; the number of tables follows from the recall wanted for a
pair exactly at the threshold. Pairs that meet are checked by exact cosines inside their bucket. A pair is counted in
the first table in which it meets, and no pairs are written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.llm.cluster import components, lowest, runs, split_pairs
from tidekb.llm.common import query, stored, table
from tidekb.session import ship_package

THRESHOLD, WIDTH, RECALL, SEED = 0.9, 2.5, 0.97, 23
#: Cosine of pairs taken as unrelated when the number of projections is chosen.
UNRELATED = 0.0


def meeting(distance: float, width: float) -> float:
    """Probability that one quantised projection is equal for two points at this distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(tables, projections) for n vectors: about one chance meeting per vector and table, and the recall at the threshold."""
    near, far = meeting(math.sqrt(2 - 2 * threshold), width), meeting(math.sqrt(2 - 2 * UNRELATED), width)
    projections = max(4, math.ceil(math.log(max(2, n)) / -math.log(far)))
    return math.ceil(math.log(1 - recall) / math.log1p(-(near**projections))), projections


class Projections:
    """Keys of all tables for a block of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.shape = (tables, projections)
        self.a = rng.standard_normal((dim, tables * projections)) / width
        self.b = rng.random(tables * projections)
        self.mix = rng.integers(0, 1 << 62, projections, dtype=np.int64) * 2 + 1
        self.dim = dim

    def keys(self, x: np.ndarray) -> np.ndarray:
        codes = np.floor(x @ self.a + self.b).astype(np.int64).reshape(len(x), *self.shape)
        return (codes * self.mix).sum(2) + self.dim


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # against overflow of the squares
    return x / np.sqrt((x * x).sum(1))[:, None]


def vector_links(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL, seed: int = SEED, block_rows: int = 1_000) -> DataFrame:
    """One row per row of ``rows``: key, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null key, link with nothing: no
    links, a component of their own, kept. Vectors of different dimensions don't link. Equal vectors are one class that
    is compared once; a copy counts as a link. Rows that repeat a key are rows like others, and all that carry the
    smallest key of their component are kept. Extra columns are ignored.
    """
    spark = rows.sparkSession
    ship_package(spark)
    single = rows.select(vector).schema[0].dataType.elementType.simpleString() == "float"
    kind, limit = ("<f4", np.float32) if single else ("<f8", np.float64)
    key_kind = rows.select(key).schema[0].dataType.simpleString()
    usable = F.col("k").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).withColumn("usable", usable)

    def pack(batches):
        for b in batches:
            packed = [np.asarray(v.as_py(), limit).tobytes() for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["k", "vec"])

    thin = stored(base.filter("usable").select("k", "v").mapInArrow(pack, f"k {key_kind}, vec binary"), "vectors")
    classes = stored(thin.groupBy("vec").agg(F.min("k").alias("first"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    tables, projections = tables_for(classes.count(), threshold, width, recall)

    def keyed(b, vec: int):
        """(row numbers, keys) by dimension."""
        vectors = b.column(vec).to_pylist()
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for size, at in by.items():
            p = Projections(size // np.dtype(kind).itemsize, tables, projections, width, seed)
            for lo in range(0, len(at), 2000):
                part = at[lo : lo + 2000]
                yield part, p.keys(unit([vectors[i] for i in part], kind))

    def count_keys(batches):
        for b in batches:
            for _, keys in keyed(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), len(keys))), pa.array(keys.reshape(-1))], ["tab", "bucket"])

    def deal(batches):
        for b in batches:
            for part, keys in keyed(b, 2):
                rows_at = np.repeat(np.array(part), tables)
                blocks = np.ones((len(part), tables), np.int64)
                for i, row in enumerate(part):
                    for x in b.column(3)[row].as_py() or ():
                        blocks[i, x["tab"]] = x["blocks"]
                for lo in range(0, len(rows_at), 20_000):
                    at = pa.array(rows_at[lo : lo + 20_000])
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), len(part))[lo : lo + n]), pa.array(keys.reshape(-1)[lo : lo + n]), pa.array(blocks.reshape(-1)[lo : lo + n]), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], ["tab", "bucket", "blocks", "cid", "copies", "vec"])

    def check(batches):
        known: dict[int, Projections] = {}
        for b, starts, ends in runs(batches, 4):
            tab, lo, hi, own, ids, copies, split = (b.column(i).to_numpy() for i in (0, 2, 3, 4, 5, 6, 7))
            vectors = b.column(8)
            out = []
            for s, e in zip(starts, ends):
                across = lo[s] != hi[s]
                if across and (own[s:e] == own[s]).all():
                    continue
                vecs = vectors.slice(s, e - s).to_pylist()
                if len({len(v) for v in vecs}) > 1:
                    vecs = [v if len(v) == len(vecs[0]) else b"" for v in vecs]  # keys of another dimension met by chance: seen in another table
                    at = np.array([i for i, v in enumerate(vecs) if v]) + s
                    vecs = [v for v in vecs if v]
                else:
                    at = np.arange(s, e)
                x = unit(vecs, kind)
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if across:
                    linked &= own[at][:, None] != own[at][None, :]
                hit = np.flatnonzero(linked.any(1))
                if not len(hit):
                    continue
                dim = x.shape[1]
                if dim not in known:
                    known[dim] = Projections(dim, tables, projections, width, seed)
                linked, keys, at = linked[np.ix_(hit, hit)], known[dim].keys(x[hit]), at[hit]
                for t in range(int(tab[s])):
                    linked &= keys[:, t][:, None] != keys[:, t][None, :]
                hit = linked.any(1)
                if hit.any():
                    low = lowest(linked, ids[at])
                    out.append(np.stack([ids[at], linked @ copies[at], low])[:, hit])
            got = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], ["cid", "links", "low"])

    counted = classes.select("vec").mapInArrow(count_keys, "tab long, bucket long").groupBy("tab", "bucket").count()
    large = stored(counted.filter(F.col("count") > block_rows).select("tab", "bucket", F.ceil(F.col("count") / block_rows).alias("blocks")), "large")
    none = F.lit(None).cast("array<struct<tab:bigint,blocks:bigint>>").alias("large")
    if large.isEmpty():
        dealt = classes.select("cid", "copies", "vec", none)
    else:  # buckets over the block size are checked block by block; their rows are found once more by their keys
        small = classes.select("cid", "copies", "vec", none).mapInArrow(deal, "tab long, bucket long, blocks long, cid long, copies long, vec binary").select("tab", "bucket", "cid")
        wide = small.join(large, ["tab", "bucket"]).groupBy("cid").agg(F.collect_list(F.struct("tab", "blocks")).alias("large"))  # at most one entry a table
        dealt = classes.select("cid", "copies", "vec").join(wide, "cid", "left")
    spread = split_pairs(dealt.mapInArrow(deal, "tab long, bucket long, blocks long, cid long, copies long, vec binary"), "cid", "blocks")
    spread = spread.select("tab", "bucket", "lo", "hi", "own", "cid", "copies", "blocks", "vec").repartition("tab", "bucket", "lo", "hi").sortWithinPartitions("tab", "bucket", "lo", "hi")
    found = stored(spread.mapInArrow(check, "cid long, links long, low long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    label = components(found, "cid", "low").withColumnRenamed("id", "cid").withColumnRenamed("comp", "label")
    labelled = classes.join(label, "cid", "left").join(links, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    labelled = stored(labelled.join(heads, "label").select("vec", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")), "labels")
    linked = thin.join(labelled, "vec").select(F.col("k").alias(key), F.col("n").alias("n_links"), F.col("head").alias("component_id"), (F.col("k") == F.col("head")).alias("kept"))
    alone = base.filter(~F.col("usable")).select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.c = p.a),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


@query("op4_embedding_dedup", SQL)
def op4_embedding_dedup(spark, sf):
    return vector_links(table(spark, sf, "embeddings"))
