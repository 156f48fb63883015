"""N-gram Jaccard join by MinHash banding.

Texts with one n-gram set are one class. Band and row counts follow from the recall wanted at the threshold. Band
hashes are shuffled, never texts; classes that share a band are joined into candidate groups by star edges (linear in
a bucket's size), and within a group every pair is verified on full n-gram sets by sparse matrix products, a block
pair of bounded size at a time. No pairs are written: a task reports per class how many it links to and the smallest class reached.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.llm.cluster import components, lowest, runs, split_pairs
from tidekb.llm.common import kept, located, numbered, query, stored, table
from tidekb.llm.licenses import words
from tidekb.session import ship_package

THRESHOLD, WIDTH, RECALL, HASHES, SEED = 0.8, 5, 0.99, 256, 11


def bands_for(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the steepest banding that finds a pair at the threshold with this probability using at most so many hashes.

    >>> bands_for(0.8, 0.99)
    (26, 8)
    """
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


class Shingler(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words; texts -> sorted distinct n-gram hashes."""

    def __init__(self, width: int, room: int = 500_000):
        super().__init__()
        self.width, self.room = width, room

    def __missing__(self, word: bytes) -> int:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.room:
            self[word] = got
        return got

    def grams(self, text: str | None) -> np.ndarray:
        """A text of fewer words than an n-gram has one n-gram of all its words; one without words has none."""
        ws = words(text)
        if not ws:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
        wide = min(self.width, len(h))
        n = len(h) - wide + 1
        g = h[:n] + np.uint64(wide)
        for k in range(1, wide):
            g = g * np.uint64(0x9E3779B97F4A7C15) ^ h[k : k + n]
            g ^= g >> np.uint64(29)
        return np.unique(g * np.uint64(0xBF58476D1CE4E5B9))


class MinHasher:
    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)[:, None]
        low = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024] * self.mul
            part += self.add
            np.minimum(low, part.min(0), out=low)
        return (low.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(1, dtype=np.uint64).view(np.int64)


def shared_grams(sets: list[np.ndarray], room: int = 8_000_000) -> np.ndarray:
    """Sizes of all pairwise intersections. N-grams of one set only are left out; columns are taken in bounded chunks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    owner, column = owner[common], np.cumsum(fresh & common)[common] - 1
    out = np.zeros((len(sets), len(sets)), np.float32 if len(values) < 1 << 24 else np.float64)
    wide = max(256, room // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        m = np.zeros((len(sets), wide), out.dtype)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, seed: int = SEED, block_rows: int = 1_000, block_grams: int = 1_000_000, slots: int = 1 << 20) -> DataFrame:
    """One row per document: key, ``class_id``, ``n_links``, ``kept``, and its place (``at_file``, ``at_row``).

    n_links: other documents whose n-gram sets have a Jaccard similarity of the threshold or more; class_id: the smallest key
    that links lead to; kept: exactly one row of a class, the one with the smallest key (null keys last, repeated keys
    by place). Texts without words (null and empty ones too) link with nothing. Words: runs of letters and digits, A-Z
    lower-cased. An empty table gives an empty result; other columns are ignored. What is broadcast are at most ``slots`` numbers:
    the hash slots of shared buckets and of candidates, which keep most other rows out of the shuffles; joins on the keys follow.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = located(docs.select(key, text))
    bands, rows = bands_for(threshold, recall)
    at = ["at_file", "at_row"]
    kind = docs.select(key).schema[0].dataType.simpleString()

    def sketch(batches):
        kept(None)  # tables of an earlier stage, as the language model's, are let go
        cut, mh = Shingler(width), MinHasher(bands, rows, seed)
        for b in batches:
            digests, sizes, hashes = [], [], []
            for t in b.column(3):
                g = cut.grams(t.as_py())
                digests.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                sizes.append(len(g))
                hashes.append(mh.band_hashes(g) if len(g) else np.zeros(bands, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["k", *at, "digest", "n_grams", "bands"])

    def shingle(batches):
        kept(None)
        cut = Shingler(width)
        for b in batches:
            for begin in range(0, b.num_rows, 1000):
                c = b.slice(begin, 1000)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([cut.grams(t.as_py()).tobytes() for t in c.column(2)], pa.binary())], [*at, "grams"])

    def verify(batches):
        kept(None)
        for b, starts, ends in runs(batches, 3):
            own, ids, copies, split = (b.column(i).to_numpy() for i in (3, 4, 5, 6))
            out: list[np.ndarray] = []
            for s, e in zip(starts, ends):
                if b.column(1)[s].as_py() != b.column(2)[s].as_py() and (own[s:e] == own[s]).all():
                    continue
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(7).slice(s, e - s)]
                both, n = shared_grams(sets).astype(np.float64), np.array([len(x) for x in sets], np.float64)
                linked = both / (n[:, None] + n[None, :] - both) >= threshold
                np.fill_diagonal(linked, False)
                if b.column(1)[s].as_py() != b.column(2)[s].as_py():
                    linked &= own[s:e][:, None] != own[s:e][None, :]
                hit = linked.any(1)
                if hit.any():
                    low = lowest(linked, ids[s:e])
                    out.append(np.stack([ids[s:e], linked @ copies[s:e], low, split[s:e]])[:, hit])
            got = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], ["cid", "links", "low", "blocks"])

    prints = docs.select(F.col(key).alias("k"), *at, text).mapInArrow(sketch, f"k {kind}, at_file string, at_row long, digest binary, n_grams long, bands array<long>")
    prints = stored(prints, "prints")
    first = F.min(F.struct(F.col("k").isNull().alias("no_key"), "k", *at)).alias("first")
    reps = prints.filter("n_grams > 0").groupBy("digest", "n_grams").agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"))
    reps = stored(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = reps.select("cid", F.posexplode("bands").alias("band", "hash"))
    shared = stored(buckets.groupBy("band", "hash").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).filter("lead < last").drop("last"), "buckets")
    place = lambda *key: F.pmod(F.xxhash64(*key), F.lit(slots)).alias("slot")
    met = lambda df, few, *key: df.withColumn("slot", place(*key)).join(F.broadcast(few.select(place(*key)).distinct()), "slot", "left_semi").drop("slot")
    buckets = met(buckets, shared, "band", "hash")
    groups = stored(components(buckets.join(shared, ["band", "hash"]).filter("cid != lead").select("cid", "lead"), "cid", "lead"), "groups")
    members = groups.withColumnRenamed("id", "cid").join(reps.select("cid", "n_grams", "copies", "first.at_file", "first.at_row"), "cid")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block_rows)), F.ceil(F.sum("n_grams") / F.lit(block_grams)), F.lit(1)).cast("long")
    members = stored(members.join(members.groupBy("comp").agg(F.least(blocks, F.count("*")).alias("blocks")), "comp").drop("n_grams"), "members")
    wanted = met(docs, members, *at)
    grams = wanted.select(*at, text).mapInArrow(shingle, "at_file string, at_row long, grams binary").join(members, at)
    meets = split_pairs(grams, "cid", "blocks").select("comp", "lo", "hi", "own", "cid", "copies", "blocks", "grams")
    meets = meets.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    found = stored(meets.mapInArrow(verify, "cid long, links long, low long, blocks long"), "links")
    whole = found.filter("blocks = 1").select("cid", F.col("low").alias("label"))
    parts = components(found.filter("blocks > 1"), "cid", "low").withColumnRenamed("id", "cid").withColumnRenamed("comp", "label")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labelled = reps.select("cid", "digest", "n_grams", "first", "copies").join(whole.unionByName(parts), "cid", "left").join(links, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    labelled = stored(labelled.join(heads, "label").select("digest", "n_grams", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "labels")
    out = prints.select("k", *at, "digest", "n_grams").join(labelled, ["digest", "n_grams"], "left")
    stays = F.coalesce((F.col("head.at_file") == F.col("at_file")) & (F.col("head.at_row") == F.col("at_row")), F.lit(True))
    return out.select(F.col("k").alias(key), F.when(F.col("head").isNull(), F.col("k")).otherwise(F.col("head.k")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), stays.alias("kept"), *at)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class is kept, with all their columns."""
    plain, names = numbered(docs)
    rows = located(plain)
    dropped = ngram_join(rows.drop("at_file", "at_row"), names[key], names[text], **options).filter("not kept").select("at_file", "at_row")
    return rows.join(dropped, ["at_file", "at_row"], "left_anti").drop("at_file", "at_row").toDF(*docs.columns)


@query("op3_ngram_join")
def op3_ngram_join(spark, sf):
    return ngram_join(table(spark, sf, "documents")).select("doc_id", "class_id", "n_links", "kept")
