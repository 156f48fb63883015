"""Exact cosine join inside collections: blocks that pivots keep apart are never compared (D2), and greedy grouping: the first
rows take what is similar to them, what is left is grouped over a stored neighbour table (D3).

Vectors are unit vectors without negative parts. A bounded sample gives pivots, shared by all collections; every row's
angle to each pivot is measured once. Rows of a collection are put in order of their nearest pivot and the angle to it
and cut into blocks of equal size, each with the range of its angles to every pivot. By the triangle inequality on
angles, two blocks hold no pair within ``limit`` if their ranges to some pivot lie further apart than ``limit``. Blocks are
packed once in the shared folder and read inside tasks; what goes through shuffles are block numbers and results. Products are
taken in single precision first, and in double precision where these come near the threshold.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.functions.blas import one_thread
from tidekb.functions.blockstore import PLACE, Reader, Writer, dealt, from_bytes, new_folder, to_bytes, write_blocks
from tidekb.functions.ranking import positions, top_per_group
from tidekb.functions.vectors import DIM, list_columns_to_matrix
from tidekb.session import written

PIVOTS, SAMPLE, BLOCK_ROWS, STRIP = 32, 2048, 1024, 64
#: Added to angles before blocks are left out, and taken off bounds before rows are, far above rounding.
SLACK = 1e-6
#: More than the error of a cosine in single precision.
NEAR = 1e-4
#: Pairs of blocks are dealt in squares of so many blocks a side, so that a task reads a block once for several pairs.
SIDE = 8
#: Rows of a collection that lead or join before the others are looked at, and the share of the others that has to go for another such round.
FIRST_ROWS, FIRST_SHARE = 2048, 0.05


@dataclass
class Blocks:
    index: DataFrame  # collection, block, place, rows, low and high angles to the pivots
    dim: int
    threshold: float

    @cached_property
    def pairs(self) -> DataFrame:
        """Collection, a, b and both places: the pairs that pivots don't keep apart."""
        limit = math.acos(min(1.0, self.threshold)) + SLACK
        return written(_pairs(self.index.drop("seqs"), limit), "pairs")

    def compared(self) -> tuple[int, int]:
        """(block pairs compared, block pairs of all collections)."""
        n = self.index.groupBy("collection").count().agg(F.sum(F.expr("count * (count + 1) div 2"))).first()[0]
        return self.pairs.count(), n or 0


def choose_pivots(vec: DataFrame, dim: int, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """At most ``most`` rows, far from each other, of at most ``sample`` rows by hash (which bounds what the driver sees)."""
    rows = vec.select("buckets", "weights").orderBy(F.xxhash64("buckets", "weights"), "buckets", "weights").limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((0, dim))
    x = list_columns_to_matrix(rows["buckets"], rows["weights"], dim)
    chosen, near = [0], x @ x[0]
    while len(chosen) < most and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def vector_blocks(vec: DataFrame, threshold: float, dim: int = DIM, block_rows: int = BLOCK_ROWS) -> Blocks:
    """Blocks of ``vec`` (collection, seq, buckets, weights); ``seq`` is unique. A collection may hold all rows."""
    vec = written(vec.select("collection", "seq", "buckets", "weights"), "vectors")
    pivots = choose_pivots(vec, dim)
    small = np.int16 if dim < 1 << 15 else np.int32

    def measure(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            to = angles(list_columns_to_matrix(t["buckets"], t["weights"], dim), pivots)
            cell = to.argmin(1)
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            flat = [_as_binary(b.column(i).flatten().to_numpy(zero_copy_only=False).astype(k), sizes) for i, k in ((2, small), (3, np.float64))]
            far = _as_binary(to.ravel(), np.full(len(to), to.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *flat, pa.array(cell), pa.array(to.min(1)), far], [*b.schema.names, "cell", "near", "far"])

    def pack(t: pa.Table) -> tuple[bytes, dict]:
        far = _flat(t["far"], np.float64).reshape(t.num_rows, -1)
        seqs = t["seq"].to_numpy()
        sizes = pc.binary_length(t["buckets"]).to_numpy().astype(np.int32) // small().itemsize
        info = {"rows": t.num_rows, "low": far.min(0).tolist(), "high": far.max(0).tolist(), "seqs": seqs.tobytes()}
        return to_bytes(seqs, sizes, _flat(t["buckets"], small), _flat(t["weights"], np.float64)), info

    measured = vec.mapInArrow(measure, "collection string, seq long, buckets binary, weights binary, cell long, near double, far binary")
    placed = positions(written(measured, "measured"), ["cell", "near", "seq"], ["collection"], "place")
    placed = placed.withColumn("block", F.expr(f"place div {block_rows}")).drop("cell", "near")
    index = write_blocks(placed, ["collection", "block"], ["place"], pack, "rows long, low array<double>, high array<double>, seqs binary", "vector-blocks")
    return Blocks(index, dim, threshold)


def _as_binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of each row's share of ``flat``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _pairs(index: DataFrame, limit: float, side: int = 256) -> DataFrame:
    """Pairs of blocks a <= b that no pivot keeps apart. Blocks b are dealt over parts of ``side`` blocks a, so that the
    pairs of one large collection come from many tasks."""
    parts = index.groupBy("collection").agg(F.ceil(F.count("*") / side).alias("parts"))
    both = index.join(parts, "collection")
    a = both.select("collection", F.pmod(F.col("block"), F.col("parts")).alias("part"), *[F.col(c).alias(f"{c}_a") for c in index.columns[1:]])
    b = both.select("collection", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), *[F.col(c).alias(f"{c}_b") for c in index.columns[1:]])
    near = F.expr(f"forall(arrays_zip(low_a, high_a, low_b, high_b), z -> z.low_a - z.high_b <= {limit!r} and z.low_b - z.high_a <= {limit!r})")
    met = a.join(b, ["collection", "part"]).filter((F.col("block_a") <= F.col("block_b")) & near)
    return met.select("collection", *[f"{c}_{s}" for s in "ab" for c in ("block", "file", "offset", "bytes")])


class _Loaded:
    """A block as dense rows, in double and single precision, with the greatest weight per bucket of each strip of rows."""

    def __init__(self, block: bytes, dim: int):
        self.seqs, sizes, buckets, weights = from_bytes(block)
        self.x = np.zeros((len(sizes), dim))
        self.x[np.repeat(np.arange(len(sizes)), sizes), buckets] = weights
        self.f = self.x.astype(np.float32)
        self.strips = np.stack([self.f[i : i + STRIP].max(0) for i in range(0, len(self.f), STRIP)])


def _packed(seqs: np.ndarray, x: np.ndarray) -> bytes:
    """Rows as a block."""
    row, bucket = np.nonzero(x)
    return to_bytes(seqs, np.bincount(row, minlength=len(x)).astype(np.int32), bucket.astype(np.int16 if x.shape[1] < 1 << 15 else np.int32), x[row, bucket])


def similar(a: _Loaded, b: _Loaded, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, cosines between them): all rows that have a partner in the other block.

    A cosine is at most the product with a strip's greatest weights, as no weight is negative.
    """
    may = a.f @ b.strips.T >= threshold - NEAR
    rows = np.flatnonzero(may.any(1))
    cols = np.flatnonzero(np.repeat(may.any(0), STRIP)[: len(b.f)])
    if not len(rows) or not len(cols):
        return rows, cols, np.zeros((len(rows), len(cols)))
    about = _taken(a.f, rows) @ _taken(b.f, cols).T
    if about.max() < threshold - NEAR:
        return rows[:0], cols[:0], np.zeros((0, 0))
    may = about >= threshold - NEAR
    rows, cols = rows[may.any(1)], cols[may.any(0)]
    return rows, cols, a.x[rows] @ b.x[cols].T


def _taken(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return x if len(rows) == len(x) else x[rows]


def _hits(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of a x rows of b: whether their cosine is ``threshold`` or more. Double precision decides where single precision doesn't."""
    about = a.astype(np.float32) @ b.astype(np.float32).T
    hits = about >= threshold + NEAR
    x, y = np.nonzero((about >= threshold - NEAR) & ~hits)
    for i in range(0, len(x), 1 << 16):
        part = slice(i, i + (1 << 16))
        hits[x[part], y[part]] = np.einsum("ij,ij->i", a[x[part]], b[y[part]]) >= threshold
    return hits


def _compare(blocks: Blocks, schema: str, emit) -> DataFrame:
    """``emit(collection, a, b, same block, Loaded a, Loaded b, rows, cols, cosines, hits)`` yields record batches per block pair."""
    dim, threshold = blocks.dim, blocks.threshold

    def run(batches):
        one_thread()
        first, second = Reader(lambda x: _Loaded(x, dim), 1), Reader(lambda x: _Loaded(x, dim), SIDE)
        for batch in batches:
            for p in batch.to_pylist():
                same = p["block_a"] == p["block_b"]
                a = first.get(p["file_a"], p["offset_a"], p["bytes_a"])
                b = a if same else second.get(p["file_b"], p["offset_b"], p["bytes_b"])
                rows, cols, cos = similar(a, b, threshold)
                hits = (cos >= threshold) & (a.seqs[rows][:, None] != b.seqs[cols][None, :])
                if hits.any():
                    yield from emit(p, same, a, b, rows, cols, cos, hits)
        yield from emit(None, False, None, None, None, None, None, None)

    return _squares(blocks.pairs, blocks.pairs.count()).mapInArrow(run, schema)


def _squares(pairs: DataFrame, n: int) -> DataFrame:
    """``n`` pairs of blocks over tasks, those of one square together: a task reads its blocks few times."""
    square = [F.expr(f"block_{s} div {SIDE}") for s in "ab"]
    return dealt(pairs, ["collection", *square], n, SIDE * SIDE).sortWithinPartitions("collection", *square, "block_a", "block_b")


def neighbour_summary(blocks: Blocks) -> DataFrame:
    """Per row with a partner in its collection: ``(collection, seq, n_similar, n_earlier, first_earlier, best)``.

    A pair of blocks gives at most one line per row, whatever the number of pairs of rows.
    """
    names = ["seq", "n_similar", "n_earlier", "first_earlier", "best"]

    def emit(p, same, a, b, rows, cols, cos, hits):
        if p is None:
            return
        views = [(a.seqs[rows], b.seqs[cols], hits, cos)] + ([] if same else [(b.seqs[cols], a.seqs[rows], hits.T, cos.T)])
        for own, other, h, c in views:
            at = np.flatnonzero(h.any(1))
            h, c = h[at], c[at]
            earlier = h & (other[None, :] < own[at][:, None])
            first = np.where(earlier, other[None, :], np.iinfo(np.int64).max).min(1)
            cols_ = [own[at], h.sum(1), earlier.sum(1), first, np.where(h, c, -1.0).max(1)]
            yield pa.RecordBatch.from_arrays([pa.array([p["collection"]] * len(at), pa.string()), *map(pa.array, cols_)], ["collection", *names])

    part = _compare(blocks, "collection string, seq long, n_similar long, n_earlier long, first_earlier long, best double", emit)
    return part.groupBy("collection", "seq").agg(
        F.sum("n_similar").alias("n_similar"), F.sum("n_earlier").alias("n_earlier"),
        F.min(F.when(F.col("n_earlier") > 0, F.col("first_earlier"))).alias("first_earlier"), F.max("best").alias("best"))


# ---- greedy grouping ----
OPEN, LEADER, MEMBER = 0, 1, 2
STATE = "collection string, block long, n_open long, seqs binary, state binary, leaders binary"


def neighbour_bits(blocks: Blocks) -> DataFrame:
    """The neighbour table: per pair of blocks with a hit, its bits in the shared folder. Bits are deflated, so that a
    cluster of near copies takes little room however many pairs it has."""
    folder = new_folder(blocks.index.sparkSession, "bits")

    def emit_all():
        out = None

        def emit(p, same, a, b, rows, cols, cos, hits):
            nonlocal out
            if p is None:
                if out:
                    out.close()
                return
            out = out or Writer(folder)
            shape = np.array(hits.shape, np.int32)
            place = out.put(zlib.compress(to_bytes(rows.astype(np.int32), cols.astype(np.int32), shape, np.packbits(hits)), 1))
            cols_ = [[p["collection"]], [p["block_a"]], [p["block_b"]], [place[0]], [place[1]], [place[2]]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds)], ["collection", "block_a", "block_b", "file", "offset", "bytes"])

        return emit

    return written(_compare(blocks, f"collection string, block_a long, block_b long, {PLACE}", _PerTask(emit_all)), "bits")


class _PerTask:
    """Calls what ``make`` makes, once made in each task."""

    def __init__(self, make):
        self.make, self.made = make, None

    def __call__(self, *args):
        self.made = self.made or self.make()
        return self.made(*args)

    def __reduce__(self):
        return _PerTask, (self.make,)


def _unpack_bits(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, shape, bits = from_bytes(zlib.decompress(block))
    n, m = map(int, shape)
    return rows, cols, np.unpackbits(bits, count=n * m).reshape(n, m).astype(bool)


def first_open(batches):
    """Per row that is open: its smallest earlier neighbour that is open or a leader. Input: places of the bits and of both states."""
    bits, states = Reader(_unpack_bits, 1), {"a": Reader(from_bytes, 1), "b": Reader(from_bytes, SIDE)}
    for batch in batches:
        for p in batch.to_pylist():
            rows, cols, hits = bits.get(p["file"], p["offset"], p["bytes"])
            of = {s: r.get(p[f"file_{s}"], p[f"offset_{s}"], p[f"bytes_{s}"]) for s, r in states.items()}
            one = [of[s][0][at] for s, at in (("a", rows), ("b", cols))]
            state = [of[s][1][at] for s, at in (("a", rows), ("b", cols))]
            views = [("a", rows, 0, 1, hits)] + ([("b", cols, 1, 0, hits.T)] if p["block_a"] != p["block_b"] else [])
            for s, at, own, other, h in views:
                mine = np.flatnonzero(state[own] == OPEN)
                live = np.flatnonzero(state[other] != MEMBER)
                if not len(mine) or not len(live):
                    continue
                earlier = h[np.ix_(mine, live)] & (one[other][live][None, :] < one[own][mine][:, None])
                first = np.where(earlier, one[other][live][None, :], np.iinfo(np.int64).max)
                best = first.argmin(1)
                some = np.flatnonzero(earlier.any(1))
                if len(some):
                    pick = live[best[some]]
                    cols_ = [at[mine[some]].astype(np.int64), one[other][pick], state[other][pick] == LEADER]
                    head = [pa.array([p["collection"]] * len(some), pa.string()), pa.array([p[f"block_{s}"]] * len(some), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*head, *map(pa.array, cols_)], ["collection", "block", "row", "first", "led"])


def _settle(state: pa.Table, firsts: pa.Table) -> pa.Table:
    """One block's next state: an open row without an earlier open or leading neighbour leads; one whose first is a leader joins it."""
    seqs, kind, leaders = (np.frombuffer(state[c][0].as_py(), k).copy() for c, k in (("seqs", np.int64), ("state", np.uint8), ("leaders", np.int64)))
    first, led = np.full(len(seqs), -1, np.int64), np.zeros(len(seqs), bool)
    held = np.zeros(len(seqs), bool)
    if firsts.num_rows:
        at = firsts["row"].to_numpy()
        first[at], led[at], held[at] = firsts["first"].to_numpy(), firsts["led"].to_numpy(), True
    open_ = kind == OPEN
    lead, join = open_ & ~held, open_ & led
    leaders[lead], leaders[join] = seqs[lead], first[join]
    kind[lead], kind[join] = LEADER, MEMBER
    return pa.table({"collection": state["collection"], "block": state["block"], "n_open": pa.array([int((kind == OPEN).sum())], pa.int64()), "seqs": state["seqs"], "state": pa.array([kind.tobytes()], pa.binary()), "leaders": pa.array([leaders.tobytes()], pa.binary())})


def first_leaders(blocks: Blocks, first_rows: int = FIRST_ROWS) -> tuple[Blocks, DataFrame, int, int]:
    """One round of greedy grouping: the ``first_rows`` first rows of each collection lead or join, and all rows similar to a new
    leader join the smallest. (blocks of the rows left, ``(collection, seqs, leaders)`` of the others, rows left, others that joined).

    Whatever the collection, its first rows meet in one task of that size; all others are compared with their leaders in their blocks.
    """
    index, dim, threshold, spark = blocks.index, blocks.dim, blocks.threshold, blocks.index.sparkSession
    n = index.count()

    def spell(batches):
        for b in batches:
            for c, seqs in zip(*(col.to_pylist() for col in b.columns)):
                seqs = np.frombuffer(seqs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(seqs), pa.string()), pa.array(seqs)], ["collection", "seq"])

    rows = index.select("collection", "seqs").mapInArrow(spell, "collection string, seq long")
    last = top_per_group(rows, "collection", [F.asc("seq")], first_rows).groupBy("collection").agg(F.max("seq").alias("last"))
    work = written(index.join(last, "collection"), "work")

    def pick(batches):
        read = Reader(from_bytes, 1)
        for b in batches:
            for p in b.to_pylist():
                seqs, sizes, buckets, weights = read.get(p["file"], p["offset"], p["bytes"])
                ends = np.r_[0, np.cumsum(sizes)]
                at = np.flatnonzero(seqs <= p["last"])
                if len(at):
                    cut = [pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary()) for x in (buckets, weights)]
                    yield pa.RecordBatch.from_arrays([pa.array([p["collection"]] * len(at), pa.string()), pa.array(seqs[at]), *cut], ["collection", "seq", "buckets", "weights"])

    def lead(t: pa.Table) -> tuple[bytes, dict]:
        one_thread()
        small, seqs = np.int16 if dim < 1 << 15 else np.int32, t["seq"].to_numpy()
        sizes = pc.binary_length(t["weights"]).to_numpy() // 8
        x = np.zeros((len(seqs), dim))
        x[np.repeat(np.arange(len(seqs)), sizes), _flat(t["buckets"], small)] = _flat(t["weights"], np.float64)
        hits, leaders = _hits(x, x, threshold), np.full(len(seqs), -1)
        for i in range(len(seqs)):
            if leaders[i] < 0:
                leaders[i] = i
                at = i + 1 + np.flatnonzero(hits[i, i + 1 :])
                leaders[at[leaders[at] < 0]] = i
        heads = np.flatnonzero(leaders == np.arange(len(seqs)))
        return _packed(seqs[heads], x[heads]), {"seqs": seqs.tobytes(), "leaders": seqs[leaders].tobytes()}

    picked = dealt(work.select("collection", "file", "offset", "bytes", "last"), ["collection", "offset", "file"], n).mapInArrow(pick, "collection string, seq long, buckets binary, weights binary")
    led = write_blocks(picked, ["collection"], ["seq"], lead, "seqs binary, leaders binary", "leaders")
    heads = led.select("collection", *[F.col(c).alias(f"{c}_b") for c in ("file", "offset", "bytes")])
    folder, names = new_folder(spark, "left"), ["collection", "block", "file", "offset", "bytes", "rows", "low", "high", "seqs", "others", "leaders"]

    def leave(batches):
        one_thread()
        read, heads, out = Reader(lambda x: _Loaded(x, dim), 1), Reader(lambda x: _Loaded(x, dim), 1), None
        for b in batches:
            for p in b.to_pylist():
                a, to = read.get(p["file"], p["offset"], p["bytes"]), heads.get(p["file_b"], p["offset_b"], p["bytes_b"])
                at = np.flatnonzero(a.seqs > p["last"])
                hits = _hits(a.x[at], to.x, threshold)
                gone = hits.any(1)
                left, others = at[~gone], at[gone]
                out = out or Writer(folder)
                place = out.put(_packed(a.seqs[left], a.x[left]))
                row = {**{c: p[c] for c in ("collection", "block", "low", "high")}, **dict(zip(("file", "offset", "bytes"), place)), "rows": len(left),
                       "seqs": a.seqs[left].tobytes(), "others": a.seqs[others].tobytes(), "leaders": to.seqs[hits[gone].argmax(1)].tobytes()}
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in names}], schema=kept)
        if out:
            out.close()

    kept = pa.schema([("collection", pa.string()), ("block", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64()),
                      ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("seqs", pa.binary()), ("others", pa.binary()), ("leaders", pa.binary())])
    met = dealt(work.drop("seqs", "rows").join(heads, "collection"), ["collection", "offset", "file"], n).sortWithinPartitions("collection", "file", "offset")
    left = written(met.mapInArrow(leave, f"collection string, block long, {PLACE}, rows long, low array<double>, high array<double>, seqs binary, others binary, leaders binary"), "left")
    done = led.select("collection", "seqs", "leaders").unionByName(left.select("collection", F.col("others").alias("seqs"), "leaders"))
    counts = left.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.expr("octet_length(others) div 8")), F.lit(0))).first()
    return Blocks(left.filter("rows > 0").select(*index.columns), dim, threshold), done, *map(int, counts)


def greedy_leaders(blocks: Blocks, first_rows: int = FIRST_ROWS) -> DataFrame:
    """``(collection, seq, leader)``: in order of ``seq``, a row without a leader leads all later rows without one that are
    similar to it. Leaders are the lexicographically first maximal independent set.

    The first rows of each collection lead or join, and what is similar to their leaders joins, as long as that takes a share of
    the rows: rows with many neighbours go there, and neighbours among the others are few. The pair search runs once, on those. Each round
    passes messages over the stored bits: open rows ask for their smallest earlier neighbour that is open or leads. States are
    one packed row per block, and lie in the shared folder for the tasks that ask; pairs of blocks without open rows rest.
    """
    settled = []
    while True:
        blocks, done, left, joined = first_leaders(blocks, first_rows)
        settled.append(done)
        if not left or joined < FIRST_SHARE * (left + joined):
            break

    def spell(batches):
        for b in batches:
            for c, seqs, leaders in zip(*(col.to_pylist() for col in b.columns)):
                seqs = np.frombuffer(seqs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(seqs), pa.string()), pa.array(seqs), pa.array(np.frombuffer(leaders, np.int64))], ["collection", "seq", "leader"])

    if left:
        settled.append(_leaders_of_rest(blocks))
    all_ = settled[0]
    for more in settled[1:]:
        all_ = all_.unionByName(more)
    return all_.mapInArrow(spell, "collection string, seq long, leader long")


def _leaders_of_rest(blocks: Blocks) -> DataFrame:
    """``(collection, seqs, leaders)`` per block, by rounds over the neighbour table."""
    bits = neighbour_bits(blocks)
    n, folder = bits.count(), new_folder(blocks.index.sparkSession, "states")

    def begin(batches):
        for b in batches:
            for c, block, n, seqs in zip(*(col.to_pylist() for col in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()), pa.array([block]), pa.array([n]), pa.array([seqs], pa.binary()), pa.array([bytes(n)], pa.binary()), pa.array([bytes(8 * n)], pa.binary())], ["collection", "block", "n_open", "seqs", "state", "leaders"])

    def publish(batches):
        out = None
        for b in batches:
            for c, block, n, seqs, kind in zip(*(col.to_pylist() for col in b.columns)):
                out = out or Writer(folder)
                place = out.put(to_bytes(np.frombuffer(seqs, np.int64), np.frombuffer(kind, np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()), pa.array([block]), pa.array([n]), pa.array([place[0]]), *(pa.array([x], pa.int64()) for x in place[1:])], ["collection", "block", "n", "file", "offset", "bytes"])
        if out:
            out.close()

    state = written(blocks.index.select("collection", "block", "rows", "seqs").mapInArrow(begin, STATE), "state")
    while True:
        told = written(state.select("collection", "block", "n_open", "seqs", "state").mapInArrow(publish, f"collection string, block long, n long, {PLACE}"), "told")
        side = {s: told.select("collection", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "n", "file", "offset", "bytes")]) for s in "ab"}
        asked = bits.join(side["a"], ["collection", "block_a"]).join(side["b"], ["collection", "block_b"]).filter("n_a > 0 or n_b > 0")
        firsts = _squares(asked, n).mapInArrow(first_open, "collection string, block long, row long, first long, led boolean")
        firsts = firsts.groupBy("collection", "block", "row").agg(F.min(F.struct("first", "led")).alias("f")).select("collection", "block", "row", "f.first", "f.led")
        busy = state.filter("n_open > 0")
        moved = busy.groupBy("collection", "block").cogroup(firsts.groupBy("collection", "block")).applyInArrow(_settle, STATE)
        state = written(state.filter("n_open = 0").unionByName(moved), "state")
        if not state.agg(F.sum("n_open")).first()[0]:
            break
    return state.select("collection", "seqs", "leaders")
