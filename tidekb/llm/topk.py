"""Exact top-k inner products by best-first search in an M-tree.

Vectors are scaled to integers. With M the greatest length of all, a vector x becomes the point (x, sqrt(M^2 - |x|^2)) / M
of the unit sphere and a query q the point (q, 0) / |q|; Euclidean distance between the two falls as the inner product
rises, so nearest points are highest scores, and distances obey the triangle inequality.

The tree has four levels: routing objects of cells, picked from a bounded sample of the rows; units, pages of a cell's
rows in order of their distance to its routing object; nodes of at most ``NODE`` rows inside a unit, around rows of their
own; and the rows. Every entry stores its distance to its parent's routing object, every node its covering radius. For a
query the entries are taken in order of their bounds: first the bound that stored distances give without computing
anything, |d(q, parent) - d(entry, parent)| - radius, then, if the entry may still matter, its own distance less
the radius. Across units the search runs in waves (the best unit, the next seven, the rest), each with the k-th score so
far, so a unit is opened only if its bound admits one of the k; in a unit a query takes nodes in growing batches, best
first, and stops at the first whose bound is beyond its k-th score.

All rows are indexed; only the choice of routing objects uses the sample. Scores are exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekb.functions.blas import one_thread
from tidekb.functions.blockstore import grouped
from tidekb.functions.ranking import positions
from tidekb.llm.common import query, stored, table
from tidekb.session import ship_package

NODE, UNIT, CELLS, SAMPLE = 64, 4096, 256, 8192
#: Queries of one unit, and units of one directory block, that a task takes at once.
CHUNK, BLOCK = 1024, 4096
#: Of the units that bounds admit, in order: those opened in each wave.
WAVES = ((0, 1), (1, 8), (8, None))
#: Added to distances on the unit sphere before anything is left out, far above rounding.
SLACK = 1e-6
#: No score yet.
NONE = -(1 << 63)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Integer rows as points of the unit sphere; ``top`` is the greatest squared length."""
    y = x.astype(np.float64) / math.sqrt(top)
    return np.column_stack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))])


def as_query(x: np.ndarray) -> np.ndarray:
    """Query rows as points; a zero row has no direction, and its bounds must not be used."""
    y = x.astype(np.float64)
    n = np.sqrt((y * y).sum(1))
    return np.column_stack([y / np.where(n > 0, n, 1.0)[:, None], np.zeros(len(y))])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``, all on the unit sphere."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def unpack(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i4") for v in col.to_pylist()])


def pick(points: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Row numbers of at most n routing objects, each drawn with the square of its distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [0]
    near = apart(points, points[:1])[:, 0]
    while len(chosen) < n and near.max() > SLACK:
        sums = np.cumsum(near * near)
        chosen.append(int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, len(points) - 1)))
        near = np.minimum(near, apart(points, points[chosen[-1]][None])[:, 0])
    return np.array(chosen)


def unit_nodes(x: np.ndarray, top: float):
    """The nodes of a unit: (its routing row, its radius, [(routing row, radius, distance to the unit's, rows, their distances)])."""
    u = lifted(x, top)
    heart = int(np.argmax(u @ u.mean(0)))
    to_heart = apart(u, u[heart : heart + 1])[:, 0]
    routing = pick(u, -(-len(x) // NODE))
    d = apart(u, u[routing])
    nearest = d.argmin(1)
    nodes = []
    for c, o in enumerate(routing):
        own = np.flatnonzero(nearest == c)
        own = own[np.argsort(d[own, c], kind="stable")]
        for lo in range(0, len(own), NODE):  # pages have a fixed capacity: a dense one is cut by distance
            rows = own[lo : lo + NODE]
            nodes.append((int(o), float(d[rows, c].max()), float(to_heart[o]), rows, d[rows, c]))
    return heart, float(to_heart.max()), nodes


def reach_of(least: np.ndarray, norm2: np.ndarray, top: float) -> np.ndarray:
    """Distance at which a score is met; without a score, or for a zero query, beyond everything."""
    unit = np.sqrt(norm2 * top)
    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least / np.where(unit > 0, unit, 1.0))) + SLACK
    return np.where((least == NONE) | (unit == 0), np.inf, d)


class Unit:
    """A unit opened in a task: routing points and entries of its nodes."""

    def __init__(self, t: pa.Table, top: float):
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
        points = lifted(unpack(t.column("routing")), top)
        self.heart, self.points = points[:1], points[1:]
        self.radius, self.parent = t.column("radius").to_numpy()[1:], t.column("parent").to_numpy()[1:]
        ids, self.keys, dists, vecs = (t.column(c).to_pylist()[1:] for c in ("ids", "keys", "dists", "vecs"))
        self.keys = [x for part in self.keys for x in part]
        self.ids = np.array([x for part in ids for x in part], np.int64)
        self.edges = np.concatenate([[0], np.cumsum([len(part) for part in ids])])
        self.dists = np.array([x for part in dists for x in part])
        kind = np.float64 if top < 1 << 53 else np.int64  # either is exact
        self.vecs = np.frombuffer(b"".join(vecs), "<i4").reshape(len(self.ids), -1).astype(kind)
        order = sorted(range(len(self.ids)), key=lambda i: (self.keys[i] is None, self.keys[i] if self.keys[i] is not None else 0, self.ids[i]))
        self.turn = np.empty(len(order), np.int64)  # places among ties: smaller keys first, null keys last, then by row
        self.turn[order] = np.arange(len(order))
        self.top = top
        self.computed = 0

    def search(self, rows: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, entry) of the unit's entries that can be among each query's k best, given that scores below
        ``least`` can't. Each query takes its nodes best first: the first one, the next two, the next four, ...; the
        queries that take the same node do so together.
        """
        norm2 = (q.astype(np.float64) ** 2).sum(1)
        point, free = as_query(q), norm2 == 0
        q, kth, limit = q.astype(self.vecs.dtype), least.copy(), reach_of(least, norm2, self.top)
        bound = np.abs(apart(point, self.heart) - self.parent) - self.radius  # from stored distances alone
        shut = (bound > limit[:, None]) & ~free[:, None]
        near = np.flatnonzero(~shut.all(0))
        own = np.full(bound.shape, np.inf)
        own[:, near] = apart(point, self.points[near])
        self.computed += len(q) * (1 + len(near))
        bound = np.where(shut, np.inf, np.maximum(bound, own - self.radius))
        bound[free] = -1.0
        order = np.argsort(bound, axis=1, kind="stable")
        best = [np.zeros(0, np.int64)] * 3
        at, step = 0, 1
        while at < order.shape[1]:
            nodes = order[:, at : at + step]
            who, where = np.nonzero(np.take_along_axis(bound, nodes, 1) <= limit[:, None])
            if not len(who):
                break
            node = nodes[who, where]
            by = np.argsort(node, kind="stable")
            who, node = who[by], node[by]
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            found = [best]
            for lo, hi in zip(starts, [*starts[1:], len(node)]):
                n, qs = node[lo], who[lo:hi]
                span = np.arange(self.edges[n], self.edges[n + 1])
                may = (np.abs(own[qs, n][:, None] - self.dists[span]) <= limit[qs][:, None]) | free[qs][:, None]
                some = may.any(0)
                span, may = span[some], may[:, some]
                self.computed += len(qs) * len(span)
                scores = (q[qs] @ self.vecs[span].T).astype(np.int64)
                a, c = np.nonzero(may & (scores >= kth[qs][:, None]) & (self.ids[span] != rows[qs][:, None]))
                found.append([qs[a], scores[a, c], span[c]])
            owner, score, entry = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort([self.turn[entry], -score, owner])
            owner, score, entry = owner[by], score[by], entry[by]
            first = np.searchsorted(owner, owner)
            kept = np.arange(len(owner)) - first < k
            best = [owner[kept], score[kept], entry[kept]]
            full = np.flatnonzero(np.arange(len(owner)) - first == k - 1)
            kth[owner[full]] = np.maximum(kth[owner[full]], score[full])
            limit = reach_of(kth, norm2, self.top)
            at, step = at + step, step * 2
        return tuple(best)


def scaled(rows: DataFrame, key: str, vector: str, asks: Column, scale: float) -> DataFrame:
    """(row, key, ask, dim, norm2, vec): the usable rows with floor(scale * x) as packed integers."""
    v = F.col("v")
    usable = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    kind = rows.select(key).schema[0].dataType.simpleString()
    base = rows.select(F.col(key).alias("key"), F.coalesce(asks, F.lit(False)).alias("ask"), F.col(vector).cast("array<double>").alias("v")).filter(usable)
    base = base.withColumn("row", F.monotonically_increasing_id())

    def pack(batches):
        for b in batches:
            v = b.column(2)
            flat = np.floor(np.asarray(v.flatten(), np.float64) * scale)
            ends = np.diff(np.asarray(v.offsets)).cumsum()
            parts = np.split(flat, ends[:-1]) if len(ends) else []
            norm = [float((p * p).sum()) for p in parts]
            vecs = [p.astype("<i4").tobytes() if n < 2.0**62 else None for p, n in zip(parts, norm)]
            dims = pa.array([len(p) for p in parts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), dims, pa.array(norm, pa.float64()), pa.array(vecs, pa.binary())], ["row", "key", "ask", "dim", "norm2", "vec"])

    out = base.mapInArrow(pack, f"row long, key {kind}, ask boolean, dim int, norm2 double, vec binary")
    return stored(out.filter("vec is not null"), "scaled")


def build(rows: DataFrame, top: float, n: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(tree, routing points of cells by dimension). The tree has a row per node and, as node -1, one per unit.

    The routing objects come from at most ``SAMPLE`` distinct vectors, taken by hash; a dimension without one gets a single
    cell around its zero vector. Units are cut by place in the cell, so a cell may hold all rows.
    """
    kind = rows.schema["key"].dataType.simpleString()
    sample = rows.select("dim", "vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    by: dict[int, list[bytes]] = {}
    for r in sample:
        by.setdefault(r["dim"], []).append(bytes(r["vec"]))
    points = {}
    for dim, vecs in sorted(by.items()):
        u = lifted(np.stack([np.frombuffer(v, "<i4") for v in vecs]), top)
        points[dim] = u[pick(u, max(1, min(CELLS, n // UNIT)))]

    def place(batches):
        one_thread()
        for b in batches:
            dims = b.column(2).to_numpy()
            cell, dist = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                d = apart(lifted(unpack(b.column(3).take(pa.array(at))), top), points.get(dim, _pole(dim)))
                cell[at], dist[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], ["row", "key", "dim", "vec", "cell", "dist"])

    dealt = stored(rows.select("row", "key", "dim", "vec").mapInArrow(place, f"row long, key {kind}, dim int, vec binary, cell long, dist double"), "dealt")
    dealt = positions(dealt, ["dist", "row"], ["dim", "cell"], "at", "cell_no").withColumn("unit", F.shiftleft("cell_no", 32) + F.expr(f"at div {UNIT}"))

    def grow(batches):
        one_thread()
        for t in grouped(batches, 1):
            x, ids = unpack(t.column("vec")), t.column("row")
            dist, dim, cell = t.column("dist").to_numpy(), t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
            heart, radius, nodes = unit_nodes(x, top)
            above = float(apart(lifted(x[heart : heart + 1], top), points.get(dim, _pole(dim))[cell][None])[0, 0])
            out = [(-1, x[heart], radius, above, np.zeros(0, np.int64), np.array([dist.min(), dist.max()]))]
            out += [(i, x[o], r, p, rows, d) for i, (o, r, p, rows, d) in enumerate(nodes)]
            cols = [[t.column("unit")[0].as_py()] * len(out), [dim] * len(out), [cell] * len(out), [o[0] for o in out], [o[1].tobytes() for o in out], [o[2] for o in out], [o[3] for o in out]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64()]
            lists = [[ids.take(pa.array(o[4])).to_pylist() for o in out], [t.column("key").take(pa.array(o[4])).to_pylist() for o in out], [o[5].tolist() for o in out]]
            lists_t = [pa.list_(pa.int64()), pa.list_(t.schema.field("key").type), pa.list_(pa.float64())]
            arrays = [pa.array(c, k) for c, k in zip(cols + lists, kinds + lists_t)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x[o[4]].tobytes() for o in out], pa.binary())], TREE)

    tree = f"unit long, dim int, cell long, node int, routing binary, radius double, parent double, ids array<long>, keys array<{kind}>, dists array<double>, vecs binary"
    ordered = dealt.select("unit", "row", "key", "dim", "vec", "cell", "dist").repartition("unit").sortWithinPartitions("unit")
    return stored(ordered.mapInArrow(grow, tree), "tree"), points


TREE = ["unit", "dim", "cell", "node", "routing", "radius", "parent", "ids", "keys", "dists", "vecs"]


def _pole(dim: int) -> np.ndarray:
    return np.eye(1, dim + 1, dim)


def _bounds(points: dict[int, np.ndarray], top: float, most: int | None):
    """Cogroup step: a block of queries (left) against a block of units (right): pairs that bounds don't rule out."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        one_thread()
        out = []
        if left.num_rows and right.num_rows:
            qd, ud = left.column("dim").to_numpy(), right.column("dim").to_numpy()
            for dim in np.intersect1d(qd, ud).tolist():
                qs, us = left.filter(pa.array(qd == dim)), right.filter(pa.array(ud == dim))
                q, norm2 = as_query(unpack(qs.column("vec"))), qs.column("norm2").to_numpy()
                limit = reach_of(qs.column("least").to_numpy(), norm2, top)
                to_cell = apart(q, points.get(dim, _pole(dim)))[:, us.column("cell").to_numpy()]
                near, far = np.array(us.column("dists").to_pylist()).T
                radius, parent = us.column("radius").to_numpy(), us.column("parent").to_numpy()
                bound = np.maximum.reduce([to_cell - far, near - to_cell, np.abs(to_cell - parent) - radius])
                bound[norm2 == 0] = 0.0
                open_ = (bound <= limit[:, None]).any(0)
                if open_.any():  # only units that stored distances don't rule out for every query
                    own = apart(q, lifted(unpack(us.column("routing").filter(pa.array(open_))), top)) - radius[open_]
                    own[norm2 == 0] = 0.0
                    bound[:, open_] = np.maximum(bound[:, open_], own)
                bound = np.maximum(bound, 0.0)
                rows, units = qs.column("row").to_numpy(), us.column("unit").to_numpy()
                for i in range(len(rows)):
                    may = np.flatnonzero(bound[i] <= limit[i])
                    may = may[np.lexsort([units[may], bound[i][may]])][:most]
                    out.append((np.full(len(may), rows[i]), units[may], bound[i][may]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"row": cols[0].astype(np.int64), "unit": cols[1].astype(np.int64), "bound": cols[2].astype(np.float64)})

    return step


def top_k(rows: DataFrame, asks: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """For each row that ``asks`` selects: ``query_id``, ``rank`` (from 1), the key of a row, ``score``; the k highest scores.

    The score is the integer inner product of floor(scale * x) of both vectors; a query's own row is no candidate, rows
    that repeat its key are. Ties go to the smaller key, null keys last. Vectors that are null, empty or hold null
    or non-finite components take no part, nor do those whose scaled squared length is 2^62 or more, whose scores may exceed
    a long. Vectors of different dimensions don't meet. Fewer than k candidates are all returned; other columns are ignored.
    """
    ship_package(rows.sparkSession)
    kind = rows.select(key).schema[0].dataType.simpleString()
    base = scaled(rows, key, vector, asks, scale)
    got = base.agg(F.max("norm2").alias("top"), F.count("*").alias("n"), F.count_if("ask").alias("asks")).first()
    top, n = max(1.0, got["top"] or 0.0), got["n"]
    tree, points = build(base, top, n)
    directory = tree.filter("node = -1").select("unit", "dim", "cell", "routing", "radius", "parent", "dists")
    q_blocks, u_blocks = -(-max(1, got["asks"]) // CHUNK), -(-max(1, directory.count()) // BLOCK)
    asked = stored(base.filter("ask").select("row", F.col("key").alias("query_id"), "dim", "norm2", "vec"), "asked")

    def spread(df: DataFrame, ident: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64(ident), F.lit(n_own)).cast("int")).withColumn(other, every)

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        one_thread()
        rows, score, keys, hit = [], [], [], []
        if left.num_rows and right.num_rows:
            unit, asking = Unit(right, top), left.column("row").to_numpy()
            owner, score, entry = unit.search(asking, unpack(left.column("vec")), k, left.column("least").to_numpy())
            rows, keys, hit = asking[owner], [unit.keys[i] for i in entry.tolist()], unit.ids[entry]
        key_t = right.schema.field("keys").type.value_type
        return pa.table({"row": pa.array(rows, pa.int64()), "score": pa.array(score, pa.int64()), "key": pa.array(keys, key_t), "hit": pa.array(hit, pa.int64())})

    best = seen = None
    units = spread(directory, "unit", "ub", u_blocks, "qb", q_blocks)
    first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key"), "hit")
    for lo, hi in WAVES:
        if best is None:
            asking = asked.withColumn("least", F.lit(NONE))
        else:
            worst = best.filter(f"rank = {k}").select("row", F.col("score").alias("least"))
            asking = stored(asked.join(worst, "row", "left").withColumn("least", F.coalesce("least", F.lit(NONE))), "asking")
        blocks = spread(asking, "row", "qb", q_blocks, "ub", u_blocks)
        pairs = blocks.groupBy("qb", "ub").cogroup(units.groupBy("qb", "ub")).applyInArrow(_bounds(points, top, hi), "row long, unit long, bound double")
        if seen is not None:
            pairs = pairs.join(seen, ["row", "unit"], "left_anti")
        if hi:
            turn = F.row_number().over(Window.partitionBy("row").orderBy("bound", "unit"))
            pairs = pairs.withColumn("turn", turn).filter(F.col("turn") <= hi - lo)
        pairs = stored(pairs.select("row", "unit"), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        # a unit that many queries open is opened by several tasks, each with its part of them
        parts = pairs.groupBy("unit").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
        left = pairs.join(parts, "unit").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).join(asking.select("row", "vec", "least"), "row")
        right = tree.join(parts, "unit").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        right = right.select("unit", "part", "node", "routing", "radius", "parent", "ids", "keys", "dists", "vecs")
        hits = left.select("unit", "part", "row", "vec", "least").groupBy("unit", "part").cogroup(right.groupBy("unit", "part")).applyInArrow(visit, f"row long, score long, key {kind}, hit long")
        both = hits if best is None else hits.unionByName(best.drop("rank"))
        best = stored(both.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), "best")
    return best.join(asked.select("row", "query_id"), "row").select("query_id", "rank", F.col("key").alias(key), "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op13_top_k", SQL)
def op13_top_k(spark, sf):
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)
