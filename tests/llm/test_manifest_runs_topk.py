"""Merkle manifest, periodic runs and M-tree search against plain restatements."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidekb.llm import merkle, periodic, topk


# ---- manifest ----
def hexed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """{(row, how many before are equal): outcome} by building every level as a list."""
    def leaf(r, more=0):
        d, t, la, s, n = r
        return hexed(part(v) for v in (d, s, la, n + more if n is not None else None, t))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hexed(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def up(tree, at):
        path = []
        for lv in tree[:-1]:
            path.append((lv[at ^ 1] if at ^ 1 < len(lv) else None, at & 1))
            at >>= 1
        return path

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in by[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            path = up(trees[g], i) + up(top, k)
            forged = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            node = leaf(r, 1 if forged else 0)
            for sibling, odd in path:
                node = hexed([node] if sibling is None else [sibling, node] if odd else [node, sibling])
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], hexed(s for s, _ in path if s), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, schema, rows):
    df = spark.createDataFrame(rows, schema).withColumn("leaf", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("path", F.lit("y"))
    return sorted((tuple(r) for r in merkle.checked_documents(df.repartition(5)).collect()), key=str)


def test_manifest_matches_plain_lists(spark, docs, no_docs):
    """Null keys and columns, repeated rows, a group of one leaf, a very long text, clashing extra columns."""
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(5000, "lone", "zz", None, 3), (None, None, None, None, None)]
    got = manifest_rows(spark, no_docs.schema, rows)
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_spans_segments(spark, no_docs):
    """A language with nearly all rows has two rounds of segments; many rows are the same, so that segments are equal."""
    rows = [(i, f"text {i}", "en" if i % 40 else f"l{i % 7}", "s", i) for i in range(2200)] + [(9999, "same", "en", "s", None)] * 3500
    assert manifest_rows(spark, no_docs.schema, rows) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one_group(spark, no_docs):
    assert manifest_rows(spark, no_docs.schema, []) == []
    rows = [(i, "t", "en", None, 1) for i in range(5)]
    assert manifest_rows(spark, no_docs.schema, rows) == plain_manifest(rows)
    assert manifest_rows(spark, no_docs.schema, rows[:1]) == plain_manifest(rows[:1])


def test_proofs_for_some_rows_only(spark, no_docs):
    """A caller may ask for a few leaves: only their segments are opened, and folding gives the root."""
    rows = [(i, f"text {i}", "en", "s", i) for i in range(3000)]
    df = spark.createDataFrame(rows, no_docs.schema)
    m = merkle.manifest(df.select("doc_id", "lang", merkle.digest(merkle.leaf_text(merkle.COLUMNS)).alias("leaf")), "lang", ["doc_id"])
    few = merkle.prove(m, m.leaves.filter("doc_id in (0, 1023, 1024, 2999)").select("grp", "place", "doc_id", "leaf")).collect()
    assert len(few) == 4 and all(bytes(r["reached"]) == bytes(r["leaf"]) for r in few)
    assert all(merkle.fold(bytes(r["leaf"]), [s.asDict() for s in r["path"]]) == m.root for r in few)


# ---- runs ----
def plain_runs(ws, least=24, exponent=3):
    n, out = len(ws), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            j = i
            while j < n and ws[j] == ws[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def test_runs_match_every_lag():
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            ws = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 160))]
            for _ in range(rng.randint(0, 3) if len(ws) > 5 else 0):
                a, p, n = rng.randrange(len(ws)), rng.randint(1, 30), rng.randint(1, 150)
                for i in range(a + p, min(len(ws), a + n)):
                    ws[i] = ws[i - p]
            texts.append(ws)
        least, exponent = rng.choice([24, 24, 4, 9, 50]), rng.choice([3, 3, 4, 6])
        assert periodic.runs_of_texts(texts, least, exponent) == [plain_runs(ws, least, exponent) for ws in texts]


def test_runs_of_a_long_uniform_text_stay_linear():
    """200,000 equal words: pairs of occurrences would be 2 * 10^10."""
    assert periodic.runs_of_texts([["x"] * 200_000, ["a", "b"] * 50_000]) == [[(0, 200_000, 1)], [(0, 100_000, 2)]]


def test_exponent_below_three_is_refused():
    with pytest.raises(ValueError):
        periodic.runs_of_texts([["x"]], 24, 2)


def tailed(key, text):
    ws = (text or "").encode().split()
    h, n = zlib.crc32(("" if key is None else str(key)).encode()), len(ws)
    if h % 10 or not n:
        return ws
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [ws[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_query_on_documents(spark, tmp_path, docs):
    """Null keys and texts, empty and very long texts, repeated rows, extra columns, texts with planted repeats."""
    rng = random.Random(2)
    more = [(k, " ".join(["buy now"] * rng.randint(5, 30) + [f"w{rng.randint(0, 9)}" for _ in range(60)] + ["a b c d e"] * rng.randint(2, 8)), "en", "x", 0) for k in range(600, 660)]
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    both = base.unionByName(spark.createDataFrame(more, base.schema)).withColumn("runs", F.lit("r")).withColumn("k", F.lit("k")).withColumn("_w", F.lit(1))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for key, text in both.select("doc_id", "text").collect():
        ws = tailed(key, text)
        runs = plain_runs(ws) if len(ws) < 5000 else periodic.runs_of_texts([ws])[0]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = b" ".join(w for i, w in enumerate(ws) if i not in dropped)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hexed([lines]), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[1] for r in got) > 60


def test_no_documents(spark, tmp_path, no_docs):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert periodic.op12_periodic_runs(spark, str(tmp_path)).collect() == []


# ---- search ----
VECTORS = "vec_id long, embedding array<float>, score string, row string, unit int"


def plain_top(rows, k, asks):
    use = [(i, r[0], np.floor(256 * np.array(r[1], np.float64)).astype(int)) for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, key, q in use:
        if not asks(key):
            continue
        hits = sorted(((-int(q @ v), other is None, other) for j, other, v in use if j != i and len(v) == len(q)), key=lambda h: (h[0], h[1], h[2] or 0))[:k]
        out += [(key, n + 1, h[2], -h[0]) for n, h in enumerate(hits)]
    return sorted(out, key=str)


def found(spark, rows, k=5, every=7):
    df = spark.createDataFrame([(*r, "s", "r", 1) for r in rows], VECTORS).repartition(4)
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k).collect()), key=str)


def test_search_matches_plain_scan(spark):
    """Clusters, copies of a third of all rows, zero vectors, ties, unusable rows, null and repeated keys, two dimensions."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 12))
    vecs = [(centres[i % 6] * rng.choice([0.2, 1.0, 3.0]) + 0.1 * rng.standard_normal(12)).tolist() for i in range(400)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(1000 + i, vecs[3]) for i in range(200)] + [(2000 + i, [0.0] * 12) for i in range(9)]
    rows += [(3000, None), (3003, []), (3010, [None] + vecs[0][1:]), (3017, [float("nan")] * 12), (3024, [float("inf")] + vecs[0][1:]), (None, vecs[5]), (7, vecs[7]), (7, vecs[8])]
    rows += [(4000 + i, rng.standard_normal(3).tolist()) for i in range(20)] + [(4900, [1.0])]
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    assert found(spark, rows) == plain_top(rows, 5, lambda k: k is not None and k % 7 == 0)


def test_search_over_many_units(spark, monkeypatch):
    """Small units, so that cells are cut and waves leave units out."""
    monkeypatch.setattr(topk, "UNIT", 64)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30 if i % 3 else 0] + 0.05 * rng.standard_normal(16)]) for i in range(3000)]
    assert found(spark, rows, 4, 60) == plain_top(rows, 4, lambda k: k % 60 == 0)


def test_few_or_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(7, [1.0, 0.5])]) == []
    assert found(spark, [(7, [1.0, 0.5]), (8, [0.5, -3.0])]) == [(7, 1, 8, 256 * 128 - 128 * 768)]
    assert found(spark, [(7, [1e30, 0.5]), (14, [0.5, -3.0])]) == []  # too long for a score that fits a long


def test_bounds_save_distances():
    """On clustered rows a unit's search computes far fewer distances and scores than it has rows."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.standard_normal((20, 32))[np.arange(2000) % 20] + 0.05 * rng.standard_normal((2000, 32)))).astype("<i4")
    top = float((x.astype(float) ** 2).sum(1).max())
    heart, radius, nodes = topk.unit_nodes(x, top)
    recs = [{"node": -1, "routing": x[heart].tobytes(), "radius": radius, "parent": 0.0, "ids": [], "keys": [], "dists": [], "vecs": b""}]
    recs += [{"node": i, "routing": x[o].tobytes(), "radius": r, "parent": p, "ids": rows.tolist(), "keys": rows.tolist(), "dists": d.tolist(), "vecs": x[rows].tobytes()} for i, (o, r, p, rows, d) in enumerate(nodes)]
    assert sorted(i for r in recs for i in r["ids"]) == list(range(2000))
    unit = topk.Unit(pa.Table.from_pylist(recs), top)
    ask = np.arange(0, 2000, 40)
    owner, score, entry = unit.search(ask, x[ask], 5, np.full(len(ask), topk.NONE))
    for n, i in enumerate(ask):
        scores = x.astype(np.int64) @ x[i].astype(np.int64)
        want = sorted(((-int(s), j) for j, s in enumerate(scores) if j != i))[:5]
        assert [(-s, unit.keys[e]) for s, e in zip(score[owner == n], entry[owner == n])] == want
    assert unit.computed < len(ask) * 2000 / 4
