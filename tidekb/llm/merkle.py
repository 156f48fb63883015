"""Merkle manifest of a table: a content-addressed store of digest-to-children records, and descents from the root.

Rows are leaves; the leaves of a group (a language) form a binary tree, and the groups' roots form another one above.
The tree is stored in segments of ``SEGMENT`` levels: one record per segment, found by the digest of its upper node,
holds each of its nodes' digests with the digests of their children. A leaf request descends from the root: the binary
digits of the group's number, then of the leaf's place in its group, choose a child at every node, and the children
not chosen are collected. Segments are visited top down for whole blocks of requests, so a segment is read once for all
leaves below it; at the end each path is turned round, to run from the leaf to the root.

A node's digest is the hex SHA-256 of its children's hex digests, one after the other; a node may have one child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.functions.blockstore import grouped
from tidekb.functions.ranking import positions
from tidekb.llm.common import query, stored, table
from tidekb.session import ship_package

SEGMENT = 10
#: Requests of one segment digest that a task takes before the digest is salted.
PER_SALT = 256
RECORD = "grp long, block long, levels int, top binary, parents array<binary>, lefts array<binary>, rights array<binary>"


def node_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_text(columns: list[str]) -> Column:
    """What a leaf's digest covers: ``-`` for a null, else byte count, colon, value; integers in decimal."""
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.concat(*parts)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Tree:
    """Trees of all groups: ``roots`` (grp, height, top) and the segment records by round, lowest first."""

    roots: DataFrame
    rounds: list[DataFrame]


@dataclass
class Manifest:
    leaves: DataFrame  # key, grp, place, leaf and what the caller carries
    groups: DataFrame  # group key, grp, height, subroot
    inner: Tree
    outer: Tree
    root: bytes | None


def _segments(batches):
    """One record per block: nodes level by level, each with its one or two children. A lone node in block 0 is a root."""
    for t in grouped(batches, 2):
        block, nodes = t.column(1)[0].as_py(), t.column(3).to_pylist()
        parents, lefts, rights, levels = [], [], [], SEGMENT if block else (len(nodes) - 1).bit_length()
        for _ in range(levels):
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [node_digest(p) for p in pairs]
            parents += nodes
            lefts += [p[0] for p in pairs]
            rights += [p[1] if len(p) > 1 else b"" for p in pairs]
        wide = pa.list_(pa.binary())
        cols = [t.column(0).chunk(0).slice(0, 1), t.column(1).chunk(0).slice(0, 1), pa.array([levels], pa.int32()), pa.array(nodes, pa.binary())]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x], wide) for x in (parents, lefts, rights))], ["grp", "block", "levels", "top", "parents", "lefts", "rights"])


def build(nodes: DataFrame) -> Tree:
    """``nodes``: grp, place (0, 1, ... in each group), digest. Rounds grow with the logarithm of the largest group."""
    sizes = stored(nodes.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    sizes = sizes.select("grp", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int").alias("height"))
    rounds, level = [], nodes.select("grp", "place", "digest")
    for r in range(-(-(sizes.agg(F.max("height")).first()[0] or 0) // SEGMENT)):
        blocks = level.select("grp", F.shiftright("place", SEGMENT).alias("block"), "place", "digest")
        blocks = blocks.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
        records = stored(blocks.mapInArrow(_segments, RECORD), f"segments{r}")
        rounds.append(records.filter("levels > 0"))
        level = records.select("grp", F.col("block").alias("place"), F.col("top").alias("digest"))
    return Tree(stored(level.select("grp", F.col("digest").alias("top")).join(sizes, "grp"), "roots"), rounds)


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> Manifest:
    """Trees over ``leaves``, one per value of ``group`` (null is a value and comes first), and one over their roots.

    Leaves ascend by ``order``; rows equal in it ascend by digest, so repeated rows give the same trees whatever their
    order. Nulls come first. A group may hold all rows: places are found by range partitions, and no group is gathered.
    An empty table has no groups and no root.
    """
    ship_package(leaves.sparkSession)
    base = stored(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    placed = stored(positions(base, [*order, leaf, "_row"], [group], "place", "grp").drop("_row"), "placed")
    inner = build(placed.select("grp", "place", F.col(leaf).alias("digest")))
    outer = build(inner.roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("top").alias("digest")))
    groups = placed.groupBy("grp").agg(F.min(group).alias(group)).join(inner.roots.withColumnRenamed("top", "subroot"), "grp")
    top = outer.roots.first()
    return Manifest(placed, groups, inner, outer, bytes(top["top"]) if top else None)


def _walk(top: bytes, store: dict, places: list[int], levels: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """For each place in a segment: the digest reached and the children not chosen, top down (empty: there was none)."""
    for place in places:
        node, path = top, []
        for s in range(levels - 1, -1, -1):
            left, right = store[node]
            if place >> s & 1:
                node, other = right, left
            else:
                node, other = left, right
            path.append(other)
        yield node, path


HEAD = ["head", "height", "path"]


def _found(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Frontier rows with the record of their digest. Equal segments are one record; a digest asked for often is salted."""
    salts = frontier.groupBy("digest").agg(F.ceil(F.count("*") / PER_SALT).alias("salts"))
    once = records.groupBy("top").agg(F.first(F.struct("levels", "parents", "lefts", "rights")).alias("r"))
    once = once.join(salts, once["top"] == salts["digest"]).select("digest", "r.*", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    asked = frontier.join(salts, "digest").withColumn("salt", F.pmod(F.xxhash64("grp", "block"), F.col("salts"))).drop("salts")
    return asked.join(once, ["digest", "salt"]).drop("salt")


def _step(left: pa.Table, right: pa.Table) -> pa.Table:
    """Requests of one block (left) through its segment (right, one row). A group of one leaf has no segment."""
    at = {c: right.column(c)[0].as_py() if right.num_rows else None for c in right.column_names}
    if not right.num_rows:
        if any(left.column("place").to_pylist()):
            raise ValueError("a request for a place that the tree doesn't have")
        left = left.slice(0, 0)
    store = dict(zip(at["parents"] or (), zip(at["lefts"] or (), at["rights"] or ())))
    walked = list(_walk(at["digest"], store, left.column("place").to_pylist(), at["levels"]))
    out = left.drop_columns(["block"]).append_column("reached", pa.array([x for x, _ in walked], pa.binary()))
    out = out.append_column("head", pa.array([at["head"]] * len(walked), pa.binary()))
    out = out.append_column("height", pa.array([at["height"]] * len(walked), pa.int32()))
    return out.append_column("path", pa.array([at["path"] + p for _, p in walked], pa.list_(pa.binary())))


def descend(tree: Tree, heads: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``reached``, ``head``, ``height`` and ``path``: the leaf digest that the descent ends at, the
    digest of the tree's root, its levels, and the children not chosen, the head's path first, then from the root down.

    heads: grp, path. requests: grp, place (each at most once) and more. The blocks wanted above are the distinct prefixes
    of the places, so a segment is opened once for all requests below it. Entries are empty beside an only child.
    """
    heads = stored(heads.join(tree.roots, "grp").withColumn("head", F.col("top")), "heads")
    wanted = [requests]
    for _ in tree.rounds[1:]:
        wanted.append(stored(wanted[-1].select("grp", F.shiftright("place", SEGMENT).alias("place")).distinct(), "wanted"))
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema]
    alone = heads.filter("height = 0").select("grp", F.col("top").alias("reached"), *HEAD)
    out = requests.filter("place = 0").join(alone, "grp").select(*requests.columns, "reached", *HEAD)
    below = None
    for r in range(len(tree.rounds) - 1, -1, -1):
        here = heads.filter((F.col("height") > r * SEGMENT) & (F.col("height") <= (r + 1) * SEGMENT))
        here = here.select("grp", F.lit(0).cast("long").alias("block"), F.col("top").alias("digest"), *HEAD)
        if below is not None:
            here = here.unionByName(below.select("grp", F.col("place").alias("block"), F.col("reached").alias("digest"), *HEAD))
        wide = wanted[r].withColumn("block", F.shiftright("place", SEGMENT))
        # a head is a frontier row only where a request lies below it
        opened = _found(stored(here.join(wide.select("grp", "block").distinct(), ["grp", "block"]), "frontier"), tree.rounds[r])
        schema = more if r == 0 else ["grp long", "place long"]
        got = wide.groupBy("grp", "block").cogroup(opened.groupBy("grp", "block")).applyInArrow(_step, f"{', '.join(schema)}, reached binary, head binary, height int, path array<binary>")
        below = got if r == 0 else stored(got, "reached")
    return out if below is None else out.unionByName(below)


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (grp, place and more) with ``reached``, ``head`` (subroot), ``height`` and ``path``: the siblings from
    the leaf to the root, each ``{sibling, left}``; sibling is null beside an only child, left: it is the left one.
    """
    heads = m.outer.roots.select("grp", F.array().cast("array<binary>").alias("path"))
    upper = descend(m.outer, heads, m.inner.roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place")))
    down = descend(m.inner, upper.select(F.col("place").alias("grp"), "path"), requests)
    left = "if(i < height, shiftright(place, i), shiftright(grp, i - height)) & 1L = 1L"
    return down.withColumn("path", F.expr(f"transform(reverse(path), (d, i) -> named_struct('sibling', nullif(d, X''), 'left', {left}))"))


def fold(leaf: bytes, path: list[dict]) -> bytes:
    """The root that a leaf and its path lead to."""
    for step in path:
        if step["sibling"] is None:
            leaf = node_digest([leaf])
        else:
            leaf = node_digest([step["sibling"], leaf] if step["left"] else [leaf, step["sibling"]])
    return leaf


def folded(proofs: DataFrame, leaf: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``folded_root`` from column ``leaf``, and ``proof_sha256`` over the siblings in order."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.select(*keep).schema)

    def run(batches):
        for b in batches:
            paths = b.column(b.num_columns - 1).to_pylist()
            roots = [fold(x, p) for x, p in zip(b.column(b.num_columns - 2).to_pylist(), paths)]
            proof = [node_digest([s["sibling"] for s in p if s["sibling"] is not None]) for p in paths]
            cols = [b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(roots, pa.binary()), pa.array(proof, pa.binary())], [*keep, "folded_root", "proof_sha256"])

    return proofs.select(*keep, F.col(leaf).alias("_leaf"), "path").mapInArrow(run, f"{types}, folded_root binary, proof_sha256 binary")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

CRC32 = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda z: ord(z)::BIGINT)),
 lambda c, z: list_reduce([xor(c, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384)))"""

SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
  {{part}}(doc_id::VARCHAR) || {{part}}(source) || {{part}}(lang) AS head, {{part}}(text) AS tail,
  xor(4294967295, {CRC32.format("doc_id::VARCHAR")}) % 7 = 0 AS tampered FROM documents),
l AS (SELECT doc_id, lang, place, tampered, sha256(head || {{part}}(n_chars::VARCHAR) || tail) AS leaf, sha256(head || {{part}}((n_chars + 1)::VARCHAR) || tail) AS forged FROM d),
g AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gp, count(*) OVER () AS k FROM l GROUP BY lang),
up AS (SELECT gp, 0 AS level, place, leaf AS digest, n FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang
  UNION ALL SELECT gp, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY gp, level, place // 2, n),
sub AS (SELECT gp, level AS height, digest AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS level, gp AS place, subroot AS digest, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, place // 2, n),
r AS (SELECT level AS height, digest AS root FROM top WHERE n = 1),
path AS (
  SELECT l.doc_id, u.level, s.digest AS sibling, (l.place >> u.level) & 1 AS odd
  FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN up u ON u.gp = g.gp AND u.place = l.place >> u.level AND u.n > 1
  LEFT JOIN up s ON s.gp = g.gp AND s.level = u.level AND s.place = xor(u.place, 1)
  UNION ALL SELECT l.doc_id, sub.height + u.level, s.digest, (g.gp >> u.level) & 1
  FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN sub ON sub.gp = g.gp JOIN top u ON u.place = g.gp >> u.level AND u.n > 1
  LEFT JOIN top s ON s.level = u.level AND s.place = xor(u.place, 1)),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM path GROUP BY doc_id),
up2 AS (SELECT doc_id, 0 AS level, CASE WHEN tampered THEN coalesce(forged, leaf) ELSE leaf END AS digest FROM l
  UNION ALL SELECT up2.doc_id, up2.level + 1, sha256(CASE WHEN p.odd = 1 THEN coalesce(p.sibling, '') || digest ELSE digest || coalesce(p.sibling, '') END)
  FROM up2 JOIN path p ON p.doc_id = up2.doc_id AND p.level = up2.level),
fin AS (SELECT doc_id, max_by(digest, level) AS folded_root FROM up2 GROUP BY doc_id)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN sub ON sub.gp = g.gp JOIN r ON true JOIN fin ON fin.doc_id = l.doc_id LEFT JOIN proof ON proof.doc_id = l.doc_id
"""


def _sql() -> str:
    """SQL without macros: each ``{part}(x)`` becomes the text of one leaf column."""
    import re

    out = SQL
    while (m := re.search(r"\{part\}\(", out)) is not None:
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        x = out[m.end() : end - 1]
        out = f"{out[: m.start()]}coalesce(strlen({x}) || ':' || {x}, '-'){out[end:]}"
    return out


def checked_documents(docs: DataFrame) -> DataFrame:
    """The contract of op11 over the columns of ``COLUMNS``; other columns are ignored.

    Null columns are ``-`` in their leaf; a null doc_id sorts first and its crc32 is that of empty text; repeated rows are
    leaves like others; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    shown = F.when((crc % 7 == 0) & F.col("n_chars").isNotNull(), digest(_forged_text()))
    leaves = docs.select("doc_id", "lang", digest(leaf_text(COLUMNS)).alias("leaf"), shown.alias("shown"))
    m = manifest(leaves, "lang", ["doc_id"])
    proofs = prove(m, m.leaves.select("grp", "place", "doc_id", "leaf", F.coalesce("shown", "leaf").alias("shown")))
    out = folded(proofs, "shown", ["doc_id", "leaf", "head"]).withColumnRenamed("head", "subroot")
    root = F.lit(m.root.hex() if m.root else None).cast("string").alias("root")
    low = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "proof_sha256", "folded_root")}
    out = out.select("doc_id", low["leaf"], low["subroot"], root, low["proof_sha256"], low["folded_root"])
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _forged_text() -> Column:
    """Leaf text of a row whose n_chars is one too large."""
    more = (F.col("n_chars") + 1).cast("string")
    parts = [leaf_text([c]) if c != "n_chars" else F.concat(F.octet_length(more).cast("string"), F.lit(":"), more) for c in COLUMNS]
    return F.concat(*parts)


@query("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark, sf):
    return checked_documents(table(spark, sf, "documents"))
