"""Periodic runs of words: an online sparse dynamic program over diagonals.

A diagonal is a lag: word i is compared with word i - lag. A run of smallest period q is a diagonal on which words match
often enough in a row. Scanning a text from left to right, each word's earlier occurrences lengthen the matches on their
lags; a diagonal whose match ends there is emitted at once if it is long enough.

The program is kept sparse without losing a run. A wanted run of length max(least, exponent * q) has at least
m(q) = length - q matches in a row. Lags up to G, the largest power of two that no m(q) is below, are followed on
G-grams, lags in (G/2, G] for each larger power of two G on G-grams: such a run has m(q) >= 2q > G matches, so its
G-grams recur at lag q, and for no smaller lag, as a gram of q words or more that recurs nearer would give the run a
smaller period. So only the latest earlier occurrence of a gram counts, one per word and size, and grams that
occur once in a text are dropped before the scan. Work grows as n log n, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import BLANKS, query, table
from tidekb.llm.merkle import CRC32
from tidekb.session import ship_package

LEAST, EXPONENT = 24, 3
#: Characters of texts that are scanned together; a longer text is scanned alone.
ROOM = 4_000_000


def first_gram(least: int, exponent: int) -> int:
    """The largest power of two that matches in a row never fall below in a wanted run."""
    fewest = min(max(least - q, (exponent - 1) * q) for q in range(1, max(least, 2) + 1))
    return 1 << (max(1, fewest).bit_length() - 1)


def recurring(ids: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram size, ends of grams, lags to their latest earlier occurrence) by rising size, of grams that recur in their text.

    ids: word numbers, equal words of one text are equal; doc: text number of each word, ascending. Grams of double size are
    pairs of neighbouring grams, so equal numbers mean equal words.
    """
    size, base = 1, first_gram(least, exponent)
    longest = int(np.bincount(doc).max()) if len(doc) else 0
    at = np.arange(len(ids))
    key = ids.astype(np.int64) * (int(doc[-1]) + 1 if len(doc) else 1) + doc
    while len(at):
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[number] > 1
        at, number = at[many], number[many]
        if size >= base and len(at):
            order = np.argsort(number, kind="stable")
            same = number[order][1:] == number[order][:-1]
            ends, lags = at[order][1:][same], (at[order][1:] - at[order][:-1])[same]
            wanted = (lags <= size) & ((lags > size // 2) | (size == base))
            ends, lags = ends[wanted], lags[wanted]
            back = np.argsort(ends, kind="stable")
            yield size, ends[back], lags[back]
        if size >= base and size * exponent > longest:
            return
        place = np.full(len(ids), -1, np.int64)
        place[at] = number
        at = at[at >= size]
        before = place[at - size]
        whole = (before >= 0) & (doc[at - size] == doc[at])
        at, before = at[whole], before[whole]
        key = before * (len(count) + 1) + place[at]
        size *= 2


def scan(size: int, ends: list[int], lags: list[int], least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of one gram size. Words without a recurring gram end every diagonal."""
    active: dict[int, int] = {}  # lag -> length of its match
    last = -2
    for end, lag in [*zip(ends, lags), (1 << 62, 0)]:
        length = active.get(lag, 0) if end == last + 1 else 0
        for other, matched in active.items():
            if (other != lag or not length) and matched + other >= max(least, exponent * other):
                yield last + 1 - matched - other, matched + other, other
        active = {lag: length + 1 if length else size}
        last = end


def runs_of_texts(words: list[list], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text's words, its runs (start, length, period) by start, then period."""
    if exponent < 3:
        raise ValueError("the exponent must be 3 or more: below, a gram's latest occurrence needn't be a run's period")
    known: dict = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for ws in words for w in ws), np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    doc, offset = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for size, ends, lags in recurring(ids, doc, least, exponent):
        for start, length, period in scan(size, ends.tolist(), lags.tolist(), least, exponent):
            k = int(doc[start])
            out[k].append((start - int(offset[k]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[at:a] if a > at else []
        at = max(at, b)
    return kept + words[at:]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT, room: int = ROOM) -> DataFrame:
    """One row per row: key, ``runs`` (array of start, length, period; words from 0; by start, then period) and ``collapsed``.

    A run is a stretch of words with smallest period q and a length of at least max(least, exponent * q) that no
    neighbouring word extends with period q. collapsed: the words outside what runs repeat, joined by one space. Words are
    split at blanks (space, tab, line feeds, return). Null and empty texts have no runs and an empty collapsed text. A text
    lies in one task, whole, whatever its length. Repeated rows and null keys give rows like others; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType
    run_t = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for b in batches:
            sizes = np.diff(np.asarray(pc.binary_length(b.column(1)).fill_null(0)).cumsum() // room, prepend=0)
            edges = [0, *np.flatnonzero(sizes[1:] > 0) + 1, b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(edges, edges[1:]):
                part = b.slice(lo, hi - lo)
                words = [(t.as_py() or b"").split() for t in part.column(1)]
                found = runs_of_texts(words, least, exponent)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
                left = [b" ".join(collapsed(ws, runs)) for ws, runs in zip(words, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, run_t), pa.array(left, pa.binary())], ["k", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    out = rows.mapInArrow(work, f"k {kind.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.select(F.col("k").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; of every tenth document by crc32 of doc_id, the words from some place on repeat with a period."""
    words = F.split(F.trim(F.regexp_replace("text", f"[{BLANKS}]+", " ")), " ")
    crc: Column = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    tailed = (crc % 10 == 0) & F.coalesce(F.col("text").rlike(f"[^{BLANKS}]"), F.lit(False))
    full = docs.select("doc_id", "text", F.floor(crc / 10).alias("_g"), F.when(tailed, words).alias("_w"))
    full = full.withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.expr("_g % _n")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("array_join(transform(sequence(0L, _n - 1), i -> _w[int(if(i < _a, i, _a + (i - _a) % _p))]), ' ')")
    return full.select("doc_id", F.when(F.col("_w").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def best_run(runs: str = "runs") -> Column:
    """The run with the greatest length / period, ties to the smallest start, then period; fractions are compared exactly."""
    better = "r.length * b.period > b.length * r.period or (r.length * b.period = b.length * r.period and (r.start < b.start or (r.start = b.start and r.period < b.period)))"
    return F.expr(f"aggregate({runs}, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or {better}, r, b))")


SQL = f"""
WITH h AS (SELECT doc_id, xor(4294967295, {CRC32.format("doc_id::VARCHAR")}) AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM h),
c AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM c),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
g2 AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o AS w FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g4 AS (SELECT doc_id, i, w || ' ' || lead(w, 2) OVER o AS w FROM g2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g8 AS (SELECT doc_id, i, w || ' ' || lead(w, 4) OVER o AS w FROM g4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g16 AS (SELECT doc_id, i, md5(w || ' ' || lead(w, 8) OVER o) AS w FROM g8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM g16 x JOIN g16 y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i < x.i),
s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM m),
st AS (SELECT doc_id, q, min(i) - q AS start, count(*) + 15 + q AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM st WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM r GROUP BY doc_id),
b AS (SELECT doc_id, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM r) WHERE k = 1),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS txt FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
 sha256(coalesce(t.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op12_periodic_runs", SQL)
def op12_periodic_runs(spark, sf):
    found = periodic_runs(with_tails(table(spark, sf, "documents"))).withColumn("b", best_run())
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
