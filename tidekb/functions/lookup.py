"""Look-up of a bounded dictionary inside tasks: rows stay where they are.

The dictionary lies in the shared folder as blocks, and each task reads it once, as with a broadcast table; the driver sees
the places of its blocks alone. It has to fit into a task's memory; the rows that ask may be any number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.functions.blockstore import Reader, from_ipc, to_ipc, write_blocks
from tidekb.functions.text import col

BLOCK_TERMS = 20_000
#: Bits of the answers of rows that are worked off at once.
AT_ONCE = 1 << 25


class _Dictionary:
    """Terms and their entries as bits over the sorted distinct entries; read when first used."""

    def __init__(self, places: list[tuple[str, int, int]]):
        self.places, self.terms = places, None

    def __reduce__(self):
        return _Dictionary, (self.places,)

    def read(self) -> None:
        pairs: dict[str, set[str]] = {}
        for p in self.places:
            t = from_ipc(Reader().get(*p))
            for term, entries in zip(t["term"].to_pylist(), t["entries"].to_pylist()):
                pairs.setdefault(term, set()).update(e for e in entries or () if e is not None)
        listed = sorted(set().union(*pairs.values())) if pairs else []
        at = {e: i for i, e in enumerate(listed)}
        self.entries, self.width = pa.array(listed, pa.string()), len(listed)
        self.size = -(-self.width // 8)
        self.ids = [np.fromiter((at[e] for e in es), np.int64, len(es)) for es in pairs.values()]
        self.terms = pa.array(list(pairs), pa.string())

    def __call__(self, lists: pa.Array) -> pa.Array:
        if self.terms is None:
            self.read()
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(flat, self.terms, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        row, term = row[term >= 0], term[term >= 0]
        found, sizes = [], np.zeros(len(lists), np.int64)
        step = max(1, AT_ONCE // max(1, self.width))
        for lo in range(0, len(lists), step):
            a, b = np.searchsorted(row, [lo, lo + step])
            flags = np.zeros((min(step, len(lists) - lo), self.width), bool)
            for r, t in zip((row[a:b] - lo).tolist(), term[a:b].tolist()):
                flags[r, self.ids[t]] = True
            at, which = np.nonzero(flags)
            sizes[lo : lo + step] = np.bincount(at, minlength=len(flags))
            found.append(which)
        values = self.entries.take(pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def entries_of(words: Column | str, dictionary: DataFrame) -> Column:
    """ARRAY<STRING> of the distinct entries, sorted, of all words of an ARRAY<STRING>; ``dictionary``: ``(term, entries)``."""
    d = dictionary.toDF("term", "entries").filter("term IS NOT NULL")
    n = d.count()
    cut = d.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(max(1, -(-n // BLOCK_TERMS)))))
    blocks = write_blocks(cut, ["part"], ["term"], lambda t: (to_ipc(t.drop_columns(["part"])), {}), "", "dictionary")
    look = _Dictionary([(r["file"], r["offset"], r["bytes"]) for r in blocks.select("file", "offset", "bytes").collect()])

    def ask(lists: pa.Array) -> pa.Array:
        return look(lists)

    return F.arrow_udf(ask, "array<string>").asNondeterministic()(col(words))
