"""Which terms of a fixed list occur in a text, for whole columns.

One Arrow-batched substring scan fills an array column that all rule tables then share. A chain of
``contains`` per term stays in the JVM but reads the text once per term at a few nanoseconds per byte and makes
plans of thousands of nodes; CPython's ``in`` rejects terms of another character width at once and searches the
rest at memory speed. The functions are marked non-deterministic only to keep the optimizer from copying the scan
into pushed-down filters and collapsed projections.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidekb.functions.text import col

#: Rows of a batch that are Python strings at once.
SLICE = 256


def _sliced(batch: pa.Array):
    for at in range(0, len(batch), SLICE):
        yield from batch.slice(at, SLICE).to_pylist()


def find_terms(text: Column | str, terms: Iterable[str]) -> Column:
    """ARRAY<STRING> of the distinct terms contained in the text, in list order; empty for null."""
    listed = list(dict.fromkeys(terms))

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[t for t in listed if t in x] if x else [] for x in _sliced(texts)], pa.list_(pa.string()))

    return F.arrow_udf(scan, "array<string>").asNondeterministic()(col(text))


def flag_terms(texts: Column | str, terms: Iterable[str]) -> Column:
    """ARRAY<BOOLEAN>, one flag per element of an ARRAY<STRING>: does the element contain any of the terms?"""
    listed = list(dict.fromkeys(terms))

    def scan(lists: pa.Array) -> pa.Array:
        return pa.array([[any(t in x for t in listed) for x in xs] if xs is not None else [] for xs in _sliced(lists)], pa.list_(pa.bool_()))

    return F.arrow_udf(scan, "array<boolean>").asNondeterministic()(col(texts))


def _array(terms: Iterable[str]) -> Column:
    """The terms as one constant: a single folded literal instead of a plan node per term."""
    return F.split(F.lit("\x01".join(dict.fromkeys(terms))), "\x01")


def any_found(found: Column | str, terms: Iterable[str]) -> Column:
    return F.arrays_overlap(col(found), _array(terms))


def count_found(found: Column | str, terms: Iterable[str]) -> Column:
    return F.size(F.array_intersect(col(found), _array(terms)))


def labels_found(found: Column | str, hints: dict[str, list[str]]) -> Column:
    """Labels, in table order, of which at least one hint was found."""
    return F.array_compact(F.array(*[F.when(any_found(found, hs), F.lit(lab)) for lab, hs in hints.items()]))
