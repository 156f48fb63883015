"""Deterministic text vectors and dense matrix helpers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb import rules

RAW_TOKEN = r"[a-z0-9][a-z0-9\-_/]{1,}|[一-鿿]"
RAW = re.compile(RAW_TOKEN)
WORDS = re.compile(r"[^ \t\n\v\f\r]+")
HAN_RUN = re.compile(f"[{rules.HAN_CLASS}]{{2,}}")
HAN_LONGEST = 4
#: Keeps the bytes of raw tokens but Han letters, blanks for all others; first bytes in UTF-8 of Han letters, among others.
RAW_ONLY = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789-_/" else 32 for c in range(256))
MAYBE_HAN = re.compile(rb"[\xe3-\xe9\xef]")
DIM = 256
#: Rows whose tokens are counted at once.
VECTOR_ROWS = 2048


def weigh(low: str, extra: list[str] | None = None) -> dict[str, float]:
    """Weights of a lower-cased text's tokens: raw tokens weigh their count; words, Han n-grams and ``extra`` that are not raw weigh 0.5."""
    out: dict[str, float] = Counter(RAW.findall(low))
    for token in set(WORDS.findall(low)):
        out.setdefault(token, 0.5)
        if len(token) > 2:
            for run in HAN_RUN.findall(token):
                for n in range(2, HAN_LONGEST + 1):
                    for i in range(len(run) - n + 1):
                        out.setdefault(run[i:i + n], 0.5)
    for token in extra or ():
        out.setdefault(token, 0.5)
    return out


def _with_extra(df: DataFrame, key: str, text: str, synonyms: DataFrame | None, keep: list[str] = ()) -> DataFrame:
    """``(key, *keep, low, extra)``: the lower-cased text and the tokens that synonyms add to it."""
    base = df.select(key, *keep, F.lower(F.col(text)).alias("low"))
    if synonyms is None:
        return base.withColumn("extra", F.lit(None).cast("array<string>"))
    from tidekb.operators.enrich import expand_tokens

    return base.join(expand_tokens(df, key, text, synonyms).groupBy(key).agg(F.collect_set("token").alias("extra")), key, "left")


def token_weights(df: DataFrame, key: str, text: str, synonyms: DataFrame | None = None) -> DataFrame:
    """``(key, token, weight)`` of each row's text; nothing is shuffled unless synonyms are given."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, texts, extras = (c.to_pylist() for c in b.columns)
            for k, low, extra in zip(keys, texts, extras):
                w = weigh(low or "", extra)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(w), b.schema.field(0).type), pa.array(list(w), pa.string()), pa.array(list(w.values()), pa.float64())], [key, "token", "weight"])

    return _with_extra(df, key, text, synonyms).mapInArrow(run, f"`{key}` {kind}, token string, weight double")


class _Buckets(dict):
    """Token in UTF-8 -> hash bucket: the token's 256-bit digest modulo ``dim``; a bounded number is remembered."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        digest = hashlib.sha256(token).digest()
        got = self[token] = digest[-1] if self.dim == 256 else int.from_bytes(digest, "big") % self.dim
        return got


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(pieces between blanks, the row of each) of all texts."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    pieces = lists.flatten()
    some = pc.binary_length(pieces).to_numpy() > 0
    return pieces.filter(pa.array(some)).view(pa.binary()), rows[some]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _plain_cells(lows: list[bytes], buckets: _Buckets) -> np.ndarray:
    """Rows x buckets of texts without Han letters: words of all rows are numbered at once, and a bucket is looked up per distinct word."""
    n, dim = len(lows), buckets.dim
    raw, raw_row = _cut([low.translate(RAW_ONLY) for low in lows])
    word, word_row = _cut(lows)
    coded = pa.concat_arrays([raw, word]).dictionary_encode()
    tokens, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    raw_id, word_id = ids[: len(raw)].astype(np.int64), ids[len(raw) :].astype(np.int64)
    # a raw token begins with a letter or digit and has two bytes at least
    size = pc.binary_length(coded.dictionary).to_numpy()
    odd = np.flatnonzero(pc.match_substring_regex(coded.dictionary.view(pa.string()), "^[-_/]").to_numpy(zero_copy_only=False))
    if len(odd):
        at = {t: k for k, t in enumerate(tokens)}
        begun = np.arange(len(tokens))
        for i in odd:
            begun[i] = at.setdefault(t := tokens[i].lstrip(b"-_/"), len(tokens))
            if begun[i] == len(tokens):
                tokens.append(t)
        size = np.r_[size, [len(t) for t in tokens[len(size) :]]]
        raw_id = begun[raw_id]
    long = size[raw_id] > 1
    raw_id, raw_row = raw_id[long], raw_row[long]
    bucket = np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens))
    half = np.setdiff1d(_distinct(word_row * len(tokens) + word_id), _distinct(raw_row * len(tokens) + raw_id), assume_unique=True)
    count = lambda rows, ids: np.bincount(rows * dim + bucket[ids], minlength=n * dim)
    return (count(raw_row, raw_id) + 0.5 * count(half // len(tokens), half % len(tokens))).reshape(n, dim)


def _cells(lows: list[bytes], extras: list, buckets: _Buckets) -> np.ndarray:
    """Rows x buckets: the weights of ``weigh``, summed per bucket. Texts are cut in UTF-8."""
    plain = np.array([not extra and not MAYBE_HAN.search(low) for low, extra in zip(lows, extras)], bool)
    out = np.zeros((len(lows), buckets.dim))
    if plain.any():
        out[plain] = _plain_cells([low for low, p in zip(lows, plain) if p], buckets)
    for i in np.flatnonzero(~plain):
        w = weigh(lows[i].decode(), extras[i])
        at = np.fromiter((buckets[t.encode()] for t in w), np.int64, len(w))
        out[i] = np.bincount(at, weights=np.fromiter(w.values(), float, len(w)), minlength=buckets.dim)
    return out


def text_vectors(df: DataFrame, key: str, text: str, dim: int = DIM, synonyms: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """Sparse unit vectors ``(key, *keep, buckets ARRAY<INT>, weights ARRAY<DOUBLE>)``, at most ``dim`` entries each.

    A vector depends on its own row only, so texts are not shuffled (synonyms are joined if given). Rows without a token are left out.
    """
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches):
        buckets = _Buckets(dim)
        for b in batches:
            for at in range(0, b.num_rows, VECTOR_ROWS):
                part = b.slice(at, VECTOR_ROWS)
                low, extra = part.column(len(keep) + 1), part.column(len(keep) + 2)
                lows = pc.fill_null(low.cast(pa.binary()), b"").to_pylist()
                cells = _cells(lows, extra.to_pylist() if extra.null_count < len(extra) else [None] * len(extra), buckets)
                some = cells.any(1)
                cells = cells[some]
                row, bucket = np.nonzero(cells)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(cells)))]).astype(np.int32)
                weights = (cells / np.sqrt((cells**2).sum(1))[:, None])[row, bucket]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bucket.astype(np.int32), weights)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).filter(pa.array(some)) for i in range(len(keep) + 1)], *lists], [key, *keep, "buckets", "weights"])

    return _with_extra(df, key, text, synonyms, keep).mapInArrow(run, f"{types}, buckets array<int>, weights array<double>")


def list_columns_to_matrix(buckets, weights, dim: int) -> np.ndarray:
    """Two Arrow list columns of (bucket, weight) as rows of a dense matrix."""
    buckets, weights = buckets.combine_chunks(), weights.combine_chunks()
    out = np.zeros((len(buckets), dim))
    sizes = pc.list_value_length(buckets).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(buckets)), sizes), buckets.flatten().to_numpy()] = weights.flatten().to_numpy()
    return out


def unit_rows(vectors, dim: int) -> np.ndarray:
    """Dense vectors as unit rows; a missing or zero vector stays zero."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1.0, norm)
