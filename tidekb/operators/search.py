"""Batch top-k search over a Q&A table.

Queries lie in the shared folder as blocks. Few blocks are read by every task, which scores its rows as they stream by; many
meet the rows, then also blocks, in a grid of (query block, row block) items. Tasks keep k rows per query, and only those meet
in one small top-k per query. The driver sees counts and the places of at most ``STREAMED_BLOCKS`` blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidekb import rules
from tidekb.functions.blas import one_thread
from tidekb.functions.blockstore import Reader, dealt, from_ipc, to_ipc, write_blocks, write_rows
from tidekb.functions.layout import spread
from tidekb.functions.ranking import top_per_group
from tidekb.functions.scoring import MetadataScore, QueryTexts, TermIndex, Tokens, cosine, infer_labels, words_of
from tidekb.functions.text import col
from tidekb.functions.vectors import unit_rows
from tidekb.session import written

QUERY_BATCH_ROWS = 2048
QUERY_BATCH_CHARS = 4_000_000
#: Rows of a corpus block, and corpus blocks that a task scores with one scorer.
CORPUS_BLOCK_ROWS, BLOCKS_PER_SCORER = 2048, 8
#: Rows scored at once where they stream by, and the most scores (rows x queries) at once: words that rows share are looked up once.
STREAM_ROWS, STREAM_SCORES = 4096, 1 << 20
SCORE_DIGITS = 9
#: Query blocks that a task holds with their scorers while rows stream by.
STREAMED_BLOCKS = 2

Scorer = Callable[[Callable[[str], list]], np.ndarray]


def query_blocks(queries: DataFrame, columns: list[str], max_rows: int = QUERY_BATCH_ROWS, max_chars: int = QUERY_BATCH_CHARS) -> DataFrame:
    """Index of the queries as blocks of about ``max_rows`` rows and ``max_chars`` characters, dealt by the hash of their id."""
    q = queries.select(*columns)
    chars = F.sum(F.length("query")) if "query" in columns else F.lit(0)
    n, size = q.agg(F.count("*"), F.coalesce(chars, F.lit(0))).first()
    parts = max(1, -(-n // max_rows), -(-size // max_chars))
    q = q.withColumn("qblock", F.pmod(F.xxhash64(columns[0]), F.lit(parts)))
    return write_blocks(q, ["qblock"], columns[:1], lambda t: (to_ipc(t.drop_columns(["qblock"])), {}), "", "queries")


def _best(query: np.ndarray, score: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best per query by (score desc, seq asc)."""
    order = np.lexsort((seq, -score, query))
    q = query[order]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, dtype=bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else np.zeros(0, dtype=int)
    return order[np.arange(len(q)) - first < k]


class Columns:
    """A batch's columns as lists, each converted once, or as Arrow arrays."""

    def __init__(self, rows: pa.Table):
        self.rows, self.lists = rows, {}

    def __call__(self, c: str) -> list:
        if c not in self.lists:
            self.lists[c] = self.rows[c].to_pylist()
        return self.lists[c]

    def arrow(self, c: str) -> pa.Array:
        return pa.concat_arrays(self.rows[c].chunks) if self.rows[c].num_chunks else pa.array([], self.rows.schema.field(c).type)


class _Pool:
    """Best k rows per query of one query block, with the columns that are kept."""

    def __init__(self, ids: pa.Array, k: int, keep: list[str], min_score: float, strict: bool):
        self.ids, self.k, self.keep, self.held = ids, k, keep, None
        self.least, self.strict = np.full(len(ids), min_score), np.full(len(ids), strict)

    def add(self, scores: np.ndarray, rows: pa.Table) -> None:
        """``scores``: rows x queries. Only what reaches the query's k-th best so far is looked at."""
        s = np.round(scores, SCORE_DIGITS)
        row, q = np.nonzero(np.where(self.strict[None, :], s > self.least[None, :], s >= self.least[None, :]))
        if not len(row):
            return
        rows = rows.select(self.keep)
        score, seq = s[row, q], rows["seq"].to_numpy()[row]
        pick = _best(q, score, seq, self.k)
        q, score, rows = q[pick], score[pick], rows.take(pa.array(row[pick]))
        if self.held is not None:
            q, score, rows = np.r_[self.held[0], q], np.r_[self.held[1], score], pa.concat_tables([self.held[2], rows])
        best = _best(q, score, rows["seq"].to_numpy(), self.k)
        q, score = q[best], score[best]
        self.held = (q, score, rows.take(pa.array(best)).combine_chunks())
        full = np.bincount(q, minlength=len(self.ids)) >= self.k
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, q, score)
        self.least[full], self.strict[full] = worst[full], False

    def flush(self, schema: pa.Schema):
        if self.held is not None and len(self.held[0]):
            q, score, rows = self.held
            cols = [self.ids.take(pa.array(q)), rows["seq"], pa.array(score), *(rows[c] for c in self.keep if c != "seq")]
            yield from pa.table(cols, names=schema.names).cast(schema).combine_chunks().to_batches()


def top_k(corpus: DataFrame, queries: DataFrame, columns: list[str], make_scorer, k: int, needs: list[str], keep: list[str] = (),
          min_score: float = float("-inf"), strict: bool = False, max_rows: int = QUERY_BATCH_ROWS) -> DataFrame:
    """Best k rows per query as ``(query_id, rank, seq, score, *keep)``; ties keep row order.

    ``make_scorer(block)`` gets a query block's columns as lists; its scorer gets the ``Columns`` of some rows and returns
    rows x queries. Queries are written as blocks to the shared folder. Up to ``STREAMED_BLOCKS`` are read by every task, and
    the corpus is scored where it is. With more of them the corpus is written as blocks too, and the work is a grid of
    (query block, corpus block) items whose tasks read both inside. A task holds some rows, its query blocks and the best k
    rows of their queries, whatever the sizes of the tables; only those are shuffled.
    """
    asked = query_blocks(queries, ["query_id", *columns], max_rows)
    m = asked.count()
    source = corpus.select(*dict.fromkeys(["seq", *needs, *keep]))
    if m <= STREAMED_BLOCKS:
        return score_stream(source, asked, queries.schema["query_id"], make_scorer, k, keep, min_score, strict)
    source = spread(source, "seq")
    stored = write_rows(source, CORPUS_BLOCK_ROWS, "corpus")
    ask = asked.select("qblock", *[F.col(c).alias(f"q{c}") for c in ("file", "offset", "bytes")])
    n = stored.count()
    parts = max(1, -(-n // BLOCKS_PER_SCORER), min(n, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # every query block meets every part of the corpus; both indexes hold places only
    grid = stored.withColumn("part", F.pmod(F.xxhash64("file", "offset"), F.lit(parts)))
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    items = dealt(grid.join(ask, "part"), ["qblock", "part"], n * m, BLOCKS_PER_SCORER)
    return score_items(items, queries.schema["query_id"], source.schema, make_scorer, k, keep, min_score, strict)


def _found_schema(query_id: T.StructField, fields: T.StructType, extra: list[str]) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_id.dataType), fields["seq"], T.StructField("score", T.DoubleType()), *[fields[c] for c in extra]])


def score_stream(source: DataFrame, asked: DataFrame, query_id: T.StructField, make_scorer, k: int, keep: list[str] = (), min_score: float = float("-inf"), strict: bool = False) -> DataFrame:
    """The best k rows per query of a few query blocks, over rows as they stream by, in the partitions that they have."""
    extra = [c for c in keep if c != "seq"]
    schema = _found_schema(query_id, source.schema, extra)
    arrow_schema = to_arrow_schema(schema)
    places = [(r["file"], r["offset"], r["bytes"]) for r in asked.select("file", "offset", "bytes").collect()]  # at most STREAMED_BLOCKS

    def scan(batches):
        one_thread()
        work = None
        for batch in batches:
            if work is None:
                blocks = [Reader(from_ipc, 1).get(*p) for p in places]
                work = [(make_scorer(b.to_pydict()), _Pool(b["query_id"].combine_chunks(), k, ["seq", *extra], min_score, strict)) for b in blocks]
                step = min(STREAM_ROWS, max(256, STREAM_SCORES // max(1, sum(b.num_rows for b in blocks))))
            for at in range(0, batch.num_rows, step):
                rows = pa.Table.from_batches([batch.slice(at, step)])
                read = Columns(rows)
                for scorer, pool in work:
                    pool.add(scorer(read), rows)
        for _, pool in work or ():
            yield from pool.flush(arrow_schema)

    found = source.mapInArrow(scan, schema)
    return top_per_group(found, "query_id", [F.desc("score"), F.asc("seq")], k)


def score_items(items: DataFrame, query_id: T.StructField, fields: T.StructType, make_scorer, k: int, keep: list[str] = (),
                min_score: float = float("-inf"), strict: bool = False) -> DataFrame:
    """The best k rows per query over work items (qblock, qfile, qoffset, qbytes, file, offset, bytes), each a query block
    that meets a row block. A query may be in several query blocks, but meets a row once."""
    extra = [c for c in keep if c != "seq"]
    schema = _found_schema(query_id, fields, extra)
    arrow_schema = to_arrow_schema(schema)

    def scan(batches):
        one_thread()
        ask, read_rows = Reader(from_ipc, 1), Reader(from_ipc, 1)
        current, scorer, pool = None, None, None
        for batch in batches:
            for item in batch.to_pylist():
                if item["qblock"] != current:
                    if pool is not None:
                        yield from pool.flush(arrow_schema)
                    block = ask.get(item["qfile"], item["qoffset"], item["qbytes"])
                    current, pool = item["qblock"], _Pool(block["query_id"].combine_chunks(), k, ["seq", *extra], min_score, strict)
                    scorer = make_scorer(block.to_pydict())
                rows = read_rows.get(item["file"], item["offset"], item["bytes"])
                pool.add(scorer(Columns(rows)), rows)
        if pool is not None:
            yield from pool.flush(arrow_schema)

    found = items.sortWithinPartitions("qblock", "file", "offset").mapInArrow(scan, schema)
    return top_per_group(found, "query_id", [F.desc("score"), F.asc("seq")], k)


# ---- F1, F2 ----
def _vector_scorer(batch):
    qv = unit_rows(batch["query_vector"], max((len(v) for v in batch["query_vector"] if v is not None), default=1))
    wanted = batch.get("category")

    def score(read):
        s = cosine(qv, read("embedding"))
        if wanted is not None:
            s = np.where(np.array(read("category"), dtype=object)[:, None] == np.array(wanted, dtype=object)[None, :], s, -1.0)
        return s

    return score


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, by_category: bool = False, keep: list[str] = ()) -> DataFrame:
    """Cosine top-k of ``(query_id, query_vector[, category])``; only positive scores."""
    cols, needs = ["query_vector"], ["embedding"]
    if by_category:
        cols, needs = cols + ["category"], needs + ["category"]
    return top_k(corpus.filter(F.col("embedding").isNotNull()), queries, cols, _vector_scorer, k, needs, keep, 0.0, strict=True)


def train_clusters(corpus: DataFrame, lists: int = 50, seed: int = 7) -> np.ndarray:
    """Centroids (``lists`` × dim, a bounded table) of the unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = corpus.filter(F.col("embedding").isNotNull())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    unit = x.select(array_to_vector(F.transform("embedding", lambda v: v.cast("double") / norm)).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(unit)
    return np.array(model.clusterCenters())


def _nearest(centroids: np.ndarray, vectors, n: int) -> np.ndarray:
    """The n nearest lists of each vector, best first."""
    x = unit_rows(vectors, centroids.shape[1])
    return np.argsort((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T, axis=1, kind="stable")[:, :n]


def _with_lists(df: DataFrame, vector: str, centroids: np.ndarray, n: int) -> DataFrame:
    """Every row once for each of its n nearest lists, column ``cluster``."""
    fields = T.StructType([*df.schema.fields, T.StructField("cluster", T.LongType())])
    at = df.columns.index(vector)

    def assign(batches):
        one_thread()
        for rb in batches:
            near = _nearest(centroids, rb.column(at).to_pylist(), n)
            rows = pa.array(np.repeat(np.arange(rb.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in rb.columns), pa.array(near.reshape(-1).astype(np.int64))], names=[*rb.schema.names, "cluster"])

    return df.filter(F.col(vector).isNotNull()).mapInArrow(assign, fields)


def _listed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of at most about ``rows`` rows per list; a list of any size is many blocks."""
    sizes = df.groupBy("cluster").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    key = df.columns[0]
    cut = df.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts"))).drop("_parts")
    return write_blocks(cut, ["cluster", "part"], [key], lambda t: (to_ipc(t.drop_columns(["cluster", "part"])), {}), "", name)


def inverted_file(corpus: DataFrame, centroids: np.ndarray, keep: list[str] = (), rows: int = CORPUS_BLOCK_ROWS) -> DataFrame:
    """The index of an inverted file: every row of ``corpus`` in the blocks of its nearest list. Searches read the blocks of
    the lists that they probe and no others."""
    kept = corpus.select("seq", "embedding", *[c for c in keep if c != "seq"])
    return _listed(written(_with_lists(kept, "embedding", centroids, 1), "assigned"), rows, "lists")


def probe_search(index: DataFrame, fields: T.StructType, queries: DataFrame, centroids: np.ndarray, k: int, probes: int = 5, keep: list[str] = ()) -> DataFrame:
    """Approximate top-k: each query looks only at rows of its ``probes`` nearest lists.

    ``index``: of ``inverted_file``; ``fields``: the corpus's schema. Queries are grouped into blocks by the lists that they
    probe, and joined with the lists' blocks by list.
    """
    asked = _listed(written(_with_lists(queries.select("query_id", "query_vector"), "query_vector", centroids, probes), "probes"), QUERY_BATCH_ROWS, "probes")
    asked = asked.select("cluster", F.xxhash64("cluster", "part").alias("qblock"), *[F.col(c).alias(f"q{c}") for c in ("file", "offset", "bytes")])
    work = written(index.drop("part").join(asked, "cluster"), "items")
    items = dealt(work, ["qblock", F.expr("offset % 7")], work.count(), BLOCKS_PER_SCORER)
    return score_items(items, queries.schema["query_id"], fields, _vector_scorer, k, keep, 0.0, strict=True)


def recall_against(exact: DataFrame, approx: DataFrame) -> DataFrame:
    hit = exact.join(approx.select("query_id", "seq", F.lit(1).alias("_h")), ["query_id", "seq"], "left")
    return hit.groupBy("query_id").agg((F.count("_h") / F.count("*")).alias("recall"))


# ---- F3 - F9 ----
META_COLS = ["retrieval_surface_text", "retrieval_phrases", "categories", "intent_labels", "scenario_tags", "serving_tier", "booster_target_queries", "hard_negative_terms"]


def hybrid_scorer(semantic: bool = True, metadata: bool = True, freshness: bool = True, weight: float = rules.SEMANTIC_WEIGHT,
                  text_match: float = 0.0, parts: tuple[str, ...] = ("keyword", "synonym"), text_chars: int | None = None, max_tokens: int | None = None):
    """(weight · cosine + keyword boost + synonym bonus + metadata score [+ text match]) · freshness."""

    def make(batch):
        q = QueryTexts(batch["query"])
        meta = MetadataScore(batch["query"], text_chars, max_tokens, q) if metadata else None
        qv = unit_rows(batch["query_vector"], max((len(v) for v in batch["query_vector"] if v is not None), default=1)) if semantic else None

        def score(read):
            s = np.zeros((len(read("seq")), q.n))
            if semantic:
                s += weight * cosine(qv, read("embedding"))
            if "keyword" in parts:
                s += q.keyword_boost(read.arrow("keywords"))
            if "synonym" in parts:
                s += q.synonym_bonus(read.arrow("synonyms"))
            if metadata:
                s += meta(read)
            if text_match:
                s += text_match * (q.whole(read("question")) | q.whole(read("answer")))
            if freshness:
                s *= np.array([1.0 if f is None else f for f in read("freshness_score")])[:, None]
            return s

        return score

    needs = (["embedding"] if semantic else []) + (["keywords"] if "keyword" in parts else []) + (["synonyms"] if "synonym" in parts else [])
    needs += (META_COLS if metadata else []) + (["freshness_score"] if freshness else []) + (["question", "answer"] if text_match else [])
    return make, needs


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int, min_score: float = 0.20, keep: list[str] = (), category: str | None = None, **options) -> DataFrame:
    """Hybrid top-k of ``(query_id, query[, query_vector])``. A category mask filters before scoring."""
    make, needs = hybrid_scorer(**options)
    rows = corpus if category is None else corpus.filter(F.array_contains("categories", category))
    cols = ["query"] + (["query_vector"] if options.get("semantic", True) else [])
    return top_k(rows, queries, cols, make, k, needs, keep, min_score)


def over_retrieve(corpus: DataFrame, queries: DataFrame, k: int, min_score: float = 0.10, keep: list[str] = (), **options) -> DataFrame:
    return hybrid_search(corpus, queries, k * rules.OVER_RETRIEVE, min_score, keep, **options)


def keyword_search(corpus: DataFrame, queries: DataFrame, k: int, min_score: float = 0.01, keep: list[str] = (), stored: bool = False, **options) -> DataFrame:
    """Search without vectors. ``stored``: the variant that adds .05 for a text match and keeps every positive score."""
    make, needs = hybrid_scorer(semantic=False, text_match=0.05 if stored else 0.0, **options)
    return top_k(corpus, queries, ["query"], make, k, needs, keep, 0.0 if stored else min_score, strict=stored)


# ---- F8, F11: diversity re-rank of bounded candidate lists ----
RERANK_COLS = ["question", "categories", "intent_labels", "retrieval_surface_text"]
#: The lexical style looks at no surface text, so its candidates carry none.
LEXICAL_RERANK_COLS = RERANK_COLS[:-1]


def _signature(question: str, length: int) -> str:
    import re

    drop = r"\W+" if length == 80 else "[^A-Za-z0-9_一-鿿]+"
    return re.sub(drop, "", question.lower())[:length]


def _pick(n: int, k: int, base: list[float], gain: Callable[[int, list[int]], float]) -> list[tuple[int, float]]:
    """Repeatedly take the candidate with the best base score plus gain; the first wins ties."""
    left, chosen = list(range(n)), []
    taken: list[int] = []
    while left and len(chosen) < k:
        scored = [round(base[i] + gain(i, taken), SCORE_DIGITS) for i in left]
        at = int(np.argmax(scored))
        i = left.pop(at)
        taken.append(i)
        chosen.append((i, scored[at]))
    return chosen


def _novelty(novel: int, total: int) -> float:
    if novel <= 0 or total <= 0:
        return 0.0
    step, cap = (0.01, 0.04) if total >= 8 else (0.015, 0.06) if total >= 5 else (0.02, 0.08)
    return min(novel * step, cap)


def _hybrid_gain(query: str, rows: dict[str, list]):
    terms = words_of(query)
    cats = infer_labels(query.lower(), rules.QUERY_CATEGORY_HINTS)
    sig = [_signature(q, 120) for q in rows["question"]]
    matched = [{t for t in terms if t in (s or "").lower()} for s in rows["retrieval_surface_text"]]
    cat, intent = [x or [] for x in rows["categories"]], [x or [] for x in rows["intent_labels"]]

    def gain(i, taken):
        seen_cats = {c for j in taken for c in cat[j]}
        seen_intents = {c for j in taken for c in intent[j]}
        seen_terms = set().union(*[matched[j] for j in taken]) if taken else set()
        g = -0.25 if sig[i] in {sig[j] for j in taken} else 0.0
        fresh = len([c for c in cat[i] if c in cats and c not in seen_cats])
        g += 0.12 + min(fresh - 1, 1) * 0.06 if fresh > 0 else 0.0
        g += 0.04 if intent[i] and not seen_intents.intersection(intent[i]) else 0.0
        return g + _novelty(len(matched[i] - seen_terms), len(terms))

    return gain


def _lexical_gain(query: str, rows: dict[str, list]):
    sig = [_signature(q, 80) for q in rows["question"]]
    cat, intent = [set(x or []) for x in rows["categories"]], [set(x or []) for x in rows["intent_labels"]]

    def gain(i, taken):
        g = -2.4 if sig[i] in {sig[j] for j in taken} else 0.0
        if cat[i]:
            g += 0.5 if cat[i].isdisjoint(set().union(*[cat[j] for j in taken])) else -0.15
        if intent[i] and intent[i].isdisjoint(set().union(*[intent[j] for j in taken])):
            g += 0.35
        return g

    return gain


def diversify(candidates: DataFrame, queries: DataFrame, k: int, style: str = "hybrid") -> DataFrame:
    """Re-rank ``(query_id, rank, seq, score, *RERANK_COLS)`` per query (lexical: ``LEXICAL_RERANK_COLS``). Lists are at most
    3k rows, cut by top-k before."""
    make_gain, cols_used = {"hybrid": (_hybrid_gain, RERANK_COLS), "lexical": (_lexical_gain, LEXICAL_RERANK_COLS)}[style]
    idt = candidates.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", idt), T.StructField("rank", T.IntegerType()), candidates.schema["seq"], T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def rerank(table):
        t = table.sort_by("rank")
        rows = {c: t[c].to_pylist() for c in ["query_id", "query", "seq", "score", *cols_used]}
        picked = _pick(t.num_rows, k, rows["score"], make_gain(rows["query"][0], rows))
        cols = [[rows["query_id"][i] for i, _ in picked], list(range(1, len(picked) + 1)), [rows["seq"][i] for i, _ in picked], [s for _, s in picked]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, arrow_schema)], schema=arrow_schema)

    c = candidates.select("query_id", "rank", "seq", "score", *cols_used).join(queries.select("query_id", "query"), "query_id")
    return c.groupBy("query_id").applyInArrow(rerank, schema)


def search(corpus: DataFrame, queries: DataFrame, k: int = 5, min_score: float = 0.20, **options) -> DataFrame:
    """Hybrid candidates (3k) and diversity re-rank to k: the whole search request for a batch."""
    cand = hybrid_search(corpus, queries, k * rules.OVER_RETRIEVE, min_score, RERANK_COLS, **options)
    return diversify(cand, queries, k)


# ---- F10 - F14: lexical searches ----
def full_text_search(corpus: DataFrame, queries: DataFrame, k: int, keep: list[str] = ()) -> DataFrame:
    """Rows with every query word, or the query as a keyword, or the query inside the question.

    Rank is the share of the row's words that are query words (our definition).
    """
    import re

    word = re.compile(r"[^\W_]+")

    def make(batch):
        low = [q.lower() for q in batch["query"]]
        sets = [set(word.findall(q)) for q in low]
        ix = TermIndex(sets)
        size = np.array([len(s) for s in sets])
        pos = ix.pos

        def score(read):
            out = np.full((len(read("seq")), len(low)), -1.0)
            for i, (qn, an, kws) in enumerate(zip(read("question"), read("answer"), read("keywords"))):
                toks = word.findall(f"{qn} {an}".lower())
                tf = np.zeros(len(pos))
                for t in toks:
                    p = pos.get(t)
                    if p is not None:
                        tf[p] += 1
                present = (tf > 0) @ ix.incidence
                ranks = (tf @ ix.incidence) / max(1, len(toks))
                hit = (present == size) & (size > 0)
                ql = qn.lower()
                for q, text in enumerate(batch["query"]):
                    if hit[q] or text in (kws or ()) or low[q] in ql:
                        out[i, q] = ranks[q]
            return out

        return score

    return top_k(corpus, queries, ["query"], make, k, ["question", "answer", "keywords"], keep, 0.0)


LEXICAL_FIELDS = [("keywords", 3.2), ("retrieval_phrases", 2.3), ("question", 2.0), ("answer", 0.8), ("retrieval_surface_text", 1.2)]


def lexical_search(corpus: DataFrame, queries: DataFrame, tokens: DataFrame, k: int, candidates: int = 30) -> DataFrame:
    """Metadata-aware lexical search with its own diversity pass.

    ``tokens``: expanded ``(query_id, token)`` of the queries; they are packed per query (a query is short).
    """
    packed = tokens.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    qs = queries.select("query_id", "query").join(packed, "query_id")

    def make(batch):
        ix = TermIndex([set(t) for t in batch["tokens"]])
        q = QueryTexts(batch["query"])
        meta = MetadataScore(batch["query"], asked=q)

        def score(read):
            lex = np.zeros((len(read("seq")), q.n))
            for f, w in LEXICAL_FIELDS:
                cells = read.arrow(f)
                lex += w * ix.shared(Tokens(cells) if pa.types.is_list(cells.type) else Tokens.of_texts(cells))
            s = lex + meta.overlaps(read, (2.2, 1.8, 1.6))
            s += meta.tiers(read, {"canonical": 0.8, "supporting": 0.3, "booster": -0.6}, 0.0, 0.9, -0.6)
            return np.where((lex > 0) & (s > 0), s, -1.0)

        return score

    needs = [f for f, _ in LEXICAL_FIELDS] + META_COLS
    cand = top_k(corpus, qs, ["query", "tokens"], make, max(candidates, k), needs, LEXICAL_RERANK_COLS, 0.0, strict=True)
    return diversify(cand, queries, k, "lexical")


def naive_search(corpus: DataFrame, queries: DataFrame, k: int = 5, keep: list[str] = ()) -> DataFrame:
    """Number of distinct query words that occur anywhere in question, answer or keywords."""

    def make(batch):
        ix = TermIndex([set(words_of(q, 1)) for q in batch["query"]])
        return lambda read: ix.contained([f"{a} {b} {' '.join(c or ())}" for a, b, c in zip(read("question"), read("answer"), read("keywords"))])

    return top_k(corpus, queries, ["query"], make, k, ["question", "answer", "keywords"], keep, 0.0, strict=True)


def substring_search(corpus: DataFrame, queries: DataFrame, k: int, keep: list[str] = ()) -> DataFrame:
    """Whole query inside the question 1.0, inside the answer .5, each keyword containing or contained .3."""

    def make(batch):
        q = QueryTexts(batch["query"])

        def score(read):
            s = q.whole(read("question")) + 0.5 * q.whole(read("answer"))
            return s + 0.3 * q.count_of(read.arrow("keywords"), q.either)

        return score

    return top_k(corpus, queries, ["query"], make, k, ["question", "answer", "keywords"], keep, 0.0, strict=True)


def expand_query_text(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query words plus the dictionary entries whose term or synonym occurs in the query, sorted and joined.

    The dictionary meets the queries through two-character heads of its terms, so only entries that can occur are
    compared.
    """
    q = queries.select("query_id", F.lower("query").alias("q"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda i: F.substring(F.col("q"), i, F.lit(2))))
    grams = q.select("query_id", "q", F.explode(heads).alias("head"))
    entry = synonyms.select(F.lower("term").alias("term"), F.transform("synonyms", F.lower).alias("syns"))
    names = entry.select("term", "syns", F.explode(F.array_union(F.array("term"), "syns")).alias("name")).filter("name <> ''").withColumn("head", F.substring("name", 1, 2))
    hit = grams.join(names, "head").filter(F.contains("q", "name")).select("query_id", F.explode(F.array_union(F.array("term"), "syns")).alias("w"))
    own = q.select("query_id", F.explode(F.regexp_extract_all("q", F.lit(r"\S+"), F.lit(0))).alias("w"))
    return own.unionByName(hit).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("query"))


def enriched_search(corpus: DataFrame, queries: DataFrame, k: int = 5, keep: list[str] = ()) -> DataFrame:
    """Keywords and synonyms hit by the query, times freshness."""

    def make(batch):
        q = QueryTexts(batch["query"], min_len=1)

        def score(read):
            s = q.count_of(read.arrow("keywords"), q.enriched) + q.count_of(read.arrow("synonyms"), q.enriched)
            return s * np.array([1.0 if f is None else f for f in read("freshness_score")])[:, None]

        return score

    return top_k(corpus, queries, ["query"], make, k, ["keywords", "synonyms", "freshness_score"], keep, 0.0, strict=True)


# ---- F15, F16 ----
def multi_query_merge(hits: DataFrame, total: int = 15) -> DataFrame:
    """Best score and hitting queries per row over per-query top lists ``(query_id, seq, score)``, best ``total`` rows."""
    per_row = hits.groupBy("seq").agg(F.max("score").alias("score"), F.array_sort(F.collect_list("query_id")).alias("queries"))
    return per_row.orderBy(F.desc("score"), "seq").limit(total)


def fan_out_queries(alerts: DataFrame, query_map: DataFrame, by: str = "snapshot", line: str = "line", topics: list[str] = rules.REPORT_TOPICS, cap: int = 15) -> DataFrame:
    """``(snapshot, pos, query)`` from flagged metrics in the sheet's line order: mapped queries, else a template; then
    the fixed topics; first occurrences, at most ``cap`` (the report's own limit)."""
    down, up = F.col("flag") == "ALERT_DOWN", F.col("flag") == "ALERT_UP"
    template = F.concat("name", F.when(down, " 下降").when(up, " 上升").otherwise(""))
    j = alerts.join(query_map.select("name", "queries"), "name", "left")
    many = j.select(by, F.lit(0).alias("last"), F.col(line).cast("string").alias("line"), F.posexplode(F.coalesce("queries", F.array("name", template))).alias("qpos", "query"))
    if dict(alerts.dtypes)[line] != "string":
        many = many.withColumn("line", F.lpad("line", 20, "0"))
    fixed = alerts.select(by).distinct().select(by, F.lit(1).alias("last"), F.lit("").alias("line"), F.posexplode(F.array(*map(F.lit, topics)).cast("array<string>")).alias("qpos", "query"))
    first = many.unionByName(fixed).groupBy(by, "query").agg(F.min(F.struct("last", "line", "qpos")).alias("o"))
    return top_per_group(first, by, [F.col("o").asc()], cap, "pos").select(by, "pos", "query")


def gather_rows(fan: DataFrame, hits: DataFrame, by: str = "snapshot", gather: int = 20, keep: int = 8) -> DataFrame:
    """Rows for a report: hits of the fan-out in query order, first-seen distinct, ``gather`` collected and ``keep`` kept."""
    j = fan.join(hits.select("query", "rank", "seq"), "query")
    seen = j.groupBy(by, "seq").agg(F.min(F.struct("pos", "rank")).alias("o"))
    return top_per_group(seen, by, [F.col("o").asc(), F.col("seq").asc()], min(gather, keep), "slot").select(by, "slot", "seq")


def term_queries(alerts: DataFrame, terms: list[str] = rules.BROAD_TERMS, per_metric: int = 3, per_term: int = 2) -> DataFrame:
    """``(query_id, query, wanted)``: the names of flagged metrics with three rows each, and the broad terms that are no
    metric's name with two."""
    names = alerts.select(F.col("name").alias("query")).distinct()
    broad = alerts.sparkSession.createDataFrame([(t,) for t in terms], "query string").join(names, "query", "left_anti")
    both = names.withColumn("wanted", F.lit(per_metric)).unionByName(broad.withColumn("wanted", F.lit(per_term)))
    return both.select(F.col("query").alias("query_id"), "query", "wanted")


def term_rows(corpus: DataFrame, asked: DataFrame, **options) -> DataFrame:
    """Rows of each term of ``term_queries``: ``(query_id, rank, seq, score)`` of keyword searches, ``wanted`` of each."""
    most = asked.agg(F.max("wanted")).first()[0] or 1
    found = keyword_search(corpus, asked.select("query_id", "query"), most, **options)
    return found.join(asked.select("query_id", "wanted"), "query_id").filter("rank <= wanted").drop("wanted")


def stored_search(corpus: DataFrame, queries: DataFrame, k: int = 5, candidates: int | None = None) -> DataFrame:
    """The stored keyword search with its diversity re-rank: rows with a positive score, ``candidates`` (3k) of each query."""
    found = keyword_search(corpus, queries, candidates or k * rules.OVER_RETRIEVE, keep=RERANK_COLS, stored=True)
    return diversify(found, queries, k)


# ---- F17 - F22 ----
def maturity_boost(hits: DataFrame, level: Column | str) -> DataFrame:
    want = col(level)
    s = F.when(want.isNotNull() & F.col("maturity_relevance").eqNullSafe(want), F.col("score") * rules.MATURITY_BOOST).otherwise(F.col("score"))
    return top_per_group(hits.drop("rank").withColumn("score", s), "query_id", [F.desc("score"), F.asc("seq")], 2**31 - 1)


def post_filter(hits: DataFrame, k: int, **equals: str) -> DataFrame:
    """Metadata filter after over-fetch: array columns by membership, others by equality, then the first k per query."""
    kept = hits
    for c, v in equals.items():
        is_array = isinstance(hits.schema[c].dataType, T.ArrayType)
        kept = kept.filter(F.array_contains(c, v) if is_array else F.col(c) == v)
    return top_per_group(kept.withColumnRenamed("rank", "_old"), "query_id", [F.asc("_old")], k).drop("_old")


def preferred_categories(hits: DataFrame, query_cats: str = "query_categories") -> DataFrame:
    """One category per result, spreading the query's categories over the ranks.

    Folds the rank-sorted list of each query (at most k rows).
    """
    item = F.struct("rank", "seq", "category", "categories")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(query_cats).alias("qc"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("used"), none.alias("out"))

    def step(acc, x):
        matched = F.filter(x["categories"], lambda c: F.array_contains(F.col("qc"), c))
        free = F.filter(matched, lambda c: ~F.array_contains(acc["used"], c))
        pick = F.when(F.size(acc["out"]) == 0, x["category"]).otherwise(F.coalesce(F.get(free, F.lit(0)), F.get(matched, F.lit(0)), x["category"]))
        used = F.when(F.array_contains(F.col("qc"), pick), F.array_union(acc["used"], F.array(pick))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(pick)).alias("out"))

    chosen = F.aggregate("items", start, step, lambda a: a["out"])
    return lists.select("query_id", F.inline(F.arrays_zip(F.col("items.rank").alias("rank"), F.col("items.seq").alias("seq"), chosen.alias("preferred")))).toDF(
        "query_id", "rank", "seq", "preferred")


def combine_ranking(hits: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """External ranking ``(query_id, seq, ext_rank)`` first, other hits after it in old order, first k; unknown ids are dropped."""
    j = hits.join(ranking.select("query_id", "seq", "ext_rank"), ["query_id", "seq"], "left").withColumnRenamed("rank", "old_rank")
    return top_per_group(j, "query_id", [F.asc_nulls_last("ext_rank"), F.asc("old_rank")], k)


def retrieval_gate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """correct / ambiguous / incorrect from the best score; queries without hits are incorrect."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    j = queries.select("query_id").join(best, "query_id", "left")
    s = F.col("top_score")
    return j.withColumn("gate", F.when(s >= rules.GATE_CORRECT, "correct").when(s >= rules.GATE_AMBIGUOUS, "ambiguous").otherwise("incorrect"))


def citation_check(df: DataFrame, answer: str, n_sources: Column | str) -> DataFrame:
    refs = F.transform(F.array_distinct(F.regexp_extract_all(col(answer), F.lit(r"\[(\d+)\]"), F.lit(1))), lambda x: x.cast("long"))
    refs = F.array_distinct(refs)
    bad = F.filter("_refs", lambda n: (n < 1) | (n > col(n_sources)))
    out = df.withColumn("_refs", refs)
    return out.withColumn("invalid_refs", bad).withColumn("citation_count", F.size("_refs") - F.size("invalid_refs")).drop("_refs")


# ---- F26 - F29 ----
def relevant_learnings(queries: DataFrame, learnings: DataFrame, k: int = 10) -> DataFrame:
    """Newest ``k`` past records whose text contains a word of the query, as a scan with recency for score.

    ``learnings``: ``(seq, text)`` with ``seq`` growing in time.
    """

    def make(batch):
        ix = TermIndex([set(words_of(q)) for q in batch["query"]])

        def score(read):
            return np.where(ix.contained(read("text")) > 0, np.asarray(read("seq"), dtype=float)[:, None], -1.0)

        return score

    return top_k(learnings, queries, ["query"], make, k, ["text"], (), 0.0)


def context_relevance(contexts: DataFrame, by: str = "query_id") -> DataFrame:
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("freshness_score", F.lit(0.5))))
    return contexts.groupBy(by).agg(F.round(F.avg(f), 2).alias("relevance"))


def is_stale(date: Column | str, ref_date: str, months: int = 18) -> Column:
    age = F.datediff(F.lit(ref_date).cast("date"), col(date).try_cast("date"))
    return F.coalesce(age / 30 > months, F.lit(False))


ANSWER_LABELS = ["What", "Why", "How", "Evidence"]


def answer_blocks(df: DataFrame, answer: str = "answer", whole_if_missing: bool = True) -> DataFrame:
    """Columns what / why / how / evidence of structured answers; a missing label gives the whole answer or null."""
    a = F.col(answer)
    for lab in ANSWER_LABELS:
        hit = F.contains(a, F.lit(f"[{lab}]"))
        part = F.trim(F.regexp_extract(a, rf"(?s)\[{lab}\](.*?)(\[(What|Why|How|Evidence)\]|$)", 1))
        df = df.withColumn(lab.lower(), F.when(hit, part).otherwise(F.trim(a) if whole_if_missing else F.lit(None)))
    return df
