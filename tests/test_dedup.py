import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidekb.functions.layout import join_spread
from tidekb.functions.vectors import text_vectors, weigh
from tidekb.operators import dedup as D
from tidekb.operators import neighbours as N


def texts(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}x" for i in range(40)]
    base = [" ".join(rnd.choices(vocab, k=30)) for _ in range(8)]
    out = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        out.append((i, rnd.choice(["a", "b"]), " ".join(words)))
    return out + [(n, "a", ""), (n + 1, "a", "")]


def plain_greedy(rows, vecs, threshold):
    leader = {}
    for i, c, _ in rows:
        if i in leader:
            continue
        leader[i] = i
        for j, c2, _ in rows:
            if j > i and c2 == c and j not in leader and i in vecs and j in vecs and vecs[i] @ vecs[j] >= threshold:
                leader[j] = i
    return leader


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1024), (3, 3)])
def test_greedy_groups_equal_plain_scan(spark, seed, block):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "seq long, source_collection string, text string")
    vecs = {}
    for r in text_vectors(df, "seq", "text").collect():
        v = np.zeros(256)
        v[r["buckets"]] = r["weights"]
        vecs[r["seq"]] = v
    got = {r["seq"]: r["leader"] for r in D.greedy_groups(df, block_rows=block).collect()}
    assert got == plain_greedy(rows, vecs, 0.88)


def test_summary_is_independent_of_blocks_and_partitions(spark):
    df = spark.createDataFrame(texts(5), "seq long, source_collection string, text string")
    key = lambda d: sorted((r["seq"], r["n_similar"], r["n_earlier"], r["first_earlier"], round(r["best"], 9)) for r in d.collect())
    one = key(D.similar_rows(df, block_rows=1024))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert key(D.similar_rows(df.repartition(5), block_rows=5)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_pairs(rows, threshold):
    """Brute force over vectors (collection, seq, vector)."""
    out = {}
    for c, i, v in rows:
        hits = [(j, v @ w) for c2, j, w in rows if c2 == c and j != i and v @ w >= threshold]
        if hits:
            earlier = [j for j, _ in hits if j < i]
            out[i] = (len(hits), len(earlier), min(earlier, default=None), round(max(s for _, s in hits), 9))
    return out


def clusters(seed, n, hot):
    """Unit vectors around many directions; ``hot`` of the rows are near copies of one, all in one collection."""
    rng = np.random.default_rng(seed)
    rows = []
    centres = np.abs(rng.standard_normal((8, 64))) * (rng.random((8, 64)) < 0.15)
    for i in range(n):
        k = 0 if i < hot * n else rng.integers(8)
        v = centres[k] + 0.08 * np.abs(rng.standard_normal(64)) * (rng.random(64) < 0.3)
        rows.append(("a" if k == 0 or i % 8 else "b", int(i * 37 % 10_007), v / np.linalg.norm(v)))
    return rows


def vector_table(spark, rows):
    data = [(c, i, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) for c, i, v in rows]
    return spark.createDataFrame(data, "collection string, seq long, buckets array<int>, weights array<double>").repartition(5)


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.9)])
def test_cosine_join_equals_brute_force_and_skips_blocks(spark, seed, hot):
    rows = clusters(seed, 1200, hot)
    blocks = N.vector_blocks(vector_table(spark, rows), 0.88, 64, 32)
    got = {r["seq"]: (r["n_similar"], r["n_earlier"], r["first_earlier"], round(r["best"], 9)) for r in N.neighbour_summary(blocks).collect()}
    assert got == plain_pairs(rows, 0.88)
    kept, all_pairs = blocks.compared()
    assert kept < all_pairs * (0.5 if not hot else 1.0)
    leaders = {r["seq"]: r["leader"] for r in N.greedy_leaders(blocks).collect()}
    want: dict = {}
    for c, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = next((j for c2, j, w in sorted(rows, key=lambda r: r[1]) if c2 == c and j < i and want.get(j) == j and v @ w >= 0.88), i)
    assert leaders == want


@pytest.mark.parametrize("first", [1, 20, 5000])
def test_first_rows_take_all_that_is_similar_to_them(spark, first):
    """Near copies join the first rows' leaders, so that the neighbour table holds none of their pairs; groups are those of the plain scan."""
    rows = clusters(3, 600, 0.8)
    table = vector_table(spark, rows)
    vec = {i: (c, v) for c, i, v in rows}
    left, done, n, joined = N.first_leaders(N.vector_blocks(table, 0.88, 64, 32), first)
    seqs = {c: sorted(i for c2, i, _ in rows if c2 == c) for c in "ab"}
    firsts = {i for c in "ab" for i in seqs[c][:first]}
    led = {int(i): int(j) for r in done.collect() for i, j in zip(np.frombuffer(r["seqs"], np.int64), np.frombuffer(r["leaders"], np.int64))}
    heads = {i for i in firsts if led[i] == i}
    rest = {int(i) for r in left.index.collect() for i in np.frombuffer(r["seqs"], np.int64)}
    assert len(rest) == n and len(led) == len(firsts) + joined and not rest & led.keys() and len(rest) + len(led) == len(rows)
    assert all(vec[i][0] != vec[j][0] or vec[i][1] @ vec[j][1] < 0.88 for i in rest for j in heads)
    assert joined > 300 or first == 5000
    want: dict = {}
    for c, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = next((j for j in seqs[c] if j < i and want.get(j) == j and v @ vec[j][1] >= 0.88), i)
    assert all(want[i] == j for i, j in led.items())
    assert {r["seq"]: r["leader"] for r in N.greedy_leaders(N.vector_blocks(table, 0.88, 64, 32), first).collect()} == want


def test_vectors_of_whole_batches_equal_the_weights_of_each_text(spark):
    """Texts are cut for a batch at once: words, raw tokens that begin inside a word, Han letters and blanks of other kinds as in ``weigh``."""
    rnd = random.Random(3)
    rows = [(i, "x", "".join(rnd.choices("ab z09-_/,.\n\t\x1c\x85 中文字數åé㐀豈", k=rnd.randrange(50)))) for i in range(300)] + [(300, "x", None), (301, "x", " -- a")]
    df = spark.createDataFrame(rows, "seq long, kind string, text string")
    got = {r["seq"]: (r["kind"], r["buckets"], r["weights"]) for r in text_vectors(df, "seq", "text", keep=["kind"]).collect()}
    want = {}
    for i, _, t in rows:
        cells = np.zeros(256)
        for token, w in weigh((t or "").lower()).items():
            cells[hashlib.sha256(token.encode()).digest()[-1]] += w
        if cells.any():
            at = np.flatnonzero(cells)
            want[i] = ("x", at.tolist(), (cells[at] / np.sqrt((cells**2).sum())).tolist())
    assert got == want


def test_merging_reads_few_members_and_goes_on_until_it_has_enough(spark):
    """One group whose answers are mostly parts of the longest one and whose members share keywords, and small ones: as by a plain scan, though
    answers and keywords are read of the members that come first only."""
    rnd = random.Random(5)
    long = " ".join(f"w{i}" for i in range(60))
    data = []
    for i in range(120):
        g = 1 if i < 90 else 2 + i % 7
        part = long[: 3 * rnd.randrange(1, 40)].strip() if g == 1 and i % 45 else f"own {i} " * rnd.randrange(0, 4)
        data.append((i, g, long if i == 3 else part, [rnd.choice("aAbB") if i < 80 else f"K{i}", " ", "c"]))
    df = spark.createDataFrame([(i, f"s{i}", f"q{i}", a, k, f"f{i}", None) for i, _, a, k in data], "seq long, stable_id string, question string, answer string, keywords array<string>, source_file string, source_date string")
    groups = spark.createDataFrame([(i, g) for i, g, _, _ in data], "seq long, leader long")
    asked = []

    def rows_of(seqs):
        asked.append({r["seq"] for r in seqs.collect()})
        return df.join(seqs, "seq", "left_semi")

    got = {r["leader"]: (r["answer"], r["keywords"], r["source_count"], r["source_file"]) for r in D.merge_groups(df, groups, rows_of).collect()}
    norm = lambda t: re.sub(r"\s+", " ", t)
    want = {}
    for g in {g for _, g, _, _ in data}:
        of = [r for r in data if r[1] == g]
        answers = sorted(((a.strip(), i) for i, _, a, _ in of if a.strip()), key=lambda x: (-len(x[0]), x[1]))
        base = answers[0][0] if answers else ""
        more = [a for a, _ in answers if norm(a) not in norm(base) and norm(base) not in norm(a)][:2]
        words: dict = {}
        for _, _, _, kw in of:
            for w in kw:
                if w.strip():
                    words.setdefault(w.lower(), w)
        want[g] = (base + ("\n\n補充：" + "\n\n".join(more) if more else ""), list(words.values())[:7], len(of), f"f{of[0][0]}")
    assert got == want
    assert len(asked[1]) < 40 and len(asked) > 4  # all members for the narrow rows, then few, and again where these were not enough


def test_tokens_of_one_side_only_fall_away_before_sets_are_compared(spark):
    """Long sets of words that the other side doesn't have are in no block: 3 sets of a side share 6 words, all others have one in common and 30 of their own."""
    some = [f"both{i}" for i in range(6)]
    mk = lambda side: spark.createDataFrame([(f"{side}{k}", [hash(w) for w in some] if k < 3 else [hash("common")] + [hash(f"{side}{k}-{i}") for i in range(30)]) for k in range(40)], "set_id string, marks array<long>")
    for least, n in ((5, 3), (2, 3), (1, 40), (7, 0)):
        got = [s.collect() for s in D._shared([mk("a"), mk("b")], least)]
        assert [len(g) for g in got] == [n, n]
        assert all(len(r["marks"]) == (6 if int(r["set_id"][1:]) < 3 else 1) for g in got for r in g)


def test_rows_of_most_tokens_give_the_threshold(spark, monkeypatch):
    """With a threshold from few rows, the pairs are those of brute force, and only rows that can reach it are compared."""
    rnd = random.Random(9)
    a, b = [[(i + shift, [f"t{k}" for k in rnd.sample(range(60), rnd.randrange(1, 25))]) for i in range(60)] for shift in (0, 1000)]
    mk = lambda rows: spark.createDataFrame(rows, "seq long, toks array<string>")
    asked, plain = [], D._overlapping
    monkeypatch.setattr(D, "_overlapping", lambda *args: asked.append((args[0].count(), args[1].count(), args[2])) or plain(*args))
    monkeypatch.setattr(D, "OVERLAP_FIRST", 10)
    got = [(-r["overlap"], r["new_seq"], r["existing_seq"]) for r in D.top_overlap_pairs(mk(a), mk(b), "seq", "toks", block_rows=16).collect()]
    assert got == sorted((-len(set(x) & set(y)), i, j) for i, x in a for j, y in b)[:5]
    assert asked[0] == (10, 10, 2) and asked[1][2] > 5 and max(asked[1][:2]) < 50


def test_null_collection_is_one_of_its_own(spark):
    rows = [(1, None, "w1 w2 w3 w4"), (2, None, "w1 w2 w3 w4"), (3, "a", "w1 w2 w3 w4"), (4, None, "w1 w2 w3 w4 w4"), (5, "", "w1 w2 w3 w4"), (6, "a", None)]
    df = spark.createDataFrame(rows, "seq long, source_collection string, text string")
    assert {(r["seq"], r["collection"], r["leader"]) for r in D.greedy_groups(df).collect()} == {(1, None, 1), (2, None, 1), (3, "a", 3), (4, None, 1), (5, "", 5), (6, "a", 6)}
    assert {(r["seq"], r["collection"], r["n_similar"]) for r in D.similar_rows(df).collect()} == {(1, None, 1), (4, None, 1)}
    assert D.greedy_groups(df.filter("seq > 9")).collect() == []


def test_join_spread_with_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") < 2700, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    for most in (1, 5, 10_000):
        got = {(r["id"], r["k"], r["m"]) for r in join_spread(left, right, ["k"], "n", most=most).collect()}
        assert got == {(i, 1 if i < 2700 else i, 2699 if i < 2700 else i) for i in range(3000)}


def test_synonyms_weigh_a_half(spark):
    df = spark.createDataFrame([(1, "ctr up")], "seq long, text string")
    syn = spark.createDataFrame([("CTR", ["click rate"])], "term string, synonyms array<string>")
    from tidekb.functions.vectors import token_weights

    got = {r["token"]: r["weight"] for r in token_weights(df, "seq", "text", syn).collect()}
    assert got == {"ctr": 1.0, "up": 1.0, "click rate": 0.5}


@pytest.mark.parametrize("seed", [1, 2])
def test_top_overlap_pairs_brute_force(spark, seed):
    rnd = random.Random(seed)
    make = lambda n: [(i, rnd.sample([f"t{k}" for k in range(25)], rnd.randint(1, 8))) for i in range(n)]
    a, b = make(20), make(25)
    a += [(100 + i, a[0][1]) for i in range(10)]
    pairs = [(len(set(x) & set(y)), i, j) for i, x in a for j, y in b]
    want = sorted([p for p in pairs if p[0] >= 2], key=lambda p: (-p[0], p[1], p[2]))[:5]
    mk = lambda rows: spark.createDataFrame(rows, "seq long, toks array<string>")
    got = [tuple(r) for r in D.top_overlap_pairs(mk(a), mk(b), "seq", "toks").collect()]
    assert sorted(got) == sorted(want)


def test_top_overlap_pairs_with_a_token_in_most_sets(spark):
    """Small blocks, one token in nine sets of ten, copies on both sides, too few pairs, empty sides."""
    rnd = random.Random(8)
    make = lambda n, o: [(o + i, rnd.sample([f"t{k}" for k in range(60)], rnd.randint(1, 20)) + (["every"] if rnd.random() < 0.9 else [])) for i in range(n)]
    a, b = make(70, 0), make(90, 1000)
    b += [(3000 + i, a[3][1]) for i in range(7)]
    pairs = sorted((-len(set(x) & set(y)), i, j) for i, x in a for j, y in b)
    mk = lambda rows: spark.createDataFrame(rows, "seq long, toks array<string>")
    for top in (3, 40):
        got = [(-r["overlap"], r["new_seq"], r["existing_seq"]) for r in D.top_overlap_pairs(mk(a), mk(b), "seq", "toks", top=top, block_rows=16).collect()]
        assert got == [p for p in pairs if p[0] <= -2][:top]
    assert D.top_overlap_pairs(mk([(1, ["x", "y"])]), mk([(2, ["x"])]), "seq", "toks").collect() == []
    assert D.top_overlap_pairs(mk([]), mk(b), "seq", "toks").collect() == []


def test_overlap_counts_leave_out_sets_that_fall_short(spark):
    """Of two blocks, only sets that can reach the threshold with the other block's remaining sets are multiplied out."""
    import pyarrow as pa

    from tidekb.functions.blockstore import to_ipc

    rnd = random.Random(3)
    block = lambda sets: D._Sets(to_ipc(pa.table({"toks": pa.array([[f"t{k}" for k in x] for x in sets]), "marks": pa.array(sets, pa.list_(pa.int64())), "seqs": pa.array([[i] for i in range(len(sets))])})))
    x = [rnd.sample(range(200), rnd.randint(1, 60)) for _ in range(50)] + [[*range(500, 580)], [*range(600, 680)]]
    y = [rnd.sample(range(200), rnd.randint(1, 60)) for _ in range(40)] + [[*range(500, 540)], [*range(700, 780)]]
    for floor in (1, 10, 20, 40, 41):
        want = {(i, j): n for i, a in enumerate(x) for j, b in enumerate(y) if (n := len(set(a) & set(b))) >= floor}
        rows, cols, got = D._counts(block(x), block(y), floor)
        assert {(int(r), int(c)): int(got[i, j]) for i, r in enumerate(rows) for j, c in enumerate(cols) if got[i, j] >= floor} == want
        assert 51 not in rows and 41 not in cols
    assert 50 not in rows and 40 not in cols


def test_merge_takes_longest_and_two_supplements(spark):
    rows = [(1, "i1", "q1", "short one", ["A", "b"]), (2, "i2", "q2", "a much longer base answer", ["B", "c"]), (3, "i3", "q3", "base answer", ["d"]), (4, "i4", "q4", "other text here", ["e"]), (5, "i5", "q5", "tiny", ["f"])]
    df = spark.createDataFrame([(*r, "f", "2024-01-01") for r in rows], "seq long, stable_id string, question string, answer string, keywords array<string>, source_file string, source_date string")
    m = D.merge_groups(df, spark.createDataFrame([(i, 1) for i in range(1, 6)], "seq long, leader long")).first()
    assert m["answer"] == "a much longer base answer\n\n補充：other text here\n\nshort one"
    assert m["keywords"] == ["A", "b", "c", "d", "e", "f"] and m["question"] == "q1" and m["source_count"] == 5


def test_merged_ids_follow_one_rule_for_every_size(spark):
    m = spark.createDataFrame([(1, f"id{i}") for i in range(10)] + [(2, "x"), (2, "y")], "leader long, stable_id string")
    a = {r["leader"]: r["stable_id"] for r in D._group_ids(m).collect()}
    b = {r["leader"]: r["stable_id"] for r in D._group_ids(m.repartition(7)).collect()}
    import hashlib

    def tree(ids):
        parts = {}
        for i in sorted(ids):
            parts.setdefault(hashlib.sha256(i.encode()).hexdigest()[:3], []).append(i)
        pieces = [hashlib.sha256("::".join(parts[p]).encode()).hexdigest() for p in sorted(parts)]
        return hashlib.sha256("::".join(pieces).encode()).hexdigest()[:16]

    assert a == b == {1: tree([f"id{i}" for i in range(10)]), 2: tree(["x", "y"])}
    assert m.agg(F.count("*")).first()[0] == 12
