import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.functions import scoring
from tidekb.operators import search as S

KB = ("seq long, question string, answer string, keywords array<string>, synonyms array<string>, embedding array<double>, freshness_score double, retrieval_surface_text string, retrieval_phrases array<string>, "
      "categories array<string>, intent_labels array<string>, scenario_tags array<string>, serving_tier string, booster_target_queries array<string>, hard_negative_terms array<string>")


def row(seq, question, keywords=(), vec=(1.0, 0.0), tier="canonical", cats=(), intents=(), fresh=1.0, syn=(), targets=(), neg=()):
    return (seq, question, "answer", list(keywords), list(syn), list(vec), fresh, question, [], list(cats), list(intents), [], tier, list(targets), list(neg))


@pytest.fixture()
def kb(spark):
    return spark.createDataFrame([
        row(1, "fix schema markup", ["schema"], cats=["技術SEO"], intents=["implementation"]), row(2, "fix schema markup!", ["schema"], cats=["技術SEO"], intents=["implementation"]),
        row(3, "news traffic drop", ["news"], cats=["Discover與AMP"], intents=["diagnosis"]), row(4, "unrelated", [], vec=(0.0, 1.0), tier="supporting"),
        row(5, "targeted", ["ctr"], tier="booster", targets=["schema"]), row(6, "missed", ["ctr"], tier="booster", targets=["zzz"]), row(7, "no vector", ["schema"], vec=(0.0, 0.0))], KB)


@pytest.fixture()
def qs(spark):
    return spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(["fix schema and news", "why ctr fell", "amp page", "x", "schema"])], "query_id long, query string, query_vector array<double>")


def by_rank(df):
    return sorted((r["query_id"], r["rank"], r["seq"], round(r["score"], 6)) for r in df.collect())


def test_batches_do_not_change_results(kb, qs):
    make, needs = S.hybrid_scorer()
    run = lambda n: by_rank(S.top_k(kb, qs, ["query", "query_vector"], make, 3, needs, max_rows=n))
    assert run(2048) == run(2) and len({r[0] for r in run(2)}) == 5


def test_partitions_do_not_change_results(kb, qs):
    assert by_rank(S.hybrid_search(kb.repartition(1), qs, 4)) == by_rank(S.hybrid_search(kb.repartition(5), qs, 4))


def test_keyword_layers():
    q = scoring.QueryTexts(["how to fix core web vitals", "xco yes"])
    boost = lambda kws: list(q.keyword_boost([kws])[0])
    assert boost(["core web"]) == [0.1, 0.05]  # contained; first two characters of the keyword
    assert boost(["vitals report"]) == [0.1, 0.0]  # a keyword word in the query
    assert boost(["prefix-fixing"])[0] == pytest.approx(0.1)  # a query word inside the keyword
    assert boost(["core", "web", "vitals", "fix"])[0] == pytest.approx(0.3)  # three hits at most
    assert boost([""]) == [0.0, 0.0]


def test_substrings_find_every_word_inside():
    words = ["a", "ab", "bc", "abc", "zz", "é"]
    find = scoring.Substrings(words)
    for s in ("abcab", "", "zzé", "q"):
        assert sorted(find(s)) == sorted(i for w, i in find.pos.items() if w in s)
    assert scoring.Substrings([])("abc") == ()


def test_tier_priors(kb, spark):
    q = spark.createDataFrame([(1, "schema")], "query_id long, query string")
    s = {r["seq"]: r["score"] for r in S.hybrid_search(kb, q, 10, -9.0, semantic=False, parts=(), freshness=False).collect()}
    assert s[5] == pytest.approx(rules.TIER_BOOSTER_HIT) and s[6] == pytest.approx(rules.TIER_BOOSTER_MISS) and s[4] == pytest.approx(rules.TIER_SUPPORTING)


def plain_rerank(cands, query, k):
    """Direct restatement of the selection rule for one query."""
    terms = scoring.words_of(query)
    cats = scoring.infer_labels(query.lower(), rules.QUERY_CATEGORY_HINTS)
    chosen, left = [], list(cands)
    while left and len(chosen) < k:
        best, best_i = None, None
        for i, c in enumerate(left):
            s = c["score"]
            sig = lambda x: "".join(ch for ch in x["question"].lower() if ch.isalnum() or ch == "_")[:120]
            if sig(c) in {sig(x) for x in chosen}:
                s -= 0.25
            fresh = len([x for x in c["categories"] if x in cats and not any(x in y["categories"] for y in chosen)])
            s += (0.12 if fresh == 1 else 0.18) if fresh else 0
            if c["intent_labels"] and not any(i2 in y["intent_labels"] for y in chosen for i2 in c["intent_labels"]):
                s += 0.04
            seen = {t for y in chosen for t in terms if t in y["retrieval_surface_text"].lower()}
            new = len({t for t in terms if t in c["retrieval_surface_text"].lower()} - seen)
            if new and terms:
                s += min(new * 0.01, 0.04) if len(terms) >= 8 else min(new * 0.015, 0.06) if len(terms) >= 5 else min(new * 0.02, 0.08)
            s = round(s, 9)
            if best is None or s > best:
                best, best_i = s, i
        chosen.append({**left.pop(best_i), "final": best})
    return [(c["seq"], round(c["final"], 6)) for c in chosen]


def test_diversity_rerank_equals_plain_selection(kb, qs):
    cand = S.hybrid_search(kb, qs, 15, 0.0, S.RERANK_COLS)
    got = by_rank(S.diversify(cand, qs, 5))
    texts = {r["query_id"]: r["query"] for r in qs.collect()}
    by_q = {}
    for r in sorted(cand.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append(r.asDict())
    want = [(q, i + 1, s, v) for q, cs in by_q.items() for i, (s, v) in enumerate(plain_rerank(cs, texts[q], 5))]
    assert got == sorted(want)


def test_vector_search_skips_missing_and_non_positive(kb, qs):
    got = {r["seq"] for r in S.vector_search(kb, qs, 10).collect()}
    assert got == {1, 2, 3, 5, 6}


def test_preferred_category_spreads(spark):
    h = spark.createDataFrame([(1, 1, 10, "a", ["a", "b"], ["a", "b"]), (1, 2, 11, "a", ["a", "b"], ["a", "b"]), (1, 3, 12, "c", ["a"], ["a", "b"]), (1, 4, 13, "d", ["d"], ["a", "b"])],
                              "query_id long, rank int, seq long, category string, categories array<string>, query_categories array<string>")
    assert [r["preferred"] for r in S.preferred_categories(h).orderBy("rank").collect()] == ["a", "b", "a", "d"]


def test_lexical_search_needs_a_lexical_hit(kb, spark):
    q = spark.createDataFrame([(1, "schema"), (2, "qqq")], "query_id long, query string")
    t = spark.createDataFrame([(1, "schema"), (2, "qqq")], "query_id long, token string")
    got = S.lexical_search(kb, q, t, 5).collect()
    assert {r["query_id"] for r in got} == {1} and got[0]["rank"] == 1 and got[0]["seq"] == 1


def test_search_without_queries_is_empty_and_many_batches_agree(spark):
    rows = spark.createDataFrame([(i, f"question {i}", f"answer {i % 7} word{i}", [f"kw{i % 5}"]) for i in range(50)], "seq long, question string, answer string, keywords array<string>")
    qs = spark.createDataFrame([(i, f"word{i} kw{i % 5}") for i in range(40)], "query_id long, query string")
    none = S.naive_search(rows, qs.limit(0))
    assert none.count() == 0 and none.columns == S.naive_search(rows, qs).columns
    want = sorted(map(tuple, S.naive_search(rows, qs).collect()))
    old = S.top_k.__defaults__
    S.top_k.__defaults__ = (*old[:-1], 7)
    try:
        assert sorted(map(tuple, S.naive_search(rows, qs).collect())) == want
    finally:
        S.top_k.__defaults__ = old


def test_inverted_file_probes_and_hot_list(spark):
    """Most rows in one list, blocks of few rows; all lists probed give the full search, few lists a part of it."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[0 if i % 10 else i // 10 % 8] + 0.2 * rng.standard_normal(8)).tolist(), "c") for i in range(600)] + [(900, None, "c"), (901, [0.0] * 8, "c")]
    kb = spark.createDataFrame(rows, "seq long, embedding array<double>, category string")
    qs = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(25)], "query_id long, query_vector array<double>")
    centres = np.eye(8)
    index = S.inverted_file(kb, centres, keep=["category"], rows=50)
    key = lambda d: sorted((r["query_id"], r["rank"], r["seq"], round(r["score"], 9)) for r in d.collect())
    full = S.vector_search(kb, qs, 4)
    assert key(S.probe_search(index, kb.schema, qs, centres, 4, 8)) == key(full)
    part = S.probe_search(index, kb.schema, qs, centres, 4, 2, keep=["category"])
    recall = S.recall_against(full, part).agg(F.avg("recall")).first()[0]
    assert 0.3 < recall < 1 and {r["category"] for r in part.collect()} == {"c"}
    assert S.probe_search(index, kb.schema, qs.filter("query_id < 0"), centres, 4).collect() == []


def test_five_thousand_queries(spark):
    """Many query blocks against the rows: the same as a plain scan."""
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((300, 6)), rng.standard_normal((5000, 6))
    kb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, embedding array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query_vector array<double>")
    cos = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, S.SCORE_DIGITS)
    got = {(r["query_id"], r["rank"]): r["seq"] for r in S.vector_search(kb, qs, 2).collect()}
    want = {(i, k + 1): j for i in range(5000) for k, j in enumerate(np.lexsort((np.arange(300), -cos[i]))[:2])}
    assert got == want


def test_bits_equal_plain_relations():
    """Every relation between strings and queries against its plain statement, for more queries than one number has bits."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcñ") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(150)] + ["x" * 80, "ab  c\td"]
    strings = list(dict.fromkeys([word() for _ in range(60)] + [f"{word()} {word()}" for _ in range(60)] + ["", " ", "x" * 70, "ab  c", "Ab", "zz"]))
    q = scoring.QueryTexts(texts)
    low, words = [t.lower() for t in texts], [set(scoring.words_of(t)) for t in texts]
    for s in (x.lower() for x in strings):
        full = [s in t or any(w in s for w in ws) or any(p in t for p in scoring.words_of(s)) for t, ws in zip(low, words)]
        half = [len(s) >= 2 and s[:2] in t and not f for t, f in zip(low, full)]
        assert q.spread(q.having([s]))[0].tolist() == [s in t for t in low], s
        assert q.spread(q.inside([s]))[0].tolist() == [t in s for t in low], s
        assert q.spread(q.word_within([s]))[0].tolist() == [any(w in s for w in ws) for ws in words], s
        if s:
            assert q._sums(scoring.Tokens([[s]]), q.hit([s]), (2, 1))[0].tolist() == [2 * f + h for f, h in zip(full, half)], s
    rows = [" ".join(rng.choices(strings, k=5)) for _ in range(40)] + ["", texts[3]]
    assert q.whole(rows).tolist() == [[t in r.lower() for t in low] for r in rows]
    ix = scoring.TermIndex(words)
    assert ix.contained([*rows, None]).tolist()[:-1] == [[sum(w in r.lower() for w in ws) for ws in words] for r in rows]
    lists = [rng.choices(strings, k=rng.randint(0, 9)) for _ in range(40)] + [None]
    assert q.count_of(lists, q.having).tolist() == [[sum(s.lower() in t for s in ls or () if s) for t in low] for ls in lists]


def test_few_query_blocks_stream_past_the_rows(kb, qs):
    """Nothing of the corpus is written when a task can hold the queries."""
    plan = S.hybrid_search(kb, qs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "corpus" not in plan and "MapInArrow" in plan


def test_look_up_of_a_dictionary(spark):
    from tidekb.functions.lookup import entries_of

    d = spark.createDataFrame([("a", ["x", "y"]), ("a", ["z"]), ("b", ["y", "é"]), ("c", []), (None, ["n"])], "term string, entries array<string>")
    rows = spark.createDataFrame([(1, ["a", "b", "q"]), (2, []), (3, None), (4, ["c", "b", "b"])], "seq long, words array<string>")
    got = {r["seq"]: r["found"] for r in rows.select("seq", entries_of("words", d).alias("found")).collect()}
    assert got == {1: ["x", "y", "z", "é"], 2: [], 3: [], 4: ["y", "é"]}
    assert rows.select(entries_of("words", d.filter("false")).alias("f")).first()["f"] == []


def test_occurrences_match_brute_force():
    rng = np.random.default_rng(5)
    words = ["a", "ab", "ba", "abab", "b" * 16, "b" * 17, "b" * 16 + "a", "b" * 40, "ß", "ñandú", "零點", "點", "é"]
    strings = ["", "ab", "b" * 50, "xñandúx", "零點ab", "é" * 3] + ["".join(rng.choice(list("abßñ點é零"), rng.integers(0, 30))) for _ in range(300)]
    got = {(int(s), int(w)) for part in scoring.Occurrences(words)(pa.array(strings)[0:]) for s, w in zip(*part)}
    assert got == {(i, j) for i, s in enumerate(strings) for j, w in enumerate(words) if w in s}
    assert {(int(s), int(w)) for part in scoring.Occurrences(words)(pa.array(strings)[1:3]) for s, w in zip(*part)} == {(i - 1, j) for i, j in got if i in (1, 2)}
    assert not list(scoring.Occurrences([])(pa.array(strings))) and not list(scoring.Occurrences(words)(pa.array([], pa.string())))


def test_lowered_is_python_lower():
    words = ["ABC", "ÄÖ", "İx", "ΑΣ", "straße", "", "K"]
    assert scoring.lowered(pa.array(words)).to_pylist() == [w.lower() for w in words]


def test_capped_sums_leave_settled_rows():
    """Entries behind the first ones are weighed only for rows whose sum is below its cap, with the same sums."""
    q = scoring.QueryTexts(["alpha beta", "gamma delta"])
    full = [f"alpha{i}gamma" for i in range(scoring.FIRST_ENTRIES)] + [f"late{i}" for i in range(50)]
    open_row = [f"none{i}" for i in range(scoring.FIRST_ENTRIES)] + ["alpha", "deltas", "al"]
    lists = [full, open_row, None, []]
    got = q.keyword_boost(pa.array(lists, pa.list_(pa.string())))
    assert not any(f"late{i}" in q.hit.at for i in range(50)) and "deltas" in q.hit.at
    assert got.tolist() == scoring.QueryTexts(q.low).keyword_boost(scoring.Tokens(lists)).tolist()


def test_many_strings_at_once_equal_one_by_one():
    q = scoring.QueryTexts(["how to fix core web vitals", "straße 零點 ab"])
    texts = list(dict.fromkeys([w[i:j] for t in q.low for w in [t] for i in range(len(t)) for j in range(i + 1, min(len(t), i + 9))] + ["zz", "", "fix core", "x y"]))
    assert len(texts) > scoring.TOGETHER
    got = q.spread(q._having(texts)).astype(bool)
    assert got.tolist() == [[s in t for t in q.low] for s in texts]


def test_lexical_rerank_takes_candidates_without_surface(spark):
    fields = "query_id long, rank int, seq long, score double, question string, categories array<string>, intent_labels array<string>"
    cand = spark.createDataFrame([(1, 1, 10, 3.0, "same", ["a"], ["i"]), (1, 2, 11, 2.9, "same", ["a"], ["i"]), (1, 3, 12, 2.0, "other", ["b"], ["k"])], fields)
    rows = S.diversify(cand, spark.createDataFrame([(1, "q")], "query_id long, query string"), 2, "lexical").orderBy("rank").collect()
    assert [r["seq"] for r in rows] == [10, 12] and "retrieval_surface_text" not in S.LEXICAL_RERANK_COLS


def test_parts_of_query_words_and_the_longer_way_agree(monkeypatch):
    """Strings are looked up among all parts of the query words; where these would be too many, in the words themselves."""
    texts = ["how to fix core web vitals", "straße 零點 " + "x" * 70, "", "a  b\tab"]
    strings = list(dict.fromkeys([w[i:j] for t in texts for w in t.split() for i in range(len(w)) for j in range(i + 1, len(w) + 1)] + ["", " ", "zz", "fix core", "xa", "a  b", "x" * 71]))
    near = scoring.QueryTexts(texts)
    monkeypatch.setattr(scoring, "PARTS_BYTES", 0)
    far = scoring.QueryTexts(texts)
    assert near.parts is not None and far.parts is None and max(len(p) for p in near.parts.to_pylist()) == scoring.SUFFIX
    want = [[s in t for t in texts] for s in strings]
    assert len(strings) > scoring.TOGETHER and all(q.spread(q._having(strings)).astype(bool).tolist() == want for q in (near, far))
    assert near.hit(strings[:-1]).tolist() == far.hit(strings[:-1]).tolist()


def test_occurrences_leave_places_where_no_word_begins():
    """Hashes grow only where some word goes on; words that begin alike, end inside others or are longer than the hash are found."""
    words = ["ab", "abc", "abcd" * 6, "abcd" * 5 + "x", "q" * 15, "q" * 16, "q" * 17]
    strings = ["abcd" * 6, "abcd" * 4, "zabc", "q" * 18, "ab", "a", "", "q" * 14 + "ab"]
    find = scoring.Occurrences(words)
    assert sorted(find.longer) == list(range(1, find.LONGEST + 1)) and not find.longer[find.LONGEST].any()
    got = {(int(s), int(w)) for part in find(pa.array(strings)) for s, w in zip(*part)}
    assert got == {(i, j) for i, s in enumerate(strings) for j, w in enumerate(words) if w in s}
