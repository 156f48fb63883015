"""Classification and enrichment columns over a Q&A table (E1-E17). Everything is one JVM projection per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.functions.lookup import entries_of
from tidekb.functions.terms import any_found, count_found, find_terms, labels_found
from tidekb.functions.text import col, words


def _pick_max(scored: list[tuple[str, Column]], default: str) -> Column:
    """Name with the highest score, first wins ties, ``default`` when all are zero."""
    best = F.greatest(*[s for _, s in scored])
    out = F.when(best == 0, default)
    for name, s in scored:
        out = out.when(s == best, name)
    return out


def classify(df: DataFrame, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """Add category, difficulty and evergreen from ``question`` and ``answer``."""
    markers = markers or rules.CATEGORY_MARKERS
    terms = [m for ms in markers.values() for m in ms] + rules.ADVANCED_MARKERS + rules.TIME_SENSITIVE_MARKERS
    base = df.withColumn("_t", F.lower(F.concat_ws("\n", "question", "answer"))).withColumn("_found", find_terms("_t", terms))
    scored = [(n, count_found("_found", ms)) for n, ms in markers.items()]
    advanced = (F.length("answer") >= rules.ADVANCED_MIN_CHARS) | any_found("_found", rules.ADVANCED_MARKERS)
    evergreen = ~F.col("_t").rlike(rules.YEAR_PATTERN) & ~any_found("_found", rules.TIME_SENSITIVE_MARKERS)
    return (
        base.withColumn("category", _pick_max(scored, rules.CATEGORY_OTHER))
        .withColumn("difficulty", F.when(advanced, rules.DIFFICULTY_ADVANCED).otherwise(rules.DIFFICULTY_BASIC))
        .withColumn("evergreen", evergreen).drop("_t", "_found")
    )


MATURITY_TERMS = (rules.MATURITY_L4 + rules.MATURITY_TREND_TOPICS + rules.MATURITY_AI_SEARCH + rules.MATURITY_L4_STRATEGY + rules.MATURITY_L3
                  + rules.MATURITY_L2 + rules.MATURITY_L1 + [rules.MATURITY_FORECAST_TERM] + rules.MATURITY_FORECAST_LOOKALIKES)
PHRASING_TERMS = [t for ts in rules.MATURITY_ADVANCED_PHRASES + rules.MATURITY_BASIC_PHRASES for t in ts]


def maturity_level(df: DataFrame, name: str = "maturity_relevance") -> DataFrame:
    """L1..L4 or null: weighted term hits plus phrasing and length signals, highest level wins ties."""
    full = F.concat_ws(" ", F.lower(F.array_join("keywords", " ")), F.lower("question"), F.lower("answer"))
    base = df.withColumn("_f", find_terms(full, MATURITY_TERMS)).withColumn("_p", find_terms(F.lower("answer"), PHRASING_TERMS))
    has, hits = lambda ts: any_found("_f", ts), lambda ts: count_found("_f", ts)
    phrases = lambda groups: sum((any_found("_p", ts).cast("int") for ts in groups), F.lit(0))
    long_answer, short_answer = F.length("answer") > 500, F.length("answer") < 100
    base = base.withColumn("_adv", phrases(rules.MATURITY_ADVANCED_PHRASES)).withColumn("_strategy", has(rules.MATURITY_L4_STRATEGY))
    base = base.select(
        "*",
        (2 * hits(rules.MATURITY_L4) + hits(rules.MATURITY_TREND_TOPICS) + F.col("_adv")
         + F.when(has(rules.MATURITY_AI_SEARCH) & F.col("_strategy"), 2).otherwise(0)).alias("_raw"),
        (2 * hits(rules.MATURITY_L3) + F.col("_adv") + long_answer.cast("int")).alias("_l3"),
        hits(rules.MATURITY_L2).alias("_l2"),
        (hits(rules.MATURITY_L1) + 2 * phrases(rules.MATURITY_BASIC_PHRASES) + short_answer.cast("int")).alias("_l1"),
        (~has([rules.MATURITY_FORECAST_TERM]) & has(rules.MATURITY_FORECAST_LOOKALIKES)).alias("_lookalike"))
    lowered = F.when(F.col("_lookalike"), F.greatest(F.lit(0), F.col("_raw") - 2)).otherwise(F.col("_raw"))
    backed = (F.col("_adv") > 0) | F.col("_strategy") | long_answer
    l4 = F.when((lowered >= 2) & ~backed, 0).otherwise(lowered)
    top = F.greatest(l4, "_l3", "_l2", "_l1")
    level = (
        F.when(top < 2, None).when(l4 == top, "L4").when(F.col("_l3") == top, "L3").when(F.col("_l2") == top, "L2").otherwise("L1")
    )
    return base.withColumn(name, level).drop("_f", "_p", "_adv", "_strategy", "_raw", "_l3", "_l2", "_l1", "_lookalike")


def freshness(source_date: Column | str, evergreen: Column | str, ref_date: str, floor: float = 0.5,
              rate: float = 0.693, half_life: float = 540.0) -> Column:
    """Exponential decay by age in days against the given reference date; unknown and future dates are fresh."""
    d = col(source_date).try_cast("date")
    age = F.datediff(F.lit(ref_date).cast("date"), d)
    decayed = F.greatest(F.lit(floor), F.bround(F.exp(-rate * age / half_life), 4))
    return F.when(col(evergreen) | d.isNull() | (age <= 0), F.lit(1.0)).otherwise(decayed)


LABEL_TERMS = (
    [h for table in (rules.CATEGORY_HINTS, rules.INTENT_HINTS, rules.SCENARIO_HINTS, rules.EVIDENCE_HINTS) for hs in table.values() for h in hs]
    + [t for groups, _ in rules.CATEGORY_CO_RULES for g in groups for t in g] + [t for _, hs in rules.GRANULARITY_HINTS for t in hs]
)


def infer_categories(df: DataFrame, found: str) -> DataFrame:
    """Multi-label categories in order of discovery, from the column of found label terms, and a confidence by their number."""
    prim = F.col("category")
    hinted = [F.when(any_found(found, hs) & ~prim.eqNullSafe(F.lit(c)), F.lit(c)) for c, hs in rules.CATEGORY_HINTS.items()]
    extra = []
    for groups, adds in rules.CATEGORY_CO_RULES:
        cond = any_found(found, groups[0])
        for g in groups[1:]:
            cond = cond & any_found(found, g)
        extra += [F.when(cond, F.lit(a)) for a in adds]
    cats = F.array_distinct(F.array_compact(F.array(F.when(prim != "", prim), *hinted, *extra)))
    out = df.withColumn("categories", cats)
    n = F.size("categories")
    return out.withColumn("backfill_confidence", F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low"))


def granularity(found: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, hs in rules.GRANULARITY_HINTS:
        out = out.when(any_found(found, hs), name)
    return out.otherwise(rules.GRANULARITY_DEFAULT)


def retrieval_phrases(question: str = "question", keywords: str = "keywords", limit: int = 12) -> Column:
    """Adjacent word pairs of the question, then the keywords, first occurrences, at most ``limit``."""
    toks = words(question)
    pairs = F.when(
        F.size(toks) >= 2,
        F.transform(F.arrays_zip(F.slice(toks, F.lit(1), F.size(toks) - 1).alias("a"), F.slice(toks, F.lit(2), F.size(toks)).alias("b")),
                    lambda p: F.concat_ws(" ", p["a"], p["b"])),
    ).otherwise(F.array().cast("array<string>"))
    kws = F.filter(F.transform(F.col(keywords), F.lower), lambda k: k != "")
    return F.slice(F.array_distinct(F.concat(pairs, kws)), 1, limit)


def retrieval_metadata(df: DataFrame) -> DataFrame:
    """Category, intent, scenario and evidence labels, tier, phrases, surface text and negatives in one projection."""
    text = F.lower(F.concat_ws(" ", F.when(F.col("question") != "", F.col("question")), F.when(F.col("answer") != "", F.col("answer")),
                               F.array_join("keywords", " ")))
    df = infer_categories(df.withColumn("_found", find_terms(text, LABEL_TERMS)), "_found")
    curation = F.lower(F.concat_ws(" ", *[F.col(c) for c in ("manual_curation_tag", "manual_curation_reason") if c in df.columns]))
    tier = (
        F.when(F.contains(curation, F.lit("booster")), "booster")
        .when(F.col("backfill_confidence") == "low", "supporting").otherwise("canonical")
    )
    none = F.array().cast("array<string>")
    df = (
        df.withColumn("intent_labels", labels_found("_found", rules.INTENT_HINTS))
        .withColumn("scenario_tags", labels_found("_found", rules.SCENARIO_HINTS))
        .withColumn("evidence_scope", labels_found("_found", rules.EVIDENCE_HINTS))
        .withColumn("content_granularity", granularity("_found"))
        .withColumn("serving_tier", tier)
        .withColumn("retrieval_phrases", retrieval_phrases())
    )
    surface = F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("question", "answer")],
                          "categories", "intent_labels", "scenario_tags", "keywords")
    return (
        df.withColumn("retrieval_surface_text", surface)
        .withColumn("booster_target_queries", F.when(F.col("serving_tier") == "booster", F.slice("retrieval_phrases", 1, 5)).otherwise(none))
        .withColumn("hard_negative_terms", F.when(F.col("backfill_confidence") == "low",
                                                  F.array(*[F.lit(t) for t in rules.LOW_CONFIDENCE_NEGATIVES])).otherwise(none))
        .drop("_found")
    )


def merge_synonyms(base: DataFrame, supplemental: DataFrame, custom: DataFrame) -> DataFrame:
    """Three layers ``(term, synonyms)`` into one: base ∪ supplemental sorted, custom replaces; ``origin`` names the layer."""
    tagged = (
        base.select("term", "synonyms", F.lit(0).alias("layer"))
        .unionByName(supplemental.select("term", "synonyms", F.lit(1).alias("layer")))
        .unionByName(custom.select("term", "synonyms", F.lit(2).alias("layer")))
    )
    per = tagged.groupBy("term").agg(
        F.max("layer").alias("layer"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("layer") < 2, F.col("synonyms")))))).alias("soft"),
        F.first(F.when(F.col("layer") == 2, F.col("synonyms")), ignorenulls=True).alias("hard"),
    )
    return per.select("term", F.coalesce("hard", "soft").alias("synonyms"),
                      F.when(F.col("layer") == 2, "custom").otherwise("static").alias("origin"))


def expand_keywords(df: DataFrame, synonyms: DataFrame, key: str = "seq") -> DataFrame:
    """Synonyms of a row's keywords, looked up where the rows are; ``expanded`` = keywords ∪ synonyms, ``synonyms`` those that are no keywords."""
    out = df.withColumn("_syn", entries_of("keywords", synonyms.select("term", "synonyms")))
    # sort_array compares natively, array_sort by a lambda
    return out.withColumn("expanded", F.sort_array(F.array_union("keywords", "_syn"))).withColumn("synonyms", F.array_except("_syn", "keywords")).drop("_syn")


def han_ngrams(df: DataFrame, key: str, token: str = "token", max_n: int = 4) -> DataFrame:
    """2..``max_n``-grams of Han runs inside tokens longer than two characters."""
    runs = df.filter(F.length(token) > 2).select(
        key, F.explode(F.regexp_extract_all(F.col(token), F.lit(f"[{rules.HAN_CLASS}]{{2,}}"), F.lit(0))).alias("run"))
    sized = runs.select(key, "run", F.explode(F.array(*[F.lit(n) for n in range(2, max_n + 1)])).alias("n")).filter(F.length("run") >= F.col("n"))
    return sized.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1),
                                                   lambda i: F.substring(F.col("run"), i, F.col("n")))).alias(token))


def _grams_of(runs: Column, n: int) -> Column:
    """All n-grams of an ARRAY<STRING>. A lambda's second parameter would be the place in the array, so ``n`` is none."""
    each = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))
    return F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= n), each))


def token_lists(df: DataFrame, text: str, synonyms: DataFrame, name: str = "tokens") -> DataFrame:
    """Column ``name``: distinct whitespace words and Han n-grams of each text, and one step of synonyms in both directions."""
    low = F.lower(F.col(text))
    own = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0)))
    # a run has no white space, so it lies in one word, and the run of a word of two characters is that word: runs are those of the text
    runs = F.array_distinct(F.regexp_extract_all(low, F.lit(f"[{rules.HAN_CLASS}]{{2,}}"), F.lit(0)))
    grams = [_grams_of(runs, n) for n in (2, 3, 4)]
    seeds = df.withColumn("_own", F.array_distinct(F.concat(own, *grams)))
    pairs = synonyms.select(F.lower("term").alias("term"), F.explode("synonyms").alias("s")).select("term", F.lower("s").alias("syn"))
    links = pairs.select(F.col("term").alias("token"), F.col("syn").alias("other")).unionByName(pairs.select(F.col("syn").alias("token"), F.col("term").alias("other")))
    links = links.groupBy("token").agg(F.collect_set("other").alias("others"))
    return seeds.withColumn(name, F.array_union("_own", entries_of("_own", links))).drop("_own")


def expand_tokens(df: DataFrame, key: str, text: str, synonyms: DataFrame) -> DataFrame:
    """Distinct ``(key, token)`` of ``token_lists``."""
    return token_lists(df.select(key, text), text, synonyms).select(key, F.explode("tokens").alias("token")).distinct()


def corpus_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, token, tf)``: words of two or more characters, single CJK characters and CJK pairs."""
    cjk = rules.CJK_CLASS
    low = F.lower(F.col(text))
    plain = F.regexp_extract_all(F.regexp_replace(low, f"[{cjk}]", " "), F.lit(r"\S{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{cjk}]+"), F.lit(0))
    chars = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))))
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 2), lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return df.select(key, F.explode(F.concat(plain, chars, pairs)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


QUERY_TABLES = {"query_categories": rules.QUERY_CATEGORY_HINTS, "query_intents": rules.QUERY_INTENT_HINTS, "query_scenarios": rules.QUERY_SCENARIO_HINTS}


def query_labels(queries: DataFrame, text: str = "query") -> DataFrame:
    terms = [h for table in QUERY_TABLES.values() for hs in table.values() for h in hs]
    found = queries.withColumn("_found", find_terms(F.lower(text), terms))
    return found.select("*", *[labels_found("_found", t).alias(n) for n, t in QUERY_TABLES.items()]).drop("_found")


def hit_counts(log: DataFrame, kinds: list[str], ident: str = "returned_ids") -> DataFrame:
    """Returned-id counts from log events of the given kinds that carry a top score."""
    kept = log.filter(F.col("event").isin(*kinds) & F.col("top_score").isNotNull())
    return kept.select(F.explode(ident).alias("id")).groupBy("id").agg(F.count("*").alias("search_hit_count"))


def enrich(df: DataFrame, synonyms: DataFrame, hits: DataFrame | None, ref_date: str, key: str = "seq", url_map: DataFrame | None = None) -> DataFrame:
    """The whole enrichment row: labels, maturity, freshness, synonyms, hit count and URL.

    ``hits`` may be None if ``df`` has the column ``search_hit_count`` (joined while its rows were narrow)."""
    if hits is not None:
        df = df.join(hits.withColumnRenamed("id", key).hint("shuffle_hash"), key, "left")
    df = maturity_level(retrieval_metadata(df))
    df = df.withColumn("freshness_score", freshness("source_date", "evergreen", ref_date))
    df = expand_keywords(df, synonyms, key).drop("expanded")
    df = df.withColumn("search_hit_count", F.coalesce("search_hit_count", F.lit(0)))
    if url_map is not None:
        df = df.join(url_map.select("source_file", F.col("url").alias("_mapped")), "source_file", "left")
        df = df.withColumn("source_url", F.when(F.col("source_type") == "article", F.col("source_url")).otherwise(F.col("_mapped"))).drop("_mapped")
    return df


def enrichment_stats(df: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.agg(
        F.count("*").alias("rows"), F.round(F.avg(F.size("synonyms")), 6).alias("avg_synonyms"),
        F.round(F.avg("freshness_score"), 6).alias("avg_freshness"),
        share(F.col("maturity_relevance").isNotNull()).alias("maturity_share"),
        share(F.size("intent_labels") > 0).alias("intent_share"), share(F.size("scenario_tags") > 0).alias("scenario_share"),
        share(F.col("search_hit_count") > 0).alias("hit_share"),
        F.count_if(F.col("backfill_confidence") == "high").alias("n_high"),
        F.count_if(F.col("backfill_confidence") == "medium").alias("n_medium"),
        F.count_if(F.col("backfill_confidence") == "low").alias("n_low"),
    )


def reclassify_l4(df: DataFrame, old: str = "old_level", new: str = "new_level") -> DataFrame:
    """Transition counts of rows that were L4; a missing new level falls to L3."""
    return (
        df.filter(F.col(old) == "L4").withColumn("to_level", F.coalesce(F.col(new), F.lit("L3")))
        .groupBy("to_level").agg(F.count("*").alias("n"))
    )


def source_defaults(df: DataFrame, default_collection: str = "seo-meetings") -> DataFrame:
    c = F.coalesce(F.when(F.col("source_collection") != "", F.col("source_collection")), F.lit(default_collection))
    df = df.withColumn("source_collection", c)
    inferred = F.when(F.col("source_collection") == default_collection, "meeting").otherwise("article")
    return df.withColumn("source_type", F.coalesce(F.when(F.col("source_type") != "", F.col("source_type")), inferred))
