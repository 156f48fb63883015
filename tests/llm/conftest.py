import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VOCABULARY = {
    "en": "the of and house river stone light under water morning window garden winter table letter".split(),
    "fr": "le de et maison rivière pierre lumière sous eau matin fenêtre jardin hiver table lettre".split(),
    "de": "der von und haus fluss stein licht unter wasser morgen fenster garten winter tisch brief".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def documents(n: int = 120, seed: int = 1) -> list[tuple]:
    """Rows with exact and near copies, null and empty columns, repeated rows, a very long text, odd characters."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(VOCABULARY))
        rows.append((i, sentence(rng, lang, rng.randint(3, 80)), lang, rng.choice(["a", "b", "c", None]), 0))
    base = rows[5][1] + " " + sentence(rng, "en", 60)
    rows += [(200, base, "en", "a", 0), (201, base.replace(" ", "  \n"), "en", "b", 0), (202, base + " tail", "en", "a", None), (203, "head " + base, None, "b", 0)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \n\t ", "fr", "b", 0), (303, "12 34 !?", "de", "c", 0), (304, sentence(rng, "en", 30_000), "en", "a", 0)]
    rows += [(305, "日本語 テキスト 🙂 ▁ x", "en", "c", 0), rows[7], rows[7], (None, "the house of stone", "en", "a", 0), (None, rows[3][1], "en", "b", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The rows above with an extra column whose name clashes with outputs, read from several files."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    extra = {"score": F.lit("x"), "taken": F.lit("y"), "size": F.lit("z"), "kept": F.lit("k"), "digest": F.lit("d")}
    spark.createDataFrame(documents(), DOCS).withColumns(extra).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
