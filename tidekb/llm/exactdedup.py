"""Exact deduplication as a stateful stream.

Fingerprints (digest, length, stable id, content locator) stream through an aggregation whose state lies in RocksDB on
the executors' disks and in the shared checkpoint; no watermark is set, so no key ever expires. Each micro-batch is
aggregated before the shuffle, hence a key that holds a third of all rows reaches the state as one row per task. Every
hit is then checked on the full normalised bytes, and rows that only share the digest are regrouped by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekb.llm.common import BLANKS, located, numbered, query, shared_path, stored, table

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes megabytes ahead
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: str | Column) -> Column:
    """Each run of blanks becomes one space; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), f"[{BLANKS}]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_seen(spark: SparkSession, folder: str, schema, files_per_batch: int, state: str) -> DataFrame:
    """Stream the fingerprints in ``folder`` through keyed state; one row per digest: the row that stays and the count.

    state: folder of the stream's checkpoint. A later call with the same folder and more files goes on from the state kept there.
    """
    changes = f"{state.rstrip('/')}-changes"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")  # a replayed batch overwrites its own folder

    prints = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    kept = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at_file", "at_row")).alias("first")
    seen = prints.groupBy("digest", "n_bytes").agg(kept, F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        q = seen.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    rows = spark.read.schema(f"digest string, n_bytes long, first {seen.schema['first'].dataType.simpleString()}, n long, batch long").parquet(changes)
    return rows.groupBy("digest", "n_bytes").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, batches: int = 3, slots: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, with ``digest``, ``keep_id``, ``group_size`` and ``kept``.

    Of equal normalised texts the row with the smallest key stays; null keys come last, and rows that repeat a key are
    told apart by their place in the files, so exactly one row of a group is kept. Null texts equal empty ones. An
    empty table gives an empty result. Other columns are passed through unless named like the output.
    The texts of rows whose digest occurs once are never shuffled: a table of at most ``slots`` occupied digest slots,
    the only thing broadcast, sorts most of them out during the scan.
    """
    spark = docs.sparkSession
    docs = located(docs.select(key, text))
    prints = stored(docs.select(F.col(key).alias("id"), "at_file", "at_row", normalised(text).alias("t")).select("id", "at_file", "at_row", F.octet_length("t").cast("long").alias("n_bytes"), digest(F.col("t")).alias("digest")), "prints")
    folder = prints.inputFiles()
    if not folder:
        return prints.select(F.col("id").alias(key), "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    seen = first_seen(spark, folder[0].rsplit("/", 1)[0], prints.schema, max(1, -(-len(folder) // batches)), shared_path(spark, "state"))
    groups = stored(seen.filter("n > 1"), "groups")
    slot = lambda: F.pmod(F.xxhash64("digest"), F.lit(slots)).alias("slot")
    occupied = groups.select(slot()).distinct()
    pair, at = ["digest", "n_bytes"], ["at_file", "at_row"]
    content = docs.select(*at, F.col(key).alias("id"), normalised(text).alias("t")).withColumn("digest", digest(F.col("t"))).withColumn("n_bytes", F.octet_length("t").cast("long"))
    hits = content.withColumn("slot", slot()).join(F.broadcast(occupied), "slot", "left_semi")
    # whole bytes of all rows of a digest: its smallest and largest text must coincide; copies meet before the shuffle
    odd = stored(hits.groupBy(*pair).agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low != high").select(*pair), "odd")
    plain = prints.join(groups.select(*pair, "first", "n"), pair, "left")
    if odd.isEmpty():
        merged = plain.select("*", F.lit(None).cast(groups.schema["first"].dataType).alias("own_first"), F.lit(None).cast("long").alias("own_n"))
    else:
        rows = stored(content.join(odd, pair), "odd-rows")
        own = rows.groupBy(*pair, "t").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *at)).alias("own_first"), F.count("*").alias("own_n"))
        merged = plain.join(rows.join(own, [*pair, "t"]).select(*at, "own_first", "own_n"), at, "left")
    stays = F.coalesce("own_first", "first", F.struct(F.col("id").isNull().alias("no_id"), "id", *at))
    size = F.coalesce("own_n", "n", F.lit(1)).cast("long")
    merged = merged.withColumn("stays", stays)
    kept = (F.col("stays.at_file") == F.col("at_file")) & (F.col("stays.at_row") == F.col("at_row"))
    return merged.select(F.col("id").alias(key), F.col("stays.id").alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "digest", "at_file", "at_row")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns."""
    plain, names = numbered(docs)
    rows = located(plain)
    dropped = exact_dedup(rows.drop("at_file", "at_row"), names[key], names[text]).filter("not kept").select("at_file", "at_row")
    return rows.join(dropped, ["at_file", "at_row"], "left_anti").drop("at_file", "at_row").toDF(*docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{BLANKS}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark, sf):
    return exact_dedup(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
