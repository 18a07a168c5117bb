"""Exact deduplication through disk-backed streaming state, DataFrame and SQL functions only.

1. Each text gets the digest of its normalised form (A-Z lower-cased); digest, id and
   content locator (file and byte length) go to a slim table in the shared folder.
2. A Structured Streaming query folds that table into keyed RocksDB state without expiry:
   digest -> largest id with its locator, and the number of rows. The state is read back
   through the state data source. A hot digest is folded map-side before the shuffle.
3. Digests seen more than once are hits. Their texts alone are compared byte by byte:
   grouped by (digest, text), which also folds map-side. The hits are broadcast only while
   their counted size is at most `broadcast_bytes`; beyond that a sort-merge semi-join does it.
4. A digest whose texts differ (a collision) is resolved by the texts themselves.

Defined results: a null text equals the empty text; of equal texts the row with the largest
id stays; rows that repeat an id are all kept or dropped by that id; a row with a null id
stays only if its text occurs with no other id (keep_id is then null). Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, fresh, staged, staged_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state partition reserves megabytes
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # a stopped query's state leaves the executors' memory at the next one
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def fold_state(slim: DataFrame, path: str) -> DataFrame:
    """Streams the slim table (digest, id, locator) into state; returns digest, id, locator, n."""
    spark = slim.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    checkpoint = staged_path(spark, "dedup-state")
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(slim.schema).parquet(path)
        best = F.max(F.struct("id", "locator")).alias("best")
        folded = stream.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
        query = folded.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress is None:  # no file, no batch, no state
            return slim.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).select("digest", "best.*", "n")
        state = spark.read.format("statestore").load(checkpoint)
        fields = {f.dataType.simpleString(): f.name for f in state.schema["value"].dataType.fields}
        got = state.select("key.digest", *(F.col(f"value.`{name}`").alias("n" if kind == "bigint" else "best") for kind, name in fields.items()))
        return staged(got.select("digest", "best.*", "n"), "dedup-folded")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: id, keep_id, group_size, kept, text_sha256 and locator.

    digest: an expression over the column `norm`; SHA-256 by default (tests pass weak ones).
    """
    spark = docs.sparkSession
    norm = docs.select(docs[id_col].alias("id"), ascii_lower(F.coalesce(docs[text_col], F.lit(""))).alias("norm"), F.input_file_name().alias("file"))
    sha = F.sha2("norm", 256)
    keyed = norm.withColumn("digest", F.unhex(sha) if digest is None else digest.cast("string").cast("binary"))
    path = staged_path(spark, "dedup-slim")
    slim = keyed.select("digest", "id", F.struct("file", F.octet_length("norm").alias("n_bytes")).alias("locator"), *([] if digest is None else [F.unhex(sha).alias("sha")]))
    slim.write.parquet(path)
    slim = spark.read.schema(slim.schema).parquet(path)

    state = fold_state(slim.select("digest", "id", "locator"), path)
    hits = state.where("n > 1").select("digest")
    small = hits.count() * 48 <= broadcast_bytes
    suspects = keyed.join(F.broadcast(hits) if small else hits, "digest", "left_semi")
    groups = suspects.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", F.sha2("norm", 256).alias("text_sha"), "keep_id", "group_size")
    # Full bytes decide: one text to a digest confirms it; several are told apart by the texts' own digests.
    verified = staged(groups, "dedup-verified")
    single = state.where("n = 1").select("digest", F.lit(None).cast("string").alias("text_sha"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    found = slim if digest is not None else slim.withColumn("sha", F.col("digest"))
    if digest is None:
        decided = single.unionByName(verified).drop("text_sha")
        joined = found.join(decided, "digest", "left")
    else:
        decided = single.unionByName(verified)
        joined = found.alias("f").join(decided.alias("d"), (F.col("f.digest") == F.col("d.digest")) & (F.col("d.text_sha").isNull() | (F.col("d.text_sha") == F.lower(F.hex("f.sha")))), "left").select("f.id", "f.sha", "f.locator", "d.keep_id", "d.group_size")
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull())
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that stay, with its columns: of equal texts the row with the largest id (null before all).

    Of rows equal in id and normalised text the one whose text sorts first stays, of wholly equal ones any. The keys of
    dropped rows, and of repeated ones, are broadcast while counted within broadcast_bytes.
    """
    found = staged(exact_dedup(docs, id_col, text_col).select(F.struct(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha")).alias("row"), "kept"), "dedup-rows")
    lost, twice = found.where("not kept").select("row"), found.where("kept").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    at, of, no = fresh(docs, "_row"), fresh(docs, "_of"), fresh(docs, "_no")
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256))
    keyed = docs.withColumn(at, F.struct(docs[id_col].alias("id"), sha.alias("sha")))

    def gone(rows: DataFrame) -> tuple[DataFrame, bool]:
        rows = staged(rows.distinct().withColumnRenamed("row", of), "dropped")
        n = rows.count()
        return (F.broadcast(rows) if n * 64 <= broadcast_bytes else rows), n > 0

    drop, _ = gone(lost)
    out = keyed.join(drop, F.col(at).eqNullSafe(F.col(of)), "left_anti")
    again, any_twice = gone(twice)
    if not any_twice:
        return out.drop(at)
    once = out.join(again, F.col(at).eqNullSafe(F.col(of)), "left_anti").drop(at)
    first = Window.partitionBy(at).orderBy(F.col(text_col).asc_nulls_first())
    rest = out.join(again, F.col(at).eqNullSafe(F.col(of)), "left_semi").withColumn(no, F.row_number().over(first)).where(F.col(no) == 1)
    return once.unionByName(rest.drop(at, no))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("locator")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
