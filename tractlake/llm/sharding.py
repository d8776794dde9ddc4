"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit in memory. Pass two puts each bucket through a
Fisher-Yates shuffle (Spark's ``shuffle`` of an array) and writes it. The buckets one after another are a random order
of all records; cutting that order into equal runs gives the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tractlake.llm.common import ROW, Scratch, carried, table, total

#: Bytes a record needs besides its text.
RECORD_BYTES = 16
#: Uncompressed bytes of a bucket: with the copies that sorting and shuffling make, a task needs a few times as much.
BUCKET_BYTES = 16 << 20
#: Buckets of a shuffle partition. They are gathered one after another, but a task fetches, sorts and writes all of them:
#: few, so that what it holds is a small part of an executor.
BUCKETS_PER_TASK = 2
#: Shuffle partitions, at most: beyond, they have more buckets each, and sorting them spills.
MOST_TASKS = 100_000
_HASH_AGG = "spark.sql.execution.useObjectHashAggregateExec"


def record_size(text: str = "text"):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def shard(docs: DataFrame, n_shards: int, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard), in seeded random order.

    The law that holds is that of rows: shards' counts are at most one apart. Records are scattered by a seeded hash of
    key and text, so equal ones share a bucket; where they alone would fill more than one, they are spread by their place
    in the input. Null keys and texts count as values of their own; an empty table gives no rows. Other columns are
    carried whatever their names and types, save ones named ``shard`` or ``slot``. The same rows, seed and bucket size give
    the same shards, however the input is split, unless records are spread by place: then the same splits do. Results are
    read from tables in the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    _, n_bytes = total(docs, F.count(F.lit(1)), F.sum(record_size(text)))
    n_buckets = max(1, -(-(n_bytes or 0) // bucket_bytes))
    content = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    # the record is one column up to the end, so that no name of its own can clash
    rows = docs.select(content.alias("hash"), F.struct(*carried(docs, "shard", "slot")).alias(ROW))
    # equal records that fill more than a bucket: there are fewer of those than buckets, so their hashes may be broadcast
    sizes = docs.select(content.alias("hash"), record_size(text).alias("size")).groupBy("hash").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    large = scratch.save(sizes.where((F.col("size") > bucket_bytes) & (F.col("n") > 1)).select("hash", F.lit(True).alias("large")), "large")
    spread = F.when(F.col("large"), F.xxhash64("hash", F.monotonically_increasing_id())).otherwise(F.col("hash"))
    rows = rows.join(F.broadcast(large), "hash", "left").select(spread.alias("hash"), ROW)
    bucket = F.pmod("hash", F.lit(n_buckets)).cast("int")
    n_tasks = min(-(-n_buckets // BUCKETS_PER_TASK), MOST_TASKS)
    # the task is a grouping column too, so that rows dealt by task need no second shuffle to be grouped
    scattered = rows.withColumn("bucket", bucket).withColumn("task", F.pmod("bucket", F.lit(n_tasks))).repartitionById(n_tasks, "task").sortWithinPartitions("task", "bucket", "hash")
    by_hash = lambda a, b: F.when(a["hash"] < b["hash"], -1).when(a["hash"] > b["hash"], 1).otherwise(0)
    buckets = scattered.groupBy("task", "bucket").agg(F.array_sort(F.collect_list(F.struct("hash", ROW)), by_hash).alias("rows"))
    shuffled = buckets.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "rec")).select("bucket", "pos", F.col(f"rec.{ROW}").alias(ROW))
    # sorted aggregation: buckets of a partition come one by one
    before = spark.conf.get(_HASH_AGG)
    spark.conf.set(_HASH_AGG, "false")
    try:
        shuffled = scratch.save(shuffled, "buckets")
    finally:
        spark.conf.set(_HASH_AGG, before)
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each bucket: a sum over the table of buckets, not over records
    bases = scratch.save(counts.select("bucket", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")), "bases")
    n = total(bases, F.sum("n"))[0] or 0
    each, more = divmod(n, n_shards)
    place = F.col("base") + F.col("pos")
    cut = F.lit(more * (each + 1))
    late = place >= cut
    step = F.lit(max(each, 1))
    number = F.when(late, F.lit(more) + F.floor((place - cut) / step)).otherwise(F.floor(place / F.lit(each + 1)))
    slot = F.when(late, F.pmod(place - cut, step)).otherwise(F.pmod(place, F.lit(each + 1)))
    return shuffled.join(bases, "bucket").select(number.cast("int").alias("shard"), slot.cast("long").alias("slot"), ROW).select(f"{ROW}.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its files holding runs of slots in order. A shard may be many files: none is gathered whole."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards with counts at most one apart, with size and CRC-32 of what each shard holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard(docs, 40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
