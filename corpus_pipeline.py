"""A corpus from raw documents to shuffled shards, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written and read again before
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tractlake.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from tractlake.llm.common import Scratch, table
from tractlake.llm.textkernel import WORD_PATTERN

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, name="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.PREDICT).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8, the one with the smallest id.

    Rows without words, or without an id, are linked with nothing and all stay, whatever else has their id. Rows with
    words that share an id count as linked: the first of them by text stays.
    """
    groups = ngram_join.linked(docs, k=5, percent=80)
    apart = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    stays = groups.where("doc_id = component_id and n_shingles > 0").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text"))))
    kept = docs.where(~apart).join(stays, "doc_id", "left_semi").withColumn("__n", first).where("__n = 1").select(*docs.columns)
    return kept.union(docs.where(apart))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: whole copies, and one more with the chance that the rest makes.

    The chance is a hash of id and text, so that reruns agree. What the mix takes nothing of is not in it.
    """
    rows = Scratch(spark, "mixed").save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    taken = mixing.mix(rows.select("__row", "doc_id", "text", "source"))["documents"].select("__row", "size", "taken")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1_000_000)) / 1_000_000
    times = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    copies = rows.join(taken.where("taken > 0"), "__row").withColumn("__times", times).where("__times > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, in random order."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The first stage learns a classifier, and the last two draw at random: SQL has no equal.
ORACLE_SQL = None
