"""Mixing sources to target weights by packed blocks.

Each source's tokens are packed into blocks of fixed length, document after document in a seeded order. Every output
shard draws how many of its slots each source fills (a multinomial over what the sources have left). A source's slots
are mapped through a pseudorandom permutation of its block numbers, epoch after epoch, and joined to blocks by number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tractlake.llm.common import ROW, Scratch, carried, table
from tractlake.llm.textkernel import WORD_PATTERN

#: Words of a block.
BLOCK = 128
#: Output shards whose source counts are drawn.
SHARDS = 64
#: A source gives at most this many times its size.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Slots that one row unfolds into, and that a task maps.
SLOT_RUN, SLOT_TASK = 100_000, 250_000
#: Sources whose sizes and draws the driver may hold; a mix over more is refused.
MOST_SOURCES = 100_000
#: Up to so many sources their table is broadcast; beyond, Spark joins as it sees fit.
BROADCAST_ROWS = 10_000


def water_fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the summed sizes by weight; what exceeds ``most`` times a size is shared anew until none is above."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def draw_shards(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Multinomial counts of each source in each shard (shards x sources), drawn from what the sources have left."""
    rng, left = np.random.default_rng(seed), np.array(quotas, dtype=np.int64)
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    for k in range(n_shards):
        want = int(left.sum()) // (n_shards - k)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(slot: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of ``slot`` in a keyed pseudorandom permutation of 0..n-1: a four-round Feistel network, walked until in range."""
    slot, n, key = slot.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.ceil(np.ceil(np.log2(np.maximum(n, 2).astype(float))) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = slot.copy(), np.ones(len(slot), dtype=bool)
    while todo.any():
        m, h = mask[todo], half[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = out >= n
    return out.astype(np.int64)


def block_of(slot: pd.Series, n_blocks: pd.Series, source_no: pd.Series) -> pd.Series:
    """The block that a source's slot takes; each epoch of n_blocks slots has a permutation of its own."""
    s, n = slot.to_numpy(np.int64), n_blocks.to_numpy(np.int64)
    epoch = s // n
    return pd.Series(permuted(s % n, n, source_no.to_numpy(np.int64) * 1_000_003 + epoch * 7_919 + 1))


def mix(docs: DataFrame, block: int = BLOCK, n_shards: int = SHARDS, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source") -> dict[str, DataFrame]:
    """What a mix takes.

    documents: the input's rows without their text, with size, source_size, target, taken (words, repeats counted) and
    row_no. slots: the mix itself: shard, source_no, slot, block_no. pieces: which words of which row a block holds
    (source_no, block_no, row_no, first, words), so that slots joined to pieces on block spell the mix out.
    sources: source_no, source, source_size, target.

    Null text has no words, and nothing is taken from it; a null source is a source, last in order. Repeated rows are
    packed one after another, each on its own. Other columns are carried whatever their names and types, but those named
    like an added one are left out. An empty table gives empty results. Sources' sizes, one row each, and a row for each
    source and output shard are handled on the driver: more than MOST_SOURCES sources are a ValueError. All draws depend
    on rows and seed only; equal rows may swap what is taken from them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    own = ("size", "source_size", "target", "taken", "row_no")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    # the input's columns are one column up to the end, so that no name of theirs can clash
    rows = docs.select(F.struct(*carried(docs, text, *own)).alias(ROW), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row_no"))
    rows = scratch.save(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    found = sorted(found, key=lambda r: (r[0] is None, str(r[0] or "").encode()))
    sizes = [r[1] for r in found]
    targets = water_fill(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))])
    blocks = [-(-s // block) for s in sizes]
    # as many slots as blocks of mean length make up the target; no block more than MOST times
    quotas = [min(MOST * n, round(t * n / s)) if s else 0 for s, n, t in zip(sizes, blocks, targets, strict=True)]
    counts = draw_shards(quotas, n_shards, seed)
    starts = np.cumsum(counts, axis=0) - counts
    kind = docs.schema[source].dataType.simpleString()
    sources = spark.createDataFrame([(i, r[0], r[1], t) for i, (r, t) in enumerate(zip(found, targets, strict=True))], f"source_no int, source {kind}, source_size long, target double")
    drawn = [(k, i, blocks[i], int(starts[k, i]), int(counts[k, i])) for k in range(n_shards) for i in range(len(found)) if counts[k, i]]
    drawn = spark.createDataFrame(drawn, "shard int, source_no int, n_blocks long, first long, n long")
    # a shard's slots of a source are unfolded in runs of bounded length, dealt over tasks
    runs = drawn.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_RUN).cast("long")))).repartition(1 + sum(quotas) // SLOT_TASK)
    slot = F.sequence(F.col("first") + F.col("lo"), F.col("first") + F.least(F.col("lo") + SLOT_RUN, "n") - 1)
    slots = runs.select("shard", "source_no", "n_blocks", F.explode(slot).alias("slot"))
    slots = scratch.save(slots.select("shard", "source_no", "slot", F.pandas_udf(block_of, "long")("slot", "n_blocks", "source_no").alias("block_no")), "slots")
    few = sources.withColumnRenamed("source", "name")
    numbered = rows.join(F.broadcast(few) if len(found) <= BROADCAST_ROWS else few, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    # a running sum of sizes in each source, in two levels so that a large source is spread over tasks
    chunk = F.pmod(F.shiftright("h", 8), F.lit(max(1, math.isqrt(sum(r[2] for r in found)))))
    placed = numbered.where("size > 0").select("source_no", "row_no", "size", "h", chunk.alias("chunk"))
    bases = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    bases = bases.select("source_no", "chunk", (F.sum("words").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("words")).alias("base"))
    upto = F.sum("size").over(Window.partitionBy("source_no", "chunk").orderBy("h", "row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("upto", upto).join(bases, ["source_no", "chunk"])
    placed = placed.select("source_no", "row_no", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    covers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = placed.select("source_no", "row_no", "start", "size", F.explode(covers).alias("block_no"))
    first = F.greatest(F.col("block_no") * block, F.col("start"))
    last = F.least((F.col("block_no") + 1) * block, F.col("start") + F.col("size"))
    pieces = scratch.save(pieces.select("source_no", "block_no", "row_no", (first - F.col("start")).alias("first"), (last - first).alias("words")), "pieces")
    times = slots.groupBy("source_no", "block_no").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["source_no", "block_no"]).groupBy("row_no").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    documents = numbered.join(taken, "row_no", "left").select(f"{ROW}.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row_no")
    return {"documents": documents, "slots": slots, "pieces": pieces, "sources": sources.withColumnRenamed("source", source)}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, with its source's size and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs)["documents"].select("doc_id", "size", "source_size", "target", "taken")
