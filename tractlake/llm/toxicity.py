"""Toxicity by compression distance.

Two zstandard dictionaries: one trained on ordinary text by zstandard's trainer, and one that continues it with what
toxic texts say and ordinary ones don't, put together by ``toxic_stems``: the trainer goes by frequency alone and spends
its room on syllables that both classes share. Every text is cut into overlapping windows of words; a window that the second dictionary
compresses further than the first is evidence. Thresholds and weights are calibrated on labelled rows.
"""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.llm.common import Scratch, table
from tractlake.llm.labelled import held_out, logistic, sigmoid
from tractlake.llm.memory import trim, trimmed
from tractlake.llm.textkernel import text_bytes
from tractlake.shipping import ship

#: Labelled rows of either class that are learned from, at most, and bytes of their texts: what the driver may hold.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
WINDOW, STEP = 12, 6
LEVEL = 6
#: Bytes that two neighbouring windows gain together, for weak and strong evidence.
SOME, MANY = 4, 8
#: Bytes of the two dictionaries' contents, at most; the toxic one takes stems while they fit, commonest first.
ORDINARY_BYTES, TOXIC_BYTES = 20_480, 4_096
#: Bytes of a word's beginning that the toxic dictionary may hold, space included.
STEM = range(5, 14)
EDGE = b".,;:!?\"'()[]{}|#*$%&<>-"
PREDICT = 0.5
#: Labelled texts that a task measures.
MEASURED = 128
#: How far from chance a stem must be, in standard deviations.
LEAST_Z = 8.0


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(text: bytes):
    """Overlapping runs of words that cover the whole text."""
    w = words(text)
    for i in range(0, max(1, len(w) - WINDOW + STEP), STEP):
        yield b" ".join(w[i : i + WINDOW]) + b" "


def stems(text: bytes) -> set[bytes]:
    """Beginnings of words, and whole words with the space behind them."""
    out = set()
    for w in set(words(text)):
        w = b" " + w.strip(EDGE) + b" "
        out.update(w[:k] for k in STEM if k <= len(w))
    return out


def toxic_stems(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stems that many toxic texts have and few ordinary ones, commonest first.

    zstandard's own trainer spends its room on syllables that both classes share; so segments are picked by how much
    more often toxic texts have them (a z-score of document frequencies); of stems that hold one another the commonest stays.
    """
    there, here = Counter(), Counter()
    for t in toxic:
        there.update(stems(t))
    candidates = {s for s, c in there.items() if c >= max(5, 0.015 * len(toxic))}
    for t in ordinary:
        here.update(stems(t) & candidates)
    nt, no = max(1, len(toxic)), max(1, len(ordinary))
    score = {}
    for s in candidates:
        a, b, both = there[s] / nt, here[s] / no, (there[s] + here[s]) / (nt + no)
        if a > 3 * b:
            score[s] = (a - b) / np.sqrt(both * (1 - both) * (1 / nt + 1 / no) + 1e-12)
    chosen: list[bytes] = []
    for s in sorted((s for s, z in score.items() if z >= LEAST_Z), key=lambda s: (-there[s], -len(s), s)):
        if sum(map(len, chosen)) + len(s) <= TOXIC_BYTES and not any(s in c or c in s for c in chosen):
            chosen.append(s)
    return chosen


def ordinary_content(ordinary: list[bytes], stems: list[bytes]) -> bytes:
    """A dictionary trained on all windows without those stems, which ordinary texts have now and then."""
    samples = [w for t in ordinary for w in windows(t) if not any(s in b" " + w for s in stems)]
    random.Random(5).shuffle(samples)
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer, which are few bytes too: they are the dictionary
        return b"".join(samples)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Model:
    """Two dictionaries' contents, and the weights of what their compression lengths say."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, None

    def features(self, texts: list[bytes]) -> np.ndarray:
        # the toxic part stands last, where matches cost least; zeros stand in its place in the other dictionary, so that
        # what both have is equally far away
        gap = bytes(16)
        plain, other = compressor(self.ordinary + gap + bytes(len(self.toxic))), compressor(self.ordinary + gap + self.toxic)
        out = np.zeros((len(texts), 7))
        for i, text in enumerate(texts):
            gain = np.fromiter((len(plain.compress(w)) - len(other.compress(w)) for w in windows(text)), dtype=np.int64)
            # each word but the first few stands in two windows, whose gains count together
            pair = gain[:-1] + gain[1:] if len(gain) > 1 else gain * 2
            some, many = (pair >= SOME).sum(), (pair >= MANY).sum()
            out[i] = min(pair.max(), 2 * MANY) / 4, np.log1p(some), np.log1p(many), 10 * some / len(pair), 10 * many / len(pair), pair.mean(), np.log1p(len(pair))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = self.features(texts)
        return sigmoid(self.weights[0] + x @ self.weights[1:])


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model without weights, from labelled texts of both classes."""
    stems = toxic_stems(toxic, ordinary)
    # commonest last, where matches cost least
    return Model(ordinary_content(ordinary, stems), b"".join(reversed(stems)))


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """The model with weights for features of labelled texts, where ``share`` of all labelled rows are toxic."""
    n, toxic = len(y), int(y.sum())
    model.weights = logistic(x, y, np.where(y == 1, share * n / toxic, (1 - share) * n / (n - toxic)))
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model from labelled rows outside the held-out fold; None if a class has none.

    At most ``rows`` rows of either class, and ``most_bytes`` of both together, chosen by a hash of the key; whole texts,
    all of their windows. A key that is repeated in docs gives each of its rows. Windows are measured in tasks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    labels = labels.where(~held_out(key) & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    count = {r[0]: r[1] for r in labels.groupBy("y").count().collect()}
    order = F.xxhash64("key", F.lit(3))
    chosen = [r for y in (0, 1) for r in labels.where(F.col("y") == y).orderBy(order, "key").limit(rows).collect()]
    if not chosen:
        return None
    few = spark.createDataFrame(chosen, labels.schema).dropDuplicates()
    # at most 2 * rows keys: a bounded broadcast
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(few), "key")
    found = scratch.save(found.withColumns({"order": order, "n": F.octet_length("text"), "id": F.monotonically_increasing_id()}), "labelled")
    taken, size = [], 0
    sizes = [found.where(F.col("y") == y).select("id", "n").orderBy("order", "text", "id").limit(rows).collect() for y in (0, 1)]
    for pair in itertools.zip_longest(*sizes):  # both classes in turn
        for r in filter(None, pair):
            if size + r[1] <= most_bytes:
                taken.append(r[0])
                size += r[1]
    ids = F.broadcast(spark.createDataFrame([(i,) for i in taken], "id long"))
    found = found.join(ids, "id").select("key", "y", "text")
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for y, t in found.orderBy("key", "y", "text").select("y", "text").collect():
        texts[y].append(t.encode())
    if not texts[0] or not texts[1]:
        return None
    model = dictionaries(texts[1], texts[0])
    texts.clear()
    trim()
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            x = shared.value.features(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    measured = found.select("y", "text").repartition(1 + len(taken) // MEASURED).mapInArrow(trimmed(measure), "y int, x array<double>").collect()
    measured = sorted(measured)  # sums of floats in an order of their own
    return calibrated(model, np.array([r[1] for r in measured]), np.array([r[0] for r in measured], dtype=float), count.get(1, 0) / max(1, sum(count.values())))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """The rows with ``name``: how likely each whole text is toxic, from 0 to 1.

    Null text is empty; an empty text has no windows that gain, and the score that goes with that. Without a model
    (no labels of one class) all scores are 0. Rows are scored one by one, so repeats, ties, null keys and groups make
    no difference; an empty table gives no rows. An input column named like the score is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    kept = docs.select(*(F.col(f"`{c}`") for c in columns))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = text_bytes(part.column(part.schema.get_field_index(text)))
                s = model.score(texts) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, name])

    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return kept.mapInArrow(trimmed(run), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
