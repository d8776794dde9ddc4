"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size. A document is searched with windows of a partition's size: a window that holds most of
an item tends to have the item's MinHash values, whatever the document's length. An item is a candidate where some
hash function's minimum over the item is the minimum of some window; candidates are verified by exact containment of
their shingles in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from tractlake.llm.common import Scratch, table
from tractlake.llm.memory import trimmed
from tractlake.llm.textkernel import mix, shingle_sets, shingles_in_order, slices, sliding_min, text_bytes, word_hashes
from tractlake.shipping import ship

K, CONTAINED, HASHES = 5, 0.8, 32
#: Items go to executors in blocks of about this many bytes of text; a larger benchmark makes more blocks.
BLOCK_BYTES = 8 << 20
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_FILTER_BITS = 20


def minhash(shingles: np.ndarray) -> np.ndarray:
    """For each hash function, the shingle where its minimum over the set stands."""
    return np.array([shingles[np.argmin(mix(shingles ^ s))] for s in _SEEDS], dtype=np.uint64)


class Items:
    """A block of items: shingle sets, MinHash shingles with the items that have them, and a bitmap before the search."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int):
        """Items of fewer than k words are kept apart by length: their one shingle is sought at that length."""
        raw = [(t or "").encode() for t in texts]
        self.ids, self.by_k = ids, {}
        lengths = [len(t.split()) for t in raw]
        for kk in sorted({min(n, k) for n in lengths if n}):
            chosen = [i for i, n in enumerate(lengths) if min(n, k) == kk]
            sets = list(shingle_sets([raw[i] for i in chosen], kk))
            signature = np.array([minhash(s) for s in sets])
            values, inverse = np.unique(signature, return_inverse=True)
            inverse = inverse.reshape(signature.shape)
            holders: dict[int, list[tuple[int, int]]] = {}
            for a, row in enumerate(inverse):
                for j, v in enumerate(row):
                    holders.setdefault(int(v), []).append((a, j))
            bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bitmap[values & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.by_k[kk] = (chosen, sets, values, holders, bitmap)

    def search(self, texts: list[bytes], contained: float):
        """(index of text, index of item, shingles of the item, of which in the text) of all that are contained."""
        for lo, hi in slices(texts):
            words, bounds = word_hashes(texts[lo:hi])
            for kk, (chosen, sets, values, holders, bitmap) in self.by_k.items():
                for at, run in enumerate(shingles_in_order(words, bounds, kk)):
                    if len(run) == 0 or (kk > 1 and bounds[at + 1] - bounds[at] < kk):
                        continue
                    maybe = np.flatnonzero(bitmap[run & np.uint64((1 << _FILTER_BITS) - 1)])
                    if not len(maybe):
                        continue
                    places = np.searchsorted(values, run[maybe])
                    found = values[np.minimum(places, len(values) - 1)] == run[maybe]
                    if not found.any():
                        continue
                    yield from ((lo + at, chosen[a], n, c) for a, n, c in self.verify(run, maybe[found], places[found], sets, holders, contained))

    @staticmethod
    def verify(run, positions, value_nos, sets, holders, contained):
        """Window minima by size partition, then exact containment."""
        candidates: set[int] = set()
        hashed: dict[int, np.ndarray] = {}
        minima: dict[tuple[int, int], np.ndarray] = {}
        for p, v in zip(positions.tolist(), value_nos.tolist(), strict=True):
            for a, j in holders[v]:
                if a in candidates:
                    continue
                if j not in hashed:
                    hashed[j] = mix(run ^ _SEEDS[j])
                # the partition's upper bound is the next power of two
                width = min(1 << (len(sets[a]) - 1).bit_length(), len(run))
                if (j, width) not in minima:
                    minima[j, width] = sliding_min(hashed[j], width)
                low = minima[j, width]
                if (low[max(0, p - width + 1) : min(p, len(low) - 1) + 1] == hashed[j][p]).any():
                    candidates.add(a)
        if candidates:
            own = np.unique(run)
            for a in sorted(candidates):
                place = np.minimum(np.searchsorted(own, sets[a]), len(own) - 1)
                common = int((own[place] == sets[a]).sum())
                if common >= contained * len(sets[a]):
                    yield a, len(sets[a]), common


def blocks_of(items: DataFrame, item_key: str, item_text: str, limit: int):
    """Items in blocks of bounded bytes, streamed through the driver."""
    ids, texts, size = [], [], 0
    for row in items.select(item_key, item_text).toLocalIterator():
        n = len((row[1] or "").encode()) + 64
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, contained: float = CONTAINED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (key, item key, n_shingles, n_common, containment) of documents with items at least ``contained`` in them.

    With HASHES functions an item that is contained is missed where every function's minimum stands in the missing fifth of
    its shingles or is beaten in every window: about 0.6 ** 32, or once in ten million. Words are runs outside ASCII white
    space, A-Z lower-cased; shingles are sets. Item keys may be of any type and null. An item of fewer than k words is one
    shingle of its own length; an item or document without words is in no pair. Null keys are carried; repeated rows on
    either side give repeated pairs; an empty table on either side gives none. Every block of items meets every
    document; documents are neither shuffled nor cut. Other columns are not read.
    """
    ship(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, n_shingles long, n_common long, containment double"
    id_type = to_arrow_type(items.schema[item_key].dataType)
    out = None
    for ids, texts in blocks_of(items, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, k))

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                rows = list(block.search(text_bytes(batch.column(1)), contained))
                if rows:
                    at, item, n, common = zip(*rows, strict=True)
                    ids_ = pa.array([block.ids[i] for i in item], id_type)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids_, pa.array(n, pa.int64()), pa.array(common, pa.int64()), pa.array([c / m for c, m in zip(common, n, strict=True)], pa.float64())], [key, item_key, "n_shingles", "n_common", "containment"])

        found = docs.select(key, text).mapInArrow(trimmed(run), schema)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, contained: float = CONTAINED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that contain an item.

    Every row is judged by its own text: the key is not read, so it may be null or repeated. All columns pass through
    Python. Where items make several blocks, what a block leaves is saved before the next, so that a worker holds one.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    out = saved = docs
    for n, (ids, texts) in enumerate(blocks_of(items, item_key, item_text, block_bytes)):
        if n:
            before, saved = saved, scratch.save(out, "left")
            out = saved
            if n > 1:
                scratch.drop(before)
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, k))

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for at, *_ in block.search(text_bytes(batch.column(batch.schema.get_field_index(text))), contained):
                    clean[at] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(trimmed(run), docs.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that is contained in it."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS.format(t="text")} AS w, least(len(w), 5) AS k FROM benchmark WHERE len(w) > 0),
     bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM b),
     ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
            FROM d JOIN (SELECT DISTINCT k FROM b) ON len(w) >= k),
     bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
     c AS (SELECT doc_id, item_id, count(*) AS m FROM ds JOIN bs USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, m AS n_common, m::DOUBLE / n AS containment FROM c JOIN bn USING (item_id) WHERE m >= 0.8 * n
"""
