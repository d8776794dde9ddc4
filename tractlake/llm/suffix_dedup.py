"""Removing repeated strings by a distributed merge sort of suffixes that knows common prefixes.

Sorting a suffix for every byte is not needed to find strings of LENGTH bytes that repeat. Each such string holds an
anchor: its K-gram with the smallest hash, which depends on the string alone. So only suffixes at anchors are sorted,
and of those only the ones whose K-gram occurs again. The order of the sort is by ranges of the K-gram's hash, then by
suffix, then by what stands before it. Tasks sort their suffixes into runs, where equal contexts (suffix and the bytes
before it) leave one entry, and front-code them: each entry but the first is the length it shares with the one before,
and the rest. Runs are exchanged by range; a range ends at fixed hashes, and at sampled contexts inside a K-gram that
holds more entries than a range may. A loser tree merges them, comparing bytes only beyond prefixes known to be shared.

Neighbours' shared lengths in the merged order say which suffixes agree on how many bytes after the anchor; with a
running hash of the bytes before it, that tells for each offset which LENGTH-byte strings around the anchors are equal.
All but the earliest of equal strings are removed. What an entry shares with the borders of its range says which of
its strings may stand in the next range too; the earliest one of each of those is compared over the borders.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.common import Scratch, table
from tractlake.llm.textkernel import U64, mix, powers, sliding_min, text_bytes

LENGTH, K = 100, 32
#: Places a string's anchor may have in it, less one.
REACH = LENGTH - K
#: Entries of a range and of a sorted run; samples for each range inside a K-gram of more entries.
BUCKET, RUN, SAMPLES = 150_000, 100_000, 16
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_LAST = (1 << 63) - 1


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k bytes."""
    if len(data) < k:
        return np.empty(0, dtype=U64)
    prefix = np.empty(len(data) + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(_MULT, len(data)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(_INV, len(prefix))[: len(prefix) - k])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in a text that are the anchor of some string of LENGTH bytes, and their K-grams' hashes."""
    if len(text) < LENGTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
    h = gram_hashes(np.frombuffer(text, dtype=np.uint8))
    low = sliding_min(h, REACH + 1)  # for each string, the smallest of its K-grams
    none = np.zeros(REACH, dtype=U64)
    # a place is an anchor if it is the smallest of some string that holds it: the largest of their minima
    most = ~sliding_min(~np.concatenate([none, low, none]), REACH + 1)
    at = np.flatnonzero(most == h)
    return at, h[at]


def anchors_of(docs: DataFrame) -> DataFrame:
    """Rows (kh, doc, uid, pos) for the anchors of all texts."""

    def run(batches):
        for batch in batches:
            found = [anchors(text) for text in text_bytes(batch.column(2))]
            each = [len(at) for at, _ in found]
            if sum(each):
                owners = (pa.array(np.repeat(batch.column(i).to_numpy(), each)) for i in (0, 1))
                hashes, places = np.concatenate([h for _, h in found]), np.concatenate([at for at, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *owners, pa.array(places.astype(np.int32))], ["kh", "doc", "uid", "pos"])

    return docs.select("doc", "uid", "text").mapInArrow(run, "kh long, doc long, uid long, pos int")


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, as they are to be shuffled; only those long enough to hold a string."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [pack.compress(t) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc", "uid", "packed"])

    return docs.where(F.octet_length("text") >= LENGTH).select("doc", "uid", "text").mapInArrow(run, "doc long, uid long, packed binary")


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, known to be at least start."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Lengths shared with the suffix before, and the rests, of sorted suffixes."""
    shared = np.zeros(len(suffixes), dtype=np.uint8)
    for i in range(1, len(suffixes)):
        shared[i] = common_prefix(suffixes[i - 1], suffixes[i], 0)
    return shared, b"".join(s[h:] for s, h in zip(suffixes, shared.tolist(), strict=True))


def decode(shared: list[int], lengths: list[int], rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for h, n in zip(shared, lengths, strict=True):
        last = last[:h] + rests[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs with their shared lengths by a loser tree.

    Returns for each output its run, its place there and the length it shares with the output before. Each contender
    carries the length it shares with the last output: the longer one is smaller, and only where they are equal are
    bytes compared, from there on.
    """
    m = len(runs)
    place = [0] * m
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    known = [0] * m
    tree = [-1] * m

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = common_prefix(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    for r in range(m):  # each run climbs until it meets a place without a loser yet
        node, up = (r + m) // 2, r
        while node > 0 and tree[node] >= 0:
            up, tree[node] = play(up, tree[node])
            node //= 2
        if node > 0:
            tree[node] = up
        else:
            top = up
    if m == 1:
        top = 0
    order_run, order_place, shared = [], [], []
    while heads[top] is not None:
        order_run.append(top)
        order_place.append(place[top])
        shared.append(known[top])
        place[top] += 1
        strings, lengths = runs[top]
        if place[top] < len(strings):
            heads[top], known[top] = strings[place[top]], lengths[place[top]]
        else:
            heads[top] = None
        up, node = top, (top + m) // 2
        while node > 0:
            up, tree[node] = play(up, tree[node])
            node //= 2
        top = up
    return order_run, order_place, shared


class Entries:
    """Contexts of anchors: ``right`` and ``left`` (nearest byte first) as bytes, and rows of ids (doc, uid, pos)."""

    def __init__(self, right: list[bytes], left: list[bytes], ids: np.ndarray):
        self.right, self.left, self.ids = right, left, ids

    def __len__(self) -> int:
        return len(self.right)

    def part(self, lo: int, hi: int) -> Entries:
        return Entries(self.right[lo:hi], self.left[lo:hi], self.ids[lo:hi])

    def encode(self, pack) -> bytes:
        shared, rests = front_code(self.right)
        lengths, before = (np.array([len(x) for x in side], dtype=np.uint8) for side in (self.right, self.left))
        return pack.compress(pickle.dumps((shared, lengths, rests, before, b"".join(self.left), self.ids)))


def contexts(text: bytes, pos: np.ndarray) -> np.ndarray:
    """For each place the REACH bytes before it and the LENGTH bytes from it, zero where the text has none."""
    padded = np.zeros(len(text) + REACH + LENGTH, dtype=np.uint8)
    padded[REACH : REACH + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)[pos]


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Spans (doc, uid, first, last) with those of a document that meet made one."""
    if len(spans) == 0:
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    new = np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])
    # ends so far within a document: documents are set apart by what no end can reach
    lift = np.cumsum(new) * np.int64(1 << 40)
    end = np.maximum.accumulate(spans[:, 3] + lift)
    new[1:] |= spans[1:, 2] + lift[1:] > end[:-1]
    starts = np.flatnonzero(new)
    out = spans[starts]
    out[:, 3] = (end - lift)[np.concatenate([starts[1:], [len(spans)]]) - 1]
    return out


def combined(window: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts the place of the earliest one, and the spans that this leaves of the others: all of their context."""
    words = window.view("<u8")
    h = mix(n_left.astype(U64) * U64(256) + n_right.astype(U64))
    for i in range(words.shape[1]):
        h = mix(h ^ words[:, i]) + U64(i)
    order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0], h))
    again = np.zeros(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    maybe = np.flatnonzero((h[a] == h[b]) & (n_left[a] == n_left[b]) & (n_right[a] == n_right[b]))
    again[maybe + 1] = (window[a[maybe]] == window[b[maybe]]).all(axis=1)
    first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    # rows equal in key and text come with equal places, which are one
    late = order[again & (ids[order] != ids[first]).any(axis=1)]
    late = late[n_left[late] + n_right[late] >= LENGTH]
    spans = np.column_stack([ids[late, 0], ids[late, 1], ids[late, 2] - n_left[late], ids[late, 2] + n_right[late]])
    return order[~again], merged_spans(spans)


RUN_SCHEMA = "part long, kh long, n long, run binary, samples array<struct<right:binary,left:binary>>, spans array<struct<doc:long,uid:long,first:int,last:int>>"
_KEY = pa.struct([("right", pa.binary()), ("left", pa.binary())])
_SPAN = pa.struct([("doc", pa.int64()), ("uid", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def sorted_runs(placed: DataFrame, n_ranges: int, bucket: int = BUCKET) -> DataFrame:
    """Front-coded runs of the contexts at given places (doc, uid, packed, at: kh, pos and whether the K-gram is frequent).

    A run has a ``part`` (range of hashes), or, for a frequent K-gram, ``kh`` and samples of its contexts. Spans that a
    task finds when it combines equal contexts are in rows without a run.
    """

    def flush(parts):
        pack = zstandard.ZstdCompressor(level=1)
        window, kh, ids, lengths, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        n_left, n_right = np.minimum(ids[:, 2], REACH), np.minimum(lengths - ids[:, 2], LENGTH)
        kept, spans = combined(window, n_left, n_right, ids)
        rows = []
        if len(spans):
            rows.append((None, None, 0, None, [], [dict(zip(("doc", "uid", "first", "last"), s, strict=True)) for s in spans.tolist()]))
        window, kh, ids, n_left, n_right, many = (x[kept] for x in (window, kh, ids, n_left, n_right, many))
        # ranges are equal parts of all 64-bit numbers, by the hash mixed anew, as anchors have small hashes; a frequent
        # K-gram is a range of its own
        group = np.where(many, kh, ((mix(kh) >> U64(32)) * U64(n_ranges)) >> U64(32))
        sides = window[:, REACH:].tobytes(), window[:, :REACH][:, ::-1].tobytes()
        right = [sides[0][i * LENGTH : i * LENGTH + n] for i, n in enumerate(n_right.tolist())]
        left = [sides[1][i * REACH : i * REACH + n] for i, n in enumerate(n_left.tolist())]
        order = sorted(zip(many.tolist(), group.tolist(), right, left, range(len(kh)), strict=True))
        group_sorted = [x[:2] for x in order]
        own = Entries([x[2] for x in order], [x[3] for x in order], ids[[x[4] for x in order]])
        lo = 0
        while lo < len(order):
            hi = bisect.bisect_right(group_sorted, group_sorted[lo], lo)
            few, (frequent, g) = own.part(lo, hi), group_sorted[lo]
            if frequent:
                at = np.flatnonzero(mix(few.ids[:, 1].view(U64) + few.ids[:, 2].view(U64)) % U64(max(1, bucket // SAMPLES)) == 0)
                rows.append((None, int(np.array(g, dtype=U64).view(np.int64)), len(few), few.encode(pack), [{"right": few.right[i], "left": few.left[i]} for i in at], []))
            else:
                rows.append((g, None, len(few), few.encode(pack), [], []))
            lo = hi
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(_KEY), pa.list_(_SPAN)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "kh", "n", "run", "samples", "spans"])

    def run(batches):
        unpack, parts, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                text = unpack.decompress(batch.column(2)[row].as_py())
                at = batch.column(3)[row].values
                pos = at.field("pos").to_numpy().astype(np.int64)
                for lo in range(0, len(pos), RUN):
                    few = pos[lo : lo + RUN]
                    ids = np.column_stack([np.full(len(few), batch.column(i)[row].as_py(), dtype=np.int64) for i in (0, 1)] + [few])
                    kh, many = (at.field(c).to_numpy(zero_copy_only=False)[lo : lo + RUN] for c in ("kh", "many"))
                    parts.append((contexts(text, few), kh.view(U64), ids, np.full(len(few), len(text)), many))
                    size += len(few)
                    if size >= RUN:
                        yield flush(parts)
                        parts, size = [], 0
        if parts:
            yield flush(parts)

    return placed.select("doc", "uid", "packed", "at").mapInArrow(run, RUN_SCHEMA)


def decoded(raw: bytes, unpack) -> tuple[Entries, list[int]]:
    """A run's entries, and the lengths each suffix shares with the one before."""
    shared, lengths, rests, before, joined, ids = pickle.loads(unpack.decompress(raw))
    ends = np.cumsum(before, dtype=np.int64).tolist()
    left = [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return Entries(decode(shared.tolist(), lengths.tolist(), rests), left, ids), shared.tolist()


def splitters_of(runs: DataFrame, n_ranges: int, bucket: int) -> dict[int, tuple[int, list[tuple[bytes, bytes]]]]:
    """For each frequent K-gram its first part and the contexts that part its entries, from samples.

    On the driver are SAMPLES contexts for each full range inside frequent K-grams.
    """
    found = runs.where("kh is not null").groupBy("kh").agg(F.sum("n"), F.flatten(F.collect_list("samples"))).collect()
    out, part = {}, n_ranges
    for kh, n, samples in sorted(found):
        keys = sorted((bytes(s["right"]), bytes(s["left"])) for s in samples)
        parts = min(-(-n // bucket), len(keys) + 1)
        cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)})
        out[kh] = (part, cuts)
        part += len(cuts) + 1
    return out


def dealt(runs: DataFrame, splitters: dict) -> DataFrame:
    """Runs by part: those of frequent K-grams cut at the splitters."""
    shared = runs.sparkSession.sparkContext.broadcast(splitters)

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                kh, raw = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                if kh is None:
                    out = [(batch.column(0)[row].as_py(), raw)]
                else:
                    part, cuts = shared.value[kh]
                    own, _ = decoded(raw, unpack)
                    keys = list(zip(own.right, own.left, strict=True))
                    edges = [0, *(bisect.bisect_left(keys, c) for c in cuts), len(keys)]
                    out = [(part + i, own.part(a, b).encode(pack)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([r for _, r in out], pa.binary())], ["part", "run"])

    return runs.where("run is not null").select("part", "kh", "run").mapInArrow(run, "part long, run binary")


def repeats(right_shared: np.ndarray, right: np.ndarray, left: np.ndarray, left_length: np.ndarray, ids: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Spans (doc, uid, first, last) of the strings around anchors that occur earlier, and the strings that may do so in another range.

    right_shared: shared length with the suffix before, in sorted order; right: lengths of suffixes; left: bytes before
    the anchor, nearest first; ids: doc, uid, pos; depth: what a suffix shares with the borders of the range at most.
    The second result has for each offset the entries whose string is the first in this range and reaches over a border.
    """
    order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0]))
    # rows equal in key and text came with equal places: one of each counts
    order = order[np.concatenate([[True], (ids[order[1:]] != ids[order[:-1]]).any(axis=1)])]
    least, most = np.full(len(ids), LENGTH, dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
    before, over = np.zeros(len(ids), dtype=U64), []
    for offset in range(REACH + 1):
        if offset:
            before = mix(before * U64(_MULT) + left[:, offset - 1].astype(U64) + U64(offset))
        need = LENGTH - offset
        same_right = np.cumsum(right_shared < need)
        valid = (right >= need) & (left_length >= offset)
        # only entries that share so much with another one
        rows = order[(valid & (np.bincount(same_right)[same_right] > 1))[order]]
        key = mix(same_right[rows].astype(U64) * U64(_MULT) + before[rows])
        again = np.ones(len(key), dtype=bool)
        again[np.unique(key, return_index=True)[1]] = False  # the first of equal ones, in order of documents
        hit = rows[again]
        least[hit] = np.minimum(least[hit], offset)
        most[hit] = np.maximum(most[hit], offset)
        crossing = valid & (depth >= need)
        if crossing.any():
            crossing[hit] = False
            over.append((order[crossing[order]].astype(np.int32), offset))
    hit = np.flatnonzero(most >= 0)
    # all strings around one anchor overlap there, so their union is one span
    return np.column_stack([ids[hit, 0], ids[hit, 1], ids[hit, 2] - most[hit], ids[hit, 2] - least[hit] + LENGTH]), over


FOUND_SCHEMA = "doc long, uid long, first int, last int, pos int, offset int, string binary"


def spans_of_runs(runs: DataFrame, splitters: dict) -> DataFrame:
    """Merge the runs of each part: spans that occur earlier, and (pos, offset, string) where that is open."""
    borders = {}
    for part, cuts in splitters.values():
        for i, (right, _) in enumerate(cuts):
            borders.setdefault(part + i, []).append(right)
            borders.setdefault(part + i + 1, []).append(right)
    shared = runs.sparkSession.sparkContext.broadcast(borders)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        coded = [decoded(r, unpack) for b in batches for r in b.column(b.schema.get_field_index("run")).to_pylist()]
        run, place, lengths = merge_runs([(c.right, s) for c, s in coded])
        starts = np.cumsum([0, *(len(c) for c, _ in coded)])
        at = (starts[np.array(run)] + np.array(place)).tolist()
        right, left = ([side[i] for i in at] for side in ([x for c, _ in coded for x in c.right], [x for c, _ in coded for x in c.left]))
        ids = np.concatenate([c.ids for c, _ in coded])[at]
        del coded, run, place, at
        right_length, left_length = (np.array([len(x) for x in side]) for side in (right, left))
        matrix = np.zeros((len(left), REACH), dtype=np.uint8)
        matrix[np.arange(REACH)[None, :] < left_length[:, None]] = np.frombuffer(b"".join(left), dtype=np.uint8)
        depth = np.full(len(right), -1)
        for border in shared.value.get(key[0].as_py(), ()):
            depth = np.maximum(depth, [common_prefix(x, border, 0) for x in right])
        spans, over = repeats(np.array(lengths), right_length, matrix, left_length, ids, depth)
        names, n = ["doc", "uid", "first", "last", "pos", "offset", "string"], len(spans)
        nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(spans[:, 2].astype(np.int32)), pa.array(spans[:, 3].astype(np.int32)), *nothing], names)
        for found, offset in over:  # a batch for each offset, so that few strings are held at once
            own, n = ids[found], len(found)
            strings = [xxhash.xxh3_128_digest(bytes([offset]) + left[i][:offset] + right[i][: LENGTH - offset]) for i in found.tolist()]
            nothing = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), nothing, nothing, pa.array(own[:, 2].astype(np.int32)), pa.array(np.full(n, offset, np.int32)), pa.array(strings, pa.binary())], names)

    return dealt(runs, splitters).groupBy("part").applyInArrow(merge, FOUND_SCHEMA)


def spans_over_borders(found: DataFrame) -> DataFrame:
    """Spans of open strings that are not the earliest: each range gives one row of a string at most."""
    place = F.struct("doc", "uid", "pos")
    open_ = found.where("string is not null")
    earliest = open_.groupBy("string").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = open_.join(earliest, "string").where(place != F.col("earliest")).groupBy("doc", "uid", "pos").agg(F.min("offset").alias("least"), F.max("offset").alias("most"))
    return late.select("doc", "uid", (F.col("pos") - F.col("most")).alias("first"), (F.col("pos") - F.col("least") + LENGTH).alias("last"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` and ``removed`` (spans) where bytes are removed.

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a row of smaller key, or
    earlier in the same row. Null text is empty. Null keys come last. Rows that repeat a key with other text are
    documents of their own, in an order of their texts' hashes; rows equal in key and text are one document, and each
    gets its result. Texts shorter than LENGTH keep all bytes. An empty table gives no rows; other columns are not read.
    ``kept`` is null where nothing is removed. Keys are long. Documents are told apart by key and a 64-bit hash of key
    and text; strings by 64-bit hashes within a range and by 128-bit ones over borders.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumns({"uid": F.xxhash64("key", "text"), "doc": F.coalesce(F.col("key").cast("long"), F.lit(_LAST)), "n_bytes": F.octet_length("text").cast("long")})
    rows = scratch.save(base.select("key", "doc", "uid", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "rows")
    anchored = anchors_of(base.where(F.col("n_bytes") >= LENGTH))
    # counts are saved, so that the join reads both sides anew and can split a K-gram of many places over tasks
    often = scratch.save(anchored.groupBy("kh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("kh", (F.col("c") > bucket).alias("many")), "often")
    places = scratch.save(anchored.join(often, "kh"), "places")
    scratch.drop(often)
    texts = packed(base)
    # a set, as rows equal in key and text have equal places
    at = places.groupBy("doc", "uid").agg(F.collect_set(F.struct("kh", "pos", "many")).alias("at"))
    n_ranges = max(1, -(-places.count() // bucket))
    runs = scratch.save(sorted_runs(texts.join(at, ["doc", "uid"]), n_ranges, bucket), "runs")
    scratch.drop(places)
    splitters = splitters_of(runs, n_ranges, bucket)
    found = scratch.save(spans_of_runs(runs, splitters), "found")
    spans = found.where("string is null").select("doc", "uid", "first", "last").union(runs.select(F.inline("spans")))
    if any(cuts for _, cuts in splitters.values()):
        spans = spans.union(spans_over_borders(found))
    each = scratch.save(spans.groupBy("doc", "uid").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    scratch.drop(runs)
    scratch.drop(found)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(lo, 256).to_pylist():
                    raw = unpack.decompress(row["packed"])
                    merged: list[list[int]] = []
                    for s in sorted((s["first"], s["last"]) for s in row["spans"]):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    edges = [0, *(x for s in merged for x in s), len(raw)]
                    kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    spans_ = [{"first": a, "last": b} for a, b in merged]
                    out.append((row["doc"], row["uid"], sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest(), kept, spans_))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc", "uid", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    done = texts.join(each, ["doc", "uid"]).select("doc", "uid", "packed", "spans").mapInArrow(cut, "doc long, uid long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<first:int,last:int>>")
    out = rows.join(done.dropDuplicates(["doc", "uid"]), ["doc", "uid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("key").alias(key), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept", "removed")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that occur earlier."""
    return dedup(table(spark, sf_dir, "documents")).drop("kept", "removed")
