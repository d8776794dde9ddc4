"""N-gram Jaccard join with prefix filters under several global orders of tokens.

If two sets of shingles are similar enough, they share a token in their prefixes under any order of all tokens. Order
one puts rare tokens first, by a sketch of frequencies; its prefixes are the index that makes candidates. Under this
order and two more, by hashes, a candidate must share as many prefix tokens as similar sets do. What passes the
filters of all orders is verified on whole sets. Documents with equal sets are one class from the start.

Candidates of a token need not be all pairs that have it. Its smallest class is a hub that meets every other; what
links to the hub is then known to be connected, and only classes that are still apart meet later, in blocks of hubs,
until every pair of a token is either compared or known to be connected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tractlake.llm.common import Scratch, components, counted, table, total
from tractlake.llm.memory import trimmed
from tractlake.llm.textkernel import mix, shingle_sets, text_bytes

#: Shingles for each counter of the frequency sketch, and the bits of its size: the driver and every task hold it once.
PER_COUNTER, SKETCH_BITS = 1024, (16, 22)
#: Tokens of fewer classes than this meet in all pairs at once; larger ones through hubs.
SMALL = 8
#: Hubs of the rounds after the first; the last number goes on.
HUBS = (2, 16, 128, 1024)
#: Hash orders beside the order by frequency.
ORDERS = 2
_SEEDS = mix(np.arange(101, 101 + ORDERS, dtype=np.uint64))


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n among which any set at least so similar has one."""
    return n - -(-percent * n // 100) + 1


def first_by(keys: np.ndarray, tokens: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` tokens first in the order of (key, token), in that order."""
    if count < len(tokens):
        few = keys <= np.partition(keys, count - 1)[count - 1]
        keys, tokens = keys[few], tokens[few]
    return tokens[np.lexsort((tokens, keys))[:count]]


def set_digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def sets_of(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """Key, size and digest of every row's set."""

    def run(batches):
        for batch in batches:
            sizes, digests = [], []
            for s in shingle_sets(text_bytes(batch.column(1)), k):
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["id", "n", "digest"])

    return docs.select(key, text).mapInArrow(trimmed(run), f"id {docs.schema[key].dataType.simpleString()}, n long, digest binary")


class Sketch:
    """How many documents' sets have a token of each counter, as eighths of a power of two: enough for an order."""

    def __init__(self, counts: np.ndarray):
        self.shift = np.uint64(64 - (len(counts).bit_length() - 1))
        self.levels = np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.levels[(tokens >> self.shift).astype(np.int64)]


def sketch_of(docs: DataFrame, k: int, text: str, n_shingles: int) -> Sketch:
    """A sketch over all documents, its size in proportion to their shingles."""
    bits = min(max(SKETCH_BITS[0], (n_shingles // PER_COUNTER).bit_length()), SKETCH_BITS[1])
    size, shift = 1 << bits, np.uint64(64 - bits)

    def run(batches):
        count = np.zeros(size, dtype=np.int64)
        for batch in batches:
            found = np.concatenate([np.empty(0, np.uint64), *(s >> shift for s in shingle_sets(text_bytes(batch.column(0)), k))])
            at, n = np.unique(found.astype(np.int64), return_counts=True)
            count[at] += n
        at = np.flatnonzero(count)
        for lo in range(0, len(at), 1 << 16):
            few = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(few.astype(np.int32)), pa.array(count[few])], ["i", "c"])

    out = np.zeros(size, dtype=np.int64)
    found = docs.select(text).mapInArrow(trimmed(run), "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out[found.column("i").to_numpy()] = found.column("c").to_numpy()
    return Sketch(out)


def prefixes_of(docs: DataFrame, frequency: Sketch, k: int, percent: int, key: str, text: str) -> DataFrame:
    """Key, size, digest and prefix tokens in the order by frequency of every row with a set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches):
        frequency = shared.value
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for s in shingle_sets(text_bytes(batch.column(1)), k):
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                order = frequency.of(s)
                prefixes.append(first_by(order, s, prefix_length(len(s), percent)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "digest", "prefix"])

    return docs.select(key, text).mapInArrow(trimmed(run), f"id {docs.schema[key].dataType.simpleString()}, n long, digest binary, prefix array<bigint>").where("prefix is not null")


def filters_of(docs: DataFrame, frequency: Sketch, k: int, percent: int) -> DataFrame:
    """Id, n, and prefix tokens under every order. Halves of tokens do; ``same`` is how many that makes equal at most."""
    names = [f"p{j}" for j in range(ORDERS + 1)]
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches):
        frequency = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            sizes, same = [], []
            for s in shingle_sets(text_bytes(batch.column(1)), k):
                keys = [mix(s ^ seed) for seed in _SEEDS] + [frequency.of(s)]
                found = [(first_by(x, s, prefix_length(len(s), percent)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in keys]
                sizes.append(len(s))
                same.append(max(len(x) - len(np.unique(x)) for x in found))
                for column, x in zip(columns, found, strict=True):
                    column.append(x.view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.int64()), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], ["id", "n", "same", *names])

    return docs.select("id", "text").mapInArrow(trimmed(run), f"id {docs.schema['id'].dataType.simpleString()}, n long, same long, " + ", ".join(f"{x} array<int>" for x in names))


def enough_in_prefixes(percent: int):
    """Whether prefixes share as many tokens under every order as similar sets must.

    Similar sets share at least percent * (n + m) / (100 + percent) tokens. Of these, all that stand in the prefix
    that ends first stand in the other too, and behind it there is room for the rest of its set only.
    """
    behind = F.greatest(*(F.ceil(percent * F.col(f"{x}_n") / 100) - 1 for x in "ab"))
    needed = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent)) - behind - F.least("a_same", "b_same")
    out = F.lit(True)
    for j in range(ORDERS + 1):
        out = out & (F.size(F.array_intersect(f"a_p{j}", f"b_p{j}")) >= needed)
    return out


def tokens_of(docs: DataFrame, k: int) -> DataFrame:
    """Id and whole set."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(text_bytes(batch.column(1)), k)], pa.list_(pa.int64()))], ["id", "tokens"])

    return docs.select("id", "text").mapInArrow(trimmed(run), f"id {docs.schema['id'].dataType.simpleString()}, tokens array<bigint>")


def place_of(n: str, pos: str):
    """A row's size and the place of its token in its prefix, from 1, in one number."""
    return F.col(n) * F.lit(1 << 32) + F.col(pos) + 1


def similar_enough(x: str, y: str, percent: int):
    """Whether two rows of a token may be similar, by size, and by place if this is their first token in common.

    Before their first common token they share nothing, so the rest of the shorter one bounds what they share. Where
    it is not the first, the pair is judged at the first one instead.
    """
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    rest = F.least(n - F.col(x).bitwiseAND((1 << 32) - 1), m - F.col(y).bitwiseAND((1 << 32) - 1))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((rest + 1) * (100 + percent) >= percent * (n + m))


def with_both(scratch: Scratch, pairs: DataFrame, of) -> tuple[DataFrame, DataFrame]:
    """Pairs with what ``of`` gives for the ids of both sides, and a table to drop after use."""
    ids = scratch.save(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    made = of(counted(ids))
    side = lambda s: made.select(*(F.col(c).alias(f"{s}_{c}") for c in made.columns))
    return pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id")), ids


def verified(scratch: Scratch, pairs: DataFrame, docs: DataFrame, filters: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b, distinct) of ids, all sets of either id compared, those that pass the hash orders' filters and are similar on whole sets."""
    both, ids = with_both(scratch, pairs, lambda ids: filters.join(ids, "id", "left_semi"))
    passed = scratch.save(both.where(enough_in_prefixes(percent)).select("a", "b"), "passed")
    scratch.drop(ids)
    if passed.isEmpty():
        return passed
    tokens = []

    def sets(ids):
        tokens.append(scratch.save(tokens_of(docs.join(ids, "id", "left_semi"), k), "tokens"))
        return tokens[0]

    both, ids = with_both(scratch, passed, sets)
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    out = scratch.save(both.where(100 * common >= percent * (F.size("a_tokens") + F.size("b_tokens") - common)).select("a", "b"), "links")
    for t in (ids, passed, *tokens):
        scratch.drop(t)
    return out


def linked(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links, itself included) and class_id.

    A row's set are its distinct k-word shingles (runs outside ASCII white space, A-Z lower-cased); with fewer words
    its whole sequence; without text or words it is empty, n_shingles is 0, and it is linked with nothing. Two rows
    link when 100 * intersection >= percent * union. class_id is the smallest key with the same set. Keys are long;
    rows with a null key are left out of links and have a null component. Rows that repeat a key are one document
    if their sets are equal; if not, they count as linked, since a component is a set of keys. An empty table gives
    no rows. Other columns are not read. Candidates are found for all sets; no bucket is cut.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sets = scratch.save(sets_of(docs, k, "id", "text"), "sets")
    known = sets.where("digest is not null and id is not null")
    classes = scratch.save(known.groupBy("digest").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("copies")), "classes")
    member = classes.where("copies > 1")
    # one set (id, digest) for each class stands for it; where a key repeats with other sets, each set keeps its own row
    standing = known.join(member, "digest", "left").withColumn("cls", F.coalesce("cls", "id"))
    copy = scratch.save(standing.where("id <> cls").select("id", "digest").distinct(), "copies")
    frequency = sketch_of(docs, k, "text", total(sets, F.sum("n"))[0] or 0)
    prefixes = prefixes_of(docs, frequency, k, percent, "id", "text").where("id is not null")
    tokens = scratch.save(prefixes.join(counted(copy), ["id", "digest"], "left_anti").select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", F.col("id").alias("cls"), place_of("n", "pos").alias("place")), "tokens")
    heads = scratch.save(tokens.groupBy("token").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"), "heads")
    lists = scratch.save(tokens.join(heads, "token"), "lists")
    scratch.drop(tokens)
    scratch.drop(heads)
    # prefixes under all orders, once for every document that is in a candidate pair at all: later rounds read these
    met = scratch.save(lists.select(F.col("cls").alias("id")).distinct(), "met")
    filters = scratch.save(filters_of(docs.join(counted(met), "id", "left_semi"), frequency, k, percent), "filters")
    hub = lists.where("cls = hub").select("token", F.col("place").alias("hub_place"))
    to_hub = lists.where("cls > hub").join(hub, "token").where(similar_enough("place", "hub_place", percent)).select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    small = lists.where((F.col("m") > 2) & (F.col("m") < SMALL) & (F.col("cls") > F.col("hub"))).select("token", "cls", "place")
    other = small.select("token", F.col("cls").alias("b"), F.col("place").alias("b_place"))
    pairs_of_small = small.join(other, "token").where("cls < b").where(similar_enough("place", "b_place", percent)).select(F.col("cls").alias("a"), "b")
    done = scratch.save(to_hub.union(pairs_of_small).distinct(), "pairs")
    links = verified(scratch, done, docs, filters, k, percent)
    # rows that repeat a key with another set tie their classes together
    ties = standing.where("cls <> id").select(F.col("id").alias("a"), F.col("cls").alias("b"))
    all_links, round_no = [links, ties], 0
    labels = scratch.save(components(scratch, union(all_links)), "components")
    large = scratch.save(lists.where(F.col("m") >= SMALL).where(F.col("cls") > F.col("hub")).select("token", "cls", "place"), "large")
    scratch.drop(lists)
    while True:
        # tokens whose classes are not all connected: what is left of them, smallest first
        now = large.join(labels, large["cls"] == labels["v"], "left").select("token", "cls", "place", F.coalesce("component", "cls").alias("part"))
        open_ = now.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
        left = scratch.save(now.join(open_, "token"), "left")
        scratch.drop(large)
        if left.isEmpty():
            break
        hubs = HUBS[min(round_no, len(HUBS) - 1)]
        # tasks keep a token's first classes each before they are shuffled, so no task gets all of a token
        rank = F.dense_rank().over(Window.partitionBy("token").orderBy("cls"))
        hub = left.withColumn("rank", rank).where(F.col("rank") <= hubs).select("token", F.col("cls").alias("a"), F.col("place").alias("a_place"), F.col("part").alias("a_part"))
        hub = scratch.save(hub, "hubs")
        pairs = left.join(hub, "token").where("cls > a and part <> a_part").where(similar_enough("place", "a_place", percent)).select("a", F.col("cls").alias("b")).distinct()
        fresh = scratch.save(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.union(fresh)
        found = verified(scratch, fresh, docs, filters, k, percent)
        if not found.isEmpty():
            all_links.append(found)
            labels = scratch.save(components(scratch, union(all_links)), "components")
        last = hub.groupBy("token").agg(F.max("a").alias("last"))
        large = scratch.save(left.join(last, "token").where("cls > last").select("token", "cls", "place"), "large")
        scratch.drop(left)
        scratch.drop(hub)
        round_no += 1
    out = sets.join(member, "digest", "left").join(labels, F.col("id") == F.col("v"), "left")
    own = F.when(F.col("n") > 0, F.coalesce("cls", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), own)).alias("component_id"), F.when(F.col("id").isNotNull(), own).alias("class_id"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("a", "b")
    for f in frames[1:]:
        out = out.union(f.select("a", "b"))
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return linked(table(spark, sf_dir, "documents"), k=4, percent=85)


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS t FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y USING (t) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
  r AS (SELECT doc_id, doc_id AS v FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.c AS component_id, h.c AS class_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(v) AS c FROM r GROUP BY 1) g USING (doc_id)
JOIN (SELECT doc_id, CASE WHEN len(k) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k) END AS c
      FROM (SELECT d.doc_id, coalesce(list_sort(list(s.t) FILTER (s.t IS NOT NULL)), []) AS k FROM d LEFT JOIN s USING (doc_id) GROUP BY 1)) h USING (doc_id)
"""
