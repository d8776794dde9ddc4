import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_pipeline_equals_its_stages_by_hand(spark):
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    scores = {r.doc_id: r.predicted for r in entry.queries()["op5_toxicity"](spark, SMALL).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if not p}
    one = corpus_pipeline.one_of_near_copies(spark, docs, SMALL)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [words(r.text)] for i in range(len(w) - 4)} for r in docs.collect()}
    left = sorted(r.doc_id for r in one.collect())
    for a in left:
        for b in left:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert out and {"doc_id", "text", "shard", "slot"} <= set(out[0].__fields__) and {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}


def test_near_copies_keep_rows_without_words_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    apart = [(7, ""), (7, None), (8, " \t"), (8, " \t"), (None, a), (None, a), (None, "")]
    rows = [*apart, (7, a), (3, b), (8, b + " more"), (5, "few words"), (9, "few  words")]
    out = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert Counter(map(tuple, out.collect())) == Counter([*apart, (7, a), (3, b), (5, "few words")])


def test_registered():
    have = entry.queries()
    assert "pipeline" in have and all(any(q.startswith(f"op{n}_") for q in have) for n in range(1, 11))


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with null and repeated ids, copies, benchmark passages and several sources."""
    import random

    rng, root = random.Random(21), str(tmp_path_factory.mktemp("corpus"))
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.randrange(3, 40))) for i in range(12)] + [(12, None), (13, "")]
    rows = [(i, prose(rng.randrange(20, 160)), f"s{rng.randrange(4)}" if i % 9 else None) for i in range(150)]
    for i in range(0, 60, 6):  # whole items, and items cut short
        item = items[i // 6][1].split()
        cut = item if i % 12 else item[: max(1, len(item) * 2 // 3)]
        rows[i] = (i, f"{rows[i][1]} {' '.join(cut).upper() if i % 18 == 0 else ' '.join(cut)} {prose(10)}", rows[i][2])
    rows += [(150 + i, rows[7][1], "copies") for i in range(5)] + [(7, prose(30), "s1"), (None, prose(40), "s2"), (None, rows[6][1], "s2"), (None, None, None), (160, "", "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, docs, items


def test_decontamination_stage_in_both_directions(spark, corpus):
    root, docs, items = corpus

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def holds(text, item):
        w, v = words_of(text), words_of(item)
        k = min(5, len(v))
        own = grams(v, k) if k else set()
        return bool(own) and len(own & grams(w, k)) >= 0.8 * len(own)

    want = Counter(tuple(r) for r in docs.collect() if not any(holds(r.text, t) for _, t in items))
    out = corpus_pipeline.decontaminated(spark, docs, root)
    assert Counter(map(tuple, out.collect())) == want and out.columns == docs.columns and 0 < want.total() < docs.count()


def test_near_copy_stage_in_both_directions(spark, corpus):
    root, docs, _ = corpus
    rows = [tuple(r) for r in docs.collect()]
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[0] is None or b[0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if a[0] == b[0] or 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r, s in zip(group, rows, sets, strict=True):
        if r[0] is not None and s and (g not in best or (r[0], r[1]) < (best[g][0], best[g][1])):
            best[g] = r
    want = Counter(r for g, r, s in zip(group, rows, sets, strict=True) if r[0] is None or not s or best[g] == r)
    assert Counter(map(tuple, corpus_pipeline.one_of_near_copies(spark, docs, root).collect())) == want


def test_mixing_stage_copies_and_shares(spark, corpus):
    root, docs, _ = corpus
    out = corpus_pipeline.mixed(spark, docs, root)
    have, got = Counter(tuple(r) for r in docs.collect()), Counter(map(tuple, out.collect()))
    assert out.columns == docs.columns and set(got) <= set(have) and all(n <= 3 * have[r] for r, n in got.items())
    assert not any(r[1] is None or not r[1].split() for r in got)
    size, mixed = Counter(), Counter()
    for r, n in have.items():
        size[r[3]] += n * len(words_of(r[1]))
    for r, n in got.items():
        mixed[r[3]] += n * len(words_of(r[1]))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    from tractlake.llm import mixing

    target = dict(zip(names, mixing.water_fill([size[s] for s in names], [float(i % 3 + 1) for i in range(len(names))]), strict=True))
    # whole documents stand for words: a source of few documents comes near its target only roughly
    assert all(abs(mixed[s] - t) <= 0.35 * t + 200 for s, t in target.items())
    assert Counter(map(tuple, corpus_pipeline.mixed(spark, docs, root).collect())) == got


def test_sharding_stage_keeps_all(spark, corpus):
    root, docs, _ = corpus
    out = corpus_pipeline.sharded(spark, docs, root)
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(map(tuple, docs.collect()))
    per = Counter(r["shard"] for r in out.collect())
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(40))


def test_toxicity_stage_without_labels_keeps_all(spark, corpus):
    root, docs, _ = corpus
    assert Counter(map(tuple, corpus_pipeline.drop_toxic(spark, docs, root).collect())) == Counter(map(tuple, docs.collect()))
