import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import neardup
from palimpsest.llm.simhash import _hashes


def sets_of(texts):
    return [frozenset(_hashes(t, 5).tolist()) for t in texts]


def kept_by_brute_force(rows, similarity=0.8):
    sets = sets_of(t for _, t in rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not both or same >= similarity * both:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return sorted(min(v) for v in least.values())


def near_copies(seed, groups=40, copies=6, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_keeps_one_of_each_group(spark):
    rows = near_copies(1)
    got = sorted(r.doc_id for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(rows)


def test_large_keys_and_split_buckets_give_the_same_groups(spark):
    rows = near_copies(2, groups=3, copies=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = spark.createDataFrame(neardup.with_fingerprints(docs, "doc_id", "text", 5).dropDuplicates(["_nd_class"]).collect(), "_nd_id long, _nd_text long, _nd_fp array<bigint>, _nd_class bigint, _nd_prefix array<bigint>")

    def texts_of(nodes):
        known = classes.join(docs, F.col("_nd_id") == F.col("doc_id")).select(F.col("_nd_class").alias("class"), "text")
        return known.join(nodes, "class", "left_semi")

    ways = [dict(), dict(bucket_rows=8)]
    same = [dict(neardup.linked(classes, texts_of, **w).collect()) for w in ways]
    assert same[0] and same[0] == same[1]


def test_many_losers_take_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    test_keeps_one_of_each_group(spark)


def test_edges(spark):
    rows = [(5, None), (4, ""), (None, " "), (9, "Only four words here"), (8, "only  FOUR words here"), (7, "x y z"), (7, "x y z"), (6, "long " * 20000), (None, "alone with a null id and more words")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp) for r in neardup.dedup(docs).collect()), key=str)
    assert got == [(4, "f"), (6, "f"), (7, "f"), (8, "f"), (None, "f")]
    assert neardup.dedup(docs.limit(0)).count() == 0


def straddling(seed, groups=25, words=400):
    """Groups whose similarities lie on both sides of 0.8: 0.816 with eight words changed in all, 0.796 with nine."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for k in range(6):
            other = list(base)
            for x in rng.sample(range(words // 6), rng.randrange(4, 6)):
                other[6 * x] = f"x{g}_{k}_{x}"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_failed_edges_leave_no_close_pair_unverified(spark):
    rows = straddling(5)
    got = sorted(r.doc_id for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(rows)


def test_search_by_bits_is_all_pairs(spark):
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 63, 30, dtype=np.uint64)[rng.integers(0, 30, 300)]
    for _ in range(5):
        words ^= np.where(rng.random(300) < 0.6, np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64), np.uint64(0))
    words[:3] = words[3]
    fps = [[int(w), *map(int, rng.integers(0, 1 << 62, 3))] for w in words.view(np.int64)]
    classes = spark.createDataFrame(list(enumerate(fps)), "_nd_class long, _nd_fp array<bigint>")
    apart = np.bitwise_count(words[:, None] ^ words[None, :])
    found = {tuple(r) for r in neardup.bit_pairs(classes).collect()}
    least = {w: int(np.nonzero(words == w)[0][0]) for w in words}
    across = {(a, b) for a in least.values() for b in least.values() if a < b and apart[a, b] <= neardup.DISTANCE}
    assert len(across) > 100 and found == across | {(least[w], i) for i, w in enumerate(words) if i != least[w]}
    assert {tuple(r) for r in neardup.bit_pairs(classes, bucket_rows=2).collect()} < found
    assert neardup.bit_pairs(classes.limit(0)).count() == 0


def test_fingerprints_find_near_copies_by_themselves(spark, monkeypatch):
    rng = random.Random(10)
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(400)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-1], f"x{rng.random()}"]))]
    meetings = neardup.meetings
    monkeypatch.setattr(neardup, "meetings", lambda classes: meetings(classes.limit(0)))
    got = sorted(r.doc_id for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(rows) == list(range(0, 60, 2))


def joined(pairs, labels):
    """Labels of rows once the pairs' groups are one."""
    labels = list(labels)
    for a, b in pairs:
        labels = [labels[a] if x == labels[b] else x for x in labels]
    return [labels.index(x) for x in labels]


def test_forests_join_what_all_pairs_join_and_nothing_more():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)[rng.integers(0, 3, 200)] ^ (np.uint64(1) << rng.integers(0, 64, (200, 4), dtype=np.uint64))
    group = rng.integers(0, 150, 200)
    close = [(a, b) for a in range(200) for b in range(a + 1, 200) if np.bitwise_count(fps[a] ^ fps[b]).sum() <= 7]
    got = neardup.close_forest(fps, group, 7)
    assert joined(got, group) == joined(close, group) and set(got) <= set(close) and len(got) < 150
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))) + 1000 * rng.integers(0, 3) for _ in range(120)] + [np.empty(0, dtype=np.int64)]
    group = rng.integers(0, 100, 121)
    like = [(a, b) for a in range(121) for b in range(121) if a != b and len(np.intersect1d(sets[a], sets[b])) >= max(0.5 * len(np.union1d(sets[a], sets[b])), 1)]
    got = neardup.exact_forest(sets, group, 0.5)
    assert like and joined(got, group) == joined(like, group) and set(got) <= set(like)


def test_repeats_of_a_line_do_not_part_near_copies(spark):
    rng = random.Random(7)
    rows, apart = [], []
    for g in range(20):
        words, line = [f"g{g}w{rng.randrange(10**6)}" for _ in range(400)], " ".join(f"g{g}line{i}" for i in range(10))
        pair = [" ".join([*words[:200], *[line] * n, *words[200:]]) for n in (1, 10)]
        rows += [(2 * g + k, t) for k, t in enumerate(pair)]
        apart.append(int(np.bitwise_count(neardup.wide_fingerprint(pair[0]) ^ neardup.wide_fingerprint(pair[1])).sum()))
    assert np.mean(apart) < 0.06 * neardup.BITS, np.mean(apart)
    got = sorted(r.doc_id for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(rows) == list(range(0, 40, 2))


def test_pairs_meet_whatever_the_number_of_rows():
    rng = np.random.default_rng(8)
    missed = {0: 0, 1: 0}
    search = neardup.most_bits()
    common = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    for _ in range(4000):  # nothing in the plan, the keys or the limit depends on the number of rows
        shared, own = rng.integers(0, 1 << 63, (2, 120), dtype=np.uint64)
        shared[: rng.integers(0, 60)] = common[: rng.integers(1, 60)][0]
        a, b = (np.unique(np.concatenate([shared, own[k : k + 15]])) for k in (0, 15))
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        p, q = (neardup.prefix(x, 0.8, common, np.arange(60)) for x in (a, b))
        missed[0] += not len(np.intersect1d(p, q))
        x, y = (neardup.fingerprint_of(s) for s in (a, b))
        missed[1] += int(np.bitwise_count(x ^ y).sum()) > search
    assert missed == {0: 0, 1: 0}
