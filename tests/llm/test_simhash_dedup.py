import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import simhash_dedup as op

LOWER = {c: c + 32 for c in range(65, 91)}


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints, radius=3):
    label = {i: i for i, _ in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, x) in enumerate(prints):
        for j, y in prints[k + 1 :]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i, _ in prints}


def test_matches_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    expected = [(r.doc_id, slow_print(r.text)) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.query(spark, sf_small).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in expected}
    assert {i: c for i, (_, c) in got.items()} == slow_groups(expected)


@pytest.mark.parametrize("radius, bucket", [(3, 16), (5, 1 << 16), (8, 64), (14, 1 << 16)])
def test_links_of_dense_and_random_prints(spark, radius, bucket):
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 200)}
    for centre in list(prints)[:5]:  # balls and chains around a few of them
        x = centre
        for _ in range(80):
            base = centre if rng.random() < 0.5 else x
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                base ^= op._signed(1 << b)
            prints.add(base)
            x = base
    rows = [(f, i) for i, f in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "fp long, id long")
    old, op.BUCKET = op.BUCKET, bucket  # small: buckets are dealt out again
    try:
        links = op.links(df, radius).collect()
    finally:
        op.BUCKET = old
    from tidemill.llm.components import components

    found = {r.node: r.component for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()}
    assert {i: found.get(i, i) for _, i in rows} == slow_groups([(i, f % (1 << 64)) for f, i in rows], radius)


def test_thresholds_follow_the_principle():
    for pairs in ([1e9, 1e9], [1e3, 1e9, 1e3], [1.0] * 4, [1.0, 1e12, 1.0, 1.0, 1.0]):
        _, limits = op.allot(pairs, [64 // len(pairs)] * len(pairs), 1000, 3)
        assert sum(limits) == 3 - len(pairs) + 1
    assert op.allot([1.0, 1e12, 1.0, 1.0, 1.0], [13] * 5, 1000, 3)[1][1] == -1


def test_defined_cases(spark):
    rows = [(0, None, 1), (1, "", 2), (2, " \t\n", 3), (3, "One Two", 4), (4, "one\ttwo", 5), (4, "one\ttwo", 5), (5, "w " * 50_000, 6), (None, "alone with no id here", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component", F.lit(9))
    got = {(r.doc_id, r.fp): r.component_id for r in op.simhash_dedup(df).collect()}
    assert {k[0]: v for k, v in got.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, None: None}
    assert op.simhash_dedup(df.limit(0)).count() == 0
    kept = op.keep_one(spark, df.select("doc_id", "text"), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 3, 5] and len(kept) == 4
    assert op.keep_one(spark, df.select("doc_id", "text").limit(0), "").count() == 0


def test_no_allocation_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "fp long, id long")
    with pytest.raises(ValueError, match="radius"):
        op.links(df, 40)


def slow_kept(texts, radius=64):
    """Ids that stay: greedy by id over all pairs, or within the groups of a radius."""
    grams = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        grams[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    groups = slow_groups([(d, slow_print(t)) for d, t in sorted(texts.items())], radius)
    leaders, kept = {}, set()
    for d in sorted(texts):
        held = leaders.setdefault(groups[d], [])
        if not any(grams[d] == grams[x] or len(grams[d] & grams[x]) >= 0.8 * len(grams[d] | grams[x]) for x in held):
            held.append(d)
            kept.add(d)
    return kept


def test_one_of_near_copies_stays(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = next(t.split() for t in texts.values() if len(t.split()) > 300)
    for k in range(40):  # edited copies of one text
        copy = list(base)
        for i in range(k % 9):
            copy[(37 * i + 11 * k) % len(copy)] = f"edit{k}x{i}"
        texts[10_000 + k] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = slow_kept(texts)
    assert {r.doc_id for r in op.keep_one(spark, df, "").collect()} == expected
    old, op.GROUP = op.GROUP, 4  # groups are dealt out and begin again
    try:
        assert {r.doc_id for r in op.keep_one(spark, df, "").collect()} == expected
    finally:
        op.GROUP = old


def test_near_copies_in_different_groups_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = slow_kept(texts)
    assert expected < slow_kept(texts, radius=8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in op.keep_one(spark, df, "").collect()} == expected


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        a = rng.permutation(200)[:n]
        b = np.union1d(a[rng.random(n) < 0.95], rng.integers(0, 200, rng.integers(0, 6)))
        shared = len(np.intersect1d(a, b))
        if len(b) and shared >= 0.8 * (n + len(b) - shared):
            first = [np.sort(x)[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1] for x in (a, b)]
            assert len(np.intersect1d(*first)) >= op.least_shared(n + len(b), max(n, len(b)), 0.8) >= 1


def test_different_texts_of_one_id_are_judged_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (2, f"{a} end"), (2, b), (2, b), (3, f"{b} end"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(None, a), (1, a), (2, b), (2, b)]
    old = op.GROUP
    try:
        for op.GROUP in (old, 1):
            got = op.keep_one(spark, df, "").collect()
            assert sorted(((r.doc_id, r.text) for r in got), key=lambda r: r[0] or 0) == expected
    finally:
        op.GROUP = old


def test_shingles_match_a_plain_count():
    rng = np.random.default_rng(6)
    word = lambda: rng.choice(["a", "b", "cc", "É", "straße", "x" * 70])
    texts = [" \t".join(word() for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 40, 300)] + [None, "", " \n ", "A b", "a  B", "ab"]
    old = op.CHUNK
    try:
        for op.CHUNK in (old, 16):
            flat, many = op.Shingler().sets(texts)
            names = {}
            for text, h in zip(texts, np.split(flat, np.cumsum(many)[:-1])):
                w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
                grams = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
                assert len(grams) == len(h) and (h[1:] > h[:-1]).all()
                for g in grams:
                    names.setdefault(g, set(h.tolist())).intersection_update(h.tolist())
            assert all(names[g] for g in names)
    finally:
        op.CHUNK = old


def test_stage_keeps_odd_columns(spark):
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, a, "x"), (2, a + " end", "y"), (3, "other", "z"), (None, a, "n")], "doc_id long, text string, gone string").withColumn("gone_id", F.lit(1)).withColumn("rank", F.lit(2))
    out = op.keep_one(spark, df, "")
    assert out.columns == df.columns and {r.gone for r in out.collect()} == {"x", "z", "n"}


def test_a_filter_of_ids_loses_none(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("key"), F.col("id").cast("string").alias("words"))
    ids = spark.range(0, 20_000, 10)
    old = op.FILTER
    try:
        for op.FILTER, most in ((old, 3000), (16, 20_000)):  # a full filter lets all pass
            passed = {r.words for r in op.sifted(df, F.col("key"), ids).collect()}
            others = {r.words for r in op.sifted(df, F.col("key"), ids, among=False).collect()}
            assert {str(i) for i in range(0, 20_000, 10) if i % 7} <= passed and len(passed) <= most
            assert not passed & others and len(passed | others) == 20_000
            assert op.sifted(df, F.col("key"), ids.limit(0)).count() == 0
    finally:
        op.FILTER = old


def shuffled(spark):
    """Bytes that the session has shuffled, over all stages that are remembered."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_without_copies_are_not_shuffled(spark):
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 256, 40_000).astype(np.uint8).tobytes().hex() for _ in range(250)]  # a long word, so few shingles
    texts = [f"{' '.join(f'w{i}x{j}' for j in range(20))} {t}" for i, t in enumerate(texts)]
    same = " ".join(f"same{j}" for j in range(60))
    rows = [*enumerate(texts), (1000, same), (1001, f"{same} end"), (1002, f"{same} other end"), (None, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, group = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), op.GROUP
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for op.GROUP in (group, 1):
            before = shuffled(spark)
            kept = op.keep_one(spark, df, "").collect()
            assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [*range(250), 1000] and len(kept) == 252
            moved = sum(n for k, n in shuffled(spark).items() if k not in before)
            assert moved < 4_000_000  # three joins of whole texts by ids moved 57 MB
    finally:
        op.GROUP = group
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
