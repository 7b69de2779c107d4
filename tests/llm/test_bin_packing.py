import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemill.llm import bin_packing as op


def slow(pieces, capacity):
    bins = []  # (left, sources, clusters)
    out = []
    for size, source, cluster in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        if fits:
            _, i = min(fits)
        else:
            bins.append([capacity, set(), set()])
            i = len(bins) - 1
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return out


def test_packer_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        pieces = [(rng.randint(1, 20), rng.choice("aaabcdefg"), rng.randint(0, 30)) for _ in range(120)]
        pieces.sort(key=lambda p: -p[0])
        assert op.pack(pieces, 20) == slow(pieces, 20)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: (r.source, len((r.text or "").split()), " ".join((r.text or "").lower().split())) for r in docs.collect()}
    got = op.bin_packing(docs, shard_words=100_000).collect()
    words, bins = defaultdict(int), defaultdict(list)
    for r in got:
        words[r.doc_id] += r.n_words
        bins[r.shard, r.bin].append(r)
    assert dict(words) == {i: n for i, (_, n, _) in rows.items()}
    assert len({r.shard for r in got}) > 2
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert sum(r.n_words for r in held) <= op.CAPACITY
        assert all(a.offset + a.n_words == b.offset for a, b in zip(held, held[1:])) and held[0].offset == 0
        assert len({rows[r.doc_id][0] for r in held}) == len(held) == len({rows[r.doc_id][2] for r in held})


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 5000, "a"), (4, "same text", None), (4, "same text", None), (5, "Same  TEXT", "b"), (None, "other", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit(3)).withColumn("size", F.lit(1))
    got = op.bin_packing(df).collect()
    assert sorted(r.n_words for r in got if r.doc_id == 3) == [904, 2048, 2048]
    assert all(r.bin is None and r.n_words == 0 for r in got if r.doc_id in (1, 2)) and len(got) == 9
    assert len({(r.shard, r.bin) for r in got if r.doc_id in (4, 5)}) == 3
    assert op.bin_packing(df.limit(0)).count() == 0
    one = op.bin_packing(df, cluster="size").collect()
    assert len({(r.shard, r.bin) for r in one if r.n_words}) == 7


def test_many_pieces_of_one_source_and_of_one_row(spark):
    import time

    pieces = [(1, "s", i) for i in range(20_000)] + [(1, i % 40, -i) for i in range(20_000)]
    began = time.thread_time()
    placed = op.pack(pieces, 2048)
    assert time.thread_time() - began < 10 and len(set(placed)) == len(pieces)
    assert placed[:500] == slow(pieces[:500], 2048)
    df = spark.createDataFrame([(None, "same words", "s")] * 1050 + [(1, None, "s")] * 3, "doc_id long, text string, source string").withColumn("w", F.lit(1)).withColumn("n", F.lit("a"))
    got = op.bin_packing(df, shard_words=300).collect()
    assert len(got) == 1053 and len({(r.shard, r.bin) for r in got if r.n_words}) == 1050
    shards = {r.shard for r in got}
    assert len(shards) > 3 and max(sum(r.shard == s for r in got) for s in shards) <= 500
