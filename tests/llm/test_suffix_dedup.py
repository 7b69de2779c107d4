import hashlib
import random

from pyspark.sql import functions as F

from tidemill.llm import suffix_dedup as op


def slow(docs):
    """doc_id, bytes -> (n_bytes, n_removed, n_spans, sha256)."""
    seen, out = {}, []
    for d, t in docs:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            seen[w] = min(seen.get(w, d), d)
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if seen[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in op.suffix_dedup(df).collect())
    assert got == slow([(d, (t or "").encode()) for d, t in docs])


def test_random_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["the", "an", "é", "ing", "er", "st"]) for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 30, 60)]
    docs = []
    for d in range(150):
        parts = [" ".join(word() for _ in range(rng.choice([0, 3, 40]))) for _ in range(3)]
        for k in range(2):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.insert(rng.randrange(3), rng.choice([p, p[a:], p[: a + 1]]))
        docs.append((d, " ".join(parts)))
    for k in range(30):  # copies and edited copies
        t = rng.choice(docs)[1]
        i = rng.randrange(len(t))
        docs.append((200 + k, rng.choice([t, t[:i] + "X" + t[i + 1 :], t[i:] + t[:i]])))
    docs += [(7000, "abc" * 100), (7001, "abc" * 90), (7002, "a" * 49), (7003, "a" * 50), (7004, "a" * 51), (7005, "a" * 49)]
    rng.shuffle(docs)
    check(spark, docs)
    old = op.HOT, op.BLOCK, op.ROUND, op.COMMON
    try:
        op.COMMON = 10**9  # none is common beforehand
        check(spark, docs)
        op.HOT, op.ROUND = 3, 2000  # finer keys for nearly all
        check(spark, docs)
        op.COMMON, op.REMEMBERED = 2, 5
        check(spark, docs)
        op.HOT, op.BLOCK = 10**9, 2  # large blocks are cut
        check(spark, docs)
    finally:
        op.HOT, op.BLOCK, op.ROUND, op.COMMON = old
        op.REMEMBERED = 1 << 16


def test_small_table(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = sorted(tuple(r)[:5] for r in op.query(spark, sf_small).collect())
    assert got == slow([(d, (t or "").encode()) for d, t in docs])


def test_defined_cases(spark):
    text = "a passage that is rather longer than fifty bytes, as must be said here; "
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, text), (None, text), (None, "x" + text), (6, text * 2000), (5, text), (5, text + "tail"), (9, text[1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(1)).withColumn("k", F.lit("a")).withColumn("runs", F.lit(1))
    got = sorted((tuple(r) for r in op.suffix_dedup(df).collect()), key=str)
    null = [r for r in got if r[0] is None]
    assert len(got) == len(rows) and [r[2] for r in null if r[1] == len(text)] == [len(text)] and [r[2] for r in null if r[1] > len(text)] == [len(text)]
    assert [r[2] for r in got if r[0] == 5] == [0, 0, 0] and {r[2] for r in got if r[0] == 9} == {len(text) - 1}
    big = next(r for r in got if r[0] == 6)
    # strings over the seam of two copies are new in document 6
    assert big[1] == len(text) * 2000 and big[2] == len(text) * 2000
    assert op.suffix_dedup(df.limit(0)).count() == 0


def test_texts_whose_hashes_clash(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [text(200) for _ in range(12)]
    docs = [(i, base[i % 12] if i % 3 else base[i % 12][:100] + text(100)) for i in range(60)] + [(100, "short"), (101, "other"), (102, "short")]
    monkeypatch.setattr(op, "text_hash", lambda t: F.length(t).cast("long"))  # all texts of a length
    check(spark, docs)


def test_many_segments_of_one_anchor(spark):
    rng = random.Random(9)
    gram = "-" * 40
    parts = ["".join(rng.choice("abcd") for _ in range(12)) for _ in range(700)]
    docs = [(1, gram.join(parts)), (2, gram.join(rng.sample(parts, 600)))]
    old = op.COMMON
    try:
        for op.COMMON in (2, 10**9):
            check(spark, docs)
    finally:
        op.COMMON = old


def test_stage_with_odd_rows_and_columns(spark):
    text = "a passage that is rather longer than fifty bytes, as must be said here; "
    rows = [(1, None, "a"), (2, "", "b"), (3, "short", "c"), (3, "short", "c"), (4, "short", "d"), (5, text + "own words", "e"), (5, text + "own words", "e"), (6, text, "f"), (7, "é" * 40 + text, "g"), (None, "é" * 40 + text, "h"), (8, "new " * 30_000, "i")]
    names = ["doc_id", "text", "size", "least", "own", "runs", "k", "th", "_k", "n_chars"]
    df = spark.createDataFrame([(d, t, x, x, x, x, x, x, x, 0) for d, t, x in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:-1]) + ", n_chars long")
    out = op.remove_repeats(spark, df, "")
    assert out.columns == names and out.schema == df.schema
    got = sorted((str(r.doc_id), r.text, r.size, r.n_chars) for r in out.collect())
    kept = "é" * 40
    assert [g for g in got if g[0] == "7"] == [("7", kept, "g", 40)] and {g[2] for g in got} == set("abcdegi")
    assert [g[2] for g in got if g[0] == "5"] == ["e", "e"] and all(g[3] == len(g[1] or "") or g[1] is None for g in got)
    assert op.remove_repeats(spark, df.limit(0), "").count() == 0


def test_common_anchors_take_little_more_time_than_others():
    import time

    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    data = rng.randbytes(1_000_000)
    (found,) = op._text_anchors(iter([pa.RecordBatch.from_arrays([pa.array([data], pa.large_binary())], ["text"])]))
    common = np.sort(found.column(0).to_numpy().view(np.uint64))
    hasher, none = op.Hasher(), np.zeros(0, np.int64)
    least = {}
    for name, known in (("none", common[:0]), ("all", common)):
        times = []
        for _ in range(5):
            began = time.thread_time()
            segments = op.text_segments(hasher, np.frombuffer(data, np.uint8), none, 64, known)
            times.append(time.thread_time() - began)
        least[name] = min(times)
    # the share of common anchors grows with the table, so their parts must not take a Python step each
    assert least["all"] < 5 * least["none"]
    key, low, high, _ = segments
    assert (high - low).max() <= op.WIDTH and (high - low).sum() == len(data) - op.LENGTH + 1


def test_parts_of_equal_strings_have_equal_keys():
    import numpy as np

    rng = random.Random(12)
    passage = rng.randbytes(300)
    keys = []
    for before, after in ((7, 90), (64, 3)):
        data = np.frombuffer(rng.randbytes(before) + passage + rng.randbytes(after), np.uint8)
        hasher = op.Hasher()
        h, place, first, end = hasher.anchors(hasher.words(data))
        own = {}
        for owner, key, low, high in zip(*(x.tolist() for x in op.parts_of(hasher, hasher.words(data), h, place, first, end))):
            own |= {s - before: key for s in range(low, high)}
        assert len(own) == len(data) - op.LENGTH + 1
        keys.append([own[s] for s in range(len(passage) - op.LENGTH + 1)])
    assert keys[0] == keys[1] and len(set(keys[0])) > 40
