import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemill.llm import decontaminate as op


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def slow(docs, items):
    out = {}
    for d, text in docs:
        g = grams(text)
        for i, item in items:
            h = grams(item)
            if not h or len(g) < len(h):
                continue
            want = Counter(h)
            best = max((sum((Counter(g[s : s + len(h)]) & want).values()) / len(h), -s) for s in range(len(g) - len(h) + 1))
            if best[0] >= 0.8:
                out[d, i] = max(out.get((d, i), (0,)), (round(best[0], 6),))
    return out


def test_matches_brute_force_over_all_windows(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("the of and cat dog red blue sun moon tree".split()) + rng.choice(["", "", "x", "y", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 6, 20, 40, 41, 60])))) for i in range(25)]
    docs = []
    for d in range(80):
        body = [word() for _ in range(rng.choice([0, 3, 30, 200]))]
        copy = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[word()], [], [copy[k], word()]])
        at = rng.randrange(len(body) + 1)
        docs.append((d, " ".join(body[:at] + copy + body[at:])))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity,) for r in op.contaminated(a, b).collect()}
    expected = slow(docs, items)
    assert len(expected) > 40 and got == expected
    old, op.BROADCAST = op.BROADCAST, 0
    try:
        assert {(r.doc_id, r.item_id): (r.similarity,) for r in op.contaminated(a, b).collect()} == expected
    finally:
        op.BROADCAST = old


def test_defined_cases(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "one two"), (4, "X " + item.upper() + "!"), (4, "other"), (None, item), (5, "word " * 60_000 + item), (6, item.replace(" ", ", "))]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("a")).withColumn("n", F.lit(1)).withColumn("h", F.lit(1))
    b = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "few words only"), (None, item)], "item_id long, text string").withColumn("item", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in op.contaminated(a, b).collect()}
    assert got == {(d, i) for d in (4, None, 5, 6) for i in (1, None)}
    assert op.contaminated(a.limit(0), b).count() == 0 and op.contaminated(a, b.limit(0)).count() == 0


def test_plan_is_native(spark, sf_small):
    plan = op.query(spark, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_stage_finds_short_texts_and_short_items(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([8, 20, 40])))) for i in range(15)] + [(50, "Tiny Item!"), (51, "one"), (52, None), (53, "four short words here")]
    docs = [(0, None), (1, ""), (2, "a tiny item, twice: tiny item"), (3, "item tiny"), (4, "none of it"), (5, "ONE"), (None, "so few: four short words here"), (6, "four short words")]
    for d in range(60):
        w = rng.choice(items[:15])[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            del w[rng.randrange(len(w))]
        docs.append((100 + d, " ".join(w if d % 2 else w[: round(len(w) * rng.choice([0.7, 0.85, 0.95]))])))
    docs.append((200, items[1][1].rsplit(" ", 1)[0]))
    a = spark.createDataFrame([*docs, docs[-1]], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")

    expected = {}
    for d, text in docs:
        g, w = grams(text), [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        for i, item in items:
            h, v = grams(item), [x for x in re.split(r"[\W_]+", (item or "").lower()) if x]
            s = sum((Counter(g) & Counter(h)).values()) / len(h) if h and len(g) < len(h) else 0
            if v and not h and any(w[k : k + len(v)] == v for k in range(len(w))):
                s = 1
            if s >= 0.8:
                expected[d, i] = round(s, 6)
    assert len(expected) > 12 and {50, 51, 53} <= {i for _, i in expected}
    assert {(r.doc_id, r.item_id): r.similarity for r in op.contaminated_short(a, b).collect()} == expected
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in op.keep_clean(spark, a, str(tmp_path)).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in expected} - {d for d, _ in slow(docs, items)}


def test_query_matches_its_sql_on_short_texts_and_items(spark, tmp_path):
    import duckdb

    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "tiny item and a tiny item"), (4, item.rsplit(" ", 1)[0]), (4, "other text"), (None, item.upper()), (5, "before it " + item), (6, "one two three four five")]
    items = [(1, item), (1, item), (2, None), (3, "Tiny item"), (4, "after one")]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted((tuple(r) for r in op.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(duckdb.sql(op.SQL).fetchall(), key=str)
    assert {(d, i, s) for d, i, s, _ in got} == {(3, 3, 0), (4, 1, 0), (None, 1, 0), (5, 1, 2)}


def test_stage_keeps_odd_columns(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, item, 1), (2, "clean", 2), (2, "clean", 2), (None, None, 3)], "doc_id long, text string, bad long").withColumn("bad_id", F.lit("x")).withColumn("start", F.lit(1))
    out = op.keep_clean(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(r.bad for r in out.collect()) == [2, 2, 3]
    assert op.keep_clean(spark, df.limit(0), str(tmp_path)).count() == 0
