import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import language_id as op

TEXTS = {"aa": ["abcab abc abd", "hello cab"], "bb": ["zzz yx xyz", "yyy zx"], "cc": ["élan été"]}


def test_probabilities_sum_to_one():
    m = op.Model(TEXTS)
    alphabet = sorted({int(x) for v in TEXTS.values() for t in v for x in op.symbols(t)})
    for context in ("abc", " ab", "zzz", "qqq", "xyq"):
        head = [ord(c) for c in context]
        total = np.zeros(3)
        for w in [*alphabet, 999]:  # one symbol that no text has stands for all others
            total += 2.0 ** m.log_probs(np.array([*head, w], np.uint64))[0]
        assert np.allclose(total, 1, atol=1e-3), (context, total)


def test_lookup_matches_a_dictionary():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    t = op.Sorted(keys, np.arange(len(keys))[:, None])
    probes = np.concatenate([keys, keys + np.uint64(1)])
    got = t.find(probes)
    where = {int(k): i for i, k in enumerate(keys)}
    assert [int(t.values[g][0]) if g >= 0 else -1 for g in got] == [where.get(int(p), -1) for p in probes]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = op.query(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    apart = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in apart]) > 0.97
    assert sum(r.rejected for r in apart) <= 0.01 * len(apart)


def test_defined_cases(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(8)]
    rows += [(10 + i, "der hund und die katze sind nicht da", "de") for i in range(8)]
    rows += [(100, None, None), (101, "", "en"), (102, "123 !!!", None), (103, "The CAT " * 50_000, None), (103, "x", None), (None, "und die katze", None)]
    rows += [(104, "ものすごい文章です" * 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("count", F.lit(1)).withColumn("rate", F.lit(1))
    got = {r.doc_id: r for r in op.identify(df, op.fit(df)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[100].rejected
    assert got[103].lang_pred in {"en", "de"} and got[None].lang_pred == "de" and got[104].rejected
    assert op.identify(df.limit(0), op.fit(df)).count() == 0
    none = op.identify(df, op.fit(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    kept = op.keep_known(spark, df, "")
    assert kept.columns == df.columns and {100, 101, 102, 104} & {r.doc_id for r in kept.collect()} == set()


def _language(k):
    """Texts of words over four letters of its own."""
    a = [chr(0x4E00 + 4 * k + i) for i in range(4)]
    return [" ".join("".join(a[(i + j * k + m) % 4] for m in range(3)) for j in range(12)) for i in range(8)]


def test_shards_score_like_one_model():
    texts = {f"l{k:02d}": _language(k) for k in range(7)}
    one, many = op.Model(texts), op.Shards(texts, 3)
    probe = [t[0] for t in texts.values()] + ["unseen words", "x"]
    assert many.langs == one.langs and len(many.models) == 3
    assert np.allclose(one.entropies(probe), many.entropies(probe), atol=1e-4)


def test_every_labelled_language_has_a_model(spark):
    n = op.LANGUAGES + 6
    rows = [(100 * k + i, t, f"l{k:02d}") for k in range(n) for i, t in enumerate(_language(k) * (1 if k >= op.LANGUAGES else 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op.fit(df)
    assert model.langs == [f"l{k:02d}" for k in range(n)]
    got = op.identify(df, model).collect()
    assert all(r.lang_pred == f"l{r.doc_id // 100:02d}" and not r.rejected for r in got)
    assert op.keep_known(spark, df, "").count() == len(rows)
