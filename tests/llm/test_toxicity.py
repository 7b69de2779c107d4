import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import toxicity as op


def test_folding():
    assert op.folded("Thé ІDI0T, w0rth1ess! $tupid 2023 l0$er") == " the idiot worthiess stupid 2023 loser ".replace("2023 ", "")
    assert op.folded("") == " " and op.folded(" \n ") == " "


def test_lexicon_and_exceptions():
    toxic = [f"you are {c} a {w} {c} person" for w in ("scum", "scumbag") for c in "abcdefghijklmnopqrst"]
    clean = [f"a pond scum study by {c} and others" for c in "abc"] + [f"nothing to see {c}{d} here" for c in "abcdefghijklmnopqr" for d in "abcdefghijklmnopqr"]
    lex = op.learn([op.folded(t) for t in toxic], [op.folded(t) for t in clean])
    assert " pond scum " in lex.exceptions
    assert lex.score("what a SCUM he is")[0] >= 0.3 > lex.score("the pond scum grew")[0]
    assert lex.score("what a 5cum he is")[1] == 1


def test_dense_entries():
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    other = lambda i: " ".join(f"x{name(i + 37 * j)}" for j in range(60))
    toxic = [f"{other(i)} grumel{name(i)} {name(i)} grumel{name(3 * i)}" for i in range(40)]
    clean = [f"{other(i + 7)} grumel{name(i)} {other(i)}" for i in range(200)]
    lex = op.learn([op.folded(t) for t in toxic], [op.folded(t) for t in clean], 4.0)
    assert any(k.startswith(" grum") for k in lex.dense)
    assert lex.score(f"{other(5)} Grumelbu grumelba")[0] >= 0.3 > lex.score(f"{other(5)} grumelbu")[0]
    assert lex.score("grumelbu")[1] == 0 and lex.score(other(5) * 5 + " grumelbu grumelba")[1] == 0


def test_hits_match_a_plain_scan():
    rng = np.random.default_rng(4)
    words = ["vile", "vilest", "mean", "meaning", "pond", "the", "of"]
    lex = op.Lexicon({" vile ": 2.0, " vil": 1.0, " mean": 3.0, " mean ": 4.0}, [" pond vile "], (0.0, 1.0, 0.0), frozenset([" mean"]))
    for _ in range(300):
        text = op.folded(" ".join(rng.choice(words, rng.integers(0, 30))))
        held = text.split()
        repeated = sum(w.startswith("mean") for w in held)
        expected = []
        for i, w in enumerate(held):
            found = [v for k, v in lex.weights.items() if f" {w} ".startswith(k) and (k != " mean" or repeated > 1)]
            if found and not (i and held[i - 1 : i + 1] == ["pond", "vile"]):
                expected.append(max(found))
        assert lex.hits(text) == (sum(expected), len(expected), len(held))


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = op.query(spark, path).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    apart = [r for r in got if r.held_out]
    hits = [r for r in apart if r.predicted]
    assert np.mean([r.toxic for r in hits]) > 0.95
    assert np.mean([r.predicted for r in apart if r.toxic]) > 0.9


def test_defined_cases(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    docs = [(i, f"you {name(i)} {w} {name(7 * i)} end", 0) for i in range(40) for w in ["vile" if i % 2 else "nice"]]
    docs += [(100, None, 0), (101, "", 0), (102, "so VILE " * 30_000, 0), (102, "x", 0), (None, "vile", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)] * 2 + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, text int")
    lex = op.fit(df, labels)
    got = {r.doc_id: r for r in op.toxicity(df, lex).collect() if r.doc_id != 102}
    assert got[100].score == got[101].score < 0.3 <= got[None].score
    assert len(op.toxicity(df, lex).collect()) == len(docs)
    assert op.toxicity(df.limit(0), op.fit(df.limit(0), labels)).count() == 0
    assert {r.score for r in op.toxicity(df, op.fit(df, labels.limit(0))).collect()} == {0.0}
