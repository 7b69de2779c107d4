import re

from pyspark.sql import functions as F

from tidemill.llm import quality_rules as op

W = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = W.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if W.search(x) and x in lines[:i])
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_values(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").filter("length(text) < 4000").collect()}
    got = {r.doc_id: r for r in op.query(spark, sf_small).collect()}
    assert len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    for i, text in docs.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(text)
        assert not (r.kept and r.base_failed)


def test_keeps_good_and_rejects_bad(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").filter("quality IS NOT NULL")
    judged = op.query(spark, path).join(labels, "doc_id")
    good = judged.filter("quality = 1 AND NOT base_failed")
    assert good.filter("kept").count() >= 0.99 * good.count()
    bad = judged.filter("quality = 0")
    assert bad.filter("NOT kept").count() >= 0.9 * bad.count()


def test_defined_cases(spark):
    clean = " ".join(f"word{i} of" for i in range(40)) + "."
    nav = "Home | About | News | Contact"
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, clean + "\n" + nav), (5, "\n".join([nav + str(i) for i in range(60)])), (6, "long " * 200_000), (4, clean + "\n" + nav)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))
    got = op.quality_rules(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[4].kept and by[4].cleaned == clean and by[4].n_lines_removed == 1
    assert not by[5].kept and not by[5].base_failed or by[5].base_failed
    assert by[6].base_failed and by[6].n_words == 200_000
    assert [by[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and all(by[i].base_failed for i in (1, 2, 3))
    assert op.quality_rules(df.limit(0)).count() == 0
