import corpus_pipeline
import test_decontaminate
import test_simhash_dedup

from tidemill.llm import bin_packing, language_id


def cut(docs):
    """doc_id -> text without the 50-byte strings that start in a smaller document."""
    data = {d: t.encode() for d, t in docs.items()}
    seen = {}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            seen.setdefault(data[d][i : i + 50], d)
    out = {}
    for d, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if seen[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if kept or not any(gone):
            out[d] = kept
    return out


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(stages) == 5
    texts = {r.doc_id: r.text for r in docs.collect()}

    judged = language_id.identify(docs, language_id.fit(docs)).collect()
    texts = {r.doc_id: texts[r.doc_id] for r in judged if not r.rejected}
    one = stages[0](spark, docs, sf_small)
    assert one.columns == docs.columns and {r.doc_id: r.text for r in one.collect()} == texts

    kept = test_simhash_dedup.slow_kept(texts)
    texts = {d: t for d, t in texts.items() if d in kept}
    two = stages[1](spark, one, sf_small)
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == texts

    texts = cut(texts)
    three = stages[2](spark, two, sf_small)
    assert three.columns == docs.columns
    rows = three.collect()
    assert {r.doc_id: r.text for r in rows} == texts and all(r.n_chars == len(r.text) for r in rows)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    bad = {d for d, _ in test_decontaminate.slow(list(texts.items()), items)}
    texts = {d: t for d, t in texts.items() if d not in bad}
    four = stages[3](spark, three, sf_small)
    assert four.columns == docs.columns and {r.doc_id: r.text for r in four.collect()} == texts

    expected = {d: len(t.split()) for d, t in texts.items()}
    got = corpus_pipeline.run(spark, sf_small).collect()
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
        assert r.n_words <= bin_packing.CAPACITY
    assert words == expected and len(words) < docs.count()
