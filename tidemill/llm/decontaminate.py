"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

A document is contaminated by a benchmark item if one of its windows of as many words
as the item has is similar to it. Similarity is the weighted share of common five-word
shingles: sum of min(weights) over the item's number of shingles, a shingle's weight in
a text being how often it occurs there. Window and item have as many shingles each, so
the measure is symmetric.

1.  Shingles of all documents meet the benchmark's shingles (an item is looked for in
    every place that shares a shingle with it; elsewhere its similarity is zero). The
    best window may be taken to start at such a place: moving it right to its first
    common shingle loses none. Where the text ends first it is the last window.
2.  Each of these item-sized windows gets a SimHash fingerprint of its shingles.
3.  Multi-index blocks: the 64 bits are cut into ``RADIUS + 1`` blocks; a window within
    ``RADIUS`` bits of its item equals it in one block at least, so equal blocks give
    every window within the radius. Candidates within the radius by the whole distance
    go on.
4.  The weighted shingle similarity of the candidates is computed exactly.

The words of a text are its maximal runs of letters and digits, lower case.

At the threshold of 0.8 two fingerprints differ in about 13 of 64 bits on average;
``RADIUS`` lies over three standard deviations above.

Scale: the documents are read and shingled in one pass and never shuffled while the
benchmark has at most ``BROADCAST`` shingles, a number that is counted first; only the
windows at shared shingles leave the map stage. Beyond that number documents and
benchmark meet by a shuffle on the shingle's hash.

A text with fewer words than an item is one window as a whole, and an item of fewer than
five words is one shingle of its own length (``contaminated_short``); the query and the
pipeline's stage have both.

Defined cases
    * null and empty texts have no window; nor has a null or empty item
    * a text shorter than an item matches if it holds the threshold of the item's shingles
    * an item of fewer than five words matches where its words stand in a row
    * repeated benchmark rows with the same item_id are one item if their texts agree;
      else each text is looked for, and the best of them counts
    * repeated rows of documents count once (the best window over all of them)
    * rows with a null doc_id match like others and are returned with a null doc_id
    * empty tables give an empty result; extra columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, settle, table

NAME = "op4_decontaminate"
SHINGLE, THRESHOLD = 5, 0.8
#: Bits in which a window and an item may differ.
RADIUS = 23
#: Benchmark shingles that may be broadcast (24 bytes each).
BROADCAST = 2_000_000


def _words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words: Column) -> Column:
    """Hash of the shingle at each word position that has one; null where there is none.

    The words are bound to a lambda's variable so that they are split once a row.
    """
    parts = ", ".join(f"w[i + {k}]" for k in range(SHINGLE))
    each = F.expr(f"w -> CASE WHEN size(w) >= {SHINGLE} THEN transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({parts})) END")
    return F.element_at(F.call_function("transform", F.array(words), each), 1)


def shingled(rows: DataFrame, key: str) -> DataFrame:
    """(key, shingles) of each text with five words or more."""
    return rows.select(F.col(key).alias("key"), _hashes(_words(F.col("text"))).alias("shingles")).filter("shingles IS NOT NULL")


def _fingerprint(windows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the shingles in ``h`` of each window: one sum for each bit."""
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(64)]
    bits = windows.groupBy(*keys).agg(*sums)
    # bit 63 is added as the sign
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(-(1 << 63) if b == 63 else 1 << b)).otherwise(F.lit(0)).cast("long"))
    return bits.select(*keys, value.alias("fp"))


def _blocks(fp: Column) -> Column:
    """(block, value) of the ``RADIUS + 1`` blocks of bits."""
    n = RADIUS + 1
    cut = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
            for i, (a, b) in enumerate(zip(cut, cut[1:]))
        ]
    )


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, distance, similarity): the best window for each pair."""
    items = settle(
        shingled(benchmark, "item_id")
        .dropDuplicates(["key", "shingles"])
        .select(F.col("key").alias("item_id"), F.xxhash64("key", "shingles").alias("item"), "shingles", F.size("shingles").alias("n"))
    )
    item_rows = items.select("item", "n", F.explode("shingles").alias("h"))
    wanted = settle(item_rows.groupBy("h", "item", "n").agg(F.count("*").alias("weight")))
    few = wanted.count() <= BROADCAST

    docs = shingled(documents.select("doc_id", "text"), "doc_id").withColumn("doc", F.xxhash64("key", "shingles"))
    marks = wanted.select("h", "item", "n")
    # 1. places that share a shingle with an item, 2. the item-sized window at each of them
    start = F.least(F.col("at"), F.size("shingles") - F.col("n"))
    if few:
        seeds = docs.select("key", "doc", "shingles", F.posexplode("shingles").alias("at", "h")).join(F.broadcast(marks), "h")
    else:
        places = docs.select("doc", F.posexplode("shingles").alias("at", "h")).join(marks, "h").select("doc", "at", "item", "n")
        seeds = docs.join(places, "doc")
    windows = (
        seeds.filter(F.size("shingles") >= F.col("n"))
        .select("key", "doc", "item", "n", start.alias("start"), F.slice("shingles", start + 1, F.col("n")).alias("window"))
        .groupBy("doc", "item", "n", "start")
        .agg(F.first("key").alias("key"), F.first("window").alias("window"))
    )
    windows = settle(windows)
    prints = _fingerprint(windows.select("doc", "item", "start", F.explode("window").alias("h")), ["doc", "item", "start"])
    item_prints = settle(_fingerprint(item_rows.select("item", "h"), ["item"])).withColumnRenamed("fp", "item_fp")
    # 3. blocks of the fingerprints
    probe = prints.select("doc", "item", "start", "fp", F.explode(_blocks(F.col("fp"))).alias("k")).select("doc", "item", "start", "fp", "k.block", "k.value")
    index = item_prints.select("item", "item_fp", F.explode(_blocks(F.col("item_fp"))).alias("k")).select("item", "item_fp", "k.block", "k.value")
    near = (
        probe.join(index, ["item", "block", "value"])
        .groupBy("doc", "item", "start")
        .agg(F.first(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).alias("distance"))
        .filter(F.col("distance") <= RADIUS)
    )
    # 4. exact weighted similarity
    counts = (
        windows.join(near, ["doc", "item", "start"])
        .select("key", "doc", "item", "n", "start", "distance", F.explode("window").alias("h"))
        .groupBy("key", "doc", "item", "n", "start", "distance", "h")
        .agg(F.count("*").alias("here"))
    )
    exact = (
        counts.join(wanted.select("h", "item", "weight"), ["h", "item"])
        .groupBy("key", "doc", "item", "n", "start", "distance")
        .agg((F.sum(F.least("here", "weight")) / F.first("n")).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    best = exact.groupBy("key", "doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance"))).alias("best")
    )
    found = best.join(items.select("item", "item_id"), "item").withColumnRenamed("key", "doc_id")
    return found.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select(
        "doc_id",
        "item_id",
        (-F.col("best.start")).cast("long").alias("start"),
        (-F.col("best.distance")).cast("long").alias("distance"),
        F.round("best.similarity", 6).alias("similarity"),
    )


def contaminated_short(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, similarity) of the pairs that have no window or no shingle in ``contaminated``.

    A text with fewer shingles than an item is one window as a whole; similarity is over
    the item's shingles still, and no fingerprint is asked. An item of fewer than five
    words is one shingle of its own length, which a text has or not.
    """
    texts = shingled(benchmark, "item_id").dropDuplicates(["key", "shingles"])
    items = settle(texts.select(F.col("key").alias("item_id"), F.xxhash64("key", "shingles").alias("item"), "shingles", F.size("shingles").alias("n")))
    wanted = items.select("item", "n", F.explode("shingles").alias("h")).groupBy("h", "item", "n").agg(F.count("*").alias("weight"))
    wanted = settle(wanted)
    longest = items.agg(F.max("n")).first()[0] or 0
    docs = shingled(documents.select("doc_id", "text"), "doc_id").filter(F.size("shingles") < longest).withColumn("doc", F.xxhash64("key", "shingles"))
    # repeated rows are one text
    here = docs.dropDuplicates(["key", "doc"]).select("key", "doc", F.size("shingles").alias("m"), F.explode("shingles").alias("h"))
    here = here.groupBy("key", "doc", "m", "h").agg(F.count("*").alias("here"))
    similar = (
        here.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "h")
        .filter("m < n")
        .groupBy("key", "doc", "item", "n")
        .agg((F.sum(F.least("here", "weight")) / F.col("n")).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    found = similar.join(items.select("item", "item_id"), "item").select(F.col("key").alias("doc_id"), "item_id", F.lit(0).cast("long").alias("start"), "similarity")

    brief = benchmark.select("item_id", _words(F.col("text")).alias("w")).filter(F.size("w").between(1, SHINGLE - 1))
    brief = settle(brief.select("item_id", F.size("w").alias("size"), F.concat_ws(" ", "w").alias("words")).distinct())
    small = brief.count() <= BROADCAST
    for size in sorted(r["size"] for r in brief.select("size").distinct().collect()):  # four at most
        each = F.expr(f"w -> CASE WHEN size(w) >= {size} THEN transform(sequence(0, size(w) - {size}), i -> array_join(slice(w, i + 1, {size}), ' ')) END")
        grams = F.element_at(F.call_function("transform", F.array(_words(F.col("text"))), each), 1)
        of_size = brief.filter(F.col("size") == size).select("item_id", "words")
        places = documents.select("doc_id", F.posexplode(grams).alias("at", "words"))
        met = places.join(F.broadcast(of_size) if small else of_size, "words")
        found = found.unionByName(met.groupBy("doc_id", "item_id").agg(F.min("at").cast("long").alias("start")).select("*", F.lit(1.0).alias("similarity")))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.start")).cast("long").alias("start"), F.round("best.similarity", 6).alias("similarity"))


def contaminations(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best place for each pair, whatever their lengths."""
    found = contaminated(documents, benchmark).select("doc_id", "item_id", "start", "similarity").unionByName(contaminated_short(documents, benchmark))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.start")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go, short texts and short items included."""
    (name,) = fresh(docs, "bad")
    bad = contaminations(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


SQL = """
WITH iw AS (
  SELECT item_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ig AS (SELECT DISTINCT item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS g FROM iw WHERE len(w) >= 5),
items AS (SELECT item_id, g, len(g) AS n, row_number() OVER (ORDER BY item_id, g) AS item FROM ig),
docs AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS g, row_number() OVER () AS doc
  FROM dw WHERE len(w) >= 5),
wanted AS (SELECT item, n, h, count(*) AS weight FROM (SELECT item, n, unnest(g) AS h FROM items) GROUP BY ALL),
places AS (SELECT doc, len(g) AS m, unnest(g) AS h, unnest(range(len(g))) AS pos FROM docs),
wins AS (SELECT DISTINCT doc, item, n, least(pos, m - n) AS start FROM places JOIN wanted USING (h) WHERE m >= n),
cells AS (
  SELECT w.doc, w.item, w.n, w.start, p.h, count(*) AS here
  FROM wins w JOIN places p ON p.doc = w.doc AND p.pos >= w.start AND p.pos < w.start + w.n GROUP BY ALL),
sims AS (
  SELECT doc, item, start, sum(least(here, weight)) / max(c.n) AS similarity
  FROM cells c JOIN wanted t USING (item, h) GROUP BY doc, item, start),
short AS (
  SELECT doc, item, 0 AS start, sum(least(here, weight)) / max(t.n) AS similarity
  FROM (SELECT doc, m, h, count(*) AS here FROM places GROUP BY ALL) p JOIN wanted t USING (h) WHERE m < n GROUP BY doc, item),
long_ AS (
  SELECT doc_id, item_id, start, similarity
  FROM (SELECT * FROM sims UNION ALL SELECT * FROM short) JOIN items USING (item) JOIN docs USING (doc) WHERE similarity >= 0.8),
brief AS (SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS words FROM iw WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT DISTINCT size FROM brief),
grams AS (
  SELECT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS words, i - 1 AS start
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
found AS (
  SELECT doc_id, item_id, start, similarity FROM long_
  UNION ALL SELECT doc_id, item_id, start, 1.0 FROM grams JOIN brief USING (size, words)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM found)
SELECT doc_id, item_id, start::BIGINT AS start, round(similarity, 6) AS similarity FROM ranked WHERE k = 1
"""
