"""A corpus pipeline of five stages; each result is written as Parquet and read again.

1. language ID: documents that the models reject go
2. SimHash near-duplicates: of documents with a similarity of 0.8 or more over five-word
   shingles, found in the SimHash groups of a wide radius, the first one stays
3. suffix-array dedup: substrings of 50 bytes that an earlier document has are cut out
4. benchmark decontamination: documents that contain a benchmark item go
5. best-fit packing: where every document that is left goes
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bin_packing, decontaminate, language_id, simhash_dedup, suffix_dedup
from tidemill.llm.common import shared_folder, table

STAGES = [
    ("language_id", language_id.keep_known),
    ("simhash_near_dedup", simhash_dedup.keep_one),
    ("suffix_array_dedup", suffix_dedup.remove_repeats),
    ("benchmark_decontamination", decontaminate.keep_clean),
    ("best_fit_packing", bin_packing.pack_corpus),
]

#: Language models and bin packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
