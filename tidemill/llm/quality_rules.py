"""Quality rules, line first.

Every line of a text is judged by rules for punctuation, navigation and boilerplate;
lines that fail are removed, and a document that loses too much of its text is
rejected. Statistics of the whole text are returned beside the verdict.

Line rules (a line without a word is neither kept nor lost)
    boilerplate   a known phrase of licences, cookie bars and templates
    navigation    half or more of the line's tokens are separators, or three
                  separators or more stand between its parts
    punctuation   over a tenth of the characters are symbols, or a tenth of the words
                  end in two or more exclamation marks, and the line has three words
    repeated      the line equals an earlier line of three words or more
    chanted       ten words or more of which under a fifth are different

Defined cases
    * null text has no word; it fails the base rules, and so does the empty text
    * words are maximal runs without ASCII white space; n_chars and other columns are
      not read, extra columns are ignored, repeated rows are judged one by one
    * a text of any length is judged whole; an empty table gives an empty result
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import WORD_TEXT, table

NAME = "op5_quality_rules"
SQL = None

#: Phrases that mark a line as boilerplate (lower case).
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "lorem ipsum",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "share this",
    "spdx-license-identifier",
    "licensed under the",
    "permission is hereby granted",
    "copyright (c)",
)
SYMBOLS = re.compile(r"[#*$%&|<>]")
SEPARATOR = re.compile(r"[|>»·•]")
SHOUT = re.compile(r"!!+")

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_removed long, words_kept long, cleaned string"
)


def repeat_words(words: list[str], window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text."""
    if len(words) < window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, upto = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def line_fails(line: str, words: list[str], seen: set[str]) -> str | None:
    """The rule that a line breaks, if any."""
    low = line.lower()
    if any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    n = len(words)
    separators = len(SEPARATOR.findall(line))
    if separators >= 3 and separators * 4 >= n or separators * 2 >= n and separators:
        return "navigation"
    if n >= 3 and (len(SYMBOLS.findall(line)) * 10 > len(line) or len(SHOUT.findall(line)) * 10 > n):
        return "punctuation"
    if n >= 3 and line in seen:
        return "repeated"
    if n >= 10 and len(set(words)) * 5 < n:
        return "chanted"
    return None


def judge(text: str | None, least_kept: float = 0.5) -> tuple:
    """The values of COLUMNS for one text."""
    text = text or ""
    words = WORD_TEXT.findall(text)
    n = len(words)
    lines, seen, kept_lines = 0, set(), []
    dup = removed = kept_words = 0
    for line in text.split("\n"):
        own = WORD_TEXT.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        lines += 1
        dup += line in seen
        if line_fails(line, own, seen):
            removed += 1
        else:
            kept_lines.append(line)
            kept_words += len(own)
        seen.add(line)
    repeated = repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    return (
        n, sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeated, failed,
        not failed and kept_words >= least_kept * n, lines, removed, kept_words, "\n".join(kept_lines),
    )


def quality_rules(documents: DataFrame, least_kept: float = 0.5, cleaned: bool = True) -> DataFrame:
    """doc_id and COLUMNS of every document; ``cleaned`` is the text without the lines removed."""
    fields = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
    fields = fields if cleaned else fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        kinds = [types[c.split()[1]] for c in COLUMNS.split(", ")]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [judge(t, least_kept) for t in part.column(1).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns][: len(fields)], fields)

    schema = ("doc_id long, " + COLUMNS) if cleaned else ("doc_id long, " + COLUMNS).rpartition(", ")[0]
    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), cleaned=False)
