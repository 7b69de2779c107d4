"""Chat formatting with cumulative-snapshot collapse.

A service that logs a conversation after every exchange stores each state as a
conversation of its own, so most of the log is prefixes of other entries. Every
conversation gets a rolling hash after each turn; one whose final hash is an inner
hash of another is a prefix of it, and an anti-join on that hash removes it. Only
the maximal conversations are rendered.

Defined cases
    * turns are ordered by (turn, role, text), nulls first, so repeated turn numbers
      are ties broken by content; a repeated row is a turn of its own
    * null role or text differs from the empty string; both render as empty
    * rows with a null conv_id form one conversation, returned with a null conv_id
    * of identical conversations the one with the smallest conv_id stays (a null id
      stays only if there is no other)
    * an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import staged, table

NAME = "op10_chat_format"


def _sized(value: Column) -> Column:
    """A prefix-free encoding of a nullable string."""
    return F.when(value.isNull(), "-;").otherwise(F.concat(F.char_length(value).cast("string"), F.lit(":"), value))


def _rolling(turns: Column) -> Column:
    """The hash after each turn: sha256(previous hash, role, text)."""

    def step(state: Column, turn: Column) -> Column:
        new = F.sha2(F.concat(F.coalesce(F.element_at(state, -1), F.lit("")), _sized(turn["role"]), _sized(turn["text"])), 256)
        return F.concat(state, F.array(new))

    # the first element stands for the empty prefix
    return F.slice(F.aggregate(turns, F.array(F.lit("")), step), 2, F.size(turns))


def render(turns: Column) -> Column:
    """ChatML text of an ordered array of turns."""
    turn = lambda t: F.concat(
        F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n")
    )
    return F.array_join(F.transform(turns, turn), "")


def collapse(conversations: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, turns, final hash.

    The rows of a conversation meet in one task because they become one record; the
    collapse itself moves only hashes. Hot prefixes are pre-aggregated by the distinct
    before the anti-join, so a prefix that a third of the log shares is one key there.
    """
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = staged(whole.withColumn("hashes", _rolling(F.col("turns"))).withColumn("n_turns", F.size("turns").cast("long")))
    final = F.element_at("hashes", -1)
    inner = whole.select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("final")).distinct()
    keep = (
        whole.groupBy(final.alias("final"))
        .agg(F.min("conv_id").alias("kept"))
        .join(inner, "final", "left_anti")
    )
    return whole.withColumn("final", final).join(
        keep.select("kept", F.col("final").alias("kept_final")),
        F.col("conv_id").eqNullSafe(F.col("kept")) & (F.col("final") == F.col("kept_final")),
        "left_semi",
    )


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered text of every maximal conversation."""
    return collapse(conversations).select("conv_id", "n_turns", F.col("final").alias("turns_sha256"), render(F.col("turns")).alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "rendered")


SQL = """
WITH enc AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role IS NULL THEN '-;' ELSE length(role) || ':' || role END
         || CASE WHEN text IS NULL THEN '-;' ELSE length(text) || ':' || text END AS e,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS r
  FROM conversations),
pre AS (
  SELECT conv_id, string_agg(e, '') OVER w AS prefix, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM enc WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fin AS (SELECT prefix AS final, min(conv_id) AS conv_id FROM pre WHERE k = n GROUP BY prefix),
keep AS (SELECT conv_id FROM fin WHERE final NOT IN (SELECT prefix FROM pre WHERE k < n))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       string_agg(r, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM enc WHERE EXISTS (SELECT 1 FROM keep WHERE keep.conv_id IS NOT DISTINCT FROM enc.conv_id)
GROUP BY conv_id
"""
