"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``capacity`` words and packed into bins of
that capacity, largest first. Open bins are ordered by what is left in them; the
search starts at the tightest bin that the piece fits in and goes on to its successors
until one is compatible. Each bin carries a bitmap of the sources and a bitmap of the
duplicate clusters it holds: a source may be in a bin once, and so may a cluster, so no
training sequence repeats itself. If no open bin is compatible a new one is opened.

Shards: bins never cross a shard, and a shard holds about ``SHARD`` words of documents,
dealt by a hash of the document itself, so a hot source or a large group of copies is
spread over all of them; equal rows are dealt ``COPIES`` to a shard. The number of shards follows the total number of words, which
is counted first; a task packs a bounded shard in memory. A document of more than
``capacity`` words fills bins of its own and only its last piece is shared.

A duplicate cluster is given by a column or else by the hash of the words in lower case,
so copies that differ in case or white space are one cluster. Pieces of one document
never share a bin (they have its source and cluster).

Defined cases
    * null or empty text has no piece; the document is returned with zero words, piece 0
      and no bin
    * documents with a null source conflict like any other source
    * ties of length are packed in order of doc_id (nulls first) and piece; repeated rows
      are copies of each other and go to different bins
    * an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

NAME = "op9_bin_packing"
SQL = None
#: Words of a bin, and about as many in a shard.
CAPACITY, SHARD = 2048, 1_000_000
#: Equal rows that go to one shard.
COPIES = 100


class Packer:
    """Bins of one shard, ordered by what is left in them, ties by number.

    The bins of each residual are counted by source and cluster, so the successor search
    steps over a residual at which every bin has the piece's source without looking at
    its bins: a search takes at most ``capacity`` steps however many bins are open.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = 0  # bit r: a bin has r words left
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual, ascending
        self.sources: list[int] = []  # bitmaps by bin
        self.clusters: list[int] = []
        self.holding: tuple[dict[int, dict[int, int]], ...] = ({}, {})  # bit of source or cluster: bins by residual
        self.source_bit: dict[object, int] = {}
        self.cluster_bit: dict[object, int] = {}

    def _moved(self, b: int, left: int, by: int) -> None:
        """Count a bin at its residual, or no longer."""
        for held, counts in ((self.sources[b], self.holding[0]), (self.clusters[b], self.holding[1])):
            while held:
                bit = held & -held
                at = counts.setdefault(bit, {})
                at[left] = at.get(left, 0) + by
                held ^= bit
        if by > 0:
            insort(self.bins[left], b)
            self.open |= 1 << left
        else:
            del self.bins[left][bisect_left(self.bins[left], b)]
            if not self.bins[left]:
                self.open ^= 1 << left

    def _tightest(self, size: int, source_bit: int, cluster_bit: int) -> tuple[int, int]:
        """(left, bin) of the tightest compatible bin; a bin of -1 if there is none."""
        by_source, by_cluster = self.holding[0].get(source_bit, {}), self.holding[1].get(cluster_bit, {})
        rest = self.open >> size << size
        while rest:
            left = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            bins = self.bins[left]
            if by_source.get(left, 0) < len(bins) and by_cluster.get(left, 0) < len(bins):
                for b in bins:
                    if not (self.sources[b] & source_bit or self.clusters[b] & cluster_bit):
                        return left, b
        return self.capacity, -1

    def place(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """(bin, offset) of a piece; the tightest compatible bin, or a new one."""
        source_bit = 1 << self.source_bit.setdefault(source, len(self.source_bit))
        # clusters met once in the shard can't conflict and need no bit
        cluster_bit = 1 << self.cluster_bit[cluster] if cluster in self.cluster_bit else 0
        left, b = self._tightest(size, source_bit, cluster_bit)
        if b < 0:
            b = len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._moved(b, left, -1)
        self.sources[b] |= source_bit
        self.clusters[b] |= cluster_bit
        if left > size:
            self._moved(b, left - size, 1)
        return b, self.capacity - left


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of pieces (size, source, cluster), packed in the given order."""
    packer, seen = Packer(capacity), set()
    for _, _, cluster in pieces:
        if cluster in seen:
            packer.cluster_bit.setdefault(cluster, len(packer.cluster_bit))
        seen.add(cluster)
    return [packer.place(*p) for p in pieces]


def _words(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bin_packing(documents: DataFrame, capacity: int = CAPACITY, shard_words: int = SHARD, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, n_words, shard, bin, offset of every piece."""
    text = F.col("text").cast("string")
    # the words are bound to a lambda's variable so that they are split once a row
    measured = F.transform(F.array(_words(F.lower(text))), lambda w: F.struct(F.size(w).cast("long").alias("size"), F.xxhash64(w).alias("hash")))[0]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), measured.alias("measured"),
        (F.xxhash64(F.col(cluster).cast("string")) if cluster else F.lit(0)).alias("named"),
    )
    sized = rows.select("doc_id", "source", F.col("measured.size").alias("size"), (F.col("named") if cluster else F.col("measured.hash")).alias("cluster"))
    total = documents.select(F.sum(F.length("text"))).first()[0] or 0
    # six characters to a word; only the size of shards depends on it
    shards = max(1, round(total / 6 / shard_words))
    # equal rows are counted first, and many of them are dealt to several shards
    counted = sized.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) DIV {COPIES}"))).alias("part"))
    share = F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("long")
    dealt = parts.select("doc_id", "source", "size", "cluster", share.alias("n"), F.pmod(F.xxhash64("doc_id", "cluster", "source", "part"), F.lit(shards)).cast("long").alias("shard"))

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = sorted(zip(*(held.column(i).to_pylist() for i in range(5))), key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
        pieces, empty = [], []
        for doc, source, size, group in (r[:4] for r in rows for _ in range(r[4])):
            if not size:
                empty.append((doc, 0, 0, shard, None, None))
            for piece, start in enumerate(range(0, size, capacity)):
                pieces.append((doc, piece, min(capacity, size - start), source, group))
        pieces.sort(key=lambda p: -p[2])
        placed = pack([(size, source, group) for _, _, size, source, group in pieces], capacity)
        out = [(doc, piece, size, shard, b, at) for (doc, piece, size, _, _), (b, at) in zip(pieces, placed)] + empty
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "piece", "n_words", "shard", "bin", "offset"])

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, n_words long, shard long, bin long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing(table(spark, sf_dir, "documents"))


def pack_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where every document goes."""
    return bin_packing(docs)
