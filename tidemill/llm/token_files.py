"""Token ids in binary files of patched frame-of-reference blocks.

Layout of a file (little-endian)
    magic ``TMPFOR01``
    blocks of up to ``BLOCK`` ids: count u32, minimum u32, width u8, exceptions u32,
        (count * width + 7) // 8 bytes with id - minimum in ``width`` bits each,
        the exceptions' positions u16 and their bits above the width u32
    directory: doc_id i64 of each document, is-null u8, number of ids u64
    index: file offset u64 of each block, so any block can be read alone
    trailer: documents u64, blocks u64, ids u64, offset of the directory u64, magic

The width is the number of bits of the ``PERCENTILE``-th percentile of id - minimum,
so a few large ids don't widen the whole block; they are patched in.

Documents are written in ascending doc_id order (nulls first), over files as within
them; each ends with id ``END``. Files are written under a temporary name and renamed,
so a task that runs again replaces its file with the same bytes.

Defined cases
    * null text counts as empty: the document is its end id alone
    * repeated rows are documents of their own, ordered by the hash of their text
    * a text of any length is encoded whole; an empty table writes no file
    * extra columns are ignored
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shared_folder, table, worker_cache

NAME = "op6_token_files"
SQL = None
MAGIC = b"TMPFOR01"
BLOCK, PERCENTILE, END = 4096, 95.0, 1
HEAD, TRAILER = "<IIBI", "<QQQQ8s"
HEAD_SIZE, TRAILER_SIZE = struct.calcsize(HEAD), struct.calcsize(TRAILER)
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000


# --- blocks -------------------------------------------------------------------


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block from 1 to ``BLOCK`` ids (u32)."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    at = min(len(rest) - 1, int(np.ceil(len(rest) * percentile / 100)) - 1) if len(rest) > 1 else 0
    width = int(np.partition(rest, at)[at]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    packed = b""
    if width:
        bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
        packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    patches = over.astype("<u2").tobytes() + (rest[over] >> np.uint32(width) if width < 32 else rest[over]).astype("<u4").tobytes()
    return struct.pack(HEAD, len(ids), low, width, len(over)) + packed + patches


def unpack_block(data: memoryview) -> np.ndarray:
    """The ids of a block that starts at the beginning of ``data``."""
    count, low, width, n = struct.unpack_from(HEAD, data)
    at = HEAD_SIZE
    size = (count * width + 7) // 8
    rest = np.zeros((count, 4), np.uint8)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little").reshape(count, width)
        rest[:, : (width + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
    ids = rest.view("<u4").ravel().astype(np.uint32)
    at += size
    over = np.frombuffer(data, "<u2", n, at)
    ids[over] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width)
    return ids + np.uint32(low)


class Writer:
    """Writes one file; ids are buffered to whole blocks."""

    def __init__(self, out):
        self.out, self.at, self.offsets, self.docs, self.total = out, 0, [], [], 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        end = len(ids) if whole else len(ids) - len(ids) % BLOCK
        for start in range(0, end, BLOCK):
            self.offsets.append(self.at)
            self._put(pack_block(ids[start : min(start + BLOCK, end)]))
        self.pending, self.held = [ids[end:]], len(ids) - end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        directory = self.at
        self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self._put(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        self._put(np.array([n for _, n in self.docs], "<u8").tobytes())
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(struct.pack(TRAILER, len(self.docs), len(self.offsets), self.total, directory, MAGIC))


class Reader:
    """Reads one file: its directory at once, its blocks as they are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._at(size - TRAILER_SIZE, TRAILER_SIZE)
        docs, blocks, self.total, self.directory, magic = struct.unpack(TRAILER, tail)
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = self._at(self.directory, size - TRAILER_SIZE - self.directory)
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.nulls = np.frombuffer(body, np.uint8, docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(body, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.append(np.frombuffer(body, "<u8", blocks, 17 * docs), np.uint64(self.directory)).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        for k in range(first, len(self.offsets) - 1 if last is None else last):
            yield unpack_block(memoryview(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        blocks, held = self.blocks(), np.zeros(0, np.uint32)
        for doc, null, size in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.sizes.tolist()):
            parts, need = [], size
            while need:
                if not len(held):
                    held = next(blocks)
                parts.append(held[:need])
                held = held[len(parts[-1]) :]
                need -= len(parts[-1])
            yield (None if null else doc), (parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else held[:0])

    def slice(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file, reading only their blocks."""
        first, last = start // BLOCK, -(-(start + n) // BLOCK)
        ids = list(self.blocks(first, last))
        return np.concatenate(ids)[start - first * BLOCK :][:n] if ids else np.zeros(0, np.uint32)


# --- encoding -----------------------------------------------------------------


class Words(dict):
    """Ids of words as bytes (u32); encodes a word when it is first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


def plain(text: str, added: tuple[str, ...] = ()) -> str:
    """The text with what its normaliser would change anyway: line ends, and case where that is letter by letter.

    ``added`` are the contents of the added tokens in lower case. They are matched before
    the normaliser, so a text that has one in any case keeps its case.
    """
    text = text.replace("\n", " ")
    if not text.isascii():
        try:
            text.encode("latin-1")  # no combining marks, no letter whose lower case depends on its place
        except UnicodeEncodeError:
            return text
    low = text.lower()
    return text if any(t in low for t in added) else low


class Encoder:
    """Whole-text encoding by the tokenizers library, remembering words between spaces.

    The tokenizer's normaliser works character by character, its pre-tokenizer drops
    white space, and no token crosses a space, so the ids of a text are the ids of its
    parts between spaces, one after the other.
    """

    def __init__(self, path: str):
        self.words = Words(path)
        self.added = tuple(t.content.lower() for t in self.words.tokenizer.get_added_tokens_decoder().values())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """u32 ids of each text, with the end id."""
        get, end = self.words.__getitem__, array("I", [END]).tobytes()
        return [np.frombuffer(b"".join(map(get, plain(t or "", self.added).split(" "))) + end, np.uint32) for t in texts]


def _encoder(path: str) -> Encoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def write_files(documents: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write the files of all documents; one row for each: file, path, n_docs, n_ids, start.

    Documents are dealt by ranges of doc_id (a repeated id by its text's hash, too), so
    a task holds one slice of the order. ``start`` counts the ids of all files before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        final = f"{base}/part-{context.partitionId():06d}.tid"
        draft = f"{final}.{context.taskAttemptId()}"
        out = writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(draft)
                    writer = Writer(out)
                for doc, ids in zip(part.column(0).to_pylist(), _encoder(tokenizer).encode(part.column(1).to_pylist())):
                    writer.add(doc, ids)
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()]), pa.array([final]), pa.array([len(writer.docs)]), pa.array([writer.total])],
                ["file", "path", "n_docs", "n_ids"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    files = sorted(dealt.mapInArrow(run, "file long, path string, n_docs long, n_ids long").collect())  # one row a file
    starts = np.cumsum([0, *(r.n_ids for r in files)]).tolist()
    rows = [(*r, s) for r, s in zip(files, starts)]
    return documents.sparkSession.createDataFrame(rows, "file long, path string, n_docs long, n_ids long, start long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def batch_of(docs, starts, sizes, sums):
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as source:
                    docs, starts, sizes, sums = [], [], [], []
                    for doc, ids in Reader(source, source.size()).documents():
                        docs.append(doc)
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        at += len(ids)
                        if len(docs) == 10_000:
                            yield batch_of(docs, starts, sizes, sums)
                            docs, starts, sizes, sums = [], [], [], []
                    yield batch_of(docs, starts, sizes, sums)

    spread = files.select("path", "start", "file").repartition(max(1, files.count()), "file").select("path", "start")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write, then read back: one row for each document."""
    return read_files(write_files(documents, folder, tokenizer), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
