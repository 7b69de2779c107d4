"""Removal of long substrings that repeat across documents, with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller doc_id. Strings are judged on the input, matches never cross documents.

1.  Copies. Texts are told apart by a hash of 64 bits, which is checked: where different
    texts (by SHA-256 and size) have the same hash, it is replaced for them. Only the
    copy with the smallest doc_id of a text goes on, the others are removed whole (a text
    of under ``LENGTH`` bytes has no such string and stays).
2.  Anchors. In each string of ``LENGTH`` bytes the leftmost smallest hash of its
    ``GRAM``-byte substrings is its anchor, so equal strings have the same anchor at the
    same place, and neighbouring strings mostly share theirs (a segment). Anchors are
    dealt by hash; those that several texts have are reported back. Anchors that a share
    of a sample of texts has are known to be common beforehand and are not dealt at all.
3.  Segments. The texts' segments of repeated anchors are dealt by anchor. A common
    anchor, or one that more than ``HOT`` texts share, is dealt by finer keys, with the
    bytes around it that all strings of a narrower segment have. Of equal segments of a
    common anchor a map task sends the one with the smallest document; the others are
    repeats already. So no task gathers all places of an anchor or of a passage.
4.  Suffix arrays. Different segments of an anchor form a block; the blocks' suffix
    arrays are built by linear grouping (``gsaca``), and runs of neighbours with
    ``LENGTH`` bytes in common have a smallest document. A segment that is the only one
    of its anchor needs no array: its strings repeat in all its places. A block of more
    than ``BLOCK`` segments is cut into blocks by the same finer keys.
5.  Repeated strings go back to their documents, where they are merged and cut out.

Anchors are dealt by their upper bits in blobs, 4 bytes each; collisions of their hashes
only cost candidates, since step 4 compares bytes. The sample decides how anchors are
dealt, never what is found.

Defined cases
    * null text counts as empty; texts of under ``LENGTH`` bytes are kept whole
    * rows with a null doc_id come after all others and are not smaller than each other
    * repeated rows with the same doc_id are not smaller than each other; each is judged
      against the documents with smaller ids
    * an empty table gives an empty result; extra columns are ignored, and the pipeline's
      stage keeps them whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, fresh, staged, table, tidy, trim
from tidemill.llm.gsaca import suffix_arrays

NAME = "op3_suffix_dedup"
SQL = None
LENGTH, GRAM = 50, 20
#: Texts that may share an anchor before its segments get finer keys, and their width in strings.
HOT, WIDTH = 200, 4
#: Texts of the sample on average, and how many of them have a common anchor.
SAMPLE, COMMON = 4096, 8
#: Segments of a block at most before it is cut by finer keys.
BLOCK = 400
#: Bytes of texts that a map task turns into one round of blobs, and of blocks that go through the arrays together.
ROUND, BATCH = 4 << 20, 1 << 19
#: Bytes of text for each bucket of anchors, segments for each bucket of those, and buckets at least.
PER_BUCKET, SEGMENTS, BUCKETS = 16 << 20, 1 << 15, 64
#: Segments that a map task remembers, to send equal ones once.
REMEMBERED = 1 << 16

_MULT = 0x9E3779B97F4A7C15
_NEVER = (1 << 63) - 1
#: In the place of an anchor: the segment has a finer key.
FINE = 255


# --- anchors --------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    """Changes its argument."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Hasher:
    """Hashes of all substrings of some lengths by sums of their 8-byte words, each with a factor of its own."""

    def __init__(self) -> None:
        self.factors = np.random.default_rng(1).integers(1, 1 << 63, 8, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def words(self, data: np.ndarray) -> np.ndarray:
        """The 8-byte word at each place of a text."""
        n = max(len(data) - 7, 0)
        return np.ndarray(n, "<u8", np.ascontiguousarray(data), strides=(1,)).copy() if n else np.zeros(0, np.uint64)

    def substrings(self, words: np.ndarray, size: int, places: np.ndarray | None = None) -> np.ndarray:
        """Hash of the substring of ``size`` bytes at every place, or at some."""
        n = max(len(words) + 8 - size, 0)
        out = np.zeros(n if places is None else len(places), np.uint64)
        for factor, k in zip(self.factors, [*range(0, size - 8, 8), size - 8]):
            out += (words[k : k + n] if places is None else words[places + k]) * factor
        return _mixed(out)

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place, first string, end of strings) of each segment of a text of ``LENGTH`` bytes at least."""
        value = self.substrings(words, GRAM)
        # a number for each place, upper half of the hash and place: the smallest is the leftmost of the smallest hashes
        least = value & np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(value), dtype=np.uint64)
        width, span = LENGTH - GRAM + 1, 1
        while span < width:
            by = min(span, width - span)
            least = np.minimum(least[:-by], least[by:])
            span += by
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], cut])
        place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # the smallest of many hashes is a small number: mixed again, so that anchors are dealt evenly
        own = value[place] * np.uint64(_MULT)
        own = (own ^ own >> np.uint64(32)) * np.uint64(_MULT)
        return own, place, first, np.append(cut, len(least))

    def of(self, text: bytes | np.ndarray) -> np.ndarray:
        """Different anchors of a text, ascending."""
        h = np.sort(self.anchors(self.words(np.frombuffer(text, np.uint8)))[0])
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _blob(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unblob(data: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _rounds(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows of about ROUND bytes of text at a time."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            columns = [c.cast(pa.large_binary()).to_pylist() if i == text else c.to_pylist() for i, c in enumerate(part.columns)]
            for row in zip(*columns):
                held.append(row)
                size += len(row[text] or b"")
                if size >= ROUND:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _split(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices) of each run of equal keys in an order."""
    k = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
    for a, b in zip(cut, [*cut[1:], len(k)]):
        yield int(k[a]), order[a:b]


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _text_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for rows in _rounds(batches, 0):
        found = [hasher.of(text) for (text,) in rows if len(text) >= LENGTH]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])


def common_anchors(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted anchors that ``COMMON`` texts of a sample of ``n`` texts have; bounded by the anchors of the sample."""
    drawn = texts.filter(F.pmod(F.xxhash64("k", "n_bytes"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    counts = drawn.mapInArrow(tidy(_text_anchors), "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r[0] for r in counts.select("h").collect()], np.int64).view(np.uint64))


def _emit_anchors(buckets: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), common.value
        for rows in _rounds(batches, 1):
            found, who = [], []
            for k, (_, text) in enumerate(rows):
                if len(text) >= LENGTH:
                    h = hasher.of(text)
                    h = h[~_among(h, known)]
                    found.append(h)
                    who.append(np.full(len(h), k, np.uint32))
            if not found:
                continue
            h, who = np.concatenate(found), np.concatenate(who)
            ids = np.array([r[0] for r in rows], np.int64)
            keys = _bucket(h, buckets)
            out = []
            for b, at in _split(np.argsort(keys, kind="stable"), keys):
                docs, local = np.unique(who[at], return_inverse=True)
                out.append((b, _blob(ids[docs], local.astype(np.uint16 if len(docs) < 65536 else np.uint32), (h[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.array([len(docs)], np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], ["bucket", "blob"])

    return run


def _repeated(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
    """Anchors of a bucket that several texts have: (text, anchor's low half, hot)."""
    who, low = [], []
    for blob in held.column(1).to_pylist():
        raw = _unblob(blob, [np.int64, np.uint8, np.uint32, np.int64])
        local = raw[1].view(np.uint16 if raw[3][0] < 65536 else np.uint32)
        who.append(raw[0][local])
        low.append(raw[2])
    who, low = np.concatenate(who), np.concatenate(low)
    order = np.lexsort((who, low))
    who, low = who[order], low[order]
    fresh_ = np.concatenate([[True], (low[1:] != low[:-1]) | (who[1:] != who[:-1])])
    who, low = who[fresh_], low[fresh_]
    head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(head, len(low)))
    keep = np.repeat(size > 1, size)
    # bits 0-31 low half, bit 32 hot; the bucket follows from the text's own hashes
    code = low.astype(np.int64) | np.repeat((size > HOT).astype(np.int64) << 32, size)
    bucket = np.int64(key[0].as_py()) << np.int64(33)
    found = pa.table([pa.array(who[keep]), pa.array(code[keep] | bucket)], names=["th", "anchor"])
    trim()
    return found


# --- segments -------------------------------------------------------------------


def parts_of(hasher: Hasher, words: np.ndarray, keys: np.ndarray, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, finer key, first string, end of strings) of the parts of a text's segments: what all strings of a part have in common, whatever text they are in, is its key."""
    least = (anchors - highs + 1) // WIDTH
    part, owner = _pieces(least, (anchors - lows) // WIDTH + 1 - least, True)
    last = anchors[owner] - part * WIDTH  # the last string that a part may have
    core = hasher.substrings(words, LENGTH - WIDTH + 1, last)
    key = _mixed(core + _mixed(keys[owner] + part.astype(np.uint64) * np.uint64(_MULT)))
    return owner, key, np.maximum(lows[owner], last - WIDTH + 1), np.minimum(highs[owner], last + 1)


def text_segments(hasher: Hasher, data: np.ndarray, codes: np.ndarray, buckets: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, first string, end of strings, anchor's place from the first) of the segments of a text's repeated anchors; the last of a hot one is ``FINE``."""
    words = hasher.words(data)
    h, place, first, end = hasher.anchors(words)
    own = (_bucket(h, buckets).astype(np.int64) << np.int64(33)) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cold = _among(own, codes)  # codes are sorted; a hot one is the same with bit 32 set
    hot = np.flatnonzero(_among(own | np.int64(1 << 32), codes) | _among(h, common))
    if not len(hot):
        return h[cold], first[cold], end[cold], (place - first)[cold]
    cold[hot] = False
    _, keys, lows, highs = parts_of(hasher, words, h[hot], place[hot], first[hot], end[hot])
    return (
        np.concatenate([h[cold], keys]), np.concatenate([first[cold], lows]), np.concatenate([end[cold], highs]),
        np.concatenate([(place - first)[cold], np.full(len(keys), FINE)]),
    )


def _pieces(start: np.ndarray, size: np.ndarray, owners: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """The integers of several ranges one after the other; with the range of each."""
    first = np.cumsum(size) - size
    out = np.arange(int(size.sum())) + np.repeat(start - first, size)
    return (out, np.repeat(np.arange(len(size)), size)) if owners else out


_ASK = [np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint8, np.uint8, np.int64, np.int64]


def _emit_segments(buckets: int, dealt: int, common):
    """Blobs of segments to judge (key, order and text, first string, strings, anchor's place, bytes) and of runs that are repeats already (text, run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), common.value
        seen: dict[tuple[int, bytes], int] = {}  # smallest document of equal segments that this task has sent
        for rows in _rounds(batches, 2):
            rows.sort(key=lambda r: r[0])
            cells, done = [], []
            joined = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
            sizes = np.array([len(r[2]) for r in rows])
            begin = np.cumsum(sizes) - sizes
            for i, (k, th, text, codes) in enumerate(rows):
                key, lo, hi, place = text_segments(hasher, joined[begin[i] : begin[i] + sizes[i]], np.sort(np.array(codes or (), np.int64)), buckets, known)
                ask = np.ones(len(key), bool)
                fine = np.flatnonzero(place == FINE)
                for j, own, a, b in zip(fine.tolist(), key[fine].tolist(), lo[fine].tolist(), hi[fine].tolist()):
                    name = own, text[a : b + LENGTH - 1]
                    before = seen.get(name)
                    if before is not None and before < k:
                        ask[j] = False
                        done.append((th, a << 32 | b))
                    elif before is None or before > k:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[name] = k
                cells.append((key[ask], lo[ask], (hi - lo)[ask], place[ask], np.full(int(ask.sum()), i)))
            keys, first, count, place, who = map(np.concatenate, zip(*cells))
            where = _bucket(keys * np.uint64(_MULT), dealt)
            known_th, known_run = (np.array(x, np.int64) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
            their = _bucket(known_th.view(np.uint64) * np.uint64(_MULT), dealt)
            ids, docs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            asks, told = dict(_split(np.argsort(where, kind="stable"), where)), dict(_split(np.argsort(their, kind="stable"), their))
            none, out = np.zeros(0, np.int64), []
            for b in sorted({*asks, *told}):
                at, also = asks.get(b, none), told.get(b, none)
                strings = joined[_pieces(begin[who[at]] + first[at], count[at] + LENGTH - 1)]
                values = keys[at], ids[who[at]], docs[who[at]], first[at], count[at], place[at], strings, known_th[also], known_run[also]
                out.append((b, _blob(*(v.astype(kind) for v, kind in zip(values, _ASK)))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], ["bucket", "blob"])

    return run


class Segments:
    """Different segments: ``raw`` holds the bytes of each at ``begin``, ``strings`` many strings, with the smallest ``least`` document."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, strings: np.ndarray, least: np.ndarray, place: np.ndarray):
        self.raw, self.begin, self.strings, self.least, self.place = raw, begin, strings, least, place

    def solve(self, names: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The smallest document of each string of some segments, one segment after the other; those of a block come together."""
        return _solve(self.raw, self.begin[names], self.strings[names], self.least[names], blocks)

    def solve_large(self, names: np.ndarray) -> np.ndarray:
        """The same for a block that is too large: it is cut into blocks by finer keys."""
        hasher, begin, strings = Hasher(), self.begin[names], self.strings[names]
        starts = np.cumsum(strings) - strings
        best = np.repeat(self.least[names], strings)
        size = strings + LENGTH - 1
        new = np.cumsum(size) - size
        words = hasher.words(self.raw[_pieces(begin, size)])
        of, key, lo, hi = parts_of(hasher, words, np.zeros(len(names), np.uint64), new + self.place[names], new, new + strings)
        order = np.argsort(key, kind="stable")
        many = np.unique(key, return_inverse=True, return_counts=True)
        order = order[many[2][many[1][order]] > 1]
        block = many[1][order]
        # blocks of like size go through the arrays together
        order = order[np.lexsort((block, many[2][block]))]
        of, key, lo, hi = of[order], many[1][order], lo[order], hi[order]
        for a, b in _batches(key, hi - lo + LENGTH - 1):
            at = _pieces(starts[of[a:b]] + (lo - new[of])[a:b], (hi - lo)[a:b])
            best[at] = _solve(self.raw, begin[of[a:b]] + (lo - new[of])[a:b], (hi - lo)[a:b], self.least[names[of[a:b]]], key[a:b])
        return best


def _batches(blocks: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole blocks with about BATCH bytes."""
    if not len(blocks):
        return
    ends = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks))
    done = np.cumsum(size)[ends - 1]
    start = at = total = 0
    while at < len(ends):
        at = min(max(int(np.searchsorted(done, total + BATCH)), at), len(ends) - 1) + 1
        yield start, int(ends[at - 1])
        start, total = int(ends[at - 1]), int(done[at - 1])


def _solve(raw_: np.ndarray, at: np.ndarray, strings: np.ndarray, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    fresh = np.concatenate([[True], blocks[1:] != blocks[:-1]])
    sizes = strings + LENGTH - 1
    # each block begins with a separator, each segment ends with one
    begin = np.cumsum(sizes + 1) - (sizes + 1) + np.cumsum(fresh)
    n = int(begin[-1] + sizes[-1] + 1)
    raw = np.zeros(n + 8, np.uint8)
    text = np.zeros(n, np.int64)
    joined, to = raw_[_pieces(at, sizes)], _pieces(begin, sizes)
    raw[to] = joined
    text[to] = joined
    text[to] += 1
    bounds = np.append(begin[fresh] - 1, n)
    sa = suffix_arrays(text, bounds)
    # strings of LENGTH bytes in suffix order; equal ones are neighbours
    string_of = np.full(n, -1, np.int64)
    where, who = _pieces(begin, strings, True)
    string_of[where] = who
    owner = string_of[sa]
    real = owner >= 0
    order, owner = sa[real], owner[real]
    words = np.ndarray(n + 1, "<u8", raw, strides=(1,))
    number = np.cumsum(fresh)[owner]
    equal = number[1:] == number[:-1]
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        near = np.flatnonzero(equal)
        equal[near] = words[order[near + 1] + k] == words[order[near] + k]
    head = np.flatnonzero(np.concatenate([[True], ~equal]))
    best = np.repeat(np.minimum.reduceat(docs[owner], head), np.diff(np.append(head, len(order))))
    result = np.empty(n, np.int64)
    result[order] = best
    return result[where]


def _judge(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
    """Runs of repeated strings of the texts: (text, first << 32 | end)."""
    keys, ids, docs, first, count, place, data, texts, runs = map(np.concatenate, zip(*(_unblob(b, _ASK) for b in held.column(1).to_pylist())))
    count, first = count.astype(np.int64), first.astype(np.int64)
    size = count + LENGTH - 1
    end = np.cumsum(size)
    raw, begin = data.tobytes(), end - size
    digest = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    # equal segments of a key come together, the smallest document first
    order = np.lexsort((ids, digest, keys))
    same = (keys[order[1:]] == keys[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
    at = np.flatnonzero(same)
    same[at] = [raw[a:b] == raw[c:d] for a, b, c, d in zip(*(x.tolist() for x in (begin[order[at]], end[order[at]], begin[order[at + 1]], end[order[at + 1]])))]
    head = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(order)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(ids[order[head]], many)
    run = first << 32 | first + count
    again = ids > least
    found = [(np.concatenate([texts, docs[again]]), np.concatenate([runs, run[again]]))]
    one = order[head]
    own = keys[one]
    block = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    names = np.diff(np.append(block, len(own)))
    judged = Segments(data, begin[one], count[one], ids[one], place[one].astype(np.int64))
    # in the smallest document's places of a segment: the first ones of its rows, in order
    left = np.add.reduceat((~again)[order].astype(np.int64), head) if len(head) else many

    def places(of: np.ndarray, best: np.ndarray) -> None:
        """Add the runs of strings that a smaller document has, in the places that are not repeats as a whole."""
        strings = judged.strings[of]
        begins = np.cumsum(strings) - strings
        rows, owner = _pieces(head[of], left[of], True)
        p, n = order[rows], strings[owner]
        # after every place there is one string that does not repeat
        start = np.cumsum(n + 1) - (n + 1)
        hit = np.zeros(int((n + 1).sum()) + 1, np.int8)
        to, who = _pieces(start, n, True)
        hit[to + 1] = best[_pieces(begins[owner], n)] < ids[p][who]
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        a, b = edge[::2], edge[1::2]
        place_ = np.searchsorted(start, a, side="right") - 1
        shift = (first[p] - start)[place_]
        found.append((docs[p][place_], a + shift << 32 | b + shift))

    # blocks of like size go through the arrays together: a long one needs many more steps
    several = np.flatnonzero(names > 1)
    several = several[np.argsort(names[several], kind="stable")]
    large = (names[several] > BLOCK) & (place[one[block[several]]] != FINE)
    for b in several[large].tolist():
        of = np.arange(block[b], block[b] + names[b])
        places(of, judged.solve_large(of))
    several = several[~large]
    members, number = _pieces(block[several], names[several], True)
    for a, b in _batches(number, judged.strings[members] + LENGTH - 1):
        places(members[a:b], judged.solve(members[a:b], number[a:b]))
    texts, runs = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    del found, raw, data, judged
    trim()
    return pa.table([pa.array(texts), pa.array(runs)], names=["th", "run"])


# --- documents ------------------------------------------------------------------


def cut(text: bytes, runs: list[int] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the byte spans removed, from the runs of repeated strings."""
    spans: list[list[int]] = []
    for run in sorted(runs or ()):
        a, b = run >> 32, (run & 0xFFFFFFFF) - 1 + LENGTH
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [tuple(s) for s in spans]


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _keys(clashes: list[int]) -> tuple[Column, Column, Column]:
    """Order of a row, hash of its text, and size; ``clashes`` are hashes that different texts have."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    th = text_hash(text)
    return (
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NEVER)),
        F.when(th.isin(clashes), F.xxhash64(th, F.sha2(text, 256))).otherwise(th) if clashes else th,
        F.octet_length(text).cast("long"),
    )


def _keyed(documents: DataFrame, clashes: list[int]) -> DataFrame:
    """doc_id and text of rows with their order ``k``, the hash ``th`` of their text and its size."""
    k, th, size = _keys(clashes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), th.alias("th"), size.alias("n_bytes"), text.alias("text"))


def texts_of(documents: DataFrame) -> tuple[DataFrame, list[int]]:
    """(th, n_bytes, least) with the smallest document of each different text, staged, and the hashes that clash.

    Texts are the same if SHA-256 and size agree. Hashes of 64 bits of which two texts
    have the same are very few (about one for 6 * 10^9 texts) and come to the driver.
    """
    clashes: list[int] = []
    while True:
        keyed = _keyed(documents, clashes).withColumn("exact", F.unhex(F.sha2("text", 256)))
        first = staged(keyed.groupBy("th", "n_bytes", "exact").agg(F.min("k").alias("least")))
        more = [r["th"] for r in first.groupBy("th").count().filter("count > 1").collect()]
        if not more:
            return first, clashes
        clashes += more
        discard(first)


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(th, n_bytes, least): the smallest document of each text; (th, runs) of repeated strings in it; clashes of ``th``."""
    first, clashes = texts_of(documents)
    first = first.drop("exact")
    keyed = _keyed(documents, clashes)
    n, total = first.agg(F.count("*"), F.sum("n_bytes")).first()
    buckets = max(BUCKETS, round((total or 0) / PER_BUCKET))
    long_ = keyed.filter(F.col("n_bytes") >= LENGTH)
    common = documents.sparkSession.sparkContext.broadcast(common_anchors(long_, n))  # anchors of a sample at most
    blobs = long_.select("th", "text").mapInArrow(tidy(_emit_anchors(buckets, common)), "bucket long, blob binary")
    anchors = blobs.groupBy("bucket").applyInArrow(_repeated, "th long, anchor long")
    codes = staged(anchors.groupBy("th").agg(F.collect_list("anchor").alias("codes")))
    dealt = max(BUCKETS, (codes.agg(F.sum(F.size("codes"))).first()[0] or 0) // SEGMENTS)
    wanted = first.filter(F.col("n_bytes") >= LENGTH).join(codes, "th", "left" if len(common.value) else "inner")
    wanted = wanted.select(F.col("th").alias("code_th"), "least", "codes")
    rows = long_.join(wanted, (F.col("th") == F.col("code_th")) & (F.col("k") == F.col("least")))
    segments = rows.select("k", "th", "text", "codes").mapInArrow(tidy(_emit_segments(buckets, dealt, common)), "bucket long, blob binary")
    runs = segments.groupBy("bucket").applyInArrow(_judge, "th long, run long")
    done = staged(runs.groupBy("th").agg(F.collect_set("run").alias("runs")))
    discard(codes)
    return first, done, clashes


def _apply(schema: str, shape):
    """Map (…, text, runs) rows by ``shape(row, kept, spans)``."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = [c.cast(pa.large_binary()).to_pylist() if n == "text" else c.to_pylist() for n, c in zip(part.schema.names, part.columns)]
                at, last = part.schema.names.index("text"), part.schema.names.index("runs")
                rows = [shape(r, *cut(r[at], r[last])) for r in zip(*columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    first, runs, clashes = repeats(documents)
    keyed = _keyed(documents, clashes)
    # copies need no text: whole or not at all, by size
    light = keyed.select("doc_id", "k", "th", "n_bytes", F.when(F.col("n_bytes") < LENGTH, F.sha2("text", 256)).alias("short"))
    copies = light.join(first.select("th", "least"), "th").filter(F.col("k") > F.col("least"))
    whole = F.col("n_bytes") >= LENGTH
    copies = copies.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.coalesce("short", F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"),
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def shape(row, kept, spans):
        return row[0], len(row[1]), len(row[1]) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    return _originals(keyed, first, runs).select("doc_id", "text", "runs").mapInArrow(tidy(_apply(schema, shape)), schema).unionByName(copies)


def _originals(keyed: DataFrame, first: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that hold the smallest document of their text, with the text's runs."""
    named = first.join(runs, "th", "left").select(F.col("th").alias("own"), "least", "runs")
    return keyed.join(named, (F.col("th") == F.col("own")) & (F.col("k") == F.col("least")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated bytes are cut out of the texts; a document of which nothing is left goes.

    A character that a cut splits is dropped. ``n_chars`` follows the text.
    """
    first, runs, clashes = repeats(docs)
    k, th, size, own, least, spans_ = fresh(docs, "k", "th", "size", "own", "least", "runs")
    keyed = docs.withColumns(dict(zip((k, th, size), _keys(clashes))))
    named = first.join(runs, "th", "left").select(F.col("th").alias(own), F.col("least").alias(least), F.col("runs").alias(spans_))
    same = F.col(th) == F.col(own)
    copies = keyed.filter(F.col(size) < LENGTH).join(named.drop(spans_), same).filter(F.col(k) > F.col(least)).drop(k, th, size, own, least)
    found = keyed.join(named, same & (F.col(k) == F.col(least))).drop(k, th, size, own, least)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts, spans = part.column(at).cast(pa.large_binary()).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                kept = [cut(t, r)[0].decode("utf-8", "ignore") if t and r else t for t, r in zip(texts, spans)]
                kept = [t.decode("utf-8", "ignore") if isinstance(t, bytes) else t for t in kept]
                mask = pa.array([not (r and not t) for t, r in zip(kept, spans)], pa.bool_())
                columns = [*part.columns[:at], pa.array(kept, pa.string()), *part.columns[at + 1 : -1]]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1]).filter(mask)

    left = found.mapInArrow(tidy(run), docs.schema).unionByName(copies)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
