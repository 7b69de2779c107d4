"""SimHash near-duplicates by the general pigeonhole principle.

Documents are fingerprinted over word 3-shingles. The distinct fingerprints are
joined with themselves within ``radius`` bits: the 64 bits are grouped into parts so
that correlated bits share a part, and a threshold is allotted to every part by
dynamic programming on the estimated number of candidates, with
sum(thresholds) = radius - parts + 1. Two fingerprints within the radius then agree
within the threshold in at least one part. Buckets of a part's value are probed (a
threshold of one also probes the values one bit away), candidates are verified by
their whole distance, and the links' connected components are the groups.

Skew: exact copies are one fingerprint. A bucket of more than ``BUCKET`` fingerprints
is dealt out again by the value of a sub-part of the remaining bits (pigeonhole once
more), so no task gathers it. A bucket emits a spanning forest of its links, never
all pairs.

Defined cases
    * null text counts as empty; a text without words has fingerprint zero and is
      linked like any other
    * fewer words than a shingle: the whole sequence is the only shingle
    * ties of a bit (set in exactly half of the shingles) give 0
    * a null doc_id is kept with a null component when its fingerprint is alone
      (a row never starts a group without an id)
    * an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import ASCII_LOWER, WORD_BYTES, discard, fresh, settle, staged, table, tidy, trim, utf8
from tidemill.llm.components import components, forest

NAME = "op1_simhash_dedup"
SQL = None
#: Fingerprints a bucket may hold before it is dealt out by a finer key.
BUCKET = 1 << 16
#: Documents of a group that are judged one after the other in a task; Spark keeps so many a map task before it deals them (its limit is 1000).
GROUP = 1000
#: Bytes of text of which shingles are made at once.
CHUNK = 1 << 20
#: Cost of one shuffled row against one verified pair, for the choice of parts.
ROW_COST = 1000.0
#: Pairs that are compared at once.
PAIRS = 1 << 21
#: Documents whose shingles tell which are common, on average, and how many of those are known; only the order of shingles depends on them.
COMMON_DOCS, COMMON = 1 << 14, 1 << 17
#: Words of 64 bits in a filter of ids at most (8 MB); with more than some 2^24 ids it lets more rows pass to the exact join behind it.
FILTER = 1 << 20
#: Parts that are considered.
PARTS = (2, 3, 4, 5, 6, 7)
#: Largest threshold of a part; with at most seven parts radii up to 20 have an allocation, beyond that ``plan`` raises.
LIMIT = 2


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text; a bit is 1 if over half of the hashes set it."""
    words = WORD_BYTES.findall((text or b"").translate(ASCII_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for start in range(0, len(rows), 1 << 14):
        set_bits += np.unpackbits(rows[start : start + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            prints = np.array([fingerprint(t) for t in utf8(part.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint as a signed long."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


# --- allocation ---------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def correlated_parts(joint: np.ndarray, n: int, parts: int) -> list[int]:
    """Masks of ``parts`` groups of bits: greedy, the most correlated bits together.

    ``joint[i, j]`` counts the fingerprints that set both bits i and j.
    """
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, masks = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        left = sorted(free)
        first = max(left, key=lambda i: (corr[i, left].sum(), -i))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.discard(best)
        masks.append(sum(1 << b for b in group))
    return masks


def allot(pairs: list[float], widths: list[int], n: int, radius: int) -> tuple[float, list[int]]:
    """Cheapest thresholds (-1 skips a part, at most ``LIMIT``) with the sum the principle asks for.

    ``pairs[i]`` is the number of pairs of equal values in part i; by Cauchy-Schwarz
    no flipped bits yield more, which bounds the candidates of a probe.
    """
    target = radius - len(pairs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for same, width in zip(pairs, widths):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for limit in range(-1, LIMIT + 1):
                # one bit: a set bit is cleared on one side of a pair only; more: any bits are flipped
                probes = 0 if limit < 0 else 1 + width / 2 if limit == 1 else sum(math.comb(width, i) for i in range(limit + 1))
                new = cost + probes * (same + ROW_COST * n)
                if total + limit not in nxt or new < nxt[total + limit][0]:
                    nxt[total + limit] = (new, [*chosen, limit])
        best = nxt
    return best.get(target, (float("inf"), []))


def plan(prints: DataFrame, radius: int) -> tuple[list[int], list[int]]:
    """Masks and thresholds for the distinct fingerprints in ``prints``; counts cover all rows."""

    def joint_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for start in range(0, len(fp), 1 << 16):
                chunk = fp[start : start + (1 << 16)]
                bits = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
                n += len(chunk)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], ["cell", "n"])

    cells = prints.select("fp").mapInArrow(joint_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(4097, np.int64)
    for cell, n in cells.collect():  # 4,097 rows at any size
        counts[cell] = n
    joint, n = counts[:4096].reshape(64, 64), int(counts[4096])
    layouts = {m: correlated_parts(joint, n, m) for m in PARTS if m <= radius + 2}
    keys = F.array(
        *[
            F.struct(F.lit(m).alias("m"), F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
            for m, masks in layouts.items()
            for i, mask in enumerate(masks)
        ]
    )
    sizes = (
        prints.select(F.explode(keys).alias("k"))
        .groupBy("k.m", "k.part", "k.value")
        .count()
        .groupBy("m", "part")
        .agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
        .collect()  # one row for each part of each layout
    )
    found = {(r["m"], r["part"]): r["pairs"] for r in sizes}
    choices = []
    for m, masks in layouts.items():
        cost, limits = allot([found.get((m, i), 0.0) for i in range(m)], [x.bit_count() for x in masks], n, radius)
        choices.append((cost, m, limits))
    cost, m, limits = min(choices)
    if cost == float("inf"):
        raise ValueError(f"no allocation of thresholds up to {LIMIT} to {max(PARTS)} parts reaches a radius of {radius}")
    return layouts[m], limits


# --- probing ------------------------------------------------------------------


def probe_keys(masks: list[int], limits: list[int]) -> Column:
    """Array of (mask, value) buckets that a fingerprint takes part in.

    Its own value in each part, and under a threshold of one the values with one of its
    set bits cleared: of two fingerprints that differ in one bit of a part, the one that
    has the bit meets the other in the other's bucket. Under a higher threshold all values
    within it are probed.
    """
    fp, keys = F.col("fp"), []
    for mask, limit in zip(masks, limits):
        if limit < 0:
            continue
        value = fp.bitwiseAND(F.lit(_signed(mask)))
        key = lambda v, mask=mask: F.struct(F.lit(_signed(mask)).alias("mask"), v.alias("value"))
        keys.append(key(value))
        bits = [b for b in range(64) if mask >> b & 1]
        if limit == 1:
            for b in bits:
                bit = F.lit(_signed(1 << b))
                keys.append(F.when(fp.bitwiseAND(bit) != 0, key(value.bitwiseXOR(bit))))
        if limit > 1:  # own fingerprints stand in a bucket with their own value, probing ones with one up to ``limit`` bits away
            for n in range(1, limit + 1):
                keys += [key(value.bitwiseXOR(F.lit(_signed(sum(1 << b for b in some))))) for some in itertools.combinations(bits, n)]
    return F.array_compact(F.array(*keys))


def near(own: np.ndarray, own_ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a bucket: among its own fingerprints, and from each of their
    connected sets to the other fingerprints that one of them is near to."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    left = np.arange(len(own))
    while len(left):
        queue, members, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(own[left] ^ own[x]) <= radius
            if hit.any():
                found = left[hit]
                left = left[~hit]
                a.append(own_ids[found])
                b.append(np.full(len(found), own_ids[members[0]]))
                queue += found.tolist()
                members += found.tolist()
        if len(more):
            touched = np.zeros(len(more), bool)
            step = max(1, PAIRS // len(more))
            for start in range(0, len(members), step):
                part = own[members[start : start + step]]
                touched |= (np.bitwise_count(part[:, None] ^ more[None, :]) <= radius).any(axis=0)
            if touched.any():
                a.append(more_ids[touched])
                b.append(np.full(int(touched.sum()), own_ids[members[0]]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def few(own: np.ndarray, own_ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a small bucket: its links by one comparison of all."""
    all_, ids = np.concatenate([own, more]), np.concatenate([own_ids, more_ids])
    x, y = np.nonzero(np.bitwise_count(own[:, None] ^ all_[None, :]) <= radius)
    keep = x < y
    return ids[x[keep]], ids[y[keep]]


def _sub_masks(mask: int, parts: int) -> list[int]:
    rest = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in rest[i::parts]) for i in range(parts) if rest[i::parts]]


SCHEMA = "mask long, value long, fp long, id long, link boolean"


def _buckets(radius: int):
    """Verify the buckets of sorted rows (mask, value, fp, id).

    A row with ``link`` is a link (fp = one id, id = the other); the others belong to
    buckets too large for a task and carry a finer key. A bucket with no more than
    ``radius`` bits open has few fingerprints and is verified whole.
    """

    def large(mask: int, n: int) -> bool:
        return n > BUCKET and 64 - (mask % (1 << 64)).bit_count() > radius

    def out(rows: list[tuple[np.ndarray, ...]], link: bool) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate(c) if len(c) else np.zeros(0, np.int64), pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(cols[0]), link))], ["mask", "value", "fp", "id", "link"])

    def finer(mask: int, value: int, fp: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        found = []
        for sub in _sub_masks(mask % (1 << 64), radius + 1):
            whole = mask % (1 << 64) | sub
            values = np.int64(value) | (fp & np.int64(_signed(sub)))
            found.append((np.full(len(fp), _signed(whole), np.int64), values, fp, ids))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rest = np.zeros((0, 4), np.int64)
        hot = None  # the key whose rows are being passed on
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            rest = np.concatenate([rest, rows]) if len(rest) else rows
            cut = np.flatnonzero((np.diff(rest[:, :2], axis=0) != 0).any(axis=1)) + 1
            whole, rest = (rest[: cut[-1]], rest[cut[-1] :]) if len(cut) else (rest[:0], rest)
            yield from groups(whole, cut[:-1] if len(cut) else cut, hot)
            if len(cut):
                hot = None
            if hot is not None or len(rest) and large(int(rest[0, 0]), len(rest)):
                key = (int(rest[0, 0]), int(rest[0, 1]))
                yield out(finer(*key, rest[:, 2], rest[:, 3]), False)
                hot, rest = key, rest[:0]
        if len(rest):
            yield from groups(rest, np.zeros(0, np.int64), hot)

    def groups(rows: np.ndarray, cut: np.ndarray, hot) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        bounds = np.concatenate([[0], cut, [len(rows)]])
        fps, ids = np.ascontiguousarray(rows[:, 2]), np.ascontiguousarray(rows[:, 3])
        own = fps & rows[:, 0] == rows[:, 1]
        fps = fps.view(np.uint64)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist() if hot is None else range(len(bounds) - 1):
            s, e = int(bounds[i]), int(bounds[i + 1])
            key = (int(rows[s, 0]), int(rows[s, 1]))
            if key == hot or large(key[0], e - s):
                yield out(finer(*key, rows[s:e, 2], rows[s:e, 3]), False)
                continue
            mine, f, n = own[s:e], fps[s:e], ids[s:e]
            if mine.any():
                join = few if e - s <= 64 else near
                x, y = join(f[mine], n[mine], f[~mine], n[~mine], radius)
                if len(x):
                    a.append(x)
                    b.append(y)
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            zero = np.zeros(len(x), np.int64)
            yield out([(zero, zero, x, y)], True)

    return run


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp, id) within the radius.

    Every pair within the radius is connected by a path of returned links; pairs that
    are already connected within a bucket are not listed.
    """
    masks, limits = plan(prints, radius)
    rows = prints.select(F.explode(probe_keys(masks, limits)).alias("k"), "fp", "id").select("k.mask", "k.value", "fp", "id")
    tables = []
    # every level fixes more bits of what large buckets hold, so there are few levels
    while not tables or not rows.isEmpty():
        dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value")
        done = staged(dealt.mapInArrow(tidy(_buckets(radius)), SCHEMA))
        tables.append(done)
        rows = done.filter("not link").select("mask", "value", "fp", "id")
    found = [t.filter("link").select(F.col("fp").alias("a"), F.col("id").alias("b")) for t in tables]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    whole._tables = tables
    return whole


def simhash_dedup(documents: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate groups of all documents."""
    prints = settle(fingerprints(documents))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = links(distinct.filter("id IS NOT NULL"), radius)
    groups = components(found)
    discard(*found._tables)
    named = distinct.join(groups, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    # one row a fingerprint on the right: a fingerprint that a third of the documents share is split by the skew join
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash_dedup(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- one document of each group -------------------------------------------------


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Different hashes of the word shingles of texts in lower case, by prefix sums of a polynomial over their bytes."""

    def __init__(self, size: int = 5):
        self.size = size
        self.random = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, m, np.uint64)]), dtype=np.uint64) for m in (_MULT, np.uint64(pow(int(_MULT), -1, 1 << 64))))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word; cut at white space, so a long text needs no long arrays."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = at + CHUNK
            raw = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
            blank = _BLANK[raw]
            if end < len(data) and not blank[-1]:
                last = np.flatnonzero(blank)
                if len(last):
                    raw, blank = raw[: last[-1] + 1], blank[: last[-1] + 1]
                else:  # one word longer than a chunk
                    rest = np.frombuffer(data, np.uint8, len(data) - at, at)
                    stop = np.flatnonzero(_BLANK[rest])
                    raw = rest[: stop[0]] if len(stop) else rest
                    blank = np.zeros(len(raw), bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
            first, stop = edge[::2], edge[1::2]
            self._powers(len(raw))
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.random[raw] * self.up[: len(raw)], out=sums[1:])
            starts.append(first + at)
            hashes.append(_mixed((sums[stop] - sums[first]) * self.down[first]))
            at += len(raw)
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts, ascending in each, and how many each has; fewer words than a shingle make one, none make none."""
        data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        begin = np.cumsum([0, *(len(d) + 1 for d in data)])
        first, word = self.words(b"\n".join(data))
        doc = np.searchsorted(begin, first, side="right") - 1
        many = np.bincount(doc, minlength=len(texts))
        h, of = np.zeros(max(len(word) - self.size + 1, 0), np.uint64), doc[: max(len(word) - self.size + 1, 0)]
        for i in range(self.size):
            h = _mixed(h * _MULT + word[i : i + len(h)])
        whole = of == doc[self.size - 1 :] if len(h) else np.zeros(0, bool)
        h, of = h[whole], of[whole]
        begin = np.cumsum(many) - many
        few = np.flatnonzero((many > 0) & (many < self.size))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for i in range(self.size - 1):
                more = many[few] > i
                short[more] = _mixed(short[more] * _MULT + word[begin[few[more]] + i])
            h, of = np.concatenate([h, short]), np.concatenate([of, few])
        h = h.view(np.int64)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        return h[keep], np.bincount(of[keep], minlength=len(texts))


def _by_size(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``CHUNK`` bytes of text."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + CHUNK)))
            yield batch.slice(start, end - start)
            start = end


def shingled(documents: DataFrame, *names: str) -> DataFrame:
    """(doc_id, rank, shingles): the different shingle hashes of every document; with other columns of longs."""
    names = ("doc_id", "rank", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in _by_size(batches, len(names)):
            h, many = shingler.sets(part.column(len(names)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*names, "shingles"])

    return documents.select(*names, "text").mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names) + ", shingles array<long>")


def _spot(key: Column, size: int) -> tuple[Column, Column]:
    """Word of a filter of ``size`` words, a power of two, and the bits in it that stand for a key."""
    h = F.xxhash64(key)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(size - 1)).cast("int"), bit(40).bitwiseOR(bit(50))


def sifted(documents: DataFrame, key: Column, ids: DataFrame, among: bool = True) -> DataFrame:
    """Rows whose key may be one of ``ids`` (id), or all others (a null key is none of them).

    A filter of bounded size that every task gets: rows that no id asks for need not be
    shuffled with their texts. Few others pass it, so an exact join has to follow; an
    inner or outer one, as Spark would do semi and anti joins before the filter.
    """
    size = min(FILTER, 1 << (ids.count() // 4).bit_length())
    word, bits = _spot(F.col("id"), size)
    held = ids.filter("id IS NOT NULL").groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()  # a row a word
    words = np.zeros(size, np.int64)
    words[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    (name,) = fresh(documents, "words")
    one = documents.sparkSession.createDataFrame(pa.table({name: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(words))}))
    word, bits = _spot(key, size)
    passes = key.isNotNull() & (F.col(name)[word].bitwiseAND(bits) == bits)
    return documents.join(F.broadcast(one), passes if among else ~passes).drop(name)


class Similar:
    """Sets that are kept, and whether another is similar to one of them.

    Prefix filter: ordered by how many of all sets have them, similar sets share one of
    their rarest elements, so only those kept with such an element are compared.
    """

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.threshold = threshold
        self.values, self.counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.kept: list[np.ndarray] = []
        self.index: dict[int, list[int]] = {}
        self.empty = False

    def rare(self, own: np.ndarray) -> list[int]:
        at = np.searchsorted(self.values, own)
        return own[np.lexsort((own, self.counts[at]))][: len(own) - int(np.ceil(self.threshold * len(own) - 1e-9)) + 1].tolist()

    def has(self, own: np.ndarray, rare: list[int]) -> bool:
        if not len(own):  # texts without words are the same
            return self.empty
        for k in {k for h in rare for k in self.index.get(h, ())}:
            other = self.kept[k]
            if min(len(own), len(other)) >= self.threshold * max(len(own), len(other)):
                small, large = (own, other) if len(own) <= len(other) else (other, own)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[place] == small).sum())
                if shared >= self.threshold * (len(own) + len(other) - shared):
                    return True
        return False

    def keep(self, own: np.ndarray, rare: list[int]) -> None:
        if not len(own):
            self.empty = True
        for h in rare:
            self.index.setdefault(h, []).append(len(self.kept))
        self.kept.append(own)


def _columns(held: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Ids and sets of a table (doc_id, rank, shingles), in order of rank and id."""
    ids = held.column("doc_id").to_numpy()
    order = np.lexsort((ids, held.column("rank").to_numpy()))
    lists = held.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return ids[order].tolist(), [flat[bounds[i] : bounds[i + 1]] for i in order.tolist()]


def _judged(threshold: float):
    """Which documents of a group stay: those not similar to an earlier one that stays."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        ids, sets = _columns(held)
        known, stays = Similar(sets, threshold), []
        for own in sets:
            rare = known.rare(own)
            stays.append(not known.has(own, rare))
            if stays[-1]:
                known.keep(own, rare)
        trim()
        return pa.table([pa.array(ids, pa.int64()), pa.array(stays, pa.bool_())], names=["doc_id", "stays"])

    return run


def _followers(threshold: float):
    """Documents that are similar to one with ``leads``."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        leads = held.column("leads")
        (_, first), (ids, sets) = _columns(held.filter(leads)), _columns(held.filter(pa.compute.invert(leads)))
        known = Similar([*first, *sets], threshold)
        for own in first:
            known.keep(own, known.rare(own))
        gone = [d for d, own in zip(ids, sets) if known.has(own, known.rare(own))]
        trim()
        return pa.table([pa.array(gone, pa.int64())], names=["doc_id"])

    return run


def row_key() -> Column:
    """Hash of doc_id and text: rows with the same id and text are one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def least_shared(total: int | Column, most: int | Column, threshold: float):
    """Prefix shingles that two sets of ``total`` shingles, ``most`` in the larger, share at least if they are similar.

    The prefix that ends first is known whole on both sides; what it doesn't share is not shared.
    """
    ceil = F.ceil if isinstance(total, Column) else np.ceil
    return ceil(total * (threshold / (1 + threshold)) - 1e-9) - ceil(most * threshold - 1e-9) + 1


def prefixes(documents: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, n, same, too, prefix) of (doc_id, rank, text): size and two hashes of the set of shingles, and its rarest.

    The order of shingles is the same for all sets: those that no bounded sample shows as
    common by their hash, then the others by how many texts of the sample have them.
    Similar sets share a shingle of their prefixes whatever the order is.
    """
    drawn = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // COMMON_DOCS))) == 0)
    known = shingled(drawn).select(F.explode("shingles").alias("h")).groupBy("h").count()
    known = known.filter("count >= 3").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes, counts = known.column(0).to_numpy(), known.column(1).to_numpy()
    order = np.argsort(hashes)
    shared = documents.sparkSession.sparkContext.broadcast((hashes[order], counts[order]))  # at most COMMON shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        shingler = Shingler()
        for part in _by_size(batches, 1):
            flat, sizes = shingler.sets(part.column(1).to_pylist())
            count = np.zeros(len(flat), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                count = np.where(common[at] == flat, often[at], 0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
            for out, salt in zip(sums, (1, 2)):
                np.add.at(out, row, _mixed((flat.view(np.uint64) + np.uint64(salt)) * _MULT))
            flat = flat[np.lexsort((flat, count, row))]
            keep = np.where(sizes > 0, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, 0)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            offsets = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[place < keep[row]]))
            values = [part.column(0), pa.array(sizes.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums), prefix]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "n", "same", "too", "prefix"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, same long, too long, prefix array<long>")


def _meet(threshold: float):
    """Pairs (a, b, total, most) of sorted rows (h, id, component, n) with the same h, similar sizes and different components."""

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, ids, group, n = rows.T
        live, d, held, size = np.arange(len(rows)), 1, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b", "total", "most"])

        while True:
            live = live[live + d < len(rows)]
            live = live[h[live] == h[live + d]]
            if not len(live):
                break
            most, least = np.maximum(n[live], n[live + d]), np.minimum(n[live], n[live + d])
            x = live[(group[live] != group[live + d]) & (least >= threshold * most - 1e-9)]
            if len(x):
                y = x + d
                held.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), n[x] + n[y], np.maximum(n[x], n[y])))
                size += len(x)
                if size >= 1 << 16:
                    yield out()
                    held, size = [], 0
            d += 1
        if held:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last value may go on in the next batch
            if cut or held and held[-1][-1, 0] != rows[0, 0]:
                yield from pairs(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from pairs(np.concatenate(held))

    return run


def joined_groups(documents: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, component_id): the groups, joined where documents of two of them are similar.

    Exact: similar sets share a shingle of their prefixes, so pairs in different groups
    that share enough of them are all compared by their whole sets. Texts with the same
    set are looked for once.
    """
    marks = staged(prefixes(documents, grouped.count(), threshold))
    set_ = ["same", "too", "n"]
    firsts = marks.groupBy(*set_).agg(F.min("doc_id").alias("first"))
    # repeated rows of a document go behind the joins by its id, which deal them out already
    groups = staged(marks.select("doc_id", *set_).join(firsts, set_).join(grouped, "doc_id").select("doc_id", "first", "component_id").dropDuplicates(["doc_id"]))
    rows = marks.join(groups.filter("doc_id = first").select("doc_id", "component_id"), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.select(F.explode("prefix").alias("h"), "doc_id", "component_id", "n")
    met = rows.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_meet(threshold)), "a long, b long, total long, most long")
    shared = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("total").alias("total"), F.first("most").alias("most"))
    pairs = staged(shared.filter(F.col("shared") >= least_shared(F.col("total"), F.col("most"), threshold)).select("a", "b"))
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    asked = sifted(documents, F.col("doc_id"), ids).join(ids, F.col("doc_id") == F.col("id"))
    asked = staged(shingled(asked.dropDuplicates(["doc_id"])))
    side = lambda name: asked.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"{name}_set"))
    common, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    similar = pairs.join(side("a"), "a").join(side("b"), "b").filter(common >= threshold * (total - common)).select("a", "b")
    similar = similar.union(groups.filter("doc_id != first").select("doc_id", "first"))
    of = lambda name: groups.select(F.col("doc_id").alias(name), F.col("component_id").alias(f"{name}_group"))
    links = similar.join(of("a"), "a").join(of("b"), "b").filter("a_group != b_group").select(F.col("a_group").alias("a"), F.col("b_group").alias("b")).distinct()
    joined = components(links)
    found = groups.join(joined, F.col("component_id") == F.col("node"), "left")
    found = staged(found.select("doc_id", F.coalesce("component", "component_id").alias("component_id")))
    discard(marks, groups, pairs, ids, asked)
    return found


def near_copies(documents: DataFrame, radius: int = 8, threshold: float = 0.8) -> DataFrame:
    """Keys (``row_key``) of documents that are similar to an earlier one which itself stays.

    In order of doc_id (different texts of one id by their keys) a document goes if the Jaccard similarity of its five-word
    shingles to one that stays is at least the threshold. Candidates are the SimHash
    groups at a wider radius, joined by an exact prefix-filter join where similar
    documents are in different ones, so no similar pair is left out. The first ``GROUP``
    documents of every group are judged one after the other in a task. What is left of
    larger groups is dealt out, held against those of the first that stay, and what
    then remains begins again; so no task ever has more than a few thousand documents of
    a group.
    """
    # from here on doc_id is the key, and rank the id
    documents = documents.filter("doc_id IS NOT NULL").select(row_key().alias("doc_id"), "text", F.col("doc_id").cast("long").alias("rank"))
    near = staged(simhash_dedup(documents, radius).select("doc_id", "component_id").distinct())
    grouped = joined_groups(documents, near, threshold)
    several = grouped.groupBy("component_id").count().filter("count > 1")
    members = staged(grouped.join(several, "component_id").select(F.col("doc_id").alias("id"), F.col("component_id").alias("group")))
    rows = sifted(documents, F.col("doc_id"), members).join(members, F.col("doc_id") == F.col("id")).dropDuplicates(["doc_id"])
    left = staged(shingled(rows, "group"))
    discard(near, grouped, members)
    gone = []
    while True:
        # only the documents of groups that are not judged whole are joined with ids
        large = staged(left.groupBy(F.col("group").alias("id")).count().filter(F.col("count") > GROUP).select("id"))
        if large.isEmpty():
            chosen = left
        else:
            order = Window.partitionBy("group").orderBy("rank", "doc_id")
            of_large = sifted(left, F.col("group"), large)
            first = of_large.select("doc_id", "rank", "group").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= GROUP)
            chosen = of_large.join(first.select(F.col("doc_id").alias("id")), F.col("doc_id") == F.col("id")).drop("id")
            chosen = sifted(left, F.col("group"), large, among=False).unionByName(chosen)
        judged = staged(chosen.groupBy("group").applyInArrow(_judged(threshold), "doc_id long, stays boolean"))
        gone.append(judged.filter("NOT stays").select("doc_id"))
        if large.isEmpty():
            discard(large)
            break
        mark = judged.select(F.col("doc_id").alias("id"), "stays")
        rest = of_large.join(mark, F.col("doc_id") == F.col("id"), "left").filter("id IS NULL").drop("id", "stays")
        sizes = staged(rest.groupBy("group").agg(F.ceil(F.count("*") / (4 * GROUP)).cast("int").alias("parts")))
        # what stays goes to every part of what is left of its group
        leaders = of_large.join(mark.filter("stays"), F.col("doc_id") == F.col("id")).join(sizes, "group")
        leaders = leaders.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", "rank", "shingles", F.lit(True).alias("leads"))
        dealt = rest.join(sizes, "group").select("group", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", "rank", "shingles", F.lit(False).alias("leads"))
        follow = staged(leaders.unionByName(dealt).groupBy("group", "part").applyInArrow(_followers(threshold), "doc_id long"))
        gone.append(follow)
        left, before = staged(rest.join(follow.select(F.col("doc_id").alias("id")), F.col("doc_id") == F.col("id"), "left_anti")), left
        discard(before, sizes, large)
        if left.isEmpty():
            break
    discard(left)
    found = gone[0]
    for more in gone[1:]:
        found = found.unionByName(more)
    return found


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of near copies the document with the smallest doc_id stays.

    Rows with the same doc_id and text stay or go together; different texts of one
    doc_id are judged apart. A row without a doc_id stays. Other columns are kept
    whatever their names.
    """
    (name,) = fresh(docs, "gone")
    gone = near_copies(docs).select(F.col("doc_id").alias("id"))
    key = F.when(F.col("doc_id").isNotNull(), row_key())
    stay = sifted(docs, key, gone, among=False)
    asked = sifted(docs, key, gone).join(gone.select(F.col("id").alias(name)), key == F.col(name), "left").filter(F.col(name).isNull()).drop(name)
    return stay.unionByName(asked)
