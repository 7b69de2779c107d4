"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language; the n-grams of all languages lie in
one array of hashes, sorted, for each order, beside a matrix with a column of
log-probabilities for each language. A text gets the language with the lowest
cross-entropy per character. A text whose best cross-entropy is above a cutoff
calibrated on texts that the models have not seen is rejected.

Every labelled language has a model. The models are fitted on a bounded sample of
labelled rows: ``PER_LANGUAGE`` whole texts on average, fewer beyond ``SAMPLE`` in all
but ``LEAST`` at least (and one in any case), chosen by a hash of the id. The matrix has
a column a language, so more than ``LANGUAGES`` of them are split over several models
(``Shards``), and a text gets the lowest cross-entropy over all. Every text is scored
whole.

Defined cases
    * null text or a text without a letter gets ``und`` with score 0, rejected
    * ties go to the language that sorts first
    * no labelled row at all: every text is ``und``
    * case and runs of white space don't matter; digits and symbols count as one class
    * an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fold, table, tidy

NAME = "op7_language_id"
SQL = None
#: Length of the longest n-gram.
ORDER = 4
#: Labelled texts for each language and in all, on average; texts that a language keeps on average however many there are; languages of one model.
PER_LANGUAGE, SAMPLE, LEAST, LANGUAGES = 400, 4000, 20, 64
#: Bytes of text that are scored at once.
BLOCK = 1 << 18
#: Characters beyond the highest cross-entropy of the calibration texts, in bits.
MARGIN = 1.0

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _class_table() -> np.ndarray:
    """Code point to symbol: letters in lower case, 32 for white space, 35 for the rest."""
    out = np.full(0x11000, 35, np.uint32)
    for c in range(0x11000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif ch.isspace():
            out[c] = 32
        elif ch in "'’-":
            out[c] = 39
    return out


_CLASS: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """Symbols of a text with a space before and after, repeated spaces collapsed."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _class_table()
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    mapped = np.where(raw < len(_CLASS), _CLASS[np.minimum(raw, len(_CLASS) - 1)], raw)
    padded = np.concatenate([[32], mapped, [32]]).astype(np.uint64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    return padded[keep]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_hashes(s: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a symbol sequence."""
    h = np.zeros(max(len(s) - n + 1, 0), np.uint64)
    for i in range(n):
        h = (h ^ s[i : i + len(h)]) * _MULT
        h ^= h >> np.uint64(29)
    return h


class Sorted:
    """Sorted hashes with a directory over their top bits; rows of values beside them."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(1, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        filled = np.diff(np.append(self.start, len(hashes)))
        self.depth = int(filled.max()) if len(hashes) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is absent."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.hashes):
            return out
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        live = np.arange(len(wanted))
        for _ in range(self.depth):
            safe = np.minimum(at, len(self.hashes) - 1)
            got = self.hashes[safe]
            hit = got == wanted[live]
            out[live[hit]] = safe[hit]
            more = (got < wanted[live]) & (at < len(self.hashes))
            live, at = live[more], at[more] + 1
            if not len(live):
                break
        return out


def alphabet_size(texts: dict[str, list[str]]) -> int:
    """Different symbols of all texts, and one for all others."""
    seen = np.zeros(0, np.uint64)
    for v in texts.values():
        seen = np.unique(np.concatenate([seen, *map(symbols, v)]))
    return len(seen) + 1


class Model:
    """Interpolated Kneser-Ney models of several languages over shared n-grams."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, alphabet: int | None = None):
        self.langs, self.order = sorted(texts), order
        streams = {k: [symbols(t) for t in texts[k]] for k in self.langs}
        alphabet = alphabet or alphabet_size(texts)
        counts = [self._counts(streams[k]) for k in self.langs]
        self.grams: list[Sorted] = []  # by order - 1: log2 probability for each language
        self.back: list[Sorted] = []  # by length of the context: log2 weight of the lower order
        lower: Sorted | None = None
        for n in range(1, order + 1):
            union = np.unique(np.concatenate([c[n - 1][0] for c in counts]))
            first = np.concatenate([c[n - 1][0] for c in counts])
            at = np.searchsorted(union, first)
            context = np.zeros(len(union), np.uint64)
            context[at] = np.concatenate([c[n - 1][2] for c in counts])
            suffix = np.zeros(len(union), np.uint64)
            suffix[at] = np.concatenate([c[n - 1][3] for c in counts])
            contexts = np.unique(context)
            where = np.searchsorted(contexts, context)
            prob = np.zeros((len(union), len(self.langs)), np.float32)
            back = np.zeros((len(contexts), len(self.langs)), np.float32)
            for l, c in enumerate(counts):
                hashes, count, _, _ = c[n - 1]
                full = np.zeros(len(union))
                full[np.searchsorted(union, hashes)] = count
                ones, twos = (count == 1).sum(), (count == 2).sum()
                d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
                total = np.bincount(where, full, len(contexts))
                kinds = np.bincount(where, full > 0, len(contexts))
                weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                if n == 1:
                    below = np.full(len(union), 1 / alphabet)
                else:
                    below = 2.0 ** lower.values[lower.find(suffix), l]
                own = np.where(total[where] > 0, np.maximum(full - d, 0) / np.maximum(total[where], 1), 0)
                prob[:, l] = np.log2(own + weight[where] * below)
                back[:, l] = np.log2(weight)
            lower = Sorted(union, prob)
            self.grams.append(lower)
            self.back.append(Sorted(contexts, back))
        self.floor = np.float32(-np.log2(alphabet))
        self.cutoff, self.heat = np.inf, 1.0

    def _counts(self, streams: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """For each order: hashes, counts (below the highest: distinct left neighbours), contexts, suffixes."""
        parts = []
        for s in streams:
            h = gram_hashes(s, self.order)
            parts.append((h, gram_hashes(s, self.order - 1)[: len(h)], gram_hashes(s[1:], self.order - 1)))
        out: list[tuple[np.ndarray, ...]] = [()] * self.order
        h, ctx, suf = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in zip(*parts))
        grams, first, count = np.unique(h, return_index=True, return_counts=True)
        out[self.order - 1] = (grams, count.astype(float), ctx[first], suf[first])
        for n in range(self.order - 1, 0, -1):
            # every distinct gram of order n + 1 is one left neighbour of its suffix
            grams, count = np.unique(out[n][3], return_counts=True)
            ctx_of, suf_of = self._parts(streams, n, grams)
            out[n - 1] = (grams, count.astype(float), ctx_of, suf_of)
        return out

    def _parts(self, streams: list[np.ndarray], n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ctx, suf = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
        for s in streams:
            h = gram_hashes(s, n)
            at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            ok = grams[at] == h
            if n > 1:
                ctx[at[ok]] = gram_hashes(s, n - 1)[: len(h)][ok]
                suf[at[ok]] = gram_hashes(s[1:], n - 1)[ok]
        return ctx, suf

    def log_probs(self, s: np.ndarray) -> np.ndarray:
        """log2 P(symbol | the symbols before it) for each position from ORDER - 1 and each language."""
        size = max(len(s) - self.order + 1, 0)
        out = np.zeros((size, len(self.langs)), np.float32)
        open_ = np.arange(size)
        for n in range(self.order, 0, -1):
            wanted = gram_hashes(s[self.order - n :], n)[open_] if len(open_) < size else gram_hashes(s[self.order - n :], n)
            row = self.grams[n - 1].find(wanted)
            hit = row >= 0
            out[open_[hit]] += self.grams[n - 1].values[row[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            ctx = gram_hashes(s[self.order - n :], n - 1)[: size][open_] if n > 1 else np.zeros(len(open_), np.uint64)
            seen = self.back[n - 1].find(ctx)
            ok = seen >= 0
            out[open_[ok]] += self.back[n - 1].values[seen[ok]]
        out[open_] += self.floor
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy in bits per character, a row for each text."""
        out = np.zeros((len(texts), len(self.langs)))
        pending: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            sizes = np.array([len(x) + self.order - 2 for x in pending])
            pad = np.full(self.order - 2, 32, np.uint64)
            s = np.concatenate([y for x in pending for y in (pad, x)])
            probs = self.log_probs(s)
            starts = np.cumsum(sizes) - sizes
            for k, (i, start, x) in enumerate(zip(rows, starts.tolist(), pending)):
                out[i] = -probs[start : start + len(x) - 1].mean(axis=0)

        held = 0
        for i, text in enumerate(texts):
            x = symbols(text)
            pending.append(x)
            rows.append(i)
            held += len(x)
            if held >= BLOCK:
                flush()
                pending, rows, held = [], [], 0
        if pending:
            flush()
        return out

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Cutoff of rejection and steepness of the score, from texts that were not counted."""
        if not texts:
            return
        h = self.entropies(texts)
        own = np.array([self.langs.index(x) for x in langs])
        self.cutoff = float(h[np.arange(len(own)), own].max() + MARGIN)
        steps = np.array([1.0, 2.0, 4.0, 8.0, 16.0, 32.0])
        cost = [-np.log(np.maximum(self.softmax(h, t)[np.arange(len(own)), own], 1e-9)).mean() for t in steps]
        self.heat = float(steps[int(np.argmin(cost))])

    @staticmethod
    def softmax(h: np.ndarray, heat: float) -> np.ndarray:
        z = np.exp2(-(h - h.min(axis=1, keepdims=True)) * heat)
        return z / z.sum(axis=1, keepdims=True)


class Shards(Model):
    """Models of up to ``LANGUAGES`` languages each that score as one.

    They share the alphabet, so a language has the same probabilities as in one model of
    all: what a shard has not seen in any of its languages backs off to the same value.
    """

    def __init__(self, texts: dict[str, list[str]], size: int):
        self.langs, alphabet = sorted(texts), alphabet_size(texts)
        self.models = [Model({k: texts[k] for k in self.langs[i : i + size]}, alphabet=alphabet) for i in range(0, len(self.langs), size)]
        self.cutoff, self.heat = np.inf, 1.0

    def entropies(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([m.entropies(texts) for m in self.models], axis=1)


def sample(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Labelled training rows, about ``per_language`` for each language, by a hash of the id."""
    usable = documents.select("doc_id", "lang", "text").filter((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.withColumn("draw", draw)
    first = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("draw"))).alias("first")
    counts = drawn.groupBy("lang").agg(F.count("*").alias("count"), first).collect()  # one row a language
    each = float(min(per_language, max(SAMPLE / max(len(counts), 1), LEAST)))
    rows = [(r["lang"], each / r["count"], r["first"]) for r in counts]
    rates = documents.sparkSession.createDataFrame(rows, "rate_lang string, rate double, first double")
    # one row a language on the right; the first row with a letter is chosen in any case
    joined = drawn.join(F.broadcast(rates), F.col("lang") == F.col("rate_lang"))
    return joined.filter((F.col("draw") < F.col("rate")) | (F.col("draw") <= F.col("first"))).select("doc_id", "lang", "text")


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Models from the bounded sample; a fifth of it calibrates."""
    rows = sorted((r.lang, r.doc_id, r.text) for r in sample(documents, per_language).collect() if has_letter(r.text))
    if not rows:
        return None
    texts: dict[str, list[str]] = {}
    apart: list[tuple[str, str]] = []
    for k, (lang, _, text) in enumerate(rows):
        if lang in texts and k % 5 == 0:
            apart.append((text, lang))
        else:
            texts.setdefault(lang, []).append(text)
    model = Model(texts) if len(texts) <= LANGUAGES else Shards(texts, LANGUAGES)
    model.calibrate([t for t, _ in apart], [x for _, x in apart])
    return model


def identify(documents: DataFrame, model: Model | None, extra: str = "") -> DataFrame:
    """doc_id, lang_pred, score, rejected, cross_entropy of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cloudpickle.loads(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                texts = part.column(1).to_pylist()
                known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
                pred = ["und"] * len(texts)
                score, best = np.zeros(len(texts)), np.full(len(texts), np.nan)
                if known:
                    h = m.entropies([texts[i] for i in known])
                    first = h.argmin(axis=1)
                    sure = m.softmax(h, m.heat)[np.arange(len(first)), first]
                    for i, k, p, e in zip(known, first.tolist(), sure.tolist(), h.min(axis=1).tolist()):
                        pred[i], score[i], best[i] = m.langs[k], p, e
                rejected = [p == "und" or e > m.cutoff for p, e in zip(pred, best)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred), pa.array(score), pa.array(rejected, pa.bool_()), pa.array(best)],
                    ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, fit(documents))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go."""
    model = fit(docs)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cloudpickle.loads(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                texts = part.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
                keep = np.zeros(len(texts), bool)
                if known:
                    keep[known] = m.entropies([texts[i] for i in known]).min(axis=1) <= m.cutoff
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
