"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digit and symbol substitutions), an
Aho-Corasick automaton finds the lexicon's stems and words at word starts, matches
inside an exception phrase don't count, and the summed weights, alone and normalised
by the number of words, give a probability through a small logistic model. Stems that
other texts use now and then are dense entries: they count in a text where they are
repeated and make up ``DENSE`` of a hundred words.

The lexicon, its weights, the exception phrases and the two coefficients are learnt
from a bounded sample of labelled rows: about ``TOXIC`` toxic and ``CLEAN`` other
texts, chosen by a hash of the id. Every text is scored whole.

Defined cases
    * null and empty texts have no match and get the score of a text without one
    * a doc_id labelled more than once counts once, toxic if any of its labels is
    * no toxic label at all, or no other: every text gets the score 0
    * an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fold as id_fold
from tidemill.llm.common import table

NAME = "op8_toxicity"
SQL = None
#: Sampled labelled texts, on average.
TOXIC, CLEAN = 1500, 3000
#: Entries of the lexicon at most, those of the greatest weight.
ENTRIES = 2000
#: How much of the number of tried stems the evidence for one must outweigh.
CAUTION = 1.0
#: The lexicon has seen the clean texts of the sample, so they understate chance matches by about this factor.
OPTIMISM = 4.0
#: Occurrences in a hundred words from which a dense entry counts.
DENSE = 1.0
#: Letters of a stem at least and at most.
SHORTEST, LONGEST = 3, 12

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгеёзикмнорстухіјѕԁɡαβεικνορτυχωı", "abvreezukmhopctyxijsdgabeikvoptuxwi"))
#: Digits and symbols that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point to folded letter (0: not a letter), and to the letter it substitutes."""
    global _TABLES
    if _TABLES is None:
        letter, stands = np.zeros(0x3000, np.uint32), np.zeros(0x3000, np.uint32)
        for c in range(0x3000):
            ch = chr(c).lower()[:1]
            if ch.isalpha():
                base = unicodedata.normalize("NFKD", ch)[0]
                base = HOMOGLYPHS.get(base, base)
                letter[c] = ord(base) if base.isalpha() else ord(ch)
        for a, b in SUBSTITUTES.items():
            stands[ord(a)] = ord(b)
        _TABLES = letter, stands
    return _TABLES


def folded(text: str) -> str:
    """Lower-case folded words, each between spaces."""
    letter, stands = _tables()
    raw = np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(raw, len(letter) - 1)
    out = np.where(raw < len(letter), letter[low], raw)
    other = np.where(raw < len(letter), stands[low], 0)
    at = np.flatnonzero(other)
    if len(at):
        # a substitute counts where a letter follows, a digit also where one goes before
        digit = (raw[at] >= 48) & (raw[at] <= 57)
        near = (out[at + 1] != 0) | (digit & ((out[at - 1] != 0) | (other[at + 1] != 0) & (out[np.minimum(at + 2, len(out) - 1)] != 0)))
        out[at[near]] = other[at[near]]
    out[out == 0] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep].tobytes().decode("utf-32-le", "replace")


class Lexicon:
    """Patterns with weights, those of them that must be dense, exception phrases and the logistic model."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: tuple[float, float, float], dense: frozenset[str] = frozenset()):
        self.weights, self.exceptions, self.coefficients, self.dense = weights, exceptions, coefficients, dense
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                found.add_word(pattern, (len(pattern), weight, pattern if pattern in self.dense else None))
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), 0.0, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, text: str) -> tuple[float, int, int]:
        """Summed weight, number of matched words, number of words."""
        words = text.count(" ") - 1
        if not self.weights:
            return 0.0, 0, max(words, 0)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        repeated: dict[str, list[int]] = {}
        for end, (size, weight, dense) in self.automaton().iter(text):
            start = end - size + 1
            if dense:
                repeated.setdefault(dense, []).append(start)
            elif weight:
                best[start] = max(best.get(start, 0.0), weight)
            else:
                spared.append((start, end))
        for pattern, starts in repeated.items():
            if is_dense(len(starts), words):
                for start in starts:
                    best[start] = max(best.get(start, 0.0), self.weights[pattern])
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        return sum(best.values()), len(best), max(words, 0)

    def score(self, text: str | None) -> tuple[float, int, int]:
        total, n, words = self.hits(folded(text or ""))
        if not self.weights:
            return 0.0, n, words
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * math.log1p(100 * total / max(words, 1)))))), n, words


def is_dense(n: int, words: int) -> bool:
    return n > 1 and 100 * n >= DENSE * words


def _dense_keys(words: list[str]) -> set[str]:
    """Stems and whole words that are dense in a text."""
    held = {w: n for w, n in Counter(words).items() if len(w) >= SHORTEST}
    out = {f" {w} " for w, n in held.items() if is_dense(n, len(words))}
    for size in range(SHORTEST, LONGEST + 1):  # a longer stem is no denser
        counted: Counter[str] = Counter()
        for w, n in held.items():
            counted[w[:size]] += n
        held = {w: n for w, n in held.items() if len(w) > size and is_dense(counted[w[:size]], len(words))}
        out.update(f" {k}" for k, n in counted.items() if is_dense(n, len(words)))
    return out


def _keys(words: set[str]) -> set[str]:
    """Stems and whole words, with the space that starts them (and ends a whole word)."""
    out = {f" {w} " for w in words if len(w) >= SHORTEST}
    for w in words:
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def learn(toxic: list[str], clean: list[str], clean_weight: float = 1.0) -> Lexicon:
    """Lexicon from folded texts; ``clean_weight`` is how many clean texts each one stands for."""
    if not toxic or not clean:
        return Lexicon({}, [], (0.0, 0.0, 0.0))
    least = max(2, round(0.002 * len(toxic)))
    chosen = _choose(*_counted(toxic, clean, lambda words: _keys(set(words)), least), len(toxic), len(clean), toxic)
    dense = _choose(*_counted(toxic, clean, _dense_keys, least), len(toxic), len(clean), toxic)
    dense = {k: w for k, w in dense.items() if not any(k[:n] in chosen for n in range(SHORTEST + 1, len(k) + 1))}
    chosen = dict(sorted((chosen | dense).items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])
    dense = frozenset(dense)
    bare = Lexicon(chosen, [], (0.0, 1.0, 0.0), dense)
    exceptions = _exceptions(bare, toxic, clean)
    lexicon = Lexicon(chosen, exceptions, (0.0, 1.0, 0.0), dense)
    rows = [(*lexicon.hits(t), 1.0, 1.0) for t in toxic] + [(*lexicon.hits(t), 0.0, clean_weight) for t in clean]
    lexicon.coefficients = _logistic(rows)
    return lexicon


def _counted(toxic: list[str], clean: list[str], keys: Callable[[list[str]], set[str]], least: int) -> tuple[Counter[str], Counter[str]]:
    """Number of toxic and of clean texts a key; those of fewer toxic ones are left out."""
    a: Counter[str] = Counter()
    for text in toxic:
        a.update(keys(text.split()))
    a = Counter({k: n for k, n in a.items() if n >= least})
    b: Counter[str] = Counter()
    for text in clean:
        b.update(k for k in keys(text.split()) if k in a)
    return a, b


def _choose(a: Counter[str], b: Counter[str], n_toxic: int, n_clean: int, toxic: list[str]) -> dict[str, float]:
    """Entries that tell toxic texts from others, and their weights."""
    weight = {k: math.log((n + 0.5) / (n_toxic + 1)) - math.log((b[k] + 0.5) / (n_clean + 1)) for k, n in a.items()}
    share = n_toxic / (n_toxic + n_clean)

    def sure(k: str, found: int | None = None) -> bool:
        """Chernoff bound: no stem of chance is as lopsided, over all the stems that are tried."""
        found = a[k] if found is None else found
        n, p = found + b[k], found / max(found + b[k], 1)
        if p <= share:
            return False
        gain = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
        return n * gain >= CAUTION * math.log(len(a))

    children: dict[str, list[str]] = {}
    for k in a:
        stem = k[:-1] if k.endswith(" ") else k
        children.setdefault(stem if k.endswith(" ") else k[:-1], []).append(k)
    chosen: dict[str, float] = {}
    for k in sorted(a, key=lambda x: (len(x), x)):
        if k.endswith(" ") or any(k.startswith(c) for c in (k[:n] for n in range(SHORTEST + 1, len(k) + 1)) if c in chosen):
            continue
        while True:  # as long as a longer stem keeps the toxic texts
            longer = [c for c in children.get(k, []) if a[c] >= 0.95 * a[k] and b[c] <= b[k] or a[c] >= 0.9 * a[k] and b[c] < b[k]]
            if not longer:
                break
            k = max(longer, key=lambda c: (weight[c], c))
        rate = (a[k] / n_toxic) / (a[k] / n_toxic + b[k] / max(n_clean, 1))
        if weight[k] >= 2.5 and rate >= 0.97 and sure(k):
            chosen[k] = weight[k]
    for k in sorted(a):  # whole words of which the stem did not qualify
        if k.endswith(" ") and weight[k] >= 3.5 and b[k] * 200 <= n_clean and sure(k) and not any(k[:n] in chosen for n in range(SHORTEST + 1, len(k) + 1)):
            chosen[k] = weight[k]
    contexts = _contexts(chosen, toxic)
    return {k: w for k, w in chosen.items() if sure(k, min(a[k], contexts.get(k, 0)))}


def _contexts(chosen: dict[str, float], toxic: list[str], width: int = 12) -> dict[str, int]:
    """Different surroundings of each entry: copies of a text don't make its rare words telling."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    for k in chosen:
        finder.add_word(k, k)
    finder.make_automaton()
    seen: dict[str, set[tuple[str, str]]] = {}
    for text in toxic if chosen else ():
        for end, k in finder.iter(text):
            start = end - len(k) + 1
            seen.setdefault(k, set()).add((text[max(0, start - width) : start], text[end + 1 : end + 1 + width]))
    return {k: len(v) for k, v in seen.items()}


def _exceptions(lexicon: Lexicon, toxic: list[str], clean: list[str]) -> list[str]:
    """Two-word phrases around a match that clean texts have and toxic ones do not."""

    def phrases(text: str) -> set[str]:
        if not lexicon.hits(text)[1]:
            return set()
        out, words = set(), text.split()
        for i, w in enumerate(words):
            if lexicon.hits(f" {w} ")[1]:
                if i:
                    out.add(f" {words[i - 1]} {w} ")
                if i + 1 < len(words):
                    out.add(f" {w} {words[i + 1]} ")
        return out

    good, bad = Counter(), set()
    for text in clean:
        good.update(phrases(text))
    if good:
        for text in toxic:
            bad |= phrases(text)
    return sorted(p for p, n in good.items() if n >= 2 and p not in bad)  # bounded by the sample of clean texts


def _logistic(rows: list[tuple[float, int, int, float, float]], ridge: float = 0.05) -> tuple[float, float, float]:
    """Weighted ridge logistic regression by Newton steps."""
    total, words = np.array([r[0] for r in rows]), np.array([max(r[2], 1) for r in rows])
    x = np.column_stack([np.ones(len(rows)), np.log1p(total), np.log1p(100 * total / words)])
    y, w = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(hessian, x.T @ (w * (y - p)) - ridge * beta), -3, 3)
    return tuple(float(v) for v in beta)


def fit(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon from the bounded sample of labelled training rows."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_fold() != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    rate = F.when(F.col("toxic") == 1, TOXIC / max(totals.get(1, 0), 1)).otherwise(CLEAN / max(totals.get(0, 0), 1))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(draw < rate).select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label_toxic"))
    # about TOXIC + CLEAN ids on the right
    rows = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label_toxic", "text").collect()
    )
    rows = sorted((r["doc_id"], r["label_toxic"], folded(r["text"] or "")) for r in rows)
    toxic, clean = [t for _, y, t in rows if y == 1], [t for _, y, t in rows if y != 1]
    return learn(toxic, clean, max(OPTIMISM, (totals.get(0, 0) / max(len(clean), 1)) / max(totals.get(1, 0) / max(len(toxic), 1), 1e-9)))


def toxicity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits, n_words of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(lexicon))  # at most ENTRIES strings, and phrases of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = cloudpickle.loads(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                scores, hits, words = zip(*map(lex.score, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(words, pa.int64())],
                    ["doc_id", "score", "n_hits", "n_words"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double, n_hits long, n_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(id_fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits"
    )
