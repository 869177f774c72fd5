"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on toxic and one on ordinary: of all word starts and words the
segments that are most distinctive of their class, each after a common lead; the ordinary one also holds the usual starts of
the toxic one's segments, so that a word which merely begins like one gains nothing. A window of a text (a word, after the lead) is
compressed with both; how many bytes shorter it is with the toxic dictionary is its gain. Two further dictionaries hold phrases
of words that are distinctive only together, and windows of several words, which overlap, have gains of their own. A text's gains, calibrated by a
logistic curve on labelled texts that the dictionaries compared with were not trained on, give its score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_remainder, slices

#: Bounds of what is fitted on: labelled rows of each class, dealt by a hash of doc_id; a row's text is then taken if no longer
#: than LONGEST code points.
TOXIC_ROWS, ORDINARY_ROWS, LONGEST = 1200, 2400, 20_000
#: Bytes of a dictionary's segments; shortest and longest word start in characters, with the space before it.
SIZE, STARTS = 3000, range(2, 9)
#: Shortest start that may be distinctive; how much rarer a usual start may be in the other class.
SHORTEST, RARER = 4, 10
THRESHOLD = 0.3
#: The share of the labelled rows that is never learnt from: crc32(doc_id) mod 4 is 2.
MOD, HELD_OUT = 4, 2
#: Words of a phrase; words of a window for phrases, and how far the next one is: each phrase lies whole in a window.
PHRASES, WIDE, WIDE_STEP = range(2, 5), 6, 3
LEAD = bytes((i * 37 + 11) % 250 + 1 for i in range(16))
WINDOW, STEP = 64, 48
MEMO = 400_000


def windows(text: str) -> list[str]:
    """The words in lower case; a longer one than WINDOW characters in overlapping windows."""
    words = text.lower().split()
    if any(len(w) > WINDOW for w in words):
        words = [w[i : i + WINDOW] for w in words for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)]
    return words


def segment_counts(texts: list[str]) -> tuple[Counter, int]:
    """How often each segment occurs, and the number of words; a word that comes again between the same neighbours isn't
    counted again, so that copies of a passage have no weight."""
    seen, counts, n = set(), Counter(), 0
    for text in texts:
        words = windows(text)
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            key = hash((before, w, after))
            if key in seen:
                continue
            seen.add(key)
            n += 1
            whole = f" {w} "
            counts.update([whole, *(whole[:k] for k in STARTS if k < len(whole))])
    return counts, n


def distinctive(own: Counter, n: int, other: Counter, m: int, size: int = SIZE) -> list[str]:
    """Segments whose share in their own class is beyond chance (Chernoff's bound, for all segments together), most telling
    first, none of which holds another."""
    share, least = n / max(1, n + m), math.log(len(own) + 1) + 1
    scored = []
    for s, v in own.items():
        if len(s) < SHORTEST:
            continue
        p = v / (v + other[s])
        if p > share and p > 0.5 and (told := (v + other[s]) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))) > least:
            scored.append((round(told, 1), len(s), s))
    out, used = [], 0
    for _, _, s in sorted(scored, reverse=True):
        if used + len(s.encode()) > size:
            break
        if not any(x.strip() in s or s in x for x in out):
            out.append(s)
            used += len(s.encode())
    return out


def usual_starts(segments: list[str], own: Counter, n: int, other: Counter, m: int) -> list[str]:
    """Of each segment of the one class the longest start that the other class uses too, no more than RARER times as rarely."""
    found = []
    for s in segments:
        usual = [s[:k] for k in STARTS if k < len(s) and other[s[:k]] * n * RARER >= own[s[:k]] * m]
        found += usual[-1:]
    return list(dict.fromkeys(found))


def wide_windows(text: str) -> list[str]:
    """Windows of WIDE words in lower case, WIDE_STEP apart, over the whole text."""
    words = text.lower().split()
    return [" ".join(words[i : i + WIDE]) for i in range(0, max(1, len(words) - WIDE + WIDE_STEP), WIDE_STEP)] if words else []


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Phrases:
    """How often each phrase of some texts occurs, by hash; as in segment_counts(), not again between the same neighbours."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        self.words = [t.lower().split() for t in texts]
        self.hashes = []
        for words in self.words:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            self.hashes.append(np.array([known[w] for w in words], np.uint64))
        self.counts, self.total = {}, 0
        for n in [1, *PHRASES]:
            grams, around = [], []
            for h in self.hashes:
                own = _grams(h, n)
                grams.append(own)
                around.append(_grams(np.concatenate([[np.uint64(1)], h, [np.uint64(2)]]).astype(np.uint64), n + 2)[: len(own)])
            grams, around = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (grams, around))
            grams = grams[np.unique(around, return_index=True)[1]]
            self.counts[n] = np.unique(grams, return_counts=True)
            self.total += len(grams) if n > 1 else 0

    def of(self, n: int, grams: np.ndarray) -> np.ndarray:
        keys, counts = self.counts[n]
        if not len(keys):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return np.where(keys[at] == grams, counts[at], 0)

    def count(self, words: list[str]) -> int:
        return int(self.of(len(words), _grams(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), len(words)))[0])

    def distinctive(self, other: Phrases, segments: list[str]) -> list[str]:
        """Phrases whose share here is beyond chance, by the bound of distinctive(), most telling first; none holds another or
        one of ``segments``, which are distinctive alone."""
        share = self.total / max(1, self.total + other.total)
        least = math.log(sum(len(self.counts[n][0]) for n in PHRASES) + 1) + 1
        scored = {}
        for n in PHRASES:
            keys, v = self.counts[n]
            both = v + other.of(n, keys)
            p = v / both
            with np.errstate(divide="ignore", invalid="ignore"):
                told = both * (p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0))
            chosen = (p > share) & (p > 0.5) & (told > least)
            keys, told = keys[chosen], told[chosen]
            for words, h in zip(self.words, self.hashes) if len(keys) else ():
                grams = _grams(h, n)
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                for i in np.flatnonzero(keys[at] == grams):
                    scored[f" {' '.join(words[i : i + n])} "] = round(float(told[at[i]]), 1), n
        alone, out = [x if x.endswith(" ") else x.rstrip() for x in segments], []
        for s in sorted(scored, key=lambda s: (scored[s], s), reverse=True):
            if not any(x in s for x in alone) and not any(x in s or s in x for x in out):
                out.append(s)
        return out


def usual_parts(phrases: list[str], own: Phrases, other: Phrases) -> list[str]:
    """Of each phrase of the one class its words, and its shorter phrases that the other class uses too, no more than RARER times as rarely."""
    found = []
    for s in phrases:
        words = s.split()
        for n in range(1, len(words)):
            for part in (words[i : i + n] for i in range(len(words) - n + 1)):
                if n == 1 or other.count(part) * own.total * RARER >= own.count(part) * other.total:
                    found.append(f" {' '.join(part)} ")
    return list(dict.fromkeys(found))


class Gains:
    """Gains of windows, those of frequent words kept."""

    def __init__(self, toxic: list[str], ordinary: list[str], phrases: tuple[list[str], list[str]] = ([], [])):
        self.toxic, self.ordinary, self.memo = self._compressor(toxic), self._compressor(ordinary), {}
        # without toxic phrases no window is shorter with their dictionary
        self.wide = tuple(map(self._compressor, phrases)) if phrases[0] else None

    @staticmethod
    def _compressor(segments: list[str]) -> zstandard.ZstdCompressor:
        content = b"".join(LEAD + s.encode() for s in segments) + LEAD
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(window_log=max(17, len(content).bit_length()), hash_log=14, chain_log=14, search_log=9, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
        dictionary.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)

    def _gain(self, window: str) -> int:
        data = LEAD + f" {window} ".encode()
        return len(self.ordinary.compress(data)) - len(self.toxic.compress(data))

    def _of_phrases(self, text: str) -> list[int]:
        """The largest gain of a window of several words, and the sum of the three largest."""
        if not self.wide:
            return [0, 0]
        toxic, ordinary = self.wide
        data = [LEAD + f" {w} ".encode() for w in wide_windows(text)]
        gains = sorted(len(ordinary.compress(d)) - len(toxic.compress(d)) for d in data)[-3:]
        return [max(0, gains[-1]), sum(max(0, g) for g in gains)]

    def __call__(self, text: str) -> np.ndarray:
        """The features of a text: the largest gain, the sum of the three largest, the logarithm of the number of windows; the
        first two again for windows of several words."""
        words = windows(text)
        if not words:
            return np.zeros(5)
        gains = list(map(self.memo.get, words))
        if None in gains:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for i, g in enumerate(gains):
                if g is None:
                    gains[i] = self.memo[words[i]] = self._gain(words[i])
        gains = np.array(gains, np.int16)
        top = np.sort(np.partition(gains, -3)[-3:]) if len(gains) > 3 else np.sort(gains)
        return np.array([top[-1], top.sum(), math.log1p(len(gains)), *self._of_phrases(text)], float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the columns of x and a constant, by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - keep @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """What fit() returns: the segments of both dictionaries, the phrases of both and the curve's weights."""

    def __init__(self, toxic: list[str], ordinary: list[str], phrases: tuple[list[str], list[str]], beta: np.ndarray):
        self.toxic, self.ordinary, self.phrases, self.beta = toxic, ordinary, phrases, beta

    def scorer(self):
        gains, beta = Gains(self.toxic, self.ordinary, self.phrases), self.beta
        return lambda text: float(1 / (1 + np.exp(-np.clip(gains(text) @ beta[:-1] + beta[-1], -30, 30))))


def fit(rows: list[tuple[str, int]], toxic_share: float, folds: int = 3) -> Model:
    """Fits on (text, label) rows in the order given; ``toxic_share``: that of label 1 among the rows to be scored."""
    rows = list(dict.fromkeys(rows))
    y = np.array([label for _, label in rows], float)
    if len(rows) < 2 or y.min() == y.max():
        always = math.log((toxic_share + 1e-3) / (1 - toxic_share + 1e-3))
        return Model([], [], ([], []), np.array([0.0] * 5 + [always]))

    def segments(kept: list[tuple[str, int]]) -> tuple[list[str], list[str], tuple[list[str], list[str]]]:
        (a, n), (b, m) = (segment_counts([t for t, label in kept if label == k]) for k in (1, 0))
        toxic = distinctive(a, n, b, m)
        ordinary = distinctive(b, m, a, n)
        bad, good = (Phrases([t for t, label in kept if label == k]) for k in (1, 0))
        phrases = bad.distinctive(good, toxic)
        usual = good.distinctive(bad, ordinary) + usual_parts(phrases, bad, good) if phrases else []
        return toxic, ordinary + usual_starts(toxic, a, n, b, m), (phrases, usual)

    x = np.zeros((len(rows), 5))
    order = np.arange(len(rows)) % folds
    for k in range(folds):
        gains = Gains(*segments([r for r, o in zip(rows, order) if o != k]))
        for i in np.flatnonzero(order == k):
            x[i] = gains(rows[i][0])
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    return Model(*segments(rows), logistic(x, y, weight))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float]:
    """A bounded sample of labelled rows that may be learnt from, and the share of label 1 among all such rows."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), MOD) != HELD_OUT))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    dealt = F.xxhash64("doc_id")
    some = [marks.where(F.col("toxic") == k).orderBy(dealt, "doc_id").limit(most) for k, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    chosen = some[0].unionByName(some[1]).dropDuplicates(["doc_id"])  # at most TOXIC_ROWS + ORDINARY_ROWS rows
    texts = id_and_text(docs).where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = texts.orderBy(dealt, "doc_id", "text").limit(TOXIC_ROWS + ORDINARY_ROWS).collect()
    return [(r["text"], r["toxic"]) for r in rows], n.get(1, 0) / max(1, sum(n.values()))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score of its text (null: as empty) as a further column; other columns stay as they are."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in texts:  # a few texts at a time as Python strings
            yield pa.array([of(t or "") for i in range(0, len(batch), 64) for t in batch.slice(i, 64).to_pylist()], pa.float64())

    return docs.withColumn(column, F.arrow_udf(run, "double")(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (never learnt from), score, predicted (1 if the score is at least THRESHOLD) of each row of docs.

    Scores come from whole texts alone. A null text counts as empty; empty texts have the score of a text without windows; a
    null doc_id stays null and is held out if crc32 of the empty text says so; rows that repeat a doc_id are scored each.
    Labels other than 0 and 1 are not used; without labels of both classes all texts have one score. Empty tables give an
    empty result; other columns of docs are not read.
    """
    model = fit(*labelled_sample(docs, labels))
    scored = score(id_and_text(docs), model)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs whose score is under the threshold, with the columns of docs."""
    model = fit(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return score(rows, model, "toxic score").where(F.col("`toxic score`") < THRESHOLD).select("row.*")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE: dict[str, str] = {}
