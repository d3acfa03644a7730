"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled texts: words that stand in toxic documents far more often than in others,
counted by the different words before them.
Features are rates of its words, their nearness to second-person words, capitals, punctuation and spelling
tricks.  Trees and calibration are fitted on a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.frames import pick

FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 20_000
LEXICON_WORDS = 512
LEAST_TOXIC = 5
LEAST_SHARE = 0.8
THRESHOLD = 0.7
NEAR = 5
# Second-person words, and look-alikes of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen euch ihr tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros os".split())
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
EDGES = "\"'()[]{}<>.,;:!?*%&#$-_|/\\~`^+=@"
FEATURES = ("density", "hits", "distinct", "near_person", "person", "capitals", "shouting", "exclamations", "punctuation", "repeats", "obfuscated", "short")


def held_out(doc_id) -> F.Column:
    """Whether a document's label may not be learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def features(text: str | None, lexicon: frozenset[str]) -> list[float]:
    """The values of ``FEATURES`` for a whole text; null counts as empty, and an empty text is all zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.split()
    words = [w.strip(EDGES) for w in text.lower().split()]
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    tricked = [i for i, w in enumerate(words) if not w.isalpha() and w and w not in lexicon and re.sub(r"[^\w]", "", w.translate(LOOKALIKES)) in lexicon]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and persons:
        p, h = np.array(persons), np.array(hits)
        at = np.searchsorted(p, h)
        gap = np.minimum(np.abs(h - p[np.maximum(at - 1, 0)]), np.abs(p[np.minimum(at, len(p) - 1)] - h))
        near = int((gap <= NEAR).sum())
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    repeated = int((data[1:] == data[:-1]).sum()) if len(data) > 1 else 0
    return [
        len(hits) / n,
        float(len(hits)),
        float(len({words[i] for i in hits})),
        near / n,
        len(persons) / n,
        int(counts[65:91].sum()) / letters,
        shouted / n,
        int(counts[33]) / n,
        marks / len(data),
        repeated / len(data),
        len(tricked) / n,
        1.0 / n,
    ]


@dataclass
class Trees:
    """Boosted trees of logistic loss: per tree, arrays of split feature, threshold and leaf values (complete trees)."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.15
    bins: int = 32
    leaf_weight: float = 2.0
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        cuts = [self._cuts(c) for c in x.T]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        """Thresholds of one feature: quantiles, and two above the smallest value, which most rows may share."""
        cuts = np.quantile(values, np.linspace(0, 1, self.bins + 1)[1:-1])
        above = values[values > values.min()]
        return np.unique(np.r_[cuts, (above.min() + values.min()) / 2, above.mean()] if len(above) else cuts)

    def _grow(self, binned, cuts, g, h):
        inner, width = 2**self.depth - 1, max(len(c) for c in cuts) + 1
        split, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for at in range(inner):
            rows = node == at
            gain, choice = 1e-6, None
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, j], g[rows], width))[: len(c)]
                hs = np.cumsum(np.bincount(binned[rows, j], h[rows], width))[: len(c)]
                score = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                score[(hs < self.leaf_weight) | (total_h - hs < self.leaf_weight)] = 0
                if score.max() > gain:
                    gain, choice = score.max(), (j, c[score.argmax()])
            if choice:
                split[at], limit[at] = choice
            right = rows.copy()
            right[rows] = binned[rows, split[at]] > (np.searchsorted(cuts[split[at]], limit[at], "left") if choice else width)
            node[rows] = 2 * at + 1
            node[right] = 2 * at + 2
        leaves = node - inner
        values = -np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + 1) * self.rate
        return split, limit, values

    def _apply(self, tree, x):
        split, limit, values = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > limit[node])
        return values[node - len(split)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step means of y over x, by pooling neighbours that are out of order."""
    values, at = np.unique(x, return_inverse=True)
    weights = np.bincount(at)
    levels: list[list[float]] = []  # mean, weight, first x, last x
    for value, mean, weight in zip(values, np.bincount(at, y) / weights, weights):
        levels.append([float(mean), float(weight), float(value), float(value)])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            m, w, _, last = levels.pop()
            k = levels[-1]
            k[0], k[1], k[3] = (k[0] * k[1] + m * w) / (k[1] + w), k[1] + w, last
    xs = np.array([v for k in levels for v in (k[2], k[3])])
    return xs, np.array([k[0] for k in levels for _ in range(2)])


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.raw(x), *self.steps), 0, 1)


def fit(lexicon: frozenset[str], x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Model:
    """Trees on the rows outside ``calibrate``, steps on those inside; labels of one kind only give a constant."""
    prior = float(y.mean()) if len(y) else 0.0
    parts = (y[~calibrate], y[calibrate])
    if any(len(np.unique(p)) < 2 for p in parts):
        return Model(lexicon, None, None, prior)
    trees = Trees().fit(x[~calibrate], y[~calibrate])
    return Model(lexicon, trees, isotonic(trees.raw(x[calibrate]), y[calibrate]), prior)


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` labelled texts that may be learned from: those whose doc_id hashes lowest."""
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about `rows` small rows by the threshold above: a proven bound
    return pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon, trees and calibration from a sample of ``rows`` labelled documents."""
    sample = _training_rows(docs, labels, rows)
    pairs = F.expr("explode(array_distinct(transform(words, (w, i) -> struct(w AS word, IF(i = 0, '', words[i - 1]) AS before))))")
    pairs = sample.withColumn("words", F.split(F.lower("text"), r"[^\p{L}\p{N}']+")).select("toxic", pairs.alias("p")).where(F.length("p.word") > 2)
    # copies of a text repeat its word pairs, so a word counts once for each word that stands before it, and as
    # toxic if all texts with the pair are
    counts = pairs.groupBy("p.word", "p.before").agg(F.min("toxic").alias("bad")).groupBy("word").agg(F.sum("bad").alias("bad"), F.count("*").alias("all"))
    share = F.col("bad") / F.col("all")
    top = counts.where((F.col("bad") >= LEAST_TOXIC) & (share >= LEAST_SHARE)).orderBy(F.desc("bad"), "word").limit(LEXICON_WORDS).collect()
    lexicon = frozenset(r["word"] for r in top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    found = sorted((r["doc_id"], r["x"], r["toxic"]) for r in sample.mapInArrow(run, "doc_id long, toxic int, x array<double>").distinct().collect())
    x = np.array([f for _, f, _ in found], float).reshape(-1, len(FEATURES))
    y = np.array([t for *_, t in found], float)
    calibrate = np.array([i % 3 == 2 for i in range(len(found))], bool)
    return fit(lexicon, x, y, calibrate)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of a text without any sign."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([features(t, shared.value.lexicon) for t in part["text"].to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_documents(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
