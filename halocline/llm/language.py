"""Language identification by cross-parsing entropy.

Per language, a suffix automaton is built of a bounded sample of labelled text.  A text is parsed by each of
them into longest matches: from a position as far as some stretch of the sample goes on, then anew.  The
language that needs the fewest phrases per character knows the text best.

For speed the automata are tables of a small alphabet whose missing transitions already lead on from the root and
carry a mark for the phrase that ended, and many stretches of texts are parsed in step.  Every language has an alphabet of its own, of its
most frequent letters; a letter that its sample lacks is a phrase by itself, whatever the script.  The sample of all languages together is bounded, so
there may be any number of them: more languages get less of it each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.frames import pick
from halocline.operators.keys import lookup_join
from halocline.storage import materialise

FOLDS, HELD_OUT = 5, 0
ROWS_PER_LANGUAGE = 32
CHARS_PER_ROW = 800
CHARS_IN_ALL = 512 * CHARS_PER_ROW  # of the samples of all languages
LETTERS = 60  # of one language that are told apart; its rarer ones are one class
STRETCH = 256
LANES = 16384
UNKNOWN = "und"
# classes 0 to 2 of all letters and of a language's alphabet; letters follow, in an alphabet after one for its rare letters
PADDING, GAP, OTHER, RARE = 0, 1, 2, 3


def held_out(doc_id) -> F.Column:
    """Whether a document may not be learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def suffix_automaton(codes: list[int], alphabet: int) -> tuple[list[list[int]], list[int]]:
    """Transitions (-1: none) and suffix links of the automaton of all stretches of ``codes``."""
    nexts, links, lengths, last = [[-1] * alphabet], [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append([-1] * alphabet)
        links.append(0)
        lengths.append(lengths[last] + 1)
        at = last
        while at >= 0 and nexts[at][c] < 0:
            nexts[at][c] = new
            at = links[at]
        if at >= 0:
            target = nexts[at][c]
            if lengths[target] == lengths[at] + 1:
                links[new] = target
            else:
                copy = len(nexts)
                nexts.append(nexts[target][:])
                links.append(links[target])
                lengths.append(lengths[at] + 1)
                while at >= 0 and nexts[at][c] == target:
                    nexts[at][c] = copy
                    at = links[at]
                links[target] = links[new] = copy
        last = new
    return nexts, links


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # class of each code point: a number for each letter of any sample
    own: np.ndarray  # per language: its own class of each of these
    alphabet: int
    table: np.ndarray  # per state and class: 4 * (start of the next state's row) + phrases that end (2 with a letter the sample lacks)
    roots: np.ndarray  # start of the root's row, per language


def encode(text: str, classes: np.ndarray) -> np.ndarray:
    """Classes of a text's characters, lower-cased; letters only count, what stands between them is one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = classes[np.minimum(points, len(classes) - 1)]
    gap = codes == GAP
    keep = ~gap
    keep[:-1] |= gap[:-1] & ~gap[1:]
    return codes[keep]


def _letter_classes(counts: list[Counter[str]]) -> tuple[np.ndarray, np.ndarray]:
    """A class for each letter of any sample and one for all others; and of these the classes in each language's alphabet."""
    letters = sorted(set().union(*counts))
    classes = np.full(0x110001, GAP, np.uint8 if len(letters) < 250 else np.uint32)
    for point in range(0x110000):
        if chr(point).isalpha():
            classes[point] = OTHER
    for i, c in enumerate(letters):
        classes[ord(c)] = OTHER + 1 + i
    own = np.full((len(counts), OTHER + 1 + len(letters)), OTHER, np.uint8)
    own[:, PADDING], own[:, GAP] = PADDING, GAP
    for row, count in zip(own, counts):
        for i, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))):
            row[classes[ord(c)]] = RARE + 1 + i if i < LETTERS else RARE
    return classes, own


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of the given texts by language."""
    languages = sorted(samples)
    classes, own = _letter_classes([Counter(c for t in samples[x] for c in t.lower() if c.isalpha()) for x in languages])
    alphabet = int(own.max(initial=OTHER)) + 1
    tables, roots, base = [], [], 0
    for language, mine in zip(languages, own):
        codes = mine[np.concatenate([np.append(encode(t, classes), GAP) for t in samples[language]] or [np.zeros(0, np.uint8)])]
        nexts, _ = suffix_automaton(codes.tolist(), alphabet)
        goto = np.array(nexts, np.int64)
        root = np.maximum(goto[0], 0)
        missing = goto < 0
        unknown = missing[0].copy()
        goto = np.where(missing, root, goto)
        goto[:, PADDING] = 0
        mark = missing.astype(np.int64)
        # a class that no stretch begins with is a phrase of its own, besides the one it ends
        mark[1:, unknown] += 1
        mark[:, PADDING] = 1
        mark[0, PADDING] = 0
        tables.append(((base + goto * alphabet) * 4 + mark).astype(np.int32).ravel())
        roots.append(base)
        base += goto.size
    return Model(languages, classes, own, alphabet, np.concatenate(tables or [np.zeros(0, np.int32)]), np.array(roots, np.int32))


def phrases(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Phrases each language needs for each text; texts are parsed in stretches of fixed length."""
    lengths = np.array([len(c) for c in codes], np.int64)
    stretches = -(-lengths // STRETCH)
    first = np.concatenate([[0], np.cumsum(stretches)])
    grid = np.full((int(first[-1]), STRETCH), PADDING, model.classes.dtype)
    flat = grid.reshape(-1)
    for at, c in zip(first * STRETCH, codes):
        flat[at : at + len(c)] = c
    counts = np.zeros((len(model.languages), len(grid)), np.int32)
    for low in range(0, len(grid), LANES):
        lanes = np.ascontiguousarray(grid[low : low + LANES].T)
        state = np.repeat((model.roots * 4)[:, None], lanes.shape[1], 1)
        total = np.zeros_like(state)
        for column in lanes:
            state = model.table[(state >> 2) + model.own[:, column]]
            total += state & 3
        # the phrase a stretch ends in counts too
        total += (state >> 2) != model.roots[:, None]
        counts[:, low : low + LANES] = total
    upto = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
    return (upto[:, first[1:]] - upto[:, first[:-1]]).T


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is 1 - best / second-best phrases, at least 0.

    Ties go to the language first by name.  A null text, one without letters, or a model of no
    languages gives ``und`` and score 0; with one language only, the score is 1.
    """
    codes = [encode(t or "", model.classes) for t in texts]
    known = np.array([bool((c > GAP).any()) for c in codes], bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    counts = phrases(model, codes)
    best = counts.argmin(axis=1)
    ranked = np.sort(counts, axis=1)
    second = ranked[:, 1] if ranked.shape[1] > 1 else np.full(len(counts), np.inf)
    score = np.where(known, 1 - ranked[:, 0] / np.maximum(second, 1), 0.0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.clip(score, 0, 1)


def learn(docs: DataFrame) -> Model:
    """Fit on a bounded sample: of each language at most ``ROWS_PER_LANGUAGE`` stretches of ``CHARS_PER_ROW`` characters, ``CHARS_IN_ALL`` together.

    The rows are those with the smallest hash, equal rows once; a threshold from the counts keeps what reaches the driver near that
    many.  A stretch begins anywhere in its text, as the hash has it.  With so many languages that one row each is too
    much, the stretches are shorter.
    """
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sizes.count()
    if not languages:
        return fit({})
    wanted = max(1, min(ROWS_PER_LANGUAGE, CHARS_IN_ALL // CHARS_PER_ROW // languages))
    chars = max(1, min(CHARS_PER_ROW, CHARS_IN_ALL // (wanted * languages)))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64(F.lit(41), "doc_id", "text"), F.lit(1 << 30)))
    rows = lookup_join(rows, sizes, ["lang"], null_safe=False)
    drawn = rows.where(F.col("hash") * F.col("n") < F.lit(4 * (wanted + 4)).cast("double") * (1 << 30))
    begin = F.pmod(F.xxhash64(F.lit(43), "doc_id", "text"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    drawn = drawn.select("lang", "hash", F.substring("text", begin, F.lit(chars)).alias("text")).distinct()
    samples: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["hash"], r["text"])):
        if len(samples.setdefault(r["lang"], [])) < wanted:
            samples[r["lang"]].append(r["text"])
    return fit(samples)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` for every whole text; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("lang_pred", "score")]
    names = [docs.columns[i] for i in kept]
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in kept])
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                languages, scores = predict(shared.value, part[text].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*names, "lang_pred", "score")


def language_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    found = identify(pick(docs, "doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
