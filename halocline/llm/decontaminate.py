"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

Test items are indexed by BM25 impacts, each divided by the score its item asks for, so a passage retrieves an
item at 1.  Items stand in blocks; a term has a list of the blocks it occurs in, with its largest impact there, and each entry has
its postings.  Every passage of every document is a query.  Its terms stand in ascending order of their largest impact, and the first at
which the running sum reaches 1 is the pivot: an item with none of the terms from the pivot on can't be retrieved, so only the blocks in the
lists of these terms are looked at, and all others are skipped.  Such a block is dropped when the block maxima of all but the least terms and the most that
these could add stay below 1, then when the block maxima of all terms do; what is left is scored from its postings.  Nothing else is dropped, so
the result is that of scoring every item.

An item asks for a share of its score against itself, or for the score of the lightest run of its words that would count as a leak, if that is less:
a passage with such a run, wherever it is cut from the item, retrieves it.  Retrieved items are verified by the overlap of word n-grams with the item's question and with its answer, or with half of the item, or
by one run of words that makes up most of half the item, wherever it is cut.

Document frequencies, lengths and the length of a passage come from all items, whatever the number of partitions of
the index.  Partitions are files in the shared folder; a task holds one of them at a time, or all if they are small, and documents are read once.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.frames import pick
from halocline.llm.warc import _open
from halocline.storage import materialise, scratch_path

K1, B = 1.2, 0.75
RETRIEVE = 0.3  # share of an item's score against itself, at most; less where a run that is a leak scores less
GRAM = 5
QUESTION_OVERLAP = ANSWER_OVERLAP = 0.25
WHOLE_OVERLAP = 0.5  # share of all n-grams of an item that counts wherever they are
RUN_OVERLAP = 0.45  # share of an item's words that counts in one run
ANSWER_WORDS = 5
ITEMS_PER_BLOCK = 2  # small blocks have tight maxima, and more entries in the lists
WORDS_PER_PART = 1 << 21  # words of the items in one partition of the index
LEAST_PASSAGE = 64
# what a worker holds of texts and of entries at a time, whatever the lengths of texts and lists
CHARS_AT_ONCE = 1 << 19
ENTRIES_AT_ONCE = 1 << 19
HELD_BYTES = 256 << 20  # of index partitions that a worker keeps
# sums of rounded impacts are compared with a little less than what is asked, before the exact score decides
NEARLY = 0.999
# share of what is asked up to which a passage's least terms are looked up only in the blocks that the others leave
DEFERRED = 0.25
TOKEN = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.?!])\s+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words in two parts: the last sentences that make up some words are its answer.

    An item of one sentence is parted in the middle; one too short to be parted is both.
    """
    words = tokens(text)
    if len(words) < 2 * ANSWER_WORDS:
        return words, words
    answer: list[str] = []
    for sentence in reversed(SENTENCE.split(text)):
        answer = tokens(sentence) + answer
        if len(answer) >= ANSWER_WORDS:
            break
    if len(words) - len(answer) < ANSWER_WORDS:
        answer = words[len(words) // 2 :]
    return words[: len(words) - len(answer)], answer


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Statistics:
    """What scores need to know of all items."""

    items: int
    words: int
    longest: int

    @property
    def passage(self) -> int:
        return max(LEAST_PASSAGE, 2 * self.longest)


@dataclass
class Index:
    ids: list[int]
    items: list[tuple[list[str], list[str]]]  # words of question and answer
    terms: dict[str, int]  # by ascending upper bound
    upper: np.ndarray  # a term's largest impact
    starts: np.ndarray  # a term's entries among the three below
    blocks: np.ndarray
    maxima: np.ndarray
    postings: np.ndarray  # where an entry's postings begin, and the end
    slots: np.ndarray  # an item's place in its block
    impacts: np.ndarray
    asked: list[float]  # share of each item's own score
    passage: int

    @property
    def n_blocks(self) -> int:
        return max(1, -(-len(self.ids) // ITEMS_PER_BLOCK))


def statistics_of(items: list[tuple[int, str]]) -> tuple[Statistics, Counter]:
    """Statistics and document frequencies of all items, for a benchmark in memory."""
    words = [w for _, t in items if (w := tokens(t))]
    return Statistics(len(words), sum(map(len, words)), max(map(len, words), default=0)), Counter(w for x in words for w in set(x))


def _lightest_run(words: list[str], weights: Mapping[str, float], length: int) -> float:
    """The least weight of the different words in a run of ``length`` words: what any passage with such a run scores at least."""
    counts: Counter[str] = Counter()
    total, least = 0.0, math.inf
    for i, w in enumerate(words):
        counts[w] += 1
        total += weights[w] if counts[w] == 1 else 0.0
        if i >= length:
            out = words[i - length]
            counts[out] -= 1
            total -= weights[out] if counts[out] == 0 else 0.0
        if i >= length - 1:
            least = min(least, total)
    # sums and differences of rounded weights
    return least * (1 - 1e-9)


def build_index(items: list[tuple[int, str]], statistics: Statistics | None = None, found: Mapping[str, int] | None = None) -> Index:
    """The index of (item_id, text) pairs, given the statistics of all items; items without words can't be found and are left out."""
    if statistics is None:
        statistics, found = statistics_of(items)
    items = sorted((i, t) for i, t in items if t and tokens(t))
    n, mean = statistics.items, statistics.words / max(1, statistics.items)
    entries, shares = [], []
    for j, (_, text) in enumerate(items):
        x = tokens(text)
        own = {w: math.log(1 + (n - found[w] + 0.5) / (found[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for w, c in Counter(x).items()}
        asked = min(RETRIEVE * sum(own.values()), _lightest_run(x, own, math.ceil(RUN_OVERLAP * len(x))))
        shares.append(asked / sum(own.values()))
        entries += [(w, j, v / asked) for w, v in own.items()]
    upper: dict[str, float] = {}
    for w, _, v in entries:
        upper[w] = max(upper.get(w, 0.0), v)
    terms = {w: k for k, w in enumerate(sorted(upper, key=lambda w: (upper[w], w)))}
    term, item, impact = (np.array(c) for c in zip(*((terms[w], j, v) for w, j, v in entries))) if entries else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((item, term))
    term, item, impact = term[order].astype(np.int64), item[order].astype(np.int64), impact[order].astype(float)
    block = item // ITEMS_PER_BLOCK
    heads = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
    return Index(
        ids=[i for i, _ in items],
        items=[question_and_answer(t) for _, t in items],
        terms=terms,
        upper=np.array([upper[w] for w in terms], float),
        starts=np.searchsorted(term[heads], np.arange(len(terms) + 1)),
        blocks=block[heads],
        maxima=np.maximum.reduceat(impact, heads) if len(heads) else np.zeros(0),
        postings=np.r_[heads, len(term)],
        slots=item % ITEMS_PER_BLOCK,
        impacts=impact,
        asked=shares,
        passage=statistics.passage,
    )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _pieces(costs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours that cost some ``most`` together, or of one that costs more."""
    cuts = np.flatnonzero(np.diff(np.cumsum(costs) // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(costs)])) if len(costs) else []


def _passages(index: Index, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) entries in order, and the text of each passage that has any; passages are numbered anew."""
    unknown, step = len(index.terms), index.passage // 2
    get = index.terms.get
    codes = [[get(w, unknown) for w in x] for x in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    term = np.fromiter(chain.from_iterable(codes), np.int64, len(owner))
    known = term < unknown
    owner, place, term = owner[known], place[known], term[known]
    # passage i of a text holds its steps i and i + 1; the passage before the first holds step 0 alone
    ends = np.cumsum(lengths // step + 2)
    base = np.r_[0, ends][owner] + place // step
    keys = np.unique(np.concatenate([base, base + 1]) * (unknown + 1) + np.concatenate([term, term]))
    passage, term = keys // (unknown + 1), keys % (unknown + 1)
    new = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.zeros(0, bool)
    return np.cumsum(new) - 1, term, np.searchsorted(ends, passage[new], "right")


def retrieve(index: Index, texts: list[list[str]]) -> list[tuple[int, int, float]]:
    """(text, item, score) of all items that some passage of a text retrieves; scores as shares of what is asked, by passage."""
    passage, term, owner = _passages(index, texts)
    blocks = index.n_blocks
    entry_keys = np.repeat(np.arange(len(index.terms)), np.diff(index.starts)) * blocks + index.blocks
    starts = np.searchsorted(passage, np.arange(len(owner) + 1))
    best: dict[tuple[int, int], float] = {}
    # the entries in the lists of a passage's terms, and a sum for each block
    costs = np.bincount(passage, weights=np.diff(index.starts)[term], minlength=len(owner)).astype(np.int64) + blocks
    for low, high in _pieces(costs, ENTRIES_AT_ONCE):
        a, z = starts[low], starts[high]
        local, t = passage[a:z] - low, term[a:z]
        first = starts[low:high] - a
        # running sums of upper bounds; the pivot is where one reaches what is asked
        running = np.cumsum(index.upper[t])
        running -= (running[first] - index.upper[t[first]])[local]
        past = running >= NEARLY
        # passages without a pivot are done; of the others the least terms, which add little, wait for the blocks that are left
        counted = (running >= DEFERRED) & np.repeat(running[np.r_[first[1:], z - a] - 1] >= NEARLY, np.diff(np.r_[first, z - a]))
        before = np.bincount(local[running < DEFERRED], minlength=high - low)
        rest = np.where(before > 0, running[np.maximum(first + before - 1, 0)], 0.0)
        sizes = index.starts[t[counted] + 1] - index.starts[t[counted]]
        at = _ranges(index.starts[t[counted]], sizes)
        keys = np.repeat(local[counted], sizes) * blocks + index.blocks[at]
        bounds = np.bincount(keys, weights=index.maxima[at], minlength=(high - low) * blocks)
        # blocks in the lists of the terms from the pivot on
        reached = np.zeros(len(bounds), bool)
        reached[keys[np.repeat(past[counted], sizes)]] = True
        pairs = np.flatnonzero(reached & (bounds + np.repeat(rest, blocks) >= NEARLY))
        owned = pairs // blocks
        # all terms' maxima of the blocks that are left, some at a time; what is left then is scored
        counts = np.diff(np.r_[first, z - a])[owned]
        group = np.cumsum(counts) // ENTRIES_AT_ONCE
        for g in range(int(group[-1]) + 1 if len(group) else 0):
            mine = np.flatnonzero(group == g)
            _score(index, t, first, counts[mine], pairs[mine], blocks, entry_keys, owner[low:high], best)
    return [(t, j, s) for (t, j), s in sorted(best.items())]


def _score(index: Index, t: np.ndarray, first: np.ndarray, counts: np.ndarray, pairs: np.ndarray, blocks: int, entry_keys: np.ndarray, owner: np.ndarray, best: dict) -> None:
    """Score the blocks of (passage, block) ``pairs`` that their block maxima leave, keeping the best score of each text and item."""
    pair = np.repeat(np.arange(len(pairs)), counts)
    wanted = t[_ranges(first[pairs // blocks], counts)] * blocks + np.repeat(pairs % blocks, counts)
    at = np.minimum(np.searchsorted(entry_keys, wanted), len(entry_keys) - 1)
    hit = entry_keys[at] == wanted
    pair, at = pair[hit], at[hit]
    bounds = np.bincount(pair, weights=index.maxima[at], minlength=len(pairs))
    left = bounds[pair] >= NEARLY
    pair, at = pair[left], at[left]
    sizes = index.postings[at + 1] - index.postings[at]
    where = _ranges(index.postings[at], sizes)
    scores = np.bincount(np.repeat(pair, sizes) * ITEMS_PER_BLOCK + index.slots[where], weights=index.impacts[where], minlength=len(pairs) * ITEMS_PER_BLOCK)
    for k in np.flatnonzero(scores >= 1).tolist():
        p = k // ITEMS_PER_BLOCK
        key = (int(owner[pairs[p] // blocks]), int(pairs[p] % blocks) * ITEMS_PER_BLOCK + k % ITEMS_PER_BLOCK)
        best[key] = max(best.get(key, 0.0), float(scores[k]))


def longest_run(item: list[str], words: list[str]) -> int:
    """Words of the longest run of an item's words that a text has; none below a gram's length."""
    n = min(GRAM, len(item))
    places: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(item) - n + 1):
        places.setdefault(tuple(item[j : j + n]), []).append(j)
    best, before = 0, {}
    for i in range(len(words) - n + 1):
        now = {j: before.get(j - 1, n - 1) + 1 for j in places.get(tuple(words[i : i + n]), ())}
        best, before = max([best, *now.values()]), now
    return best


def verify(index: Index, item: int, words: list[str]) -> tuple[float, float, float, float]:
    """Shares of the n-grams of the item's question, of its answer and of all of it that the text has, and of its words in one run."""
    question, answer = index.items[item]
    whole = question if question is answer or question == answer else question + answer
    out = []
    for part in (question, answer, whole):
        wanted = grams(part, GRAM)
        n = min(GRAM, len(part))
        own = {g for i in range(len(words) - n + 1) if (g := tuple(words[i : i + n])) in wanted}
        out.append(len(own) / len(wanted))
    return out[0], out[1], out[2], longest_run(whole, words) / len(whole) if out[2] else 0.0


def is_leak(question: float, answer: float, whole: float, run: float) -> bool:
    return question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP or whole >= WHOLE_OVERLAP or question >= 1 or run >= RUN_OVERLAP


def _stretch(index: Index, words: list[str], known: set[tuple[str, ...]]) -> list[str]:
    """The words of a text that stand in an n-gram of any item, with a mark where others are left out.

    Grams of the shortened text that are in an item are those of the whole one, and so are runs of them.
    """
    keep = np.zeros(len(words), bool)
    for n in {len(g) for g in known}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in known:
                keep[i : i + n] = True
    out: list[str] = []
    for i in np.flatnonzero(keep).tolist():
        if i and not keep[i - 1]:
            out.append("")
        out.append(words[i])
    return out


def contaminations(index: Index, words: list[list[str]]) -> list[tuple[int, int, float, float, float]]:
    """(text number, item_id, score, question overlap, answer overlap) of verified items, for texts given as words."""
    out = []
    found: dict[int, list[tuple[int, float]]] = {}
    for t, j, score in retrieve(index, words):
        found.setdefault(t, []).append((j, score))
    for t, items in found.items():
        known = set().union(*[grams(p, GRAM) for j, _ in items for p in (*index.items[j], index.items[j][0] + index.items[j][1])])
        short = _stretch(index, words[t], known)
        for j, score in items if short else ():
            q, a, whole, run = verify(index, j, short)
            if is_leak(q, a, whole, run):
                out.append((t, index.ids[j], score * index.asked[j], q, a))
    return out


def write_index(benchmark: DataFrame, words_per_part: int = WORDS_PER_PART) -> list[tuple[str, int]]:
    """(path, bytes) of the partitions of the index, files in the shared folder; null ids or texts are left out.

    Partitions are cut by the sum of the items' words, and no statistic depends on them.
    """
    spark = benchmark.sparkSession
    items = pick(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], ["item_id", "text", "words"])

    items = materialise(items.mapInArrow(split, "item_id long, text string, words array<string>").where("size(words) > 0"), "benchmark")
    total = items.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).first()
    if not total["n"]:
        return []
    statistics = Statistics(total["n"], total["words"], total["longest"])
    parts = -(-statistics.words // words_per_part)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    has = items.select("part", F.explode(F.array_distinct("words")).alias("word"))
    found = has.groupBy("word").agg(F.count("*").alias("n"))
    found = has.distinct().join(found, "word").select("part", "word", "n").toDF("own_part", "word", "n")
    folder = scratch_path(spark, "benchmark-index")

    def build(own: pa.Table, terms: pa.Table) -> pa.Table:
        counts = dict(zip(terms.column("word").to_pylist(), terms.column("n").to_pylist()))
        index = build_index(list(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist())), statistics, counts)
        data = pickle.dumps(vars(index), protocol=pickle.HIGHEST_PROTOCOL)
        # a task that runs again writes a file of its own, and the manifest names the one that counts
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        name = f"part-{own.column('part')[0].as_py()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(data)
        return pa.table({"path": [f"{folder}/{name}"], "bytes": pa.array([len(data)], pa.int64())})

    files = items.select("part", "item_id", "text").groupBy("part").cogroup(found.groupBy("own_part")).applyInArrow(build, "path string, bytes long")
    return sorted((r["path"], r["bytes"]) for r in materialise(files, "benchmark-manifest").collect())


_held: OrderedDict[str, Index] = OrderedDict()


def _load(path: str, keep: bool) -> Index:
    if path not in _held:
        fs, at = _open(path)
        with fs.open_input_stream(at) as stream:
            index = Index(**pickle.loads(stream.read()))
        if not keep:
            return index
        _held[path] = index
    return _held[path]


def _found(files: list[tuple[str, int]], texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
    """Verified items of some texts over all partitions of the index, with at most one of them in memory unless all are small."""
    keep = sum(size for _, size in files) <= HELD_BYTES
    pieces = _pieces(np.array([len(t or "") + 1 for t in texts], np.int64), CHARS_AT_ONCE)
    for path, _ in files:
        index = _load(path, keep)
        for low, high in pieces:
            for t, *rest in contaminations(index, [tokens(t) for t in texts[low:high]]):
                yield (low + t, *rest)


MATCH = T.StructType().add("doc_id", "long").add("item_id", "long").add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
ROWS_PER_LOAD = 4096


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair; clean documents have no row.

    ``score`` is the best passage's BM25 score as a share of the item's own.  Null and empty texts hold nothing.  Rows that share a doc_id, null
    included, share their pairs, one row each with the largest figures; further columns don't matter, and an empty table on either side gives no rows.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = write_index(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_LOAD):
                part = batch.slice(at, ROWS_PER_LOAD)
                columns = list(zip(*_found(files, part["text"].to_pylist()))) or [[]] * 5
                arrays = [part["doc_id"].take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]]
                yield pa.RecordBatch.from_arrays(arrays, MATCH.names)

    return rows.mapInArrow(run, MATCH).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in MATCH.names[2:]])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a verified benchmark item, all columns kept."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = names.index("text")
    files = write_index(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_LOAD):
                part = batch.slice(at, ROWS_PER_LOAD)
                clean = np.ones(part.num_rows, bool)
                for t, *_ in _found(files, part[text].to_pylist()):
                    clean[t] = False
                yield part.filter(pa.array(clean))

    return rows.mapInArrow(run, rows.schema).toDF(*names)
