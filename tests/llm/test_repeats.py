"""Substring dedup against a direct reading of its definition."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halocline.llm import repeats
from halocline.llm.frames import buffer_of


def brute(rows):
    """{doc_id: (n_words, n_removed, sha256)} for unique ids."""
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d, w in words.items():
        if d is None:
            continue
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "of", "häuser", "x" * 40, "w%d" % rng.randrange(30)])
    passages = [[word() for _ in range(rng.choice([5, 13, 14, 40, 300]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        texts.append("".join(x + rng.choice([" ", "\n", "\t ", "  "]) for x in w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_matches_definition(documents, seed):
    texts = corpus(seed)
    texts += [None, "", "   ", texts[0], " ".join(["x"] * 2000), " ".join(["x"] * 1500), "one"]
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    got = repeats.repeats_digest(documents([(d, t, None, None) for d, t in rows], 7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows)
    assert sum(r.n_removed for r in got) > 100


def test_small_buckets_and_blocks_change_nothing(documents, monkeypatch):
    rows = list(enumerate(corpus(3, 30)))
    for name, value in (("LONGEST", 3), ("BLOCK_BYTES", 50), ("BUCKET_BYTES", 500), ("ROWS_AT_ONCE", 2)):
        monkeypatch.setattr(repeats, name, value)
    text = pa.array([t for _, t in rows])
    found = list(zip(*repeats.super_kmers(*buffer_of(text))))
    for doc, start, _, packed in found:
        words = rows[doc][1].encode().split()[start : start + packed.count(b" ") + 1]
        assert b" ".join(words) == packed and 13 <= len(words) <= 15
    windows = sum(max(0, len(t.encode().split()) - 12) for _, t in rows)
    assert sum(p.count(b" ") + 1 - 12 for *_, p in found) == windows


def test_repeated_ids_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(5, text, 1, "a"), (5, text, 1, "b"), (5, text + " more", 2, "c"), (None, text, 3, "d"), (7, text, 4, "e")], "doc_id long, text string, runs int, h string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.repeats_digest(df).collect())
    assert got == [(0, 20, 0), (5, 20, 0), (5, 20, 0), (5, 21, 0), (7, 20, 20)]


def test_empty_table(documents):
    assert repeats.repeats_digest(documents([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tä", max_size=80), min_size=1, max_size=5))
def test_words_of_matches_split(texts):
    raw, bounds = buffer_of(pa.array(texts))
    starts, ends, text = repeats.words_of(raw, bounds)
    got = [[] for _ in texts]
    data = raw.tobytes()
    for a, b, t in zip(starts, ends, text):
        got[t].append(data[a:b])
    assert got == [t.encode().split() for t in texts]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(repeats, "word_hashes", lambda raw, starts, ends: np.ones(len(starts), np.uint64))
    spelled = [" ".join(f"{c}{i}" for i in range(13)).encode() for c in "abab"]
    owner, first, n, low = repeats._shared_runs(pa.array(spelled), np.array([1, 2, 3, 2]), np.array([1, 2, 3, 4]))
    assert [x.tolist() for x in (owner, first, n, low)] == [[2, 3], [0, 0], [1, 1], [1, 2]]
