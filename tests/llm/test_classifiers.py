"""Language and toxicity models: parts against brute force, whole models by held-out accuracy."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from halocline.llm import language as lg
from halocline.llm import toxicity as tx

EN = "the quick brown fox and the lazy dog went over to the river with that old friend of theirs for this one thing"
DE = "der schnelle braune fuchs und der faule hund gingen mit dem alten freund über den fluss für diese eine sache nicht"


def greedy_phrases(text, sample):
    """Cross-parsing by its definition: longest stretches that occur in the sample."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=60), st.lists(st.text("abcz ", max_size=40), max_size=5))
def test_phrases_match_definition(sample, texts):
    model = lg.fit({"x": [sample + "abc"], "y": ["b"]})
    codes = [lg.encode(t, model.classes) for t in texts]
    known = bytes([*lg.encode(sample + "abc", model.classes).tolist(), lg.GAP])
    got = lg.phrases(model, codes) if codes else np.zeros((0, 2))
    assert got[:, 0].tolist() == [greedy_phrases(bytes(c), known) for c in codes]


def test_automaton_holds_all_stretches_and_no_others():
    codes = [random.Random(1).randrange(3) for _ in range(60)]
    nexts, _ = lg.suffix_automaton(codes, 3)
    text = bytes(codes)
    for _ in range(2000):
        word = [random.randrange(3) for _ in range(random.randrange(1, 9))]
        at = 0
        for c in word:
            at = nexts[at][c] if at >= 0 else -1
        assert (at >= 0) == (bytes(word) in text)


def language_rows(n=120):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        name, words = ("en", EN.split()) if i % 3 else ("de", DE.split())
        rows.append((i, " ".join(rng.choice(words) for _ in range(30)), name, "s"))
    return rows


def test_language_on_held_out_rows(documents):
    rows = language_rows() + [(1000, None, "en", "s"), (1001, "", "de", None), (1002, "12 !!\n", None, None), (1003, "ß" * 70_000, None, None), (None, EN, None, None)]
    got = lg.language_digest(documents(rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:120]}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id in (1003, None):
            assert r.lang_pred in ("en", "de")


SCRIPTS = {"latin": (0x61, 26), "greek": (0x3B1, 24), "cyrillic": (0x430, 32), "hebrew": (0x5D0, 27), "han": (0x4E00, 3000)}


def test_a_hundred_languages_in_five_scripts(documents):
    rng = random.Random(21)
    words, rows = {}, []
    for k in range(100):
        first, size = list(SCRIPTS.values())[k % 5]
        # twenty languages of a script have words of their own from its letters
        words[f"l{k:03d}"] = ["".join(chr(first + rng.randrange(size)) for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    for i in range(3000):
        name = f"l{i % 100:03d}"
        rows.append((i, " ".join(rng.choice(words[name]) for _ in range(rng.randrange(20, 400))), name, "s"))
    rows += [(5000 + i, rows[i][1], None, "s") for i in range(100)]
    got = {r.doc_id: r for r in lg.language_digest(documents(rows, 8)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 3000]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.98 * len(held) > 500
    assert sum(got[5000 + i].lang_pred == rows[i][2] for i in range(100)) >= 98


def test_letters_of_another_script_are_no_match():
    samples = {"han": ["".join(chr(0x4E00 + i * 7 % 2000) for i in range(j, j + 500)) for j in range(8)], "thai": ["กขคงจ ฉชซ ญฎฏ " * 20]}
    model = lg.fit(samples)
    assert model.own.max() <= lg.RARE + lg.LETTERS
    assert lg.predict(model, ["กขค งจฉ", "ๆษฬฮ ๆษฬ", "中丰 临丿 "])[0][0] == "thai"
    # Hangul is in neither sample: a phrase for each letter, in both languages
    counts = lg.phrases(model, [lg.encode("가나다라마", model.classes)])
    assert counts.tolist() == [[5, 5]]


def test_repeated_rows_and_ties(documents):
    rows = [(i % 4, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(40)] + [(100 + i, "zzz qqq", None, "s") for i in range(3)]
    got = lg.language_digest(documents(rows)).collect()
    assert len(got) == 43 and len({(r.lang_pred, r.score) for r in got if r.doc_id >= 100}) == 1


def test_language_without_labels_and_with_clashing_columns(spark, documents):
    assert {r.lang_pred for r in lg.language_digest(documents([(1, "some text", None, None)])).collect()} == {"und"}
    assert lg.language_digest(documents([])).collect() == []
    df = spark.createDataFrame([(1, EN, "en", 3)], "doc_id long, text string, lang string, score int")
    assert lg.identify(df, lg.fit({"en": [EN]})).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 80).astype(float)
    y = (rng.random(80) < x / 15).astype(float)
    xs, ys = tx.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fitted = np.interp(x, xs, ys)
    # max-min formula over the distinct values
    values = np.unique(x)
    sums, counts = np.array([y[x == v].sum() for v in values]), np.array([(x == v).sum() for v in values])
    want = [max(min(sums[a : b + 1].sum() / counts[a : b + 1].sum() for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))]
    assert np.allclose(fitted, np.array(want)[np.searchsorted(values, x)])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = tx.Trees(rounds=80).fit(x[:3000], y[:3000])
    assert ((trees.raw(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_features():
    lexicon = frozenset(["idiot"])
    at = dict(zip(tx.FEATURES, tx.features("You are an IDIOT! id1ot, fine idiot.", lexicon)))
    assert (at["hits"], at["distinct"]) == (2, 1)
    assert abs(at["obfuscated"] - 1 / 7) < 1e-12 and at["near_person"] > 0 and at["shouting"] > 0
    assert tx.features(None, lexicon) == tx.features("", lexicon) == [0.0] * len(tx.FEATURES)


def toxic_rows(n=900):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [rng.choice(EN.split()) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["blockhead", "nincompoop", "dolt"])
        rows.append((i, " ".join(words), "en", "s"))
    return rows


def test_toxicity_on_held_out_rows(spark, documents):
    rows = toxic_rows() + [(5000, None, None, None), (5001, "", None, None), (5001, "", None, None), (5002, "dolt " * 30_000, None, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = tx.toxicity_digest(documents(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.98
    assert not any(r.predicted for r in got if r.doc_id in (5000, 5001))


def test_toxicity_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in tx.toxicity_digest(documents(["a text"]), labels).collect()] == [(0.0, 0)]
    assert tx.toxicity_digest(documents([]), labels).collect() == []
