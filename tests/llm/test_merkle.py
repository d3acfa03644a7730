"""Merkle manifest: the operator against a tree built in plain Python, and the octopus against its definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from halocline.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(left, right) siblings of leaf i, level by level."""
    for nodes in tree[:-1]:
        first = i - i % 8
        yield nodes[first:i], nodes[i + 1 : first + 8]
        i //= 8


def plain_manifest(rows):
    def leaf(row, text):
        d, t, lang, source, n = row
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])

    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((key(r[0]), leaf(r, r[1]), r))
    names = sorted(langs, key=key)
    trees = {}
    for lang in names:
        langs[lang].sort(key=lambda x: x[:2])
        trees[lang] = levels([x[1] for x in langs[lang]])
    top = levels([trees[lang][-1][0] for lang in names])
    out = []
    for k, lang in enumerate(names):
        for i, (_, own, r) in enumerate(langs[lang]):
            steps = [*path(trees[lang], i), *path(top, k)]
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, r[1] and "".join(c.lower() if c.isascii() else c for c in r[1]))
            for left, right in steps:
                node = sha(*left, node, *right)
            root = top[-1][0]
            out.append((r[0], own, trees[lang][-1][0], root, sha(*[x for left, right in steps for x in left + right]), node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in merkle.merkle_manifest(df).collect()), key=repr)


def some_documents(sizes):
    rng = random.Random(3)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice(["Ab ÄÖ z.", "lower", "", None, "X" * 3000]), lang, rng.choice([None, "s", "ß"])) for _ in range(n)]
    rng.shuffle(rows)
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.mark.parametrize("part", [1 << 15, 37])
def test_manifest_matches_a_plain_tree(documents, monkeypatch, part):
    monkeypatch.setattr(merkle, "LEAVES_PER_PART", part)
    rows = some_documents({"en": 700, "de": 65, "fr": 64, "es": 9, "pt": 8, "it": 1, None: 2, "Z": 1, "": 3, "é": 1, "xx": 2})
    rows += [(None, "Null id", "en", "s", 7), (5, "Same", "en", "s", 4), (5, "Same", "en", "s", 4), (5, "Other", "en", "s", 5)]
    want = plain_manifest(rows)
    assert got(documents([r[:4] for r in rows], 5)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_a_tree_of_several_rounds(documents):
    rows = [(i, str(i), "en" if i % 50 else "de", "s", len(str(i))) for i in range(merkle.FAN**merkle.LEVELS + 300)]
    assert got(documents([r[:4] for r in rows], 4)) == plain_manifest(rows)


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 8}, {"en": 1, "de": 1}, {f"l{i:02d}": 1 for i in range(70)}])
def test_small_trees(documents, sizes):
    rows = some_documents(sizes)
    assert got(documents([r[:4] for r in rows])) == plain_manifest(rows)


def test_empty_tables_and_clashing_columns(spark, documents):
    assert merkle.merkle_manifest(documents([])).collect() == []
    rows = some_documents({"en": 20, "de": 3})
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int, Text long")
    assert got(df) == plain_manifest(rows)


def test_octopus_is_the_least_set_of_missing_nodes():
    rng = random.Random(4)
    for _ in range(200):
        count = rng.choice([1, 2, 8, 9, 64, 65, 600])
        own = sorted(rng.sample(range(count), rng.randrange(1, min(count, 40) + 1)))
        found = {(level, int(i)) for level, at in merkle.octopus(np.array(own), count) for i in at}
        n, held, want = count, set(own), set()
        level = 0
        while n > 1:
            runs = {i // 8 for i in held}
            want |= {(level, j) for r in runs for j in range(r * 8, min(r * 8 + 8, n)) if j not in held}
            level, held, n = level + 1, runs, -(-n // 8)
        assert found == want
