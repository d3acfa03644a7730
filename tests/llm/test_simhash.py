"""SimHash fingerprints, the trie self-join and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from llm_helpers import components_of

from halocline.llm import resemblance, simhash
from halocline.llm.components import connected_components, local_components
from halocline.storage import materialise


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def near_keys(seed, n=400):
    """Random keys, chains of neighbours, and a dense cluster."""
    rng = random.Random(seed)
    keys = {rng.getrandbits(64) for _ in range(n)}
    for k in list(keys)[:40]:
        for _ in range(rng.randrange(5)):
            for _ in range(rng.randrange(1, 5)):
                k ^= 1 << rng.randrange(64)
            keys.add(k)
    centre = rng.getrandbits(64)
    keys |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    return sorted(keys | {0})


def pairs_within(keys, limit):
    return [(i, j) for i in range(len(keys)) for j in range(i) if (keys[i] ^ keys[j]).bit_count() <= limit]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "A b C d É é", "x " * 500, "  a"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_long_text_fingerprint():
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(1000)) for _ in range(70_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_trie_links_connect_what_is_near(limit, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    keys = near_keys(limit)
    array = np.array(keys, np.uint64)
    group, side = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    i, j = simhash.trie_links(array, group, side, 0, limit)
    assert all((keys[a] ^ keys[b]).bit_count() <= limit for a, b in zip(i, j))
    want = pairs_within(keys, limit)
    assert components_of(len(keys), zip(i, j)) == components_of(len(keys), want)
    assert len(i) <= 2 * len(keys)


def test_trie_links_between_two_sides():
    keys = near_keys(9)
    side = np.array([k % 2 for k in range(len(keys))])
    i, j = simhash.trie_links(np.array(keys, np.uint64), np.zeros(len(keys), np.int64), side, 0, 3)
    assert all(side[a] != side[b] for a, b in zip(i, j))
    want = [(a, b) for a, b in pairs_within(keys, 3) if side[a] != side[b]]
    assert components_of(len(keys), zip(i, j)) == components_of(len(keys), want)


@pytest.mark.parametrize("trie_keys, spread", [(4096, 16), (16, 16), (64, 0)])
def test_links_for_any_division(spark, trie_keys, spread, monkeypatch):
    monkeypatch.setattr(simhash, "KEYS_PER_PREFIX", spread)
    keys = near_keys(7)
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "fingerprint long")
    at = {(k - (1 << 64) if k >> 63 else k): i for i, k in enumerate(keys)}
    links = [(at[r.a], at[r.b]) for r in simhash.fingerprint_links(df, len(keys), 3, trie_keys).collect()]
    assert components_of(len(keys), links) == components_of(len(keys), pairs_within(keys, 3))


def test_connected_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5001), (5001, 5001)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 5000: 5000, 5001: 5000}
    assert got == want
    assert local_components(4, np.array([3, 1]), np.array([1, 2])).tolist() == [0, 1, 1, 1]


def test_components_join_few_edges_again(spark, monkeypatch):
    """A round joins what edges lie between roots only, however many hold a group together."""
    rng = random.Random(8)
    edges = [(rng.randrange(400) + 1000 * k, rng.randrange(400) + 1000 * k) for k in range(5) for _ in range(4000)]
    # low and high nodes in turn: after a round a path is left, whose ends are far apart
    edges += [p for i in range(100) for p in ((10**6 + i, 2 * 10**6 + i), (2 * 10**6 + i, 10**6 + i + 1))]
    stored = []

    def counted(df, name):
        out = materialise(df, name)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr("halocline.llm.components.materialise", counted)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({n for e in edges for n in e})
    at = {n: i for i, n in enumerate(ids)}
    labels = components_of(len(ids), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {n: ids[labels[at[n]]] for n in ids}
    graphs = [n for name, n in stored if name == "graph-edges"]
    assert graphs[0] > 15000 and sum(graphs[1:]) < graphs[0] / 10 and graphs[-1] == 0 and len(stored) <= 16
    assert connected_components(spark.createDataFrame([(7, 7), (None, 3)], "a long, b long")).collect() == []


def test_near_duplicates_of_documents(documents):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(20)]
    texts += [t.upper() for t in texts[:4]] + [texts[5] + " end", None, "", "  ", texts[6]]
    got = simhash.near_duplicate_digest(documents([(1000 - i, t, None, None) for i, t in enumerate(texts)])).collect()
    prints = {1000 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    ids = sorted(prints)
    labels = components_of(len(ids), pairs_within([prints[i] for i in ids], 3))
    assert {r.doc_id: r.component_id for r in got} == {d: ids[k] for d, k in zip(ids, labels)}


def test_dropping_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(3, "a b c d", "x", 1), (2, "a b c d", "y", 2), (2, "a b c d", "y", 2), (9, "other words stand here", "z", 3), (None, "a b c d", "n", 4), (None, None, "m", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fingerprint int").repartition(3)
    got = sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=repr)
    assert [r[:2] for r in got][:2] == [(2, "a b c d"), (9, "other words stand here")]
    assert len(got) == 3 and got[2][0] is None
    assert simhash.drop_near_duplicates(df.limit(0)).columns == df.columns


def test_empty_table(documents):
    assert simhash.near_duplicate_digest(documents([])).collect() == []


def test_dropping_takes_texts_of_similarity_four_fifths(spark):
    rng = random.Random(11)
    rows, words = [], lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    # one changed word takes five of 196 shingles: 4 changes leave 176 of 216 (0.815), 5 leave 171 of 221 (0.774)
    for changes in (4, 5):
        for k in range(12):
            text = words()
            other = list(text)
            for c in range(changes):
                other[20 + 30 * c] = "changed"
            rows += [(1000 * changes + 2 * k, " ".join(text)), (1000 * changes + 2 * k + 1, " ".join(other))]
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows if i >= 5000 or i % 2 == 0}


def test_dropping_tells_groups_of_null_and_repeated_ids_apart(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(10)]
    rows = [(None, t) for t in texts[:6]] * 2 + [(4, texts[0]), (7, texts[6]), (7, texts[7]), (7, texts[8]), (5, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(4, texts[0]), *[(None, t) for t in texts[1:6]], (7, texts[6]), (7, texts[7]), (5, texts[8])], key=repr)


@pytest.mark.parametrize("piece_rows", [256, 7])
def test_similar_groups_match_comparing_all_pairs(spark, piece_rows, monkeypatch):
    monkeypatch.setattr(resemblance, "PIECE_ROWS", piece_rows)
    rng = random.Random(13)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(6)]
    texts = [None, "", " \n", "a b", "A  B"]
    for k in range(90):
        own = list(base[k % 6 if k % 3 else 0])
        for _ in range(rng.randrange(6)):
            own[rng.randrange(120)] = f"c{rng.randrange(40)}"
        texts.append(" ".join(own))
    sets = [set(resemblance.shingles(None if t is None else t.encode()).tolist()) for t in texts]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = resemblance.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    label = {r.doc_id: r.label for r in got}
    groups = components_of(len(texts), want)
    assert len(got) == len(texts) and 5 < len(set(groups)) < len(texts)
    assert len({(label[i], groups[i]) for i in label}) == len(set(label.values())) == len(set(groups))


def test_dropping_takes_texts_with_near_fingerprints(spark):
    """Links of the fingerprints count by themselves, and join groups that share shingles."""
    rng = random.Random(14)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    texts = [" ".join(base[0]), " ".join([*base[0], "end"]), " ".join(base[1]), " ".join(base[2]), None, "one", "one"]
    # the phrase that is repeated decides the fingerprint: shingles in common are few
    phrase = " ".join(base[1][:9])
    texts += [f"{' '.join([phrase] * 400)} {' '.join(base[k])}" for k in (1, 2)]
    five = lambda t: simhash.fingerprint(None if t is None else t.encode(), 5)
    sets = [set(resemblance.shingles(None if t is None else t.encode()).tolist()) for t in texts]
    assert (five(texts[7]) ^ five(texts[8])).bit_count() <= 3 and 5 * len(sets[7] & sets[8]) < 4 * len(sets[7] | sets[8])
    prints = [five(t) for t in texts]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = components_of(len(texts), similar + pairs_within(prints, 3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    label = {r.doc_id: r.label for r in simhash.near_duplicate_groups(df).collect()}
    assert len({(label[i], want[i]) for i in label}) == len(set(label.values())) == len(set(want)) == 4
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [0, 2, 4, 5]
