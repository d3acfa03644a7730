"""Decontamination, sharding, mixing, URL verdicts and the pipeline against brute force."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from parity import connect, difference

import corpus_pipeline
from halocline.llm import decontaminate as dc
from halocline.llm import mixing, queries, sharding, url_filter

ITEM = "item_id long, text string"


def benchmark_items(n=40):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "and", "w%d" % rng.randrange(3000)])
    return [(i, " ".join(word() for _ in range(rng.randrange(10, 30))).capitalize() + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(n)]


def test_leaks_are_found_and_clean_documents_left_alone(spark, documents):
    rng, items = random.Random(1), benchmark_items()
    filler = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        text = filler(rng.randrange(1, 400))
        if i % 3 == 0:
            item = items[rng.randrange(len(items))]
            text += " " + item[1].upper() + "\n" + filler(rng.randrange(300))
            want.add((i, item[0]))
        rows.append((i, text, None, None))
    rows += [(100, None, None, None), (101, "", None, None), (102, items[3][1].split(". ")[0], None, None), (103, items[5][1] * 400, None, None)]
    # document 102 holds an item's whole question, 65 % of the item word for word
    want |= {(102, 3), (103, 5)}
    bench = spark.createDataFrame(items + [(None, "x y"), (77, None), (78, "!")], ITEM)
    got = dc.find_leaks(documents(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    kept = {r.doc_id for r in dc.drop_contaminated(documents(rows), bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_an_item_without_its_last_sentence_is_a_leak(spark, documents):
    rng = random.Random(7)
    sentence = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    items = [(i, f"{sentence(30)}. {sentence(15)}. {sentence(8)}.") for i in range(20)]
    rows = [(i, f"{sentence(60)} {t.rsplit('. ', 1)[0]} {sentence(60)}", None, None) for i, t in items] + [(100, sentence(200), None, None)]
    bench = spark.createDataFrame(items, ITEM)
    got = dc.find_leaks(documents(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(r.question_overlap == 1 and r.answer_overlap == 0 for r in got)
    assert [r.doc_id for r in dc.drop_contaminated(documents(rows), bench).collect()] == [100]


@pytest.mark.parametrize("keep", [lambda w, k: w[:k], lambda w, k: w[-k:], lambda w, k: w[(len(w) - k) // 2 :][:k]])
def test_an_item_cut_to_half_is_a_leak(keep):
    rng = random.Random(17)
    items = benchmark_items(200)
    index = dc.build_index(items)
    filler = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    texts = [filler(rng.randrange(200)) + keep(w, -(-len(w) // 2)) + filler(rng.randrange(200)) for _, t in items for w in [dc.tokens(t)]]
    clean = [filler(400) for _ in range(200)]
    got = {(t, i) for t, i, *_ in dc.contaminations(index, texts + clean)}
    assert got == {(t, i) for t, (i, _) in enumerate(items)}


def test_longest_run():
    item = "a b c d e f g h i j".split()
    assert dc.longest_run(item, "x a b c d e f y c d e f g h i j z".split()) == 8
    assert dc.longest_run(item, "a b c d x e f g h".split()) == 0
    assert dc.longest_run(["a"] * 12, ["a"] * 9 + ["b"] + ["a"] * 30) == 12
    assert dc.longest_run(["x", "y"], ["x", "y"]) == 2


def dense(index):
    """Impacts as a table of terms and items."""
    out = np.zeros((len(index.terms), index.n_blocks * dc.ITEMS_PER_BLOCK))
    for t in range(len(index.terms)):
        for e in range(index.starts[t], index.starts[t + 1]):
            for p in range(index.postings[e], index.postings[e + 1]):
                out[t, index.blocks[e] * dc.ITEMS_PER_BLOCK + index.slots[p]] = index.impacts[p]
                assert index.impacts[p] <= index.maxima[e] <= index.upper[t]
    return out


@pytest.mark.parametrize("deferred", [0.0, 0.25, 0.9])
def test_pruned_retrieval_matches_scoring_all_items(monkeypatch, deferred):
    monkeypatch.setattr(dc, "DEFERRED", deferred)
    rng = random.Random(2)
    items = benchmark_items(50)
    index = dc.build_index(items)
    assert (np.diff(index.upper) >= 0).all()
    texts = [dc.tokens(" ".join(rng.sample(" ".join(t for _, t in rng.sample(items, 3)).split(), 40))) for _ in range(60)] + [[], ["nothing"], ["the"] * 3000]
    got = {(t, j): s for t, j, s in dc.retrieve(index, texts)}
    table, step, want = dense(index), index.passage // 2, {}
    for t, words in enumerate(texts):
        for low in range(-step, len(words), step):
            terms = {index.terms[w] for w in words[max(0, low) : low + 2 * step] if w in index.terms}
            scores = table[sorted(terms)].sum(axis=0)
            for j in np.flatnonzero(scores >= 1):
                want[t, int(j)] = max(want.get((t, int(j)), 0), scores[j])
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_partitions_of_the_index_change_nothing(spark, documents, monkeypatch):
    items = benchmark_items(60)
    rng = random.Random(3)
    texts = [" ".join(rng.sample(t.split(), 6) + t.split()[: 4 + i % 20] + ["w%d" % rng.randrange(3000) for _ in range(90)]) for i, (_, t) in enumerate(items)]
    bench, docs = spark.createDataFrame([*items, items[3], (None, "x y"), (77, None), (78, "!")], ITEM), documents(texts + ["w1 w2 w3", None, ""])
    whole = dc.write_index
    want = sorted(map(tuple, dc.find_leaks(docs, bench).collect()))
    kept = sorted(r.doc_id for r in dc.drop_contaminated(docs, bench).collect())
    assert len(want) > 20 and len(whole(bench)) == 1
    sizes = []
    for words, held in ((300, 256 << 20), (300, 0), (1, 0)):
        monkeypatch.setattr(dc, "write_index", lambda b, w=words: sizes.append(whole(b, w)) or sizes[-1])
        monkeypatch.setattr(dc, "HELD_BYTES", held)
        got = sorted(map(tuple, dc.find_leaks(docs, bench).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-12)
        assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench).collect()) == kept
    assert 5 <= len(sizes[0]) < 40 and len(sizes[-1]) > 40 and max(n for _, n in sizes[0]) < max(n for _, n in whole(bench))


def test_leaks_of_repeated_rows_empty_tables_and_clashing_columns(spark, documents):
    items = benchmark_items(30)
    rows = [(7, items[0][1], None, None), (7, items[0][1], None, None), (7, items[1][1], None, None), (None, items[2][1], None, None), (None, items[3][1], None, None)]
    bench = spark.createDataFrame(items, ITEM)
    df = documents(rows).selectExpr("*", "1 AS item_id", "'x' AS Text", "0 AS score")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench).collect()} == {(7, 0), (7, 1), (None, 2), (None, 3)}
    assert dc.drop_contaminated(df, bench).columns == df.columns and dc.drop_contaminated(df, bench).count() == 0
    docs = documents([t for _, t in items])
    assert dc.drop_contaminated(docs, bench).count() == 0
    none = spark.createDataFrame([], ITEM)
    assert dc.find_leaks(docs, none).collect() == [] and dc.drop_contaminated(docs, none).count() == 30
    assert dc.find_leaks(documents([]), bench).collect() == []


def test_question_and_answer():
    q, a = dc.question_and_answer("One two three four five six. Seven eight nine ten eleven.")
    assert (q[-1], a[0]) == ("six", "seven")
    assert dc.question_and_answer("just a few") == (["just", "a", "few"],) * 2


def test_shards(documents, spark):
    rows = [(i, ("t%d " % i) * (i % 50), "en", "s") for i in range(500)] + [(7, "same", "en", "s")] * 30 + [(None, None, None, None)]
    got = sharding.shard_digest(documents(rows, 5)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert set(slots) == set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_digest(documents(rows, 5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_shards_of_many_buckets_are_shuffled_and_keep_columns(spark, documents):
    df = documents(["x" * 100 for _ in range(800)]).withColumnRenamed("n_chars", "Slot")
    got = sharding.shard_documents(df, 4, bucket_bytes=2000)
    assert got.columns == ["doc_id", "text", "lang", "source", "shard", "slot"]
    order = [r.doc_id for r in got.orderBy("slot", "shard").collect()]
    assert sorted(order) == list(range(800))
    assert abs(np.corrcoef(order, range(800))[0, 1]) < 0.2
    assert sharding.shard_documents(df.limit(0)).collect() == []


def water_fill(sizes):
    """Targets by resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        level = left / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mix(documents):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(200))), None, rng.choice(["a", "B", "é", None, "hot", "hot", "hot", "z"])) for i in range(900)]
    rows += [(10_000, None, None, "empty"), (10_001, "x " * 40_000, None, "long"), (10_002, "same id", None, "a"), (10_002, "same id", None, "a")]
    got = mixing.mix_digest(documents(rows)).collect()
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(sizes)
    source = {d: s for d, _, _, s in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").split())) for d, t, *_ in rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert want[s] - 1200 <= taken[s] <= want[s] + 1


def test_small_sources_reach_their_targets(documents):
    # 149 sources of a block or a few beside a large one share 64 spare slots and 2 %
    rows = [(i, "w " * (40 + 90 * (i % 4)), None, "s%03d" % i) for i in range(150)] + [(1000 + i, "w " * 4000, None, "large") for i in range(100)]
    sizes = {s: 0 for _, _, _, s in rows}
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want, taken = water_fill(sizes), Counter()
    docs = documents(rows)
    source = {d: s for d, _, _, s in rows}
    for r in mixing.mix_digest(docs).collect():
        taken[source[r.doc_id]] += r.taken
    assert all(want[s] - 1.001 <= taken[s] <= want[s] + 0.001 for s in sizes)
    con = connect("/root/testdata/sf0.001")
    con.register("few_words", docs.toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM few_words")
    assert difference(mixing.mix_digest(docs), con, mixing.MIX_SQL) is None
    assert {r.source for r in mixing.mix_documents(docs).collect()} == set(sizes)
    targets = mixing.source_targets(docs.sparkSession.createDataFrame(list(sizes.items()), "source string, source_size long"))
    slots = mixing.schedule(docs.sparkSession, targets, sum(want.values())).collect()
    assert len({r.slot for r in slots}) == len({(r.sid, r.block) for r in slots}) == len(slots)


def test_mixed_documents_and_empty_tables(documents):
    rows = [(i, "w " * 50, "en", "ab"[i % 2]) for i in range(400)]
    docs = documents(rows)
    counts = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    by = Counter(rows[d][3] for d in counts.elements())
    assert set(counts.values()) <= {1, 2} and by["a"] == 400 and 180 <= by["b"] <= 202
    for empty in (documents([]), documents([None, ""])):
        assert mixing.mix_documents(empty).columns == docs.columns and mixing.mix_documents(empty).count() == 0
    assert mixing.mix_digest(documents([])).collect() == []
    assert [r.taken for r in mixing.mix_digest(documents([None, ""])).collect()] == [0, 0]


def test_mix_plan_has_no_python(spark, sf_dir, capsys):
    queries.QUERIES["op9_mixing"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("keys_per_part", [200_000, 37])
def test_cascade_is_exact(spark, keys_per_part):
    rng = random.Random(4)
    names = [f"host{rng.randrange(10**9)}.net" for _ in range(1500)]
    listed = set(names[:400])
    universe = spark.createDataFrame([(n,) for n in [*names, *names[:50]]] + [(None,)], "key string")
    cascade, parts = url_filter.build_cascade(universe, spark.createDataFrame([(n,) for n in listed], "key string"), keys_per_part)
    got = url_filter.listed_by_cascade(universe, cascade, parts).collect()
    assert len(got) == 1551 and all(r.listed == (r.key in listed) for r in got)
    assert cascade.agg({"level": "max"}).first()[0] >= 1
    assert cascade.selectExpr("sum(octet_length(bits))").first()[0] < 1500 * 3


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
        "https://x.org?a://b/c": ("x.org", "", None, "allow"),
        "ftp://notorg/fr/": ("notorg", "/fr/", None, "allow"),
        "a://com/fr/#x": ("com", "/fr/", "com/fr/", "allow"),
        "a://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "a://www.casino.net/": ("www.casino.net", "/", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a\n://h/p\nq": ("h", "/p\nq", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, host int").repartition(3)
    got = {r.page_id: r[1:] for r in url_filter.judge_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge_urls(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None


def test_stages_and_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count, ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = {r.doc_id for r in out.select("doc_id").collect()}
        assert got <= ids and len(got) > 0.6 * count, name
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert list(got.columns) == [*docs.columns, "shard", "slot"]
    assert (got.groupby("shard").slot.max() + 1 == got.groupby("shard").slot.count()).all()
    leaked = {r.doc_id for r in queries.QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    assert leaked and not leaked & set(got.doc_id)


def test_stages_of_empty_and_odd_documents(spark, sf_dir, documents):
    odd = documents([(1, None, None, None), (2, "", "en", None), (3, "words and more words", "en", "s"), (None, "other words", "en", "s")])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), sf_dir).count() == 0
        assert stage(spark, odd, sf_dir).columns[:5] == odd.columns
    kept = corpus_pipeline.STAGES[0][1](spark, odd, sf_dir)
    assert {r.doc_id for r in kept.collect()} == {3, None}


def test_memory_for_passages_with_long_lists_is_bounded(monkeypatch):
    rng = random.Random(6)
    # every block has most of these words, so a passage's terms have lists of nearly all blocks
    vocabulary = ["v%d" % i for i in range(120)]
    items = [(i, " ".join(rng.sample(vocabulary, 100) + ["own%d_%d" % (i, j) for j in range(40)])) for i in range(120)]
    index = dc.build_index(items)
    texts = [rng.choices(vocabulary, k=600) for _ in range(200)] + [dc.tokens(items[9][1]), [], dc.tokens(items[70][1])]
    tracemalloc.start()
    try:
        got = dc.retrieve(index, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {(t, i) for t, i, _ in got} >= {(200, 9), (202, 70)}
    assert peak < 100 << 20
    for most in (1 << 14, 1 << 25):
        monkeypatch.setattr(dc, "ENTRIES_AT_ONCE", most)
        assert [r[:2] for r in dc.retrieve(index, texts[-20:])] == [(t - len(texts) + 20, i) for t, i, _ in got if t >= len(texts) - 20]
