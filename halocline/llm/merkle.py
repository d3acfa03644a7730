"""Merkle manifest of a dataset with octopus multiproofs.

Each row is a leaf, the digest of its fields.  The leaves of a language, by document id, are the bottom of a tree in which every
run of eight nodes has a digest; the roots of the languages are the bottom of one more tree.  Trees are built from the leaves up, ``LEVELS`` levels in a round:
one task takes the nodes under one node of the topmost of these levels, so no task sees more than ``FAN ** LEVELS`` of them however large a language is.

Proofs are made by leaf partition.  The octopus of a partition is the least set of nodes that it can't derive: level by level, the other
members of the runs that its own nodes stand in.  Their coordinates are worked out from positions alone, the nodes are fetched
by one join, and the task then derives the interiors that its leaves share and writes out each leaf's proof by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from halocline.llm.frames import crc32_sql, pick
from halocline.operators import ordering
from halocline.operators.keys import attach, lookup_join
from halocline.storage import materialise

FAN = 8  # fixed value of the manifest: nodes of a run
LEVELS = 4  # built in one round, so a task holds FAN ** LEVELS digests
LEAVES_PER_PART = 1 << 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 3  # every row whose checksum it divides is tampered with
TOP = -1  # number of the tree over the languages; languages count from 0

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: Iterable[str]) -> str:
    """H: lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    """``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): each row's digest and, where the row is tampered with, that of the row it is then."""
    rows = pick(docs, *FIELDS)
    fields = [_field(F.col(c)) for c in FIELDS]
    lowered = _field(F.translate("text", CAPITALS, CAPITALS.lower()))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return rows.select(
        "doc_id",
        "lang",
        F.sha2(F.concat(*fields), 256).alias("leaf"),
        F.when(hit, F.sha2(F.concat(*fields[:-1], lowered), 256)).alias("tampered"),
    )


def _above(tree: int, level: int, start: int, nodes: list[str], count: int) -> Iterator[tuple]:
    """Interior nodes over neighbouring ``nodes`` of a tree with ``count`` nodes on their level, up to LEVELS levels."""
    for _ in range(LEVELS):
        if count == 1:
            return
        nodes = [digest(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        level, start, count = level + 1, start // FAN, -(-count // FAN)
        yield from ((tree, level, start + i, node) for i, node in enumerate(nodes))


NODE = "tree long, level int, idx long, node string"
_NODE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
_NODE_NAMES = ["tree", "level", "idx", "node"]


def _nodes(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES)], names=_NODE_NAMES)


def build_trees(bottom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes over the bottom (tree, idx, node, n), bottom included, and (tree, root) of each tree.

    ``n`` is the tree's number of bottom nodes.  The driver learns the largest of them, for the number of rounds.
    """
    most = bottom.agg(F.max("n")).first()[0] or 0

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, level, n = (table.column(c)[0].as_py() for c in ("tree", "level", "n"))
        for _ in range(level):
            n = -(-n // FAN)
        return _nodes(list(_above(tree, level, table.column("idx")[0].as_py(), table.column("node").to_pylist(), n)))

    now = bottom.select("tree", F.lit(0).alias("level"), "idx", "node", "n")
    sizes = bottom.groupBy("tree").agg(F.max("n").alias("n"))
    every, level = [now.select(*_NODE_NAMES)], 0
    while most > 1:
        under = F.floor(F.col("idx") / FAN**LEVELS)
        made = materialise(now.groupBy("tree", under).applyInArrow(build, NODE), "merkle-nodes")
        every.append(made)
        level, most = level + LEVELS, -(-most // FAN**LEVELS)
        now = lookup_join(made.filter(F.col("level") == level), sizes, ["tree"], null_safe=False).select("tree", "level", "idx", "node", "n")
    nodes = every[0]
    for more in every[1:]:
        nodes = nodes.unionByName(more)
    # the highest node of a tree is its only one on that level
    roots = nodes.groupBy("tree").agg(F.max_by("node", "level").alias("root"))
    return nodes, roots


def octopus(own: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """The nodes (level, indexes) that a holder of the bottom nodes ``own`` of a tree misses to derive its root."""
    level, own = 0, np.unique(own)
    while count > 1:
        runs = np.unique(own // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        members = members[members < count]
        missing = np.setdiff1d(members, own, assume_unique=True)
        if len(missing):
            yield level, missing
        level, own, count = level + 1, runs, -(-count // FAN)


def _siblings(known: dict, tree: int, idx: int, count: int) -> Iterator[tuple[int, list[str]]]:
    """(place in its run, other members) of a bottom node and of each node above it, below the root."""
    level = 0
    while count > 1:
        first = idx - idx % FAN
        run = [known[tree, level, j] for j in range(first, min(first + FAN, count)) if j != idx]
        yield idx - first, run
        level, idx, count = level + 1, idx // FAN, -(-count // FAN)


def _derive(known: dict, tree: int, own: Iterable[int], count: int) -> None:
    """Fill in the interiors over bottom nodes whose runs are all known."""
    level, own = 0, sorted(set(own))
    while count > 1:
        runs = sorted({i // FAN for i in own})
        for r in runs:
            known[tree, level + 1, r] = digest(known[tree, level, j] for j in range(r * FAN, min((r + 1) * FAN, count)))
        level, own, count = level + 1, runs, -(-count // FAN)


def _folded(node: str, path: Iterable[tuple[int, list[str]]]) -> str:
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether the row as it is after tampering still proves the root.

    Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); ``folded_root`` uses the tampered leaf where there is one.  A null field
    is ``-``; a null doc_id sorts first and isn't tampered with, a null lang is a tree of its own.  Rows of one doc_id are ordered by
    leaf, so repeated rows are neighbours; an empty table gives no rows.  Further columns don't matter.
    """
    id_type = pick(docs, "doc_id").schema["doc_id"].dataType
    leaves = materialise(leaves_of(docs), "merkle-leaves")
    # positions over all rows by (lang, doc_id, leaf): a language is a range of them
    order = ["lang", "doc_id", "leaf"]
    placed = materialise(ordering.ranked(leaves, order, rank="at"), "merkle-placed")
    langs = placed.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    langs = materialise(ordering.ranked(langs, ["lang"], rank="tree"), "merkle-langs")
    n_langs = F.lit(langs.count())
    rows = lookup_join(placed, langs, ["lang"])
    rows = rows.withColumns({"idx": F.col("at") - F.col("first"), "part": F.floor(F.col("at") / LEAVES_PER_PART)}).drop("at", "first", "lang")
    rows = materialise(rows, "merkle-rows")

    nodes, subroots = build_trees(rows.select("tree", "idx", F.col("leaf").alias("node"), "n"))
    subroots = materialise(subroots, "merkle-subroots")
    top, roots = build_trees(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("node"), n_langs.alias("n")))
    nodes = nodes.unionByName(top)

    # what each partition of leaves misses: from ranges of positions, one row for each partition and language
    spans = rows.groupBy("part", "tree").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.first("n").alias("n"))
    spans = spans.withColumn("langs", n_langs)

    def missing(table: pa.Table) -> pa.Table:
        found = []
        part, langs = table.column("part")[0].as_py(), table.column("langs")[0].as_py()
        trees = table.column("tree").to_pylist()
        for tree, low, high, n in zip(trees, *[table.column(c).to_pylist() for c in ("low", "high", "n")]):
            found += [(tree, level, idx) for level, idx in octopus(np.arange(low, high + 1), n)]
        found += [(TOP, level, idx) for level, idx in octopus(np.array(trees), langs)]
        size = [len(x[2]) for x in found]
        columns = {
            "part": pa.array([part] * sum(size), pa.int64()),
            "tree": pa.array(np.repeat([x[0] for x in found], size).astype(np.int64)),
            "level": pa.array(np.repeat([x[1] for x in found], size).astype(np.int32)),
            "idx": pa.array(np.concatenate([x[2] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)),
        }
        return pa.table(columns)

    wanted = spans.groupBy("part").applyInArrow(missing, "part long, tree long, level int, idx long")
    fetched = wanted.join(nodes, ["tree", "level", "idx"]).select("part", *_NODE_NAMES)
    # the trees' roots close the fold of every row
    own = lookup_join(spans.select("part", "tree"), subroots, ["tree"], null_safe=False)
    own = own.select("part", "tree", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("root").alias("node"))
    root = roots.select("root")
    mine = rows.select("part", "doc_id", "tree", "idx", "n", "leaf", "tampered")
    schema = f"doc_id {id_type.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string"
    id_arrow = to_arrow_type(id_type)

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        known, subs = {}, {}
        for tree, level, idx, node in zip(*[right.column(c).to_pylist() for c in _NODE_NAMES]):
            if level < 0:
                subs[tree] = node
            else:
                known[tree, level, idx] = node
        trees, at, counts, digests, tampered = (left.column(c).to_pylist() for c in ("tree", "idx", "n", "leaf", "tampered"))
        sizes, held = dict(zip(trees, counts)), {}
        for tree, i, leaf in zip(trees, at, digests):
            known[tree, 0, i] = leaf
            held.setdefault(tree, []).append(i)
        for tree, own in held.items():
            _derive(known, tree, own, sizes[tree])
            known[TOP, 0, tree] = subs[tree]
        langs = left.column("langs")[0].as_py()
        _derive(known, TOP, held, langs)
        upper = {tree: list(_siblings(known, TOP, tree, langs)) for tree in held}
        out = []
        for tree, i, n, leaf, changed in zip(trees, at, counts, digests, tampered):
            path = [*_siblings(known, tree, i, n), *upper[tree]]
            proof = digest(node for _, others in path for node in others)
            out.append((leaf, subs[tree], proof, _folded(changed or leaf, path)))
        columns = [pa.array(c, pa.string()) for c in zip(*out)]
        return pa.table([left.column("doc_id").combine_chunks().cast(id_arrow), *columns], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    pairs = mine.withColumn("langs", n_langs).groupBy("part").cogroup(fetched.unionByName(own).groupBy("part"))
    proofs = pairs.applyInArrow(prove, schema)
    out = attach(proofs, root, [])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(column: str, value: str | None = None) -> str:
    text = f"CAST({value or column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _tree_sql(name: str, bottom: str) -> str:
    """All nodes (tree, level, idx, node, n) over a bottom, where n counts the nodes of the level."""
    return (
        f"{name} AS (SELECT tree, 0 AS level, idx, node, n FROM {bottom} UNION ALL SELECT tree, level + 1, idx // {FAN}, "
        f"sha256(string_agg(node, '' ORDER BY idx)), any_value((n + {FAN - 1}) // {FAN}) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {FAN})"
    )


def _steps_sql(nodes: str, own: str, start: int) -> str:
    """Siblings left and right of each row's node on every level of a tree; ``own`` is its place at the bottom."""
    at = f"(p.{own} >> (3 * t.level))"
    side = lambda c: f"coalesce(string_agg(t.node, '' ORDER BY t.idx) FILTER (t.idx {c} {at}), '')"
    return f"SELECT p.rid, {start} + t.level AS k, {side('<')} AS l, {side('>')} AS r FROM rows p JOIN {nodes} t ON t.tree = p.tree_of_{own} AND t.n > 1 AND t.idx // {FAN} = {at} // {FAN} GROUP BY p.rid, t.level"


_FIELDS_SQL = " || ".join(_field_sql(c) for c in FIELDS)
_LOWERED_SQL = " || ".join([*[_field_sql(c) for c in FIELDS[:-1]], _field_sql("text", f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")])

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({_FIELDS_SQL}) AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 THEN sha256({_LOWERED_SQL}) END AS tampered FROM documents),
rows AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    tree AS tree_of_idx, {TOP} AS tree_of_tree FROM leaves),
bottom AS (SELECT tree, idx, leaf AS node, n FROM rows), {_tree_sql("trees", "bottom")},
subroots AS (SELECT {TOP} AS tree, tree AS idx, node, count(*) OVER () AS n FROM trees WHERE n = 1), {_tree_sql("upper_tree", "subroots")},
steps AS ({_steps_sql("trees", "idx", 0)} UNION ALL {_steps_sql("upper_tree", "tree", 1000)}),
paths AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, list({{'l': l, 'r': r}} ORDER BY k) AS path FROM steps GROUP BY rid)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend({{'l': coalesce(tampered, leaf), 'r': ''}}, coalesce(path, [])), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l AS folded_root,
    folded_root = root AS verified
FROM rows q LEFT JOIN paths USING (rid) JOIN subroots s ON s.idx = q.tree JOIN (SELECT node FROM upper_tree WHERE n = 1) t ON true
"""
