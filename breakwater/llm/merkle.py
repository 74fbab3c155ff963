"""Merkle manifest of a dataset, kept as postorder append logs.

Leaves of a tree are numbered, and dealt to builders that own aligned runs of ``2 ** BITS``
leaves. A builder appends nodes in the order in which they are completed: a leaf, then every
node that it closes. So a node stands where its subtree ends, and its place follows from its
level and number alone: a tree of ``n`` leaves has ``2 n - popcount(n)`` full nodes. Siblings are
addressed by these places, no search. Roots of builders are the leaves of the next tier.

A tree for each key (language), and one over the keys' roots. Nodes that have no sibling are
hashed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakwater.llm import common

#: A builder owns 2 ** BITS leaves.
BITS = 8
#: Rows of the table of ranges, one for each pair of task and key, that may be broadcast.
BROADCAST_RANGES = 200_000
#: Digests are kept as bytes of this length and hashed as hexadecimal text.
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def height(leaves: int) -> int:
    """Levels over the leaves of a tree."""
    return (leaves - 1).bit_length()


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The nodes of an aligned subtree of ``levels`` levels in the order of their completion; its root is last."""
    log, open_ = [], []
    for node in leaves:
        log.append(node)
        level = 0
        while open_ and open_[-1][0] == level:
            node = digest(open_.pop()[1], node)
            log.append(node)
            level += 1
        open_.append((level, node))
    while len(open_) > 1 or open_[0][0] < levels:
        level, node = open_.pop()
        node = digest(open_.pop()[1], node) if open_ and open_[-1][0] == level else digest(node)
        log.append(node)
        open_.append((level + 1, node))
    return b"".join(log)


def place(level: int, index: np.ndarray, leaves: int) -> np.ndarray:
    """Places in the log of nodes, by level and number, in closed form.

    A full node ends its own leaves: the nodes completed before it are those of the leaves before,
    twice their number less its set bits, and those of its subtree. Nodes that reach past the last
    leaf are completed when the log is closed, in the order of their levels.
    """
    index = np.asarray(index, np.int64)
    full = 2 * (index << level) - np.bitwise_count(index).astype(np.int64) + (2 << level) - 2
    zeros = (leaves & -leaves).bit_length() - 1
    closing = 2 * leaves - leaves.bit_count() + level - zeros - 1
    return np.where((index + 1) << level <= leaves, full, closing)


def siblings(log: bytes, leaves: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf (row) and level (column) the sibling's digest, and its side: 1 right, 2 left, 0 none."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, SIZE)
    out, side = np.zeros((leaves, levels, SIZE), np.uint8), np.zeros((leaves, levels), np.uint8)
    for level in range(levels):
        own = np.arange(leaves) >> level
        other = own ^ 1
        there = other < -(-leaves >> level)
        out[there, level] = nodes[place(level, other[there], leaves)]
        side[:, level] = np.where(there, 1 + (own & 1), 0)
    return out, side


def _leaves(log: bytes, leaves: int) -> np.ndarray:
    return np.frombuffer(log, np.uint8).reshape(-1, SIZE)[place(0, np.arange(leaves), leaves)]


def _path(found: np.ndarray, side: np.ndarray) -> bytes:
    """A path in bytes: for each level the side and the digest (zeros if there is none)."""
    return np.concatenate([side[:, None], found], axis=1).tobytes()


def _steps(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[i], path[i + 1 : i + 1 + SIZE]) for i in range(0, len(path), 1 + SIZE)]


def fold(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for side, other in steps:
        node = digest(node) if side == 0 else digest(node, other) if side == 1 else digest(other, node)
    return node


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, each row's number in its ``tree`` by ``order``, from 0, and ``leaves``, how many there are.

    Rows are dealt out by ranges of tree and order, so a tree that holds most rows is spread;
    numbers are places in a range plus the sizes of the ranges before it. Ties end by a number
    given to each row beforehand.
    """
    spark = nodes.sparkSession
    keys = ["tree", *order, "tie"]
    first, at_first = common.write_table(nodes.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    dealt = first.repartitionByRange(max(common.parts(spark), 1), *keys).sortWithinPartitions(*keys)
    rows, _ = common.write_table(dealt.withColumn("at", F.monotonically_increasing_id()), "leaves")
    common.drop_table(spark, at_first)
    rows = rows.withColumn("range", F.shiftrightunsigned("at", 33))
    ranges = rows.groupBy("tree", "range").agg(F.count("*").alias("k"), F.min("at").alias("start"))
    before, whole = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    ranges = ranges.select("tree", "range", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("start")).alias("shift"), F.sum("k").over(whole).alias("leaves"))
    ranges, _ = common.write_table(ranges, "ranges")
    few = ranges.count() <= BROADCAST_RANGES
    return rows.join(F.broadcast(ranges) if few else ranges, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("tie", "at", "range", "shift")


def _levels(leaves: int, tier: int, bits: int) -> int:
    """Levels of a builder of a tier."""
    return min(bits, height(leaves) - tier * bits)


def build(nodes: DataFrame, payload: list[str], bits: int = BITS) -> list[DataFrame]:
    """Append logs of all trees of ``nodes(tree, pos, leaves, node, ..payload)``, one table for each tier.

    A row is one builder's: ``tree, block, leaves`` (of the tree), ``log``, ``root`` and, in the first tier,
    the payload of its leaves in order. Each tier is written to the shared folder.
    """
    most = nodes.agg(F.max("leaves")).first()[0] or 0
    tiers: list[DataFrame] = []
    for tier in range(max(1, -(-height(most) // bits)) if most else 1):
        if tier:
            below = tiers[-1].where(F.col("leaves") > 1 << tier * bits)
            nodes, payload = below.select("tree", F.col("block").alias("pos"), "leaves", F.col("root").alias("node")), []
        items = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "leaves", F.struct("pos", "node", *payload).alias("item"))
        tiers.append(common.write_table(_built(items, payload, tier, bits), f"tier{tier}")[0])
    return tiers


def _built(items: DataFrame, payload: list[str], tier: int, bits: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in items.schema["item"].dataType}
    columns = ["tree", "block", "leaves", "log", "root", *payload]

    def run(table: pa.Table) -> pa.Table:
        item = table.column("item").combine_chunks()
        order = np.argsort(item.field("pos").to_numpy(zero_copy_only=False), kind="stable")
        leaves = table.column("leaves")[0].as_py()
        log = append_log([n for n in item.field("node").take(pa.array(order)).to_pylist()], _levels(leaves, tier, bits))
        head = [table.column("tree").slice(0, 1), table.column("block").slice(0, 1), table.column("leaves").slice(0, 1), pa.array([log], pa.binary()), pa.array([log[-SIZE:]], pa.binary())]
        rest = []
        for name in payload:
            values = item.field(name).take(pa.array(order))
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            rest.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.Table.from_arrays([*head, *rest], names=columns)

    return items.groupBy("tree", "block").applyInArrow(run, "tree string, block long, leaves long, log binary, root binary" + "".join(f", {p} array<{kinds[p]}>" for p in payload))


def _own(log: bytes, block: int, leaves: int, tier: int, bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Leaves of a builder, their siblings and sides."""
    there = -(-leaves >> tier * bits)  # nodes of the tier in the whole tree
    mine = min(1 << bits, there - (block << bits))
    return mine, *siblings(log, mine, _levels(leaves, tier, bits))


def paths(tiers: list[DataFrame], above: DataFrame, bits: int = BITS) -> DataFrame:
    """``tree, block, path, subroot, root`` of each builder of the first tier: the way from its root to the top.

    ``above`` has ``tree, path, subroot, root``, the way from the roots of trees. The tiers are
    walked from the top; a tier adds a row for each of its leaves.
    """
    found = None
    for tier in range(len(tiers) - 1, -1, -1):
        tops = tiers[tier].where(F.col("leaves") <= 1 << (tier + 1) * bits).select("tree", "block").join(above, "tree")
        found = tops if found is None else tops.unionByName(found)
        if tier:
            segments = tiers[tier].select("tree", "block", "leaves", "log").join(found, ["tree", "block"])

            def run(batches: Iterator[pa.RecordBatch], tier=tier) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in b.to_pylist():
                        mine, others, side = _own(r["log"], r["block"], r["leaves"], tier, bits)
                        rows = [_path(others[i], side[i]) + r["path"] for i in range(mine)]
                        first = r["block"] << bits
                        same = lambda v, kind: pa.array([v] * mine, kind)
                        yield pa.RecordBatch.from_arrays([same(r["tree"], pa.string()), pa.array(range(first, first + mine), pa.int64()), pa.array(rows, pa.binary()), same(r["subroot"], pa.binary()), same(r["root"], pa.binary())], ["tree", "block", "path", "subroot", "root"])

            found = segments.mapInArrow(run, "tree string, block long, path binary, subroot binary, root binary")
    return found


def leaf_of(row: dict):
    """The leaf's digest of a row of columns, as bytes."""
    parts = []
    for name in FIELDS:
        value = row[name].cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(docs: DataFrame, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """Logs of the trees of ``docs``, one for each language, by tier, and for each language ``tree, path, subroot, root``.

    A tree's name is 0 for a null language, else 1 and the language, so that names sort as the
    languages do. The first tier also holds ids and tampered leaves.
    """
    columns = {name: F.col(name) for name in FIELDS}
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, leaf_of(columns | {"n_chars": F.col("n_chars") + 1}))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    leaves = numbered(docs.select(tree.alias("tree"), "doc_id", leaf_of(columns).alias("node"), tampered.alias("tampered")), ["doc_id", "node"])
    tiers = build(leaves, ["doc_id", "tampered"], bits)
    roots = None
    for tier, table in enumerate(tiers):
        last = 1 << (tier + 1) * bits
        done = table.where((F.col("leaves") <= last) & ((F.col("leaves") > last >> bits) if tier else F.lit(True))).select("tree", "root")
        roots = done if roots is None else roots.union(done)
    forest = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), ["name"])
    logs = build(forest, ["name"], bits)
    top = logs[-1].select("tree", F.lit(b"").alias("path"), F.col("root").alias("subroot"), "root")
    ways = logs[0].join(paths(logs, top, bits), ["tree", "block"]).select("block", "leaves", "log", "name", "path", "subroot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                mine, others, side = _own(r["log"], r["block"], r["leaves"], 0, bits)
                rows = [_path(others[i], side[i]) + r["path"] for i in range(mine)]
                own = [n.tobytes() for n in _leaves(r["log"], mine)]
                yield pa.RecordBatch.from_arrays([pa.array(r["name"], pa.string()), pa.array(rows, pa.binary()), pa.array(own, pa.binary()), pa.array([r["subroot"]] * mine, pa.binary())], ["tree", "path", "subroot", "root"])

    return tiers, ways.mapInArrow(run, "tree string, path binary, subroot binary, root binary")


def proofs(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the digest of id, source, language, length and text. Leaves of a language ascend
    by id, equal ids by their leaves (equal rows are interchangeable). Where 7 divides the CRC of the id, ``folded_root`` starts
    from a row whose ``n_chars`` is one more (a null stays null, so such a row verifies).
    Any column may be null; a null id comes first and is never tampered with; empty and very
    long texts are hashed in the executors as they are; an empty table gives an empty result;
    other columns are not read.
    """
    tiers, above = manifest(docs, bits)
    way = paths(tiers, above, bits)
    df = tiers[0].select("tree", "block", "leaves", "log", "doc_id", "tampered").join(way, ["tree", "block"])
    kind = tiers[0].schema["doc_id"].dataType.elementType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.schema.field("doc_id").type.value_type
            for r in b.to_pylist():
                mine, others, side = _own(r["log"], r["block"], r["leaves"], 0, bits)
                nodes = _leaves(r["log"], mine)
                upper = _steps(r["path"])
                rest = "".join(d.hex() for s, d in upper if s)
                root, subroot = r["root"].hex(), r["subroot"].hex()
                leaf, proof, folded = [], [], []
                for i in range(mine):
                    node = nodes[i].tobytes()
                    steps = [(int(s), others[i, k].tobytes()) for k, s in enumerate(side[i])]
                    leaf.append(node.hex())
                    proof.append(hashlib.sha256(("".join(d.hex() for s, d in steps if s) + rest).encode()).hexdigest())
                    folded.append(fold(r["tampered"][i] or node, steps + upper).hex())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"], id_type), pa.array(leaf), pa.array([subroot] * mine), pa.array([root] * mine), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])], names)

    return df.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def oracle_sql() -> str:
    """The manifest by recursive halving of whole trees; CRC by its polynomial, bit by bit."""
    crc = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x : CAST(ascii(x) AS BIGINT)), lambda c, b : list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k : xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
    leaf = "sha256(" + " || ".join(field.format(n) for n in FIELDS) + ")"
    changed = leaf.replace("n_chars", "(n_chars + 1)")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {changed} END AS bad FROM documents),
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM v
    UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), max((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, level, pos // 2),
s AS (SELECT lang, level AS h, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
f AS (SELECT 0 AS level, pos, subroot AS node, n FROM s
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), max((n + 1) // 2) FROM f WHERE n > 1 GROUP BY level, pos // 2),
r AS (SELECT node AS root, level AS top FROM f WHERE n = 1),
a AS (SELECT v.doc_id, v.lang, v.pos, v.leaf, s.subroot, s.h, s.pos AS spot, r.root, r.top, coalesce(v.bad, v.leaf) AS start FROM v JOIN s ON v.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r),
w AS (SELECT doc_id, lang, pos, leaf, subroot, root, h, spot, top, 0 AS level, start AS node, '' AS others FROM a
    UNION ALL SELECT w.doc_id, w.lang, w.pos, w.leaf, w.subroot, w.root, w.h, w.spot, w.top, w.level + 1,
        sha256(CASE WHEN o.node IS NULL THEN w.node WHEN (CASE WHEN w.level < w.h THEN w.pos >> w.level ELSE w.spot >> (w.level - w.h) END) % 2 = 0 THEN w.node || o.node ELSE o.node || w.node END), w.others || coalesce(o.node, '')
    FROM w LEFT JOIN (SELECT lang, level, pos, node, 0 AS upper FROM t UNION ALL SELECT NULL, level, pos, node, 1 FROM f) o
        ON (w.level < w.h AND o.upper = 0 AND o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.pos = xor(w.pos >> w.level, 1))
        OR (w.level >= w.h AND o.upper = 1 AND o.level = w.level - w.h AND o.pos = xor(w.spot >> (w.level - w.h), 1))
    WHERE w.level < w.h + w.top)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, node AS folded_root, node = root AS verified FROM w WHERE level = h + top"""
