"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are 64 bits; two link when at most three bits differ. Of two linked
fingerprints one can reach a common variant by flipping at most one bit and the other by
flipping at most two, so every fingerprint emits its variants within half the radius (one
bit; two bits for those of odd parity, as fingerprints three bits apart differ in parity),
and colliding variants name the links. Every collision is a true link (1 + 2 <= 3); it is
verified all the same.

The shuffle is on a part of the variant, its key bits: a fingerprint is sent once for each
value its variants take there, and the receiving task builds the variants of that value
itself. That moves tens of short rows per distinct fingerprint instead of 2081. Keys widen
with the number of fingerprints, so that a key has at most about ``KEY_ROWS`` rows, and a
task takes its keys in order, a run of whole keys at a time, so it never holds its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.common import connected_components, parts, text_and_id, write_table

#: Least and most bits of a key, and the rows of a key, about.
LEAST_KEY, MOST_KEY, KEY_ROWS = 12, 32, 500_000
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Variants or pairs that a task holds at once.
CHUNK = 200_000


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of one text; 0 for none, an empty one or white space only."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    n, half = len(words) - SHINGLE + 1, 1 << 14
    ones = np.zeros(64, np.int64)
    for at in range(0, n, half):
        part = words[at : at + half + SHINGLE - 1]
        h = np.array([digest(b" ".join(t), SEED) for t in zip(*(part[i:] for i in range(SHINGLE)))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed long) for each row; whole texts, null as empty."""
    df = text_and_id(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint_of(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: (node, its root) for each node that is not a root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    got = [(x, r) for x in up if (r := root(x)) != x]
    return np.array([x for x, _ in got], np.int64), np.array([r for _, r in got], np.int64)


def key_bits(fingerprints: int) -> int:
    """Bits of a key for so many distinct fingerprints: the fewest that keep a key's rows at KEY_ROWS, about."""
    return next((k for k in range(LEAST_KEY, MOST_KEY) if fingerprints * rows_sent(k) <= KEY_ROWS * 2**k), MOST_KEY)


def rows_sent(bits: int) -> float:
    """Rows a fingerprint is sent as, on average: half of them have odd parity."""
    return 1 + bits + bits * (bits - 1) / 4


def _links(fp: np.ndarray, key: np.ndarray, flips: np.ndarray, bits: int = LEAST_KEY) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows (fingerprint, key value of so many bits, key bits flipped), as a forest."""
    fp, one, low = fp.view(np.uint64), np.uint64(1), np.uint64(64 - bits)
    moved = (fp & ((one << low) - one)) | (key.astype(np.uint64) << low)  # the fingerprint with the key bits of this key
    rest = one << np.arange(64 - bits, dtype=np.uint64)
    home = flips == 0
    near = home | (flips == 1)
    variants = np.concatenate([moved[near], (moved[home][:, None] ^ rest).ravel()])
    owners = np.concatenate([fp[near], np.repeat(fp[home], len(rest))])
    if not len(variants):  # two flips only: no variant of the smaller ball can meet them here
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    same = variants[1:] == variants[:-1]
    pairs = [np.unique(np.stack([owners[1:][same], owners[:-1][same]]), axis=1)]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    table, table_owner = variants[first], owners[first]
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(40)
    known = np.zeros(1 << 24, bool)
    known[(table * mix) >> shift] = True

    def probe(v: np.ndarray, who: np.ndarray, times: int) -> None:
        hit = np.flatnonzero(known[(v * mix) >> shift])
        at = np.searchsorted(table, v[hit])
        ok = (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == v[hit])
        if ok.any():
            pairs.append(np.unique(np.stack([who[hit[ok] // times], table_owner[at[ok]]]), axis=1))

    odd = (np.bitwise_count(fp) & 1).astype(bool)
    i, j = np.triu_indices(len(rest), 1)
    two = rest[i] | rest[j]
    for flipped, masks in ((2, np.zeros(1, np.uint64)), (1, rest), (0, two)):
        pick = np.flatnonzero(odd & (flips == flipped))
        step = max(1, CHUNK // len(masks))
        for s in range(0, len(pick), step):
            p = pick[s : s + step]
            probe((moved[p][:, None] ^ masks).ravel(), fp[p], len(masks))
    a, b = np.concatenate(pairs, axis=1)
    ok = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    return _forest(a[ok].view(np.int64), b[ok].view(np.int64))


def _whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the second column, in runs of whole keys of about ``most`` rows (a larger key by itself)."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= most:
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[1], columns[1][-1]))  # the last key may go on
            if cut:
                yield [c[:cut] for c in columns]
            held, n = [[c[cut:] for c in columns]], n - cut
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def sent_rows(distinct: DataFrame, bits: int) -> DataFrame:
    """``fp, key, flips``: a row for each key value that a fingerprint's variants take."""
    one = [1 << i for i in range(bits)]
    two = [x | y for k, x in enumerate(one) for y in one[:k]]
    send = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("flips")) for n, ms in enumerate(([0], one, two)) for m in ms])
    near = F.slice(send, 1, 1 + bits)
    own = F.shiftrightunsigned("fp", 64 - bits)
    sent = distinct.select("fp", F.explode(F.when(F.bit_count("fp") % 2 == 1, send).otherwise(near)).alias("x"))
    return sent.select("fp", own.bitwiseXOR(F.col("x.mask")).alias("key"), F.col("x.flips").cast("byte").alias("flips"))


def fingerprint_links(distinct: DataFrame, bits: int | None = None) -> DataFrame:
    """``a, b``: links (at most three bits) that connect what all links among ``distinct(fp)`` connect.

    ``bits`` of a key follow from the number of rows unless given; the links don't depend on them.
    """
    bits = bits or key_bits(distinct.count())
    sent = sent_rows(distinct, bits).repartition(parts(distinct.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_keys(batches, KEY_ROWS):
            a, b = _links(*columns, bits)
            for at in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, root``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest doc_id reachable by
    links of at most three bits; ``root`` names the component itself. Equal fingerprints
    are one class, compared once. Null and empty texts have fingerprint zero and link like
    others; repeated rows stay; a null doc_id is never the smallest, and a component
    without any other has a null component_id. Empty input gives an empty result; other
    columns are not read.
    """
    table, _ = write_table(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = table.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots, _ = connected_components(fingerprint_links(classes.select("fp")))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.select("fp", "root").join(smallest, "root")
    return table.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


#: Long fingerprints: words of a shingle, 64-bit words, bits of a block, and the
#: most bits in which similar documents differ. A five-word Jaccard similarity of 0.8 (cosine 0.89)
#: leaves 48 of 320 bits apart, give or take 6; one of 0.6 leaves 74.
LONG_SHINGLE, LONG_WORDS, BLOCK_BITS, LONG_RADIUS = 5, 5, 32, 54
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def long_fingerprint(text: str | None) -> np.ndarray:
    """Five signed words: majority bits of five re-mixed hashes of each five-word shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ones, n = np.zeros(64 * LONG_WORDS, np.int64), max(1, len(words) - LONG_SHINGLE + 1)
    if not words:
        return np.zeros(LONG_WORDS, np.int64)
    for at in range(0, n, 1 << 13):
        part = words[at : at + (1 << 13) + LONG_SHINGLE - 1]
        shingles = zip(*(part[i:] for i in range(LONG_SHINGLE))) if len(words) >= LONG_SHINGLE else [words]
        h = np.array([digest(b" ".join(t), SEED) for t in shingles], np.uint64)[:, None] ^ _SALTS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of each range low..high, with the number of their range."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[slice]:
    """Slices of consecutive ranges that together hold about ``most`` integers."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _near_values(values: np.ndarray, byte: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places u < v in the distinct 32-bit ``values`` that agree in a byte and differ in one to three bits."""
    one = np.uint32(1)
    rest = one << np.array([i for i in range(BLOCK_BITS) if i // 8 != byte], np.uint32)
    place = np.arange(len(values))
    variants = np.concatenate([values, (values[:, None] ^ rest).ravel()])
    owners = np.concatenate([place, np.repeat(place, len(rest))])
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    pairs = []
    for apart in range(1, len(rest) + 1):  # a variant has at most as many owners as bits, and one
        same = np.flatnonzero(variants[apart:] == variants[:-apart])
        if not len(same):
            break
        pairs.append(np.stack([owners[same], owners[same + apart]]))
    mix, shift = np.uint32(0x9E3779B1), np.uint32(10)
    known = np.zeros(1 << 22, bool)
    known[(variants * mix) >> shift] = True
    i, j = np.triu_indices(len(rest), 1)
    two = rest[i] | rest[j]
    odd = np.flatnonzero(np.bitwise_count(values) & 1)
    step = CHUNK // len(two)
    for s in range(0, len(odd), step):
        p = odd[s : s + step]
        v = (values[p][:, None] ^ two).ravel()
        hit = np.flatnonzero(known[(v * mix) >> shift])
        v = v[hit]
        row, at = _ranges(np.searchsorted(variants, v), np.searchsorted(variants, v, "right"))
        pairs.append(np.stack([p[hit[row] // len(two)], owners[at]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    got = np.unique(np.minimum(a, b)[a != b] * len(values) + np.maximum(a, b)[a != b])
    return got // max(1, len(values)), got % max(1, len(values))


def _similar(node: np.ndarray, words: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all pairs of one task's rows connect that share a slot and differ in at most LONG_RADIUS bits, as (node, its root).

    Of every two nodes whose blocks differ in at most three bits all are compared, except
    those that links already found connect; so a dense group costs about its size, and no
    node is hidden behind another.
    """
    ids, where = np.unique(node, return_inverse=True)
    full = np.empty((len(ids), LONG_WORDS), np.uint64)
    full[where] = words
    up = list(range(len(ids)))
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        near = np.bitwise_count(full[a] ^ full[b]).sum(axis=1, dtype=np.int64) <= LONG_RADIUS
        if near.any():
            for x, y in zip(a[near].tolist(), b[near].tolist()):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
            root = np.array(up)
            while (root[root] != root).any():
                root = root[root]

    for k in np.unique(slot):
        own = np.unique(where[slot == k])
        word, half = divmod(int(k) // 4, 2)
        block = (full[own, word] >> np.uint64(32 * half)).astype(np.uint32)
        values, of = np.unique(block, return_inverse=True)
        u, v = _near_values(values, int(k) % 4)
        each = np.arange(len(values))
        u, v = np.concatenate([each, u]), np.concatenate([each, v])
        start = np.searchsorted(of, each, sorter=(order := np.argsort(of, kind="stable")))
        end = np.append(start[1:], len(own))
        members = own[order]
        for x, y in ((u, v), (v, u)):  # the first node of one value with all of the other
            for part in _chunks(end[y] - start[y]):
                row, at = _ranges(start[y[part]], end[y[part]])
                compare(members[start[x[part]]][row], members[at])
        many = np.minimum(end[u] - start[u], end[v] - start[v]) > 1
        u, v = u[many], v[many]
        key = of[order] * len(ids) + root[members]
        order = np.argsort(key, kind="stable")
        members, key = members[order], key[order]
        for part in _chunks(end[u] - start[u]):
            row, at = _ranges(start[u[part]], end[u[part]])
            x, y, twin = members[at], v[part][row], u[part][row] == v[part][row]
            joined = y * len(ids) + key[at] % len(ids)
            low, high = np.searchsorted(key, joined), np.searchsorted(key, joined, "right")
            # All of the other value, without those connected before; equal values once.
            for lo, hi in ((np.where(twin, end[y], start[y]), np.where(twin, end[y], low)), (high, end[y])):
                for some in _chunks(np.maximum(hi - lo, 0)):
                    row, at = _ranges(lo[some], hi[some])
                    compare(x[some][row], members[at])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def similar_links(classes: DataFrame) -> DataFrame:
    """``a, b``: links that connect what all pairs of classes ``node, w0..w4`` connect whose fingerprints
    collide in a block and differ in at most LONG_RADIUS bits.

    Similar documents agree to three bits in one of the ten blocks of 32 bits in 19 of 20
    cases, and then in all of one of the block's four bytes. So a class is sent, with all its
    bits, once for each byte; the receiving task finds all pairs that differ in at most three
    bits of the block, and verifies them on all 320 bits.
    """
    spark = classes.sparkSession
    names = [f"w{i}" for i in range(LONG_WORDS)]
    cut = F.array(*[F.shiftrightunsigned(w, 8 * i).bitwiseAND(F.lit(255)).cast("int") for w in names for i in range(8)])
    sent = classes.select("node", *names, F.posexplode(cut).alias("slot", "byte")).repartition(parts(spark), "slot", "byte").drop("byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2 + LONG_WORDS)] for b in batches]
        if not got:
            return
        node, *words, slot = (np.concatenate(x) for x in zip(*got))
        a, b = _similar(node, np.stack(words, axis=1).view(np.uint64), slot)
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def thinned(links: DataFrame) -> DataFrame:
    """Links that connect the same: each of few partitions keeps a spanning forest of its own, so dense groups stay linear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches]
        if got:
            a, b = _forest(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.repartition(max(1, parts(links.sparkSession) // 8)).mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id, root`` of each row: components of short and long fingerprints' links together.

    Links what :func:`simhash_components` links, and documents similar in five-word shingles
    (about 0.8 or more). Odd rows as there.
    """
    df = text_and_id(docs, id_col, text_col)
    names = [f"w{i}" for i in range(LONG_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(fingerprint_of(text := t.as_py()), long_fingerprint(text)) for t in b.column(1)]
            fp = np.array([f for f, _ in both], np.uint64).view(np.int64)
            long = np.array([w for _, w in both], np.int64).reshape(-1, LONG_WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *(pa.array(long[:, i].copy()) for i in range(LONG_WORDS))], ["doc_id", "fp", *names])

    prints = df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long, " + ", ".join(f"{n} long" for n in names))
    table, _ = write_table(prints.withColumn("node", F.xxhash64("fp", *names)), "fingerprints")
    classes, _ = write_table(table.groupBy("node", "fp", *names).agg(F.min("doc_id").alias("least")), "classes")
    heads = classes.groupBy("fp").agg(F.min("node").alias("head"))
    same = classes.join(heads, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    short = fingerprint_links(heads.select("fp"))
    short = short.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    roots, _ = connected_components(same.union(short).union(thinned(similar_links(classes))))
    named = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.select("doc_id", "node").join(named.select("node", "root").join(smallest, "root"), "node").select("doc_id", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of :func:`similar_components`: that with the smallest doc_id.

    Of repeated rows of that doc_id one stays. A component that has only null doc_ids
    keeps one of its rows.
    """
    found, _ = write_table(similar_components(docs), "components")
    keep = found.where("doc_id = component_id").groupBy("doc_id").count()
    kept = docs.join(keep.where("count = 1"), "doc_id", "left_semi").select(docs.columns)
    if keep.where("count > 1").limit(1).count():
        again = docs.join(keep.where("count > 1"), "doc_id", "left_semi").select(docs.columns)
        kept = kept.union(again.dropDuplicates(["doc_id"]))
    if found.where("component_id is null").limit(1).count():
        rows, _ = write_table(docs.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()), "nameless")
        lonely = found.where("component_id is null").select("root").distinct()
        named = similar_components(rows, "_row")
        first = named.where("doc_id = component_id").join(lonely, "root", "left_semi")
        kept = kept.union(rows.join(first.select(F.col("doc_id").alias("_row")), "_row", "left_semi").select(docs.columns))
    return kept
