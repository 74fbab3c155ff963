"""Boosted trees that grow leaf by leaf, on histograms of gradients.

Columns are cut into bins once and rows kept as bytes. Tasks sum gradients by leaf, column and
bin; the sums of a leaf meet where its best split is found, so the driver sees one split for
each leaf and block of columns. The leaf that gains most is split next. Leaves that may be
split are examined together, so a tree takes about as many jobs as it is deep.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.sources import tables

#: Bins of a column besides that of missing values; columns of a block; trees after which margins are written.
BINS, BLOCK, KEEP = 63, 32, 8
#: Tasks whose sums are added first.
TASKS = 64


@dataclass(frozen=True)
class Settings:
    """What a fit is told; shares of rows and columns are drawn anew for each tree, by hashes of ``seed``."""

    trees: int = 50
    leaves: int = 31
    depth: int = 12
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    least_rows: int = 20
    least_gain: float = 1e-6
    rows: float = 1.0
    columns: float = 1.0
    #: Share of the rows that are held out; after ``patience`` trees without a better loss on them the best number of trees is kept.
    held: float = 0.2
    patience: int = 10
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of creation: the column, bin and side of missing values that split one, its children, its value."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for part, nothing in ((self.column, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part.append(nothing)
        return len(self.column) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(x), np.int64)
        column, left, right = np.array(self.column), np.array(self.left), np.array(self.right)
        bins, missing = np.array(self.bin), np.array(self.missing_left)
        while True:
            open_ = np.flatnonzero(column[at] >= 0)
            if not len(open_):
                return at
            node = at[open_]
            b = x[open_, column[node]]
            at[open_] = np.where(np.where(b == BINS, missing[node], b <= bins[node]), left[node], right[node])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]


def _soft(g: float | np.ndarray, l1: float) -> float | np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _best(sums: np.ndarray, s: Settings) -> tuple[float, int, int, bool, list[float]]:
    """Gain, column, bin, side of the missing, and both sides' sums of the best split of a leaf by columns x bins x (gradient, curvature, rows)."""
    total = sums[0].sum(axis=0)
    worth = lambda g, h: _soft(g, s.l1) ** 2 / (h + s.l2)
    run, gone = np.cumsum(sums[:, :BINS], axis=1), sums[:, BINS]
    out = (0.0, -1, 0, False, [0.0] * 6)
    for with_missing in (True, False):
        left = run + gone[:, None, :] if with_missing else run
        right = total - left
        gain = (worth(left[..., 0], left[..., 1]) + worth(right[..., 0], right[..., 1]) - worth(total[0], total[1])) / 2
        gain[(left[..., 2] < s.least_rows) | (right[..., 2] < s.least_rows)] = -1
        c, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[c, b] > out[0] + 1e-12:
            out = (float(gain[c, b]), int(c), int(b), with_missing, [*left[c, b].tolist(), *right[c, b].tolist()])
    return out


class LeafwiseModel:
    """Trees over binned columns; ``score`` gives ``id`` and the probability of class 1."""

    def __init__(self, columns: list[str], cuts: list[list[float]], base: float, rate: float, trees: list[Tree], losses: list[float]):
        self.columns, self.cuts, self.base, self.rate, self.trees, self.losses = columns, cuts, base, rate, trees, losses

    def score(self, wide: DataFrame, name: str = "score", id_col: str = "id") -> DataFrame:
        base, rate, trees = self.base, self.rate, self.trees
        kind = wide.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                margin = base + rate * sum((t.score(x) for t in trees), np.zeros(b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-margin)))], [id_col, name])

        return binned(wide, self.columns, self.cuts, [id_col]).mapInArrow(run, f"{id_col} {kind}, {name} double")

    def importance(self) -> dict[str, float]:
        """How often each column splits a node."""
        used = [c for t in self.trees for c in t.column if c >= 0]
        return {c: float(used.count(i)) for i, c in enumerate(self.columns)}

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"columns": self.columns, "cuts": self.cuts, "base": self.base, "rate": self.rate, "losses": self.losses, "trees": [asdict(t) for t in self.trees]}
        spark.createDataFrame([(json.dumps(state),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LeafwiseModel:
        state = json.loads(spark.read.text(path).first()[0])
        return cls(state["columns"], state["cuts"], state["base"], state["rate"], [Tree(**t) for t in state["trees"]], state["losses"])


def cuts_of(wide: DataFrame, columns: list[str], accuracy: int = 2000) -> list[list[float]]:
    """Upper ends of the bins of each column: at most ``BINS - 1`` approximate quantiles."""
    out: list[list[float]] = []
    shares = [i / BINS for i in range(1, BINS)]
    for at in range(0, len(columns), 200):
        part = columns[at : at + 200]
        clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = wide.agg(*[F.percentile_approx(clean(c), shares, accuracy).alias(f"c{i}") for i, c in enumerate(part)]).first()
        out += [sorted(set(v or [])) for v in row]
    return out


def binned(wide: DataFrame, columns: list[str], cuts: list[list[float]], keys: list[str]) -> DataFrame:
    """``keys`` and ``x``: a byte for each column, the number of ends below its value, or ``BINS`` where it is missing."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    schema = ", ".join(f"{k} {wide.schema[k].dataType.simpleString()}" for k in keys) + ", x binary"
    ends = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(ends))
            x = np.stack([np.where(np.isnan(v[:, i]), BINS, np.searchsorted(e, v[:, i], "left")) for i, e in enumerate(ends)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([r.tobytes() for r in x], pa.binary())], [*keys, "x"])

    return wide.select(*keys, values.alias("v")).mapInArrow(run, schema)


class _Grower:
    """One fit: the rows as a table ``k, y, held, x, m`` (hash of the id, class, whether held out, bins, margin so far)."""

    def __init__(self, rows: DataFrame, width: int, s: Settings):
        self.rows, self.width, self.s, self.pending = rows, width, s, []

    def sums(self, tree: Tree, open_: list[int], columns: list[int], number: int) -> tuple[dict[int, tuple], list[float]]:
        """For each open node its best split and (as the node's own) sums; and the held rows' loss and weight."""
        s, width, pending = self.s, self.width, list(self.pending)
        blocks = [columns[i : i + BLOCK] for i in range(0, len(columns), BLOCK)]
        place = {n: i for i, n in enumerate(open_)}
        size = (BINS + 1) * 3

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(open_), len(columns), BINS + 1, 3))
            loss, seen = 0.0, 0
            for b in batches:
                k, y, out, x, m = b.columns
                x = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(b.num_rows, width)
                y, out = y.to_numpy(), out.to_numpy(zero_copy_only=False)
                margin = m.to_numpy() + s.rate * sum((t.score(x) for t in pending), np.zeros(b.num_rows))
                p = 1 / (1 + np.exp(-margin))
                q = np.clip(p[out], 1e-12, 1 - 1e-12)
                loss -= float((y[out] * np.log(q) + (1 - y[out]) * np.log(1 - q)).sum())
                seen += int(out.sum())
                draw = (k.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((number + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)
                used = np.flatnonzero(~out & (draw / 2.0**53 < s.rows))
                x, g, h = x[used], (p - y)[used], (p * (1 - p))[used]
                leaf = tree.leaf_of(x)
                for n, i in place.items():
                    own = np.flatnonzero(leaf == n)
                    for c, column in enumerate(columns):
                        bins = x[own, column]
                        held[i, c, :, 0] += np.bincount(bins, g[own], BINS + 1)
                        held[i, c, :, 1] += np.bincount(bins, h[own], BINS + 1)
                        held[i, c, :, 2] += np.bincount(bins, minlength=BINS + 1)
            task = TaskContext.get().partitionId()
            names = ["node", "block", "task", "g", "sums"]
            row = lambda n, block, v: pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([task // TASKS], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], names)
            for n, i in place.items():
                for j in range(len(blocks)):
                    yield row(n, j, held[i, j * BLOCK : j * BLOCK + BLOCK])
            yield row(-1, 0, np.array([loss, seen]))

        def added(table: pa.Table) -> np.ndarray:
            order = np.argsort(table.column("task").to_numpy())  # in one order, so that a fit can be repeated
            parts = table.column("sums").to_pylist()
            return sum((np.frombuffer(parts[i], np.float64) for i in order[1:]), np.frombuffer(parts[order[0]], np.float64).copy())

        def merge(table: pa.Table) -> pa.Table:
            keep = {c: table.column(c).slice(0, 1) for c in ("node", "block", "g")}
            return pa.table({"node": keep["node"], "block": keep["block"], "task": keep["g"], "sums": pa.array([added(table).tobytes()], pa.binary())})

        def best(table: pa.Table) -> pa.Table:
            node, block = table.column("node")[0].as_py(), table.column("block")[0].as_py()
            total = added(table)
            if node < 0:
                row = [0.0, -1, 0, False, [*total.tolist(), 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
            else:
                x = total.reshape(-1, BINS + 1, 3)
                gain, c, b, missing, sides = _best(x, s)
                row = [gain, blocks[block][c] if c >= 0 else -1, b, missing, sides, x[0].sum(axis=0).tolist()]
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.table({"node": pa.array([node], pa.int32()), **{n: pa.array([v], t) for n, v, t in zip(("gain", "column", "bin", "missing", "sides", "own"), row, kinds)}})

        partial = self.rows.mapInArrow(run, "node int, block int, task int, g int, sums binary")
        near = partial.groupBy("node", "block", "g").applyInArrow(merge, "node int, block int, task int, sums binary")
        found = near.groupBy("node", "block").applyInArrow(best, "node int, gain double, column int, bin int, missing boolean, sides array<double>, own array<double>")
        out: dict[int, tuple] = {}
        held = [0.0, 0.0]
        for r in sorted(found.collect(), key=lambda r: (r["node"], -r["gain"], r["column"])):  # a row for each open node and block of columns
            if r["node"] < 0:
                held = r["sides"][:2]
            elif r["node"] not in out:
                out[r["node"]] = (r["gain"], r["column"], r["bin"], r["missing"], r["sides"], r["own"])
        return out, held

    def grow(self, number: int) -> tuple[Tree, list[float]]:
        """The next tree, and the held rows' loss before it."""
        s = self.s
        columns = list(range(self.width))
        if s.columns < 1:
            rng = np.random.default_rng([s.seed, number])
            columns = sorted(rng.choice(self.width, max(1, math.ceil(s.columns * self.width)), replace=False).tolist())
        wide = Tree()
        wide.add()
        depth, found, loss = {0: 0}, {}, None
        while True:
            open_ = [n for n in range(len(wide.column)) if n not in found and wide.column[n] < 0]
            got, held = self.sums(wide, open_, columns, number)
            loss = loss or held
            found |= {n: got.get(n, (0.0, -1, 0, False, [0.0] * 6, [0.0] * 3)) for n in open_}
            chosen, missing = self._chosen(wide, found, depth)
            if not missing:
                return self._cut(wide, found, chosen), loss
            # All that could still be split are given children, so that one job examines them together.
            could = sorted((n for n in found if wide.column[n] < 0 and found[n][0] > s.least_gain and depth[n] < s.depth), key=lambda n: (-found[n][0], n))
            for n in could[: s.leaves]:
                _, wide.column[n], wide.bin[n], wide.missing_left[n], _, _ = found[n]
                wide.left[n], wide.right[n] = wide.add(), wide.add()
                depth[wide.left[n]] = depth[wide.right[n]] = depth[n] + 1

    def _chosen(self, wide: Tree, found: dict, depth: dict) -> tuple[set[int], bool]:
        """The nodes that best-first growth splits, and whether it meets one that has not been examined."""
        heap, chosen = [(-found[0][0], 0)], set()
        while heap and len(chosen) + 1 < self.s.leaves:
            gain, n = heapq.heappop(heap)
            if -gain <= self.s.least_gain or depth[n] >= self.s.depth:
                continue
            if wide.column[n] < 0:
                return chosen, True
            chosen.add(n)
            for child in (wide.left[n], wide.right[n]):
                if child not in found:
                    return chosen, True
                heapq.heappush(heap, (-found[child][0], child))
        return chosen, False

    def _cut(self, wide: Tree, found: dict, chosen: set[int]) -> Tree:
        """The tree of the chosen splits, with its leaves' values."""
        tree = Tree()

        def copy(n: int) -> int:
            made = tree.add()
            if n in chosen:
                tree.column[made], tree.bin[made], tree.missing_left[made] = wide.column[n], wide.bin[n], wide.missing_left[n]
                tree.left[made], tree.right[made] = copy(wide.left[n]), copy(wide.right[n])
            else:
                g, h, _ = found[n][5]
                tree.value[made] = float(-_soft(g, self.s.l1) / (h + self.s.l2))
            return made

        copy(0)
        return tree

    def add(self, tree: Tree) -> None:
        """Adds a tree to the margins; every few trees they are written."""
        self.pending.append(tree)
        if len(self.pending) >= KEEP:
            pending, rate, width = list(self.pending), self.s.rate, self.width

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, width)
                    m = b.column(4).to_numpy() + rate * sum(t.score(x) for t in pending)
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(m)], b.schema.names)

            old = self.rows
            self.rows, self.pending = tables.staged(old.mapInArrow(run, old.schema), "margins"), []
            tables.drop(old)


def fit(wide: DataFrame, columns: list[str], settings: Settings = Settings(), id_col: str = "id", y_col: str = "y") -> LeafwiseModel:
    """Boosted trees for a label of 0 and 1, with early stopping on rows that no tree has seen.

    A row is held out by a hash of its id, so equal ids go together. Missing values (null or
    NaN) go to the side that gains more. Rows without a label are left out; without rows of
    both classes the model is a constant. A fit on the same rows in the same partitions gives the same trees.
    """
    s = settings
    cuts = cuts_of(wide.where(F.col(y_col).isNotNull()), columns)
    key = F.xxhash64(F.col(id_col), F.lit(s.seed))
    base_rows = wide.where(F.col(y_col).isNotNull()).withColumn("_k", key).withColumn("_y", F.col(y_col).cast("double"))
    x = binned(base_rows, columns, cuts, ["_k", "_y"])
    out = (F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < int(s.held * 1_000_000)).alias("held")
    rows = x.select(F.col("_k").alias("k"), F.col("_y").alias("y"), out, "x", F.lit(0.0).alias("m"))
    rows = tables.staged(rows, "margins")
    n, mean = rows.where("not held").agg(F.count("*"), F.avg("y")).first()
    if not n or not 0 < mean < 1:
        mean = min(max(mean or 0.0, 1e-6), 1 - 1e-6)
        return LeafwiseModel(columns, cuts, math.log(mean / (1 - mean)), s.rate, [], [])
    base = math.log(mean / (1 - mean))
    grower = _Grower(rows.withColumn("m", F.lit(base)), len(columns), s)
    trees: list[Tree] = []
    losses: list[float] = []
    best, at = math.inf, 0
    for number in range(s.trees + 1):
        tree, (loss, weight) = grower.grow(number)  # the loss of the trees so far
        losses.append(loss / weight if weight else math.nan)
        if not weight or losses[-1] < best - 1e-12:
            best, at = losses[-1] if weight else best, number
        if number == s.trees or weight and number - at >= s.patience or len(tree.column) == 1:
            break
        trees.append(tree)
        grower.add(tree)
    tables.drop(rows)
    return LeafwiseModel(columns, cuts, base, s.rate, trees[:at] if losses and not math.isnan(losses[-1]) else trees, losses)
