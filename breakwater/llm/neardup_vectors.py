"""Embedding near-duplicates by a forest of random-projection trees with spill.

Equal vectors of a label are one class. Labels with more classes than a leaf holds get
``TREES`` trees: a node splits at the median of a random projection, and vectors within the
spill margin go to both sides, so near vectors rarely part. Trees grow level by level as
tables: a level's projections are one column, the medians of all its nodes one aggregation,
so every node is fitted on all its vectors and nothing of the trees stands on the driver.
Within a leaf all classes are compared, a leaf beyond ``LEAF`` in pairs of blocks, so no task
holds more than two blocks. A pair that meets in several leaves is counted in the first of
them, which both know from the leaves they carry; so pairs are never written out or
shuffled, only counts and, for the components, a spanning forest of each leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.common import connected_components, write_table

COSINE = 0.93
#: Trees; classes of a leaf that one task compares; deepest split.
TREES, LEAF, DEPTH = 3, 1024, 32
#: Spill margin in standard deviations of a linked pair's projected difference, and the share of a
#: node's vectors that a side may take, its margin included: a split pays only if both sides take less
#: than 0.71, as pairs within grow with the square. Where a side takes more, the node waits for the
#: next level's direction, and after WAIT levels without a split is left as it is.
MARGIN, SIDE, WAIT = 1.0, 0.7, 4
#: Nodes of a level whose medians may be broadcast (24 bytes each).
BROADCAST_NODES = 200_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def directions(dim: int, trees: int) -> np.ndarray:
    """Fixed random unit columns, one for each tree and level."""
    found = np.random.default_rng([11, dim]).standard_normal((dim, trees * DEPTH))
    return found / np.linalg.norm(found, axis=0)


def _components(linked: np.ndarray) -> np.ndarray:
    """The smallest row each row reaches over a symmetric Boolean matrix."""
    root = np.arange(len(linked))
    i, j = np.nonzero(linked)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``vec_id, node, label, v``: node names the class of equal vectors; null if it links with nothing."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & (F.coalesce(F.size("v"), F.lit(0)) > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    df = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    return df.select("vec_id", "label", "v", F.when(fine, F.xxhash64("label", "v")).alias("node"))


def leaves(classes: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """``node, leaf`` for every leaf of ``classes(node, v, grp)``; groups of at most LEAF classes are one leaf.

    Ends when no leaf holds more than LEAF classes, or none of the larger ones has been split in
    as many levels as there are (such as one dense group of near copies); those are left for
    comparison in blocks.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Projections of each class, by tree and level, with the margin of its dimension."""
        for b in batches:
            v = b.column(1).to_pylist()
            for dim in sorted({len(x) for x in v}):
                at = np.array([i for i, x in enumerate(v) if len(x) == dim])
                p = (unit(np.array([v[i] for i in at])) @ directions(dim, trees)).astype(np.float32).reshape(len(at) * trees, DEPTH)
                back = pa.array(np.repeat(at, trees))
                margin = np.full(len(p), MARGIN * np.sqrt(2 * (1 - cosine) / dim), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(back), b.column(2).take(back), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(at))), pa.array(margin), pa.FixedSizeListArray.from_arrays(p.ravel(), DEPTH).cast(pa.list_(pa.float32()))],
                    ["node", "root", "tree", "margin", "p"],
                )

    rooted = classes.select("node", "v", F.xxhash64("grp").alias("root"))
    large = rooted.groupBy("root").count().where(f"count > {LEAF}").select("root")
    few = large.limit(BROADCAST_NODES + 1).count()
    large = F.broadcast(large) if few <= BROADCAST_NODES else large
    done = [rooted.join(large, "root", "left_anti").select("node", F.col("root").alias("leaf"))]
    if not few:
        return done[0]
    split = rooted.join(large, "root", "left_semi").select("node", "v", "root").mapInArrow(project, "node long, root long, tree int, margin float, p array<float>")
    # A root that is never split is one leaf of all trees; its children differ by tree.
    now, _ = write_table(split.select("node", "tree", F.col("root").alias("leaf"), F.lit(0).alias("waits"), "margin", "p"), "level")
    for level in range(DEPTH):
        x = F.get("p", F.lit(level))
        q = F.percentile_approx(x, F.array(F.lit(1 - SIDE), F.lit(0.5), F.lit(SIDE)), F.lit(1000))
        stats = now.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.max("waits").alias("w"), F.first("margin").alias("m"), q.alias("q"))
        stats = stats.select("tree", "leaf", F.when((F.col("q")[2] > F.col("q")[1] + F.col("m")) & (F.col("q")[0] <= F.col("q")[1] - F.col("m")), F.col("q")[1]).alias("mid"), "n", "w")
        stats, _ = write_table(stats.where((F.col("n") > LEAF) & (F.col("w") < WAIT)).select("tree", "leaf", "mid"), "medians")
        n = stats.count()
        if not n:
            break
        stats = F.broadcast(stats) if n <= BROADCAST_NODES else stats
        side = lambda k: F.xxhash64("leaf", "tree", F.lit(level), F.lit(k))
        sides = F.when(F.col("mid").isNull(), F.array("leaf")).otherwise(F.array_compact(F.array(F.when(x <= F.col("mid") + F.col("margin"), side(0)), F.when(x > F.col("mid") - F.col("margin"), side(1)))))
        waits = F.when(F.col("mid").isNull(), F.col("waits") + 1).otherwise(0)
        routed, _ = write_table(now.join(stats.withColumn("open", F.lit(True)), ["tree", "leaf"], "left").select("node", "tree", F.explode(sides).alias("leaf"), waits.alias("waits"), "margin", "p", "open"), "level")
        done.append(routed.where("open is null").select("node", "leaf"))
        now = routed.where("open").drop("open")
    return reduce(DataFrame.union, [*done, now.select("node", "leaf")])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.

    Vectors link when labels are equal and the cosine, in double precision, is at least
    ``cosine``. n_links counts other rows linked directly; component_id is the smallest
    vec_id reachable by links, its own included; kept is vec_id = component_id.

    A null label or vector, an empty or zero one, and one with a null or non-finite
    component links with nothing, as do vectors of different lengths. Repeated rows are
    vectors of their own, equal vectors link. A null vec_id is never the smallest; such a
    row without another has a null component_id and is not kept. Empty input gives an
    empty result; other columns are not read.
    """
    rows, _ = write_table(vector_classes(vectors, id_col, vec_col, label_col), "vectors")
    classes, _ = write_table(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    routed = leaves(classes.select("node", "v", F.struct("label", F.size("v").alias("dim")).alias("grp")), cosine, trees)
    mine, _ = write_table(routed.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("mine")), "leaves")
    blocks = mine.select(F.explode("mine").alias("leaf")).groupBy("leaf").count().where(f"count > {LEAF}").withColumn("blocks", F.ceil(F.col("count") / LEAF).cast("int"))
    many = classes.select("node", "m", "v").join(mine, "node").withColumn("leaf", F.explode("mine"))
    many = many.join(F.broadcast(blocks) if blocks.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(13), "node"), F.col("blocks")).cast("int")
    dealt = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "m", "v", "leaf", "mine", "own", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        node, m = pdf["node"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64)
        x, leaf = unit(np.stack(pdf["v"].to_numpy())), int(pdf["leaf"].iat[0])
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if pdf["b0"].iat[0] != pdf["b1"].iat[0]:  # only what lies between the two blocks
            block = pdf["own"].to_numpy()
            linked &= block[:, None] != block[None, :]
        root = _components(linked)
        earlier = sorted({k for mine in pdf["mine"] for k in mine if k < leaf})
        if earlier:
            place = {k: i for i, k in enumerate(earlier)}
            inside = np.zeros((len(pdf), len(earlier)), np.float32)
            for i, mine in enumerate(pdf["mine"]):
                inside[i, [place[k] for k in mine if k < leaf]] = 1
            linked &= inside @ inside.T == 0
        links = linked.astype(np.float64) @ m
        some = (links > 0) | (root != np.arange(len(root)))
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})

    found, _ = write_table(dealt.groupBy("leaf", "b0", "b1").applyInPandas(compare, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots, _ = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "m", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_ = rows.where("node is not null").select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id").union(alone)
    return all_.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
