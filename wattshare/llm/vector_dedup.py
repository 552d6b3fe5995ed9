"""Near-duplicate vectors: exact pairs above a cosine, by dual traversal of a cover tree.

On the unit sphere a cosine is a distance, so the triangle inequality holds.  The tree's levels halve the radius: a node of
level i splits around a few of its own vectors; those within 2 / 2^i of their nearest centre form a child of that
radius, the others a child whose covering radius is measured.  (Where vectors lie without structure no net of half the
radius is smaller than the data; the measured child keeps the tree shallow there.)  Pairs of nodes are
followed downwards while their centres are no farther apart than the threshold and both covering radii.  Nodes of
few vectors are leaves; a pair of leaves is one bounded task, compared as a matrix product in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshare.llm.components import connected
from wattshare.session import staged

COSINE = 0.98
#: Vectors of a leaf, and children (centres) of a node.
LEAF, FAN = 1024, 8
#: Levels after which a node stays whole; by then radii are far below any rounding.
MOST_LEVELS = 40
#: Slack of the bounds for rounding; pairs this close to the threshold are computed again with exact sums.
SLACK, NEAR = 1e-6, 1e-9


def usable(label: Column, vector: Column) -> Column:
    """A label, and a vector of finite numbers that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite & some, F.lit(False))


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    # Scaled first: squares of very large or small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(batches):
    """Arrow mapper: the nearest of a row's node's centres, and the distance to it."""
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        cells = batch.column(at["_node"]).to_pylist()
        vectors, centres = batch.column(at["_v"]).to_pylist(), batch.column(at["_centres"])
        best, far = [0] * len(cells), [0.0] * len(cells)
        by_cell: dict[str, list[int]] = {}
        for i, cell in enumerate(cells):
            by_cell.setdefault(cell, []).append(i)
        for rows in by_cell.values():
            net = _units([c["v"] for c in centres[rows[0]].as_py()])
            cosines = _units([vectors[i] for i in rows]) @ net.T
            choice = cosines.argmax(axis=1)
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * cosines[np.arange(len(rows)), choice]))
            for i, k, d in zip(rows, choice.tolist(), apart.tolist()):
                best[i], far[i] = k, d
        yield pa.RecordBatch.from_arrays(
            [batch.column(at["_c"]), batch.column(at["_w"]), batch.column(at["_v"]), batch.column(at["_node"]),
             pa.array(best, pa.int32()), pa.array(far, pa.float64())], ["_c", "_w", "_v", "_node", "_k", "_far"])


def _split(members: DataFrame, big: DataFrame, level: int, fan: int, vector_type: str) -> tuple[DataFrame, DataFrame]:
    """Members of the big nodes in their children, and the children: node, parent, centre, radius, count."""
    inside = members.join(big, "_node", "left_semi")
    order = F.xxhash64("_c", F.lit(level))
    # One vector of each of ``fan`` hash ranges: a combinable minimum, whatever the size of a node.
    picked = inside.groupBy("_node", F.pmod(F.xxhash64("_c", F.lit(-level - 1)), F.lit(fan)).alias("_slot")).agg(
        F.min(F.struct(order.alias("o"), F.col("_c").alias("c"), F.col("_v").alias("v"))).alias("p"))
    nets = staged(picked.groupBy("_node").agg(
        F.sort_array(F.collect_list(F.struct("p.c", "p.v"))).alias("_centres")), "tree-nets")
    dealt = inside.join(nets, "_node").mapInArrow(
        _nearest, f"_c long, _w long, _v {vector_type}, _node string, _k int, _far double")
    near = F.when(F.col("_far") <= 2.0 / 2**level, "n").otherwise("f")
    child = F.concat_ws("/", "_node", F.concat(F.col("_k").cast("string"), near))
    placed = staged(dealt.withColumn("_child", child), "tree-members")
    nodes = placed.groupBy(F.col("_child").alias("_node"), F.col("_node").alias("_parent"), "_k").agg(
        F.max("_far").alias("_radius"), F.count(F.lit(1)).alias("_n"))
    centres = nets.select(F.col("_node").alias("_parent"), F.posexplode("_centres").alias("_k", "_p"))
    nodes = staged(nodes.join(centres, ["_parent", "_k"]).select(
        "_node", "_parent", _scaled(F.col("_p.v")).alias("_centre"), "_radius", "_n"), "tree-nodes")
    return placed.select("_c", "_w", "_v", F.col("_child").alias("_node")), nodes


def _scaled(v: Column) -> Column:
    """Components between -1 and 1, so that their squares neither overflow nor vanish together."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: x.cast("double") / most)


def _apart(a: str, b: str) -> Column:
    """Distance of two centres on the unit sphere."""
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))


def _followed(levels: list[DataFrame], roots: DataFrame, reach: float) -> DataFrame:
    """Pairs of leaves ``_a <= _b`` that the bounds leave, from the pairs of each root with itself, level by level."""
    pairs = roots.select(F.col("_node").alias("_a"), F.col("_node").alias("_b"))
    for nodes in levels:
        def side(name: str) -> DataFrame:
            return nodes.select(F.col("_parent").alias(f"_{name}"), F.col("_node").alias(f"_{name}_node"),
                                F.col("_centre").alias(f"_{name}_c"), F.col("_radius").alias(f"_{name}_r"))
        met = pairs.join(side("a"), "_a", "left").join(side("b"), "_b", "left")
        # A leaf of an earlier level stays beside the other's children; its bound was tested there.
        known = F.col("_a_node").isNotNull() & F.col("_b_node").isNotNull()
        near = _apart("_a_c", "_b_c") <= reach + F.col("_a_r") + F.col("_b_r")
        first, second = F.coalesce("_a_node", "_a"), F.coalesce("_b_node", "_b")
        kept = met.filter(F.when(known, near).otherwise(True))
        ordered = (F.col("_a") != F.col("_b")) | (first <= second)
        pairs = staged(kept.filter(ordered).select(
            F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b")), "tree-pairs")
    return pairs


def _compare(cosine: float):
    """Links of one pair of leaves: for each vector its weight of partners, and a spanning forest of the links."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["_side"] != 1], rows[rows["_side"] != 0]
        a, b = _units(left["_v"].tolist()), _units(right["_v"].tolist())
        cosines = a @ b.T
        linked = cosines >= cosine
        for i, j in np.argwhere(np.abs(cosines - cosine) < NEAR):
            linked[i, j] = _exact(left["_v"].iloc[i], right["_v"].iloc[j]) >= cosine
        own = rows["_side"].iloc[0] == 2
        if own:
            np.fill_diagonal(linked, False)
        ids_a, ids_b = left["_c"].to_numpy(), right["_c"].to_numpy()
        counts = [(ids_a, linked @ right["_w"].to_numpy())]
        if not own:
            counts.append((ids_b, linked.T @ left["_w"].to_numpy()))
        label_a, label_b = ids_a.copy(), ids_b.copy()
        most = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(label_a, np.where(linked, label_b[None, :], most).min(axis=1, initial=most))
            source = new_a if own else label_a
            new_b = new_a if own else np.minimum(label_b, np.where(linked, source[:, None], most).min(axis=0, initial=most))
            if (new_a == label_a).all() and (new_b == label_b).all():
                break
            label_a, label_b = new_a, new_b
        labels = [label_a] if own else [label_a, label_b]
        out = pd.concat([pd.DataFrame({"_c": ids, "_links": n, "_root": root})
                         for (ids, n), root in zip(counts, labels)], ignore_index=True)
        return out[out["_links"] > 0]
    return run


def _exact(a, b) -> float:
    x, y = [float(v) for v in a], [float(v) for v in b]
    p, q = max(map(abs, x)), max(map(abs, y))
    x, y = [v / p for v in x], [v / q for v in y]
    return math.fsum(p * q for p, q in zip(x, y)) / math.sqrt(math.fsum(p * p for p in x)) / math.sqrt(math.fsum(q * q for q in y))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, leaf: int = LEAF, fan: int = FAN,
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col, n_links, component_id, kept``.

    Two vectors link when their labels are equal and not null, their lengths are equal, and their cosine is at least
    ``cosine``.  ``n_links`` counts other rows linked directly; ``component_id`` is the smallest id reachable;
    ``kept``: the id is its component's.  Equal vectors of a label are one class that stands for all its rows, so
    groups of copies cost no comparisons.  No pair is skipped: only nodes whose bounds rule links out are.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with
    nothing.  Ids may repeat (each row counts) or be null (never the smallest unless all are); an empty table gives
    an empty table.
    """
    vector_type = vectors.schema[vector_col].dataType.simpleString()
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v"))
    rows = rows.withColumn("_ok", usable(F.col("_label"), F.col("_v")))
    good = rows.filter("_ok").select("_id", "_label", "_v")
    classes = staged(good.groupBy("_label", "_v").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_w")).withColumn("_c", F.monotonically_increasing_id()), "vectors")
    members = classes.select("_c", "_w", "_v", F.concat_ws("|", F.col("_label").cast("string"), F.size("_v").cast("string")).alias("_node"))
    roots = staged(members.groupBy("_node").agg(F.count(F.lit(1)).alias("_n")), "tree-roots")
    levels, leaves, nodes = [], [], roots
    for level in range(1, MOST_LEVELS + 1):
        big = nodes.filter(F.col("_n") > leaf).select("_node")
        if big.isEmpty():
            break
        leaves.append(members.join(big, "_node", "left_anti").select("_c", "_w", "_v", "_node"))
        members, nodes = _split(members, big, level, fan, vector_type)
        levels.append(nodes)
    leaves.append(members.select("_c", "_w", "_v", "_node"))
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)
    pairs = staged(_followed(levels, roots, reach), "tree-leaf-pairs")
    named = pairs.withColumn("_pair", F.concat_ws("&", "_a", "_b"))
    own = F.col("_a") == F.col("_b")
    sides = named.select("_pair", F.col("_a").alias("_node"), F.when(own, 2).otherwise(0).alias("_side")).unionByName(
        named.filter(~own).select("_pair", F.col("_b").alias("_node"), F.lit(1).alias("_side")))
    found = staged(placed.join(sides, "_node").select("_pair", "_side", "_c", "_w", "_v").groupBy("_pair").applyInPandas(
        _compare(cosine), "_c long, _links long, _root long"), "vector-links")
    links = found.groupBy("_c").agg(F.sum("_links").alias("_links"))
    roots_of = connected(found.select(F.col("_c").alias("a"), F.col("_root").alias("b")))
    joined = classes.join(links, "_c", "left").join(roots_of, F.col("_c") == F.col("node"), "left").select(
        "_label", "_v", "_first", (F.coalesce("_links", F.lit(0)) + F.col("_w") - 1).alias("n_links"),
        F.coalesce("root", "_c").alias("_root"))
    joined = staged(joined, "vector-classes")
    least = joined.groupBy("_root").agg(F.min("_first").alias("component_id"))
    table = joined.join(least, "_root").select("_label", "_v", "n_links", "component_id")
    out = good.join(table, ["_label", "_v"]).select("_id", "n_links", "component_id").unionByName(
        rows.filter(~F.col("_ok")).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(
        F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
