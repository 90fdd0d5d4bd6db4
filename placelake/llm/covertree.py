"""Embedding near-dedup by dual traversal of cover trees.

Unit vectors lie within 2 of each other; cosine c is distance sqrt(2 - 2c). The top of a label's tree is spread over the
cluster: nodes too large for a task are split by nets of their own, level by level, each child with a centre and the true
radius to its furthest member. Pairs of nodes are walked down from the roots, as tables, and pruned by d(centres) > t +
radius + radius. What is left at the bottom is a block: its cover tree, nested levels with halving radii, is built once and
stored beside its vectors. A task walks the trees of two blocks at once and prunes by the same bound; exact pairs remain,
tested by their cosine in double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import checkpoint
from placelake.llm.components import components, forest

#: Vectors of a block at most, and its bytes; children of a node at most, and members that they are chosen from, about.
BLOCK, BLOCK_BYTES, FAN, SAMPLE = 2048, 4 << 20, 32, 512
#: Levels that are spread over the cluster; what is too large below them, or has this radius at most, is cut by hash.
LEVELS, FLAT = 8, 1e-4
#: Room for rounding in bounds; the final test has none.
ROUNDING = 1e-9
NODE = ["label", "dim", "path"]


class CoverTree:
    """Nested levels with halving radii. A node has a centre (a point), the radius to its furthest descendant, and children; points are nodes without."""

    def __init__(self, x: np.ndarray, leaf: int = 32):
        self.x, self.leaf = x, leaf
        self.centre: list[int] = list(range(len(x)))  # the first nodes are the points
        self.radius: list[float] = [0.0] * len(x)
        self.kids: list[np.ndarray | None] = [None] * len(x)
        self.root = self._grow(0, np.arange(len(x)), 1.0) if len(x) else -1
        self.centres, self.radii = np.array(self.centre, dtype=np.int64), np.array(self.radius)

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.x[members] - self.x[centre]).sum(axis=1))

    def _grow(self, centre: int, members: np.ndarray, level: float) -> int:
        if len(members) == 1:
            return int(members[0])
        far = float(self._distance(centre, members).max())
        kids = members
        if len(members) > self.leaf and far > 1e-6:
            while far <= level:  # levels with this node alone
                level /= 2
            kids, left, own = [], members, centre
            while len(left):
                near = (self._distance(own, left) <= level) | (left == own)
                kids.append(self._grow(own, left[near], level / 2))
                left = left[~near]
                own = int(left[0]) if len(left) else own
        self.centre.append(centre)
        self.radius.append(far)
        self.kids.append(np.array(kids, dtype=np.int64))
        return len(self.centre) - 1

    def under(self, node: int) -> np.ndarray:
        return np.array([node]) if self.kids[node] is None else self.kids[node]


def dual_pairs(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point of a, point of b) within `reach`, up to rounding. A tree with itself gives each pair both ways, and loops."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(a.root, b.root)] if len(a.x) and len(b.x) else []
    while stack:
        na, nb = stack.pop()
        ka, kb = a.under(na), b.under(nb)
        square = 2 - 2 * (a.x[a.centres[ka]] @ b.x[b.centres[kb]].T)
        bound = reach + a.radii[ka][:, None] + b.radii[kb][None, :]
        i, j = np.nonzero(square <= bound * bound + ROUNDING)
        i, j = ka[i], kb[j]
        points = (i < len(a.x)) & (j < len(b.x))
        left.append(i[points])
        right.append(j[points])
        stack += zip(i[~points].tolist(), j[~points].tolist(), strict=True)
    return np.concatenate(left), np.concatenate(right)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as unit vectors in double precision; the others are left out."""
    for batch in batches:
        lists = batch.column(2)
        offsets, values = np.asarray(lists.offsets).astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(offsets)
        usable = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[usable & (sizes > 0)]).tolist():
            own = np.flatnonzero(usable & (sizes == size))
            x = values[offsets[own][:, None] + np.arange(size)]  # nulls are NaN
            top = np.abs(x).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            x, own = x[ok] / top[ok][:, None], pa.array(own[ok])
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own).cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "unit"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def net(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of a net: each next one is the one furthest from those before."""
    chosen, far = [0], 2 - 2 * (x @ x[0])
    while len(chosen) < min(size, len(x)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]))
    return np.array(chosen)


def _pivots(frame: pd.DataFrame) -> pd.DataFrame:
    """The children's centres of one node, from a sample of its members."""
    frame = frame.sort_values("unit")
    own = frame.iloc[net(_matrix(frame["unit"]), int(frame["fan"].iloc[0]))]
    return own.assign(kid=np.arange(len(own), dtype=np.int64))[[*NODE, "kid", "unit"]]


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and salt, pivots (kind 0) before members: each member with its child's path and the distance to its centre."""
    last, pivots, kids = None, [], []
    for batch in batches:
        frame = batch.to_pandas()
        for key, own in frame.groupby([*NODE, "salt"], sort=False, dropna=False):
            if key != last:
                last, pivots, kids = key, [], []
            first = own[own["kind"] == 0]
            pivots += list(first["unit"])
            kids += first["rep"].tolist()
            rest = own[own["kind"] == 1]
            if not len(rest):
                continue
            x, p = _matrix(rest["unit"]), _matrix(pivots)
            square = 2 - 2 * (x @ p.T)
            near = square.argmin(axis=1)
            d = np.sqrt(np.square(x - p[near]).sum(axis=1))
            path = [f"{key[2]}.{kids[k]}" for k in near]
            yield pa.RecordBatch.from_pandas(rest[["label", "dim", "rep", "times", "unit"]].assign(path=path, d=d), schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("path", pa.string()), ("rep", pa.int64()), ("times", pa.int64()), ("unit", pa.binary()), ("d", pa.float64())]), preserve_index=False)


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: its vectors, their ids and numbers, and its tree."""
    own = frame.sort_values("rep")
    x = _matrix(own["unit"])
    tree = CoverTree(x)
    rest = pickle.dumps((tree.centre, tree.radius, tree.kids, tree.root))
    return pd.DataFrame({**{c: [own[c].iloc[0]] for c in NODE}, "reps": [own["rep"].to_numpy().tobytes()], "times": [own["times"].to_numpy().tobytes()], "x": [x.tobytes()], "tree": [rest]})


def _stored(row) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    reps = np.frombuffer(row.reps, dtype=np.int64)
    tree = CoverTree.__new__(CoverTree)
    tree.x = np.frombuffer(row.x, dtype=np.float64).reshape(len(reps), -1)
    tree.centre, tree.radius, tree.kids, tree.root = pickle.loads(row.tree)
    tree.centres, tree.radii = np.array(tree.centre, dtype=np.int64), np.array(tree.radius)
    return tree, reps, np.frombuffer(row.times, dtype=np.int64)


def _compare(cosine: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    reach = float(np.sqrt(2 - 2 * cosine))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = sorted(frame.itertuples(), key=lambda r: r.side)
        (a, ra, ma), (b, rb, mb) = _stored(sides[0]), _stored(sides[-1])
        alone = len(sides) == 1
        i, j = dual_pairs(a, b, reach)
        ok = i < j if alone else np.ones(len(i), dtype=bool)
        i, j = i[ok], j[ok]
        near = np.concatenate([np.einsum("ij,ij->i", a.x[i[k : k + 50_000]], b.x[j[k : k + 50_000]]) >= cosine for k in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
        i, j = i[near], j[near]
        n = pd.concat([pd.Series(mb[j], index=ra[i]), pd.Series(ma[i], index=rb[j])]).groupby(level=0).sum()
        x, y = forest(ra[i], rb[j])
        return pd.DataFrame({"a": np.concatenate([n.index.to_numpy(), x]).astype(np.int64), "b": pd.array([None] * len(n) + list(y), dtype="Int64"), "n": np.concatenate([n.to_numpy(), np.zeros(len(x))]).astype(np.int64)})

    return run


def _cap() -> Column:
    """Vectors of a block: fewer where they are long."""
    return F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 8)))).cast("int")


def _split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and the leaves' members of distinct vectors (label, dim, path, rep, times, unit), whose path is empty.

    Nodes: label, dim, path, up (the parent's path; null for roots), centre (null for roots), radius, leaf. A level is two
    shuffles of what lies in nodes that are too large; hot nodes are salted, and no node's members meet in one task.
    """
    size = members.groupBy(*NODE).agg(F.count("*").alias("size"))
    nodes = checkpoint(size.select(*NODE, F.lit(None).cast("string").alias("up"), F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"), (F.col("size") <= _cap()).alias("leaf"), "size"))
    open_, leaves, all_nodes = members, None, nodes
    for level in range(LEVELS + 1):
        done = open_.join(nodes.where("leaf").select(*NODE), NODE, "left_semi")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = nodes.where("not leaf").withColumn("salts", F.ceil(F.col("size") / BLOCK).cast("int"))
        if large.isEmpty():
            break
        flat = F.lit(level == LEVELS) | (F.col("radius") <= FLAT)  # parts with their node's centre and radius
        name = lambda k: F.concat("path", F.lit("#"), k.cast("string")).alias("path")
        parts = large.where(flat).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        all_nodes = all_nodes.unionByName(parts.select("label", "dim", name(F.col("part")), F.col("path").alias("up"), "centre", "radius", F.lit(True).alias("leaf"), "size"))
        within = open_.join(large.where(flat).select(*NODE, "salts"), NODE)
        leaves = leaves.unionByName(within.select("label", "dim", name(F.pmod(F.xxhash64("rep"), F.col("salts"))), "rep", "times", "unit"))
        big = large.where(~flat).select(*NODE, "size", F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(2 * F.col("size") / _cap()))).cast("int").alias("fan"), "salts")
        if big.isEmpty():
            break
        inside = open_.join(big, NODE)
        drawn = inside.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("size"))
        pivots = checkpoint(drawn.select(*NODE, "unit", "fan").groupBy(*NODE).applyInPandas(_pivots, "label string, dim int, path string, kid long, unit binary"))
        copies = pivots.join(big, NODE).select(*NODE, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("kid").alias("rep"), F.lit(0).cast("long").alias("times"), "unit")
        dealt = inside.select(*NODE, F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "rep", "times", "unit").unionByName(copies)
        order = [*NODE, "salt"]
        placed = checkpoint(dealt.repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(_assigned, "label string, dim int, path string, rep long, times long, unit binary, d double"))
        found = placed.groupBy(*NODE).agg(F.count("*").alias("size"), F.max("d").alias("radius"))
        centres = pivots.mapInPandas(_centres, "label string, dim int, path string, up string, centre array<double>")
        nodes = checkpoint(found.join(centres, NODE).select(*NODE, "up", "centre", "radius", (F.col("size") <= _cap()).alias("leaf"), "size"))
        open_, all_nodes = placed.drop("d"), all_nodes.unionByName(nodes)
    return checkpoint(all_nodes.drop("size")), leaves


def _centres(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"label": f["label"], "dim": f["dim"], "path": [f"{p}.{k}" for p, k in zip(f["path"], f["kid"], strict=True)], "up": f["path"], "centre": [np.frombuffer(u) for u in f["unit"]]})


def _near_leaves(nodes: DataFrame, reach: float) -> DataFrame:
    """(label, dim, a, b): pairs of leaves' paths, a <= b, that no bound on the way down from the roots tells apart."""
    inner = nodes.where("up is not null").select("label", "dim", F.col("up").alias("path"), F.col("path").alias("kid"), "centre", "radius", "leaf")
    kids = inner.unionByName(nodes.where("leaf").select("label", "dim", "path", F.col("path").alias("kid"), "centre", "radius", "leaf"))
    side = lambda s: kids.select("label", "dim", F.col("path").alias(s), F.col("kid").alias(f"{s}_kid"), F.col("centre").alias(f"{s}_centre"), F.col("radius").alias(f"{s}_radius"), F.col("leaf").alias(f"{s}_leaf"))
    roots = nodes.where("up is null")
    pairs = roots.select("label", "dim", F.col("path").alias("a"), F.col("path").alias("b"), F.col("leaf").alias("a_leaf"), F.col("leaf").alias("b_leaf"))
    done = pairs.where("a_leaf and b_leaf").select("label", "dim", "a", "b")
    pairs = pairs.where("not (a_leaf and b_leaf)")
    square = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    for _ in range(LEVELS + 2):
        if pairs.isEmpty():
            break
        down = pairs.select("label", "dim", "a", "b").join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"]).where("a != b or a_kid <= b_kid")
        bound = F.col("a_radius") + F.col("b_radius") + reach + ROUNDING
        down = down.where((F.col("a_kid") == F.col("b_kid")) | F.coalesce(F.sqrt(square) <= bound, F.lit(True)))
        down = checkpoint(down.select("label", "dim", F.col("a_kid").alias("a"), F.col("b_kid").alias("b"), "a_leaf", "b_leaf"))
        done = done.unionByName(down.where("a_leaf and b_leaf").select("label", "dim", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = down.where("not (a_leaf and b_leaf)")
    return done


def near_vectors(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per row of `embeddings` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine is `cosine` or more.
    Null and zero vectors, and those with null or non-finite components, link with nothing: n_links 0 and their own id.
    Rows without a vec_id link with nothing and have none, kept as they equal it. Equal vectors of a label are one class
    that is compared once. Rows of one vec_id count as vectors of their own and get each the same result. Pairs are not
    emitted: a task returns link counts and a spanning forest.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = checkpoint(rows.where("vec_id is not null").mapInArrow(_units, "vec_id long, label string, unit binary"))
    classes = checkpoint(units.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")))
    nodes, leaves = _split(classes.select("label", (F.octet_length("unit") / 8).cast("int").alias("dim"), F.lit("").alias("path"), "rep", "times", "unit"))
    blocks = checkpoint(leaves.groupBy(*NODE).applyInPandas(_block, "label string, dim int, path string, reps binary, times binary, x binary, tree binary"))
    met = checkpoint(_near_leaves(nodes, float(np.sqrt(2 - 2 * cosine))).withColumn("pair", F.monotonically_increasing_id()))
    sides = met.select("label", "dim", F.col("a").alias("path"), "pair", F.lit(0).alias("side")).unionByName(met.where("a != b").select("label", "dim", F.col("b").alias("path"), "pair", F.lit(1).alias("side")))
    dealt = sides.join(blocks, NODE).select("pair", "side", "reps", "times", "x", "tree")
    told = checkpoint(dealt.groupBy("pair").applyInPandas(_compare(cosine), "a long, b long, n long"))
    roots = components(told.where("b is not null").select("a", "b"))
    counts = told.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    by_class = classes.select("rep", "times").join(counts, classes["rep"] == counts["a"], "left").join(roots, classes["rep"] == roots["node"], "left")
    by_class = by_class.select("rep", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    members = units.join(classes.select("label", "unit", "rep"), ["label", "unit"]).select("vec_id", "rep").join(by_class, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")).withColumnRenamed("vec_id", "of")
    out = rows.select("vec_id").join(members, rows["vec_id"] == members["of"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
