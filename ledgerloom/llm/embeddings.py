"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Vectors of one label are compared by cosine. Equal vectors collapse to one class first (a map-side combined
aggregation), so a vector that a third of the rows share costs one row. Tight clusters collapse next: vectors that agree in the
grid cells of GRID projections meet their cell's first vector, its pivot, and those within RADIUS of it (an angle) make a ball. Any two in a
ball are within twice that and so are linked without being compared. What goes into the forest are points: balls with their
exact radius, and single vectors with radius 0.

A tree splits a label's points by random hyperplanes again and again until a leaf is expected to hold LEAF points. A cut
lies where, between two quantiles of the node's sample, the fewest points are near it; a point within SPILL of the cut (on unit vectors)
goes to both sides; a node whose best cut would send more than MOST of its points to both sides stays a leaf. TREES
independent trees make a pair that one of them separates likely to meet in another. Cuts are fitted on a bounded sample (SAMPLE points a label); a
node with too few of them takes its cut from the sample of its last ancestor that had enough, so trees are as deep as the label asks. Every point is placed. Labels are fitted in batches
whose trees together stay below FOREST_BYTES.

Leaves are compared in blocks: a leaf cut into parts of PART points is compared part against part, each pair of parts
in a task of its own, by matrix products in double precision. A pair of points counts only in the first common (tree, leaf)
of the two, so links are counted once without keeping pairs. By the angle of the pivots and the radii all vectors of two points
are linked, or none, or the two balls are compared vector by vector, in parts again. What leaves a task are link counts, a spanning
forest of the verified links, and the pairs of balls that bounds leave open. Connected components of the forests are the result.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing and
stand alone. Vectors of different lengths never link. Repeated rows of a vec_id count as equal vectors, but no vector links with
its own vec_id only once it stands in one row; a null vec_id stands alone. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import components, small, store, store_counted

THRESHOLD = 0.98
ANGLE = float(np.arccos(THRESHOLD))
#: Bounds decide only beyond this distance from the threshold's angle.
SLACK = 1e-6
TREES = 8
LEAF = 384
SPILL = 0.02
MOST = 0.4
SAMPLE = 4096
#: A cut is fitted on so many sampled points at least.
ENOUGH = 32
PART = 256
GRID, STEP, RADIUS = 6, 0.06, 0.05
FOREST_BYTES = 32 << 20


class Tree:
    """Splits of one label's points: a random direction for each level and a cut for each node (root 1, children 2i and
    2i + 1). Below the levels that the sample reaches, a node's cut is that of its ancestor's sample along the level's direction. A cut that is
    not a number ends the tree there."""

    def __init__(self, dim: int, depth: int, seed: int, cuts: dict[tuple[int, int], float] | None = None) -> None:
        self.depth = depth
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((max(1, depth), dim))
        self.planes /= np.linalg.norm(self.planes, axis=1, keepdims=True)
        self.cuts = cuts or {}

    def fit(self, sample: np.ndarray) -> Tree:
        along = sample @ self.planes.T
        open_ = [(1, 0, np.arange(len(sample)))]
        while open_:
            node, level, own = open_.pop()
            if len(own) < 2 * ENOUGH:
                for lower in range(level, self.depth):
                    self.cuts[(node, lower)] = _cut(along[own, lower])
                continue
            if level == self.depth:
                continue
            y = along[own, level]
            cut = self.cuts[(node, level)] = _cut(y)
            if not np.isnan(cut):
                open_ += [(2 * node, level + 1, own[y < cut]), (2 * node + 1, level + 1, own[y >= cut])]
        return self

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they fall into, several for rows near cuts."""
        row, node, fitted = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), np.int64)
        along = x @ self.planes.T
        done_row, done_node = [], []
        for level in range(self.depth):
            cut = np.empty(len(row))
            kinds, back = np.unique(fitted, return_inverse=True)
            for i, f in enumerate(kinds.tolist()):
                cut[back == i] = self.cuts.get((f, level), np.nan)
            stop = np.isnan(cut)
            done_row.append(row[stop])
            done_node.append(node[stop])
            row, node, fitted, cut = row[~stop], node[~stop], fitted[~stop], cut[~stop]
            y = along[row, level] - cut
            low, high = y < SPILL, y >= -SPILL
            deeper = lambda side, bit: np.where(self._reaches(2 * fitted[side] + bit, level + 1), 2 * fitted[side] + bit, fitted[side])  # noqa: B023, E731
            fitted = np.concatenate([deeper(low, 0), deeper(high, 1)])
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
        return np.concatenate([*done_row, row]), np.concatenate([*done_node, node])

    def _reaches(self, nodes: np.ndarray, level: int) -> np.ndarray:
        """Whether the sample reaches a node, or the node is a leaf that a cut without number makes of it."""
        kinds, back = np.unique(nodes, return_inverse=True)
        own = np.array([(int(f), level) in self.cuts or level == self.depth for f in kinds], bool)
        return own[back] if len(kinds) else np.zeros(0, bool)


def _cut(y: np.ndarray) -> float:
    """The cut between the sample's 30th and 70th percentile that has the fewest points within SPILL; not a number where that is too many."""
    if len(y) < 2:
        return float("nan")
    y = np.sort(y)
    tries = np.unique(np.quantile(y, np.linspace(0.3, 0.7, 17)))
    near = np.searchsorted(y, tries + SPILL) - np.searchsorted(y, tries - SPILL)
    best = int(np.argmin(near + np.abs(np.searchsorted(y, tries) - len(y) / 2) * 0.2))
    return float("nan") if near[best] > MOST * len(y) else float(tries[best])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles of paired unit vectors; by the chord, which is exact for small ones."""
    return 2 * np.arcsin(np.clip(np.linalg.norm(x - y, axis=1) / 2, 0, 1))


def _by_key(batch: pa.RecordBatch, at: int):
    keys = np.array(batch.column(at).to_pylist(), object)
    for key in sorted(set(keys)):
        yield key, np.flatnonzero(keys == key)


def _grid(batches):
    """rep and the grid cell of each class (key, rep, v)."""
    for batch in batches:
        cell = np.zeros(batch.num_rows, np.int64)
        for key, own in _by_key(batch, 0):
            x = _unit(_matrix(batch.column(2).take(pa.array(own))))
            planes = np.random.default_rng(zlib.crc32(key.encode())).standard_normal((GRID, x.shape[1]))
            planes /= np.linalg.norm(planes, axis=1, keepdims=True)
            at = np.floor(x @ planes.T / STEP).astype(np.int64)
            out = np.zeros(len(own), np.int64)
            for j in range(GRID):
                out = out * 1_000_003 + at[:, j]
            cell[own] = out
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cell)], ["rep", "cell"])


def _from_pivot(batches):
    """rep, pivot, angle of classes (rep, v) with their pivots (pivot, pv)."""
    for batch in batches:
        angle = np.zeros(batch.num_rows)
        sizes = np.array([len(x) for x in batch.column(1)])
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            x, y = (_unit(_matrix(batch.column(i).take(pa.array(own)))) for i in (1, 3))
            angle[own] = _angles(x, y)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(angle)], ["rep", "pivot", "angle"])


def _seed(key: str, t: int) -> int:
    return zlib.crc32(key.encode()) * TREES + t


def _fit(table: pa.Table) -> pa.Table:
    """The cuts of a label's trees from its sample, as arrays."""
    key, depth = table.column("key")[0].as_py(), table.column("depth")[0].as_py()
    x = _unit(_matrix(table.sort_by("pt").column("v")))
    tree, node, level, cut = [], [], [], []
    for t in range(TREES):
        for (f, lower), c in Tree(x.shape[1], depth, _seed(key, t), {}).fit(x).cuts.items():
            tree.append(t), node.append(f), level.append(lower), cut.append(c)
    return pa.table({"key": pa.array([key] * len(tree), pa.string()), "tree": pa.array(tree, pa.int32()), "node": pa.array(node, pa.int64()), "level": pa.array(level, pa.int32()), "cut": pa.array(cut, pa.float64())})


def _leaves(shared, depths: dict[str, int]):
    """pt, leaves (tree and leaf as one number, ascending) of each point of the labels in depths; a label of depth 0 has one leaf."""

    def run(batches):
        cuts = shared.value
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for key, own in _by_key(batch, 1):
                x = _unit(_matrix(batch.column(2).take(pa.array(own))))
                depth = depths.get(key, 0)
                for t in range(TREES if depth else 1):
                    tree = Tree(x.shape[1], depth, _seed(key, t), cuts.get((key, t)))
                    row, leaf = tree.place(x)
                    for r, f in zip(own[row].tolist(), leaf.tolist()):
                        out[r].append((t << 48) + f)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(x)) for x in out], pa.list_(pa.int64()))], ["pt", "leaves"])

    return run


def _first_common(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The smallest common leaf of each pair."""
    width = max(max(map(len, a)), max(map(len, b)))
    pad = lambda x, fill: np.array([np.pad(r, (0, width - len(r)), constant_values=fill) for r in x])
    pa_, pb = pad(a, -1), pad(b, -2)
    out = np.full(len(pairs), np.iinfo(np.int64).max)
    for at in range(0, len(pairs), 20_000):
        p = pairs[at : at + 20_000]
        x, y = pa_[p[:, 0]], pb[p[:, 1]]
        hit = (x[:, :, None] == y[:, None, :]).any(2)
        out[at : at + 20_000] = np.where(hit, x, np.iinfo(np.int64).max).min(1)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    label, edges = np.arange(n), []
    for i, j in zip(a, b):
        if label[i] != label[j]:
            edges.append((i, j))
            label[label == label[j]] = label[i]
    return edges


_LINKS = "rep long, n_links long, b long, open boolean"


def _report(rep: np.ndarray, links: np.ndarray, edges: list, still: np.ndarray) -> pa.Table:
    """Rows of three kinds: link counts (b null), edges (open false), pairs of balls left open (open true)."""
    some = np.flatnonzero(links)
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    return pa.table({
        "rep": np.concatenate([rep[some], rep[a], rep[still[:, 0]]]), "n_links": np.concatenate([links[some], np.zeros(len(a) + len(still), np.int64)]),
        "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), rep[b], rep[still[:, 1]]]), mask=np.arange(len(some) + len(a) + len(still)) < len(some)),
        "open": np.concatenate([np.zeros(len(some) + len(a), bool), np.ones(len(still), bool)]),
    })


def _compare(table: pa.Table) -> pa.Table:
    """Link counts, a spanning forest and open pairs of balls of one pair of parts of one leaf of points (pt, n, v, r)."""
    table = table.sort_by("pt")
    leaf = table.column("leaf")[0].as_py()
    side, rep = table.column("side").to_numpy(), table.column("pt").to_numpy()
    n, r = table.column("n").to_numpy(), table.column("r").to_numpy()
    x = _unit(_matrix(table.column("v")))
    own = [np.array(v, np.int64) for v in table.column("leaves").to_pylist()]
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    links, edges, still = np.zeros(len(rep), np.int64), [], np.zeros((0, 2), np.int64)
    if len(left) and len(right):
        reach = np.minimum(ANGLE + r[left][:, None] + r[right][None, :] + SLACK, np.pi)
        dots = x[left] @ x[right].T
        found = np.argwhere(dots >= np.minimum(np.cos(reach), THRESHOLD))
        if one:
            found = found[found[:, 0] < found[:, 1]]
        if len(found):
            found = found[_first_common([own[i] for i in left], [own[i] for i in right], found) == leaf]
        if len(found):
            a, b, dot = left[found[:, 0]], right[found[:, 1]], dots[found[:, 0], found[:, 1]]
            radii = r[a] + r[b]
            sure = np.where(radii == 0, dot >= THRESHOLD, np.arccos(np.clip(dot, -1, 1)) + radii <= ANGLE - SLACK)
            still = np.column_stack([a, b])[~sure & (radii > 0)]
            a, b = a[sure], b[sure]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            edges = _forest(len(rep), a, b)
    return _report(rep, links, edges, still)


def _compare_balls(table: pa.Table) -> pa.Table:
    """Link counts and a spanning forest between parts of two balls, vector by vector (rep, n, v)."""
    table = table.sort_by("rep")
    side, rep, n = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
    x = _unit(_matrix(table.column("v")))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = np.argwhere(x[left] @ x[right].T >= THRESHOLD) if len(left) and len(right) else np.zeros((0, 2), np.int64)
    a, b = left[found[:, 0]], right[found[:, 1]]
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, a, n[b])
    np.add.at(links, b, n[a])
    return _report(rep, links, _forest(len(rep), a, b), np.zeros((0, 2), np.int64))


def points(classes: DataFrame) -> DataFrame:
    """rep, pt for classes (rep, key, v, n): the ball or the single vector that each belongs to; and angle, to the ball's pivot."""
    cells = classes.join(classes.select("key", "rep", "v").mapInArrow(_grid, "rep long, cell long"), "rep").select("rep", "key", "cell")
    cells = store(cells, "grid")
    first = cells.groupBy("key", "cell").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").drop("last")
    near = cells.join(first, ["key", "cell"]).select("rep", "pivot").where("rep <> pivot")
    pivots = classes.select(F.col("rep").alias("pivot"), F.col("v").alias("pv"))
    near = near.join(classes.select("rep", "v"), "rep").join(pivots, "pivot").select("rep", "v", "pivot", "pv")
    near = near.mapInArrow(_from_pivot, "rep long, pivot long, angle double").where(F.col("angle") <= RADIUS)
    return store(
        classes.select("rep", "n").join(near, "rep", "left").select("rep", "n", F.coalesce("pivot", "rep").alias("pt"), F.coalesce("angle", F.lit(0.0)).alias("angle")),
        "points",
    )


def place(found: DataFrame) -> DataFrame:
    """pt, leaves for points (pt, key, v)."""
    spark = found.sparkSession
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("points"))
    sizes = store(sizes.withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("points") / F.lit(LEAF)))).cast("int")), "labels")
    deep = sizes.where("depth > 0")
    share = F.pmod(F.xxhash64("pt"), F.lit(1_000_000)) < F.lit(1_000_000) * F.lit(float(SAMPLE)) / F.col("points") + 1
    keys = sorted((r["key"], r["depth"]) for r in deep.select("key", "depth").collect())
    # a tree has at most SAMPLE / ENOUGH fitted nodes, and each of its lowest ones a cut for every level below
    size = lambda depth: TREES * (SAMPLE // ENOUGH) * (depth + 2) * 100
    batches, total = [], 0
    for key, depth in keys:
        if not batches or total + size(depth) > FOREST_BYTES:
            batches.append({})
            total = 0
        batches[-1][key] = depth
        total += size(depth)
    spread = max(8, spark.sparkContext.defaultParallelism)
    flat = found.join(deep.select("key"), "key", "left_anti").select("pt", "key", "v")
    out = [flat.mapInArrow(_leaves(spark.sparkContext.broadcast({}), {}), "pt long, leaves array<long>")]
    for depths in batches:
        names = F.broadcast(spark.createDataFrame(sorted(depths.items()), "key string, depth int"))
        own = found.join(names, "key")
        drawn = own.join(F.broadcast(deep.select("key", "points").join(names.select("key"), "key")), "key").where(share).select("pt", "key", "v", "depth")
        cuts: dict[tuple[str, int], dict[tuple[int, int], float]] = {}
        for r in drawn.groupBy("key").applyInArrow(_fit, "key string, tree int, node long, level int, cut double").collect():
            cuts.setdefault((r["key"], r["tree"]), {})[(r["node"], r["level"])] = r["cut"]
        ready = own.select("pt", "key", "v").repartition(spread, "pt")
        out.append(ready.mapInArrow(_leaves(spark.sparkContext.broadcast(cuts), depths), "pt long, leaves array<long>"))
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    return placed


def _dealt(at: DataFrame) -> DataFrame:
    """at (with its part p of parts) once for each pair of parts i <= j that p is in."""
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    task = F.transform(every, lambda q: F.struct(F.least(q, "p").alias("i"), F.greatest(q, "p").alias("j")))
    return at.withColumn("task", F.explode(task)).withColumn("i", F.col("task.i")).withColumn("j", F.col("task.j")).withColumn(
        "side", F.when(F.col("p") == F.col("i"), 0).otherwise(1)
    )


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding, label)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    fit = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"),
        F.coalesce(fit, F.lit(False)).alias("fit"),
    )
    key = F.concat_ws(":", "label", F.size("v"))
    classes = rows.where("fit").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("key", key)
    # a vec_id with several vectors may lead several classes; classes are numbered by their own vector for that
    classes = store(classes.withColumn("rep", F.xxhash64("key", "v")), "vectors")
    member = points(classes)
    balls = member.groupBy("pt").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.max("angle").alias("r"))
    found = store(balls.join(classes.select(F.col("rep").alias("pt"), "key", "v"), "pt"), "balls")
    placed = store(found.join(place(found), "pt"), "placed")
    leaf = placed.select("pt", "key", F.explode("leaves").alias("leaf"))
    parts, seen = store_counted(
        leaf.groupBy("key", "leaf").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "leaf", F.ceil(F.col("k") / F.lit(PART)).cast("int").alias("parts")),
        "leaves", n=F.count(F.lit(1)),
    )
    at = placed.select("pt", "key", "n", "v", "r", "leaves", F.explode("leaves").alias("leaf")).join(small(parts, seen["n"]), ["key", "leaf"])
    dealt = _dealt(at.withColumn("p", F.pmod(F.xxhash64("pt"), F.col("parts")).cast("int")))
    dealt = dealt.select("key", "leaf", "i", "j", "pt", "n", "v", "r", "leaves", "side")
    links, opened = store_counted(dealt.groupBy("key", "leaf", "i", "j").applyInArrow(_compare, _LINKS), "vector-links", open=F.count_if("open"))
    by_point = links.where("b is null").groupBy(F.col("rep").alias("pt")).agg(F.sum("n_links").alias("links"))
    edges = links.where("b is not null and not open").select(F.col("rep").alias("a"), "b")
    edges = edges.unionByName(member.where("rep <> pt").select(F.col("rep").alias("a"), F.col("pt").alias("b")))
    counts = member.join(balls.select("pt", F.col("n").alias("all")), "pt").join(by_point, "pt", "left").select(
        "rep", (F.col("all") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    if opened["open"]:
        more = _between(links.where("open").select("rep", "b"), member, classes, balls)
        counts = counts.unionByName(more.where("b is null").select("rep", F.col("n_links").alias("links"))).groupBy("rep").agg(F.sum("links").alias("links"))
        edges = edges.unionByName(more.where("b is not null").select(F.col("rep").alias("a"), "b"))
    joined = components(edges, "vectors")
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    result = named.join(least, "component").join(counts, "rep").select("label", "v", F.col("links").alias("n_links"), "component_id")
    good = rows.where("fit").join(result, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _between(pairs: DataFrame, member: DataFrame, classes: DataFrame, balls: DataFrame) -> DataFrame:
    """Links between the vectors of pairs of balls (rep, b), each pair of parts in a task."""
    cut = F.ceil(F.col("m") / F.lit(PART)).cast("int")
    sides = []
    for own, other, side in (("rep", "b", 0), ("b", "rep", 1)):
        one, two = balls.select(F.col("pt").alias(own), cut.alias("mine")), balls.select(F.col("pt").alias(other), cut.alias("others"))
        tasks = pairs.join(one, own).join(two, other).select(F.col("rep").alias("x"), F.col("b").alias("y"), F.col(own).alias("pt"), "mine", "others")
        rows = tasks.join(member.select("rep", "pt", "n"), "pt").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("mine")).cast("int"))
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        i, j = ("p", "q") if side == 0 else ("q", "p")
        sides.append(rows.select("x", "y", F.col(i).alias("i"), F.col(j).alias("j"), "rep", "n", F.lit(side).alias("side")))
    both = sides[0].unionByName(sides[1]).join(classes.select("rep", "v"), "rep")
    return store(both.groupBy("x", "y", "i", "j").applyInArrow(_compare_balls, _LINKS), "ball-links")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) x from embeddings),
f as (select * from v where label is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
e as (select a.vec_id a, b.vec_id b from f a join f b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.98),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) m from r group by a), n as (select a, count(*)::bigint n from e group by a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept
from v left join n on n.a = vec_id left join c on c.a = vec_id
"""
