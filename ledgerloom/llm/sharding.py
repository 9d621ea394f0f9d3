"""Sharding by best-fit-decreasing bin packing.

Rows of equal texts are a group that stays together. Groups sorted by size, largest first, enter the open bin with
the least remaining capacity that holds them, found in a balanced tree over the remaining capacities. The capacity is
the smallest for which all groups fit into the given number of shards (bisection), so shard sizes come out near equal.

Every group goes through the packing. Groups of equal size are interchangeable, so the packing works on runs: Spark counts the
groups of each size, the driver packs sizes with their counts (a bin that was tightest for an item stays so for the next one of the same size, so a
run fills it at once), and the ranks of a size's groups are dealt to the bins of its run. What reaches the driver is a row a
distinct size, at most the square root of twice all bytes, however many rows there are; what goes back are intervals of ranks.

A group above an even shard cannot stay in one shard with sizes near equal; it alone is cut, into pieces by a hash of
its rows, which are packed as groups. Sizes and pieces are counted by map-side combined aggregation over all rows.

Ranks and slots are numbered in cells of about CELL_ROWS rows, with the cells' counts as offsets.

A null text has size 16, crc 0 and its own group (equal to the empty text). Null and repeated doc_ids are allowed. Fully equal rows
of a cell take its slots in either order. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._spark import small, store, store_counted

SHARDS = 40
OVERHEAD = 16
PIECES = 4096
CELL_ROWS = 1024


class RemainingTree:
    """The open bins by (remaining capacity, bin): an AVL tree with removal of the tightest bin that holds a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    def insert(self, item: tuple[int, int]) -> None:
        self.root = _insert(self.root, item)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the entry of least capacity >= size, the first bin among equals."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is not None:
            self.root = _remove(self.root, found)
        return found


# A node is (item, left, right, height).


def _height(node) -> int:
    return node[3] if node else 0


def _node(item, left, right):
    return (item, left, right, 1 + max(_height(left), _height(right)))


def _balanced(item, left, right):
    if _height(left) > _height(right) + 1:
        if _height(left[1]) < _height(left[2]):
            inner = left[2]
            return _node(inner[0], _node(left[0], left[1], inner[1]), _node(item, inner[2], right))
        return _node(left[0], left[1], _node(item, left[2], right))
    if _height(right) > _height(left) + 1:
        if _height(right[2]) < _height(right[1]):
            inner = right[1]
            return _node(inner[0], _node(item, left, inner[1]), _node(right[0], inner[2], right[2]))
        return _node(right[0], _node(item, left, right[1]), right[2])
    return _node(item, left, right)


def _insert(node, item):
    if node is None:
        return _node(item, None, None)
    if item < node[0]:
        return _balanced(node[0], _insert(node[1], item), node[2])
    return _balanced(node[0], node[1], _insert(node[2], item))


def _remove(node, item):
    if item < node[0]:
        return _balanced(node[0], _remove(node[1], item), node[2])
    if item > node[0]:
        return _balanced(node[0], node[1], _remove(node[2], item))
    if node[1] is None or node[2] is None:
        return node[1] or node[2]
    least = node[2]
    while least[1] is not None:
        least = least[1]
    return _balanced(least[0], node[1], _remove(node[2], least[0]))


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """Packs runs (size, count) of falling sizes: pieces (run, bin, items) in order of placing, and the number of bins. A size above
    the capacity gets bins of its own. Stops when there are more than most bins."""
    tree, pieces, count = RemainingTree(), [], 0
    for i, (size, left) in enumerate(runs):
        while left:
            found = tree.take_tightest(size)
            if found is None:
                found = (max(capacity, size), count)
                count += 1
                if most is not None and count > most:
                    return pieces, count
            fit = min(left, found[0] // size)
            tree.insert((found[0] - fit * size, found[1]))
            pieces.append((i, found[1], fit))
            left -= fit
    return pieces, count


def pack(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Pieces (run, shard, items) by best fit decreasing at the smallest capacity found that needs no more shards. An item above an
    even share of what is left gets a shard of its own first, so that the others are still even among the rest."""
    runs, alone = list(runs), []
    total = sum(size * n for size, n in runs)
    for i, (size, n) in enumerate(runs):
        while n and size * (shards - len(alone)) > total and shards - len(alone) > 1:
            alone.append((i, len(alone), 1))
            total, n = total - size, n - 1
        runs[i] = (size, n)
        if n:
            break
    taken = len(alone)
    left = shards - taken
    low = max([-(-total // left), *(size for size, n in runs if n)][:2])
    high = low
    best, count = best_fit_decreasing(runs, high, left)
    while count > left:
        low, high = high + 1, high + max(1, high // 50)
        best, count = best_fit_decreasing(runs, high, left)
    while high - low > max(0, high // 100_000):
        middle = (low + high) // 2
        pieces, count = best_fit_decreasing(runs, middle, left)
        if count <= left:
            best, high = pieces, middle
        else:
            low = middle + 1
    return alone + [(i, b + taken, n) for i, b, n in best]


def _numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows (with a column cell) and their place, from 0, among those of equal keys: by cell, then by order."""
    ahead = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*keys, "cell").orderBy(*order)
    out = rows.withColumn("place", F.row_number().over(inside) - 1).join(offsets, [*keys, "cell"])
    return out.withColumn(name, (F.col("offset") + F.col("place")).cast("long")).drop("offset", "place", "cell")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"),
        ),
        "sizes",
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    groups, seen = store_counted(groups, "groups", total=F.sum("total"), rows=F.sum("n"))
    total, n_rows = int(seen["total"] or 0), int(seen["rows"] or 0)
    # fewer groups than shards can be above an even shard
    cut = [(bytearray(r["grp"]),) for r in groups.where(F.col("total") * shards > total).select("grp").collect()]
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PIECES)).cast("int")
    if cut:
        marked = F.broadcast(spark.createDataFrame(cut, "grp binary").withColumn("cut", F.lit(True)))
        rows = rows.join(marked, "grp", "left").withColumn("piece", F.when(F.col("cut"), piece).otherwise(0)).drop("cut")
    else:
        rows = rows.withColumn("piece", F.lit(0))
    n_cells = max(1, n_rows // CELL_ROWS)
    items = rows.groupBy("grp", "piece").agg(F.sum("size").alias("total"))
    items = _numbered(items.withColumn("cell", F.pmod(F.xxhash64("grp", "piece"), F.lit(n_cells))), ["total"], ["grp", "piece"], "rank")
    items = store(items, "items")
    runs = sorted(((int(r["total"]), int(r["n"])) for r in items.groupBy("total").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    dealt, at = [], {}
    for i, to, n in pack(runs, shards):
        first = at.get(i, 0)
        dealt.append((runs[i][0], first, first + n, to))
        at[i] = first + n
    intervals = small(spark.createDataFrame(dealt, "total long, first long, last long, shard int"), len(dealt))
    placed = items.join(intervals, "total").where("rank >= first and rank < last").select("grp", "piece", "shard")
    out = rows.join(placed, ["grp", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    cells = max(1, n_rows // (shards * CELL_ROWS))
    out = store(out.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells))), "shards")
    out = _numbered(out, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
