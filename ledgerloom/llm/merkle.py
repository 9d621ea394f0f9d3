"""Merkle manifest of a dataset with lookup proofs by coordinates.

Every row is a leaf: a digest of its length-prefixed fields. Per source the leaves ascend by doc_id, and every FAN consecutive nodes become the digest of
their concatenation until one is left, the source's subroot; subroots, ordered by source, likewise give the root. The node table (tree, level, at, digest) is
materialised. Sources are trees 0, 1, ... in their order, the tree above them is -1.

A proof is looked up by coordinates. From a leaf's index, its source's size and FAN follow the coordinates of all siblings on its path. The leaves
of a run have the same path but for their places in the run, so a run explodes its coordinates once, joins the node table, orders what it finds and concatenates
it; its leaves then fold their digest through it. Nodes of low levels are asked for by few runs each and are joined by a shuffle; the levels
above the first whose nodes, with all above, are BROADCAST_ROWS at most are broadcast. The path above a subroot is looked up once a source and given to its runs in blocks.

The rank of a leaf comes from one range partitioning by (source, doc_id, leaf): the row's place in its sorted partition plus the sizes of the
partitions before, so no task holds a source. Texts are digested in the scan and not moved.

Rules: a null field is "-"; a null source is a source of its own and comes first. Null doc_ids come first in their source, rows of one doc_id follow the order of
their leaves, and equal rows have equal leaves in neighbouring places, so the result is the same multiset whatever their order. Without siblings proof_sha256 is the
digest of the empty text. An empty table gives an empty result. Other columns are ignored. Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import BROADCAST_ROWS, partitions, small, store, store_counted

FAN, BITS = 16, 4
#: Leaves in a range partition at least, where there are as many.
PART_ROWS = 20_000
#: Runs of a source that share a copy of the path above its subroot.
BLOCK = 4_096
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """UTF-8 byte count, colon, value; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' concatenation."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def ranked(rows: DataFrame, *order: str, name: str, count: int) -> DataFrame:
    """rows with place, their rank from 0 in the order of the given columns, nulls first; stored. Of the driver or one task it takes a row a partition."""
    parts = max(1, min(partitions(rows.sparkSession), count // PART_ROWS))
    row = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    placed = placed.sortWithinPartitions(*order).withColumn("part", F.shiftright(row, 33).cast("int")).withColumn("place", row.bitwiseAND((1 << 33) - 1))
    placed = store(placed, name)
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("place", F.col("place") + F.col("before")).drop("before")


def nodes_at(n: Column | str, level: Column | str) -> Column:
    """Nodes of a level in a tree of n leaves."""
    return F.expr(f"shiftright({n} - 1, cast({BITS} * ({level}) as int)) + 1")


def levels_of(n: int) -> int:
    """Levels of a tree of n leaves that have more than one node."""
    levels = 0
    while n - 1 >> BITS * levels > 0:
        levels += 1
    return levels


def grown(leaves: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Levels 0 to levels of the node table (tree, n, level, at, digest) above leaves (tree, n, at, digest); each is stored. A tree ends with its root."""
    out = [leaves.withColumn("level", F.lit(0))]
    for level in range(1, levels + 1):
        below = out[-1].where(nodes_at("n", "level") > 1)
        runs = below.groupBy("tree", "n", F.shiftright("at", BITS).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        out.append(store(runs.select("tree", "n", "at", F.unhex(digest(joined)).alias("digest"), F.lit(level).alias("level")), f"{name}-{level}"))
    return out


def coordinates(at: str, n: str) -> Column:
    """Level and place of every sibling on the path from place at in a tree of n leaves."""
    return F.expr(
        f"flatten(transform(filter(sequence(0, 15), l -> shiftright({n} - 1, {BITS} * l) > 0), l -> "
        f"transform(filter(sequence(shiftleft(shiftright({at}, {BITS} * (l + 1)), {BITS}), least(shiftleft(shiftright({at}, {BITS} * (l + 1)), {BITS}) + {FAN - 1}, shiftright({n} - 1, {BITS} * l))), "
        f"x -> x <> shiftright({at}, {BITS} * l)), x -> struct(l as level, x as at))))"
    )


def looked_up(asked: DataFrame, keys: list[str], at: str, n: str, tables: list[DataFrame], sizes: list[int]) -> DataFrame:
    """keys and found, the nodes (level, at, digest) at the sibling coordinates of place at of tree home, in order. tables are the levels of the node table, with
    sizes rows. A column also, where it is there, adds one coordinate."""
    every = coordinates(at, n)
    if "also" in asked.columns:
        every = F.array_append(every, F.col("also"))
    every = asked.select(*keys, "home", F.explode_outer(every).alias("c")).select(*keys, "home", "c.level", "c.at")
    high = len(tables)
    while high and sum(sizes[high - 1 :]) <= BROADCAST_ROWS:
        high -= 1
    found = []
    for part, own, hint in ((every.where(~(F.col("level") >= high) | F.col("level").isNull()), tables[:high], False), (every.where(F.col("level") >= high), tables[high:], True)):
        if own:
            nodes = _union(own).select(F.col("tree").alias("home"), "level", "at", "digest")
            part = part.join(F.broadcast(nodes) if hint else nodes, ["home", "level", "at"], "left")
        else:
            part = part.withColumn("digest", F.lit(None).cast("binary"))
        found.append(part.select(*keys, "level", "at", "digest"))
    node = F.when(F.col("level").isNotNull(), F.struct("level", "at", "digest"))
    return found[0].unionByName(found[1]).groupBy(*keys).agg(F.sort_array(F.collect_list(node)).alias("found"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("tree", "n", "level", "at", "digest")
    for t in tables[1:]:
        out = out.unionByName(t.select("tree", "n", "level", "at", "digest"))
    return out


def _steps(found: str, at: str, first: int) -> Column:
    """An array of (pre, post), from level first up: the siblings' digests before and after the path's own node. found holds (level, at, digest) in order."""
    def side(sign: str) -> str:
        return f"array_join(transform(filter({found}, x -> x.level = l and x.at {sign} shiftright({at}, {BITS} * l)), x -> lower(hex(x.digest))), '')"
    return F.expr(f"transform(array_distinct(transform(filter({found}, x -> x.level >= {first}), x -> x.level)), l -> struct({side('<')} as pre, {side('>')} as post))")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", UPPER, LOWERED)
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    tampered = F.when(changed & (lowered != F.col("text")), F.unhex(digest(*fields, field(lowered))))
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.unhex(digest(*fields, field(F.col("text")))).alias("digest"), tampered.alias("tampered"))
    count = docs.count()
    placed = ranked(leaves, "source", "doc_id", "digest", name="leaves", count=count)

    sources = placed.groupBy("source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    sources, seen = store_counted(sources, "sources", trees=F.count(F.lit(1)), most=F.max("n"))
    if not count:
        return docs.select(F.col("doc_id"), *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified")).where("false")
    trees = store(ranked(sources, "first", name="trees", count=seen["trees"]).select("source", "first", "n", F.col("place").alias("tree")), "trees")
    # a source's rows meet its tree by partition, so that no source meets it in one task
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("name")
    per = placed.select("part", name).distinct().join(small(trees.select(name, "tree", "n", "first"), seen["trees"]), "name")
    per, met = store_counted(per, "parts", n=F.count(F.lit(1)))
    leaves = placed.select("*", name).join(small(per, met["n"]), ["part", "name"])
    leaves = store(leaves.select("doc_id", "tree", "n", (F.col("place") - F.col("first")).alias("at"), "digest", "tampered"), "leaves")

    levels, top_n = levels_of(seen["most"]), seen["trees"]
    tables = grown(leaves.select("tree", "n", "at", "digest"), levels, "nodes")
    own_size = [F.sum(F.when(nodes_at("n", max(0, k - 1)) > 1, nodes_at("n", k)).otherwise(F.lit(int(k == 0)))) for k in range(levels + 1)]
    sizes = list(trees.agg(*[c.alias(f"s{k}") for k, c in enumerate(own_size)]).first())
    roots = _union(tables).where(nodes_at("n", "level") == 1).select("tree", "digest")
    top = grown(roots.select(F.lit(-1).cast("long").alias("tree"), F.lit(top_n).cast("long").alias("n"), F.col("tree").alias("at"), "digest"), levels_of(top_n), "top")
    root = F.lit(top[-1].first()["digest"].hex())

    # the path above each subroot, once a source, given to blocks of its runs
    asked = trees.select("tree", F.lit(top_n).cast("long").alias("trees"), F.lit(-1).cast("long").alias("home"))
    above = looked_up(asked, ["tree"], "tree", "trees", top, [(top_n - 1 >> BITS * k) + 1 for k in range(len(top))])
    blocks = trees.select("tree", F.explode(F.expr(f"sequence(0L, shiftright(n - 1, {BITS}) div {BLOCK})")).alias("block"))
    above = above.select("tree", _steps("found", "tree", 0).alias("top")).join(roots.withColumnRenamed("digest", "subroot"), "tree").join(blocks, "tree")

    first = F.struct(F.lit(0).alias("level"), F.col("at").alias("at"))
    runs = leaves.where(F.col("at") % FAN == 0).select("tree", "n", F.col("at").alias("first"), F.col("tree").alias("home"), first.alias("also"))
    paths = looked_up(runs, ["tree", "first"], "first", "n", tables, sizes).withColumn("run", F.shiftright("first", BITS))
    paths = paths.select(
        "tree", "run", F.transform(F.filter("found", lambda x: x["level"] == 0), lambda x: F.lower(F.hex(x["digest"]))).alias("run_digests"),
        _steps("found", "first", 1).alias("up"), F.expr(f"run div {BLOCK}").alias("block"),
    )
    paths = paths.join(above, ["tree", "block"]).select("tree", "run", "run_digests", F.concat("up", "top").alias("up"), F.lower(F.hex("subroot")).alias("subroot"))
    own = leaves.withColumn("run", F.shiftright("at", BITS)).join(paths, ["tree", "run"])

    j = (F.col("at") % FAN).cast("int")
    pre = F.array_join(F.slice("run_digests", F.lit(1), j), "")
    post = F.array_join(F.slice("run_digests", j + 2, F.lit(FAN)), "")
    leaf = F.lower(F.hex("digest"))
    start = F.lower(F.hex(F.coalesce("tampered", "digest")))
    begun = F.when(F.col("n") == 1, start).otherwise(digest(pre, start, post))
    folded = F.aggregate("up", begun, lambda acc, x: digest(x["pre"], acc, x["post"]))
    proof = digest(pre, post, F.array_join(F.transform("up", lambda x: F.concat(x["pre"], x["post"])), ""))
    return own.select("doc_id", leaf.alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive f as (
  select doc_id, source, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') head, coalesce(strlen(text) || ':' || text, '-') body,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b:
      list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))), 4294967295) % 5 = 0 as changed
  from documents),
d as (select doc_id, source, sha256(head || body) leaf,
    sha256(head || case when changed then translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else body end) tampered from f),
r as (select row_number() over () rid, doc_id, leaf, tampered, dense_rank() over (order by source nulls first) - 1 tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) n from d),
nodes as (select tree, 0 as level, pos, n, leaf h from r
  union all select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 16, n),
subroots as (select tree, h, count(*) over () n from nodes where n = 1),
tops as (select 0 as level, tree as pos, n, h from subroots
  union all select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 16, n),
every as (select tree, level, pos, h from nodes union all select -1, level, pos, h from tops),
sides as (select tree, level, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') pre,
    coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') post from every window w as (partition by tree, level, pos // 16 order by pos)),
low as (select rid, tree, 0 as level, pos, n, tampered h, '' proof from r
  union all select rid, p.tree, p.level + 1, p.pos // 16, (n + 15) // 16, sha256(pre || h || post), proof || pre || post
  from low p join sides s on s.tree = p.tree and s.level = p.level and s.pos = p.pos where n > 1),
high as (select rid, 0 as level, l.tree as pos, s.n, l.h, proof from low l join subroots s using (tree) where l.n = 1
  union all select rid, p.level + 1, p.pos // 16, (n + 15) // 16, sha256(pre || h || post), proof || pre || post
  from high p join sides s on s.tree = -1 and s.level = p.level and s.pos = p.pos where n > 1)
select doc_id, leaf, subroots.h subroot, tops.h root, sha256(proof) proof_sha256, high.h folded_root, high.h = tops.h verified
from r join high using (rid) join subroots using (tree) cross join tops where high.n = 1 and tops.n = 1
"""
