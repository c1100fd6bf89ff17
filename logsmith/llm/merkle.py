"""Merkle manifest of a dataset: every row is a leaf, every group of rows a tree, and a tree over
the roots of the groups gives the root of the dataset.

Building works on sorted positions: a leaf's place in its group comes from a range sort and
counts per partition, so no group has to fit a task. ``stride`` levels are built at a time, from
blocks of ``2 ** stride`` neighbours. Every node of the bottom level of such a block is stored as
a row that links to its parent link, the block's top node, with the siblings on the way there;
``stride = 1`` stores plain parents. A recursive query of Spark then climbs: all leaves ascend
together, one link a step, and each appends the siblings that it meets to its proof and folds
them into its own hash. The subroots of the groups are the leaves of the top tree, so that one
climb leads from a leaf to the root of the dataset. Links of leaves stand in the table of the
leaves, which start with them; the links above are fewer by a factor of ``2 ** stride``, and
Spark broadcasts them or not by their size.

Defined results: a null value is hashed as ``-``, so it differs from an empty one; equal group
values, null included, are one group; rows are ordered by the order column (null first) and
among equal ones by their hash, so that repeated rows are neighbours, each with a place and a
proof of its own; a lone leaf is its group's subroot, a lone group's subroot is the root, and an
empty proof hashes the empty string; an empty table has no rows and no root. Only named columns
are hashed: others pass through untouched, also under the names of results, which stand in a
table of their own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logsmith.llm.common import staged

#: Levels that one link climbs: blocks of 2 ** STRIDE nodes are built in one group.
STRIDE = 10
#: The group number of the top tree, whose leaves are the subroots.
TOP = -1
#: Rows of a recursive query are bounded by Spark unless this setting lifts it.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def encoded(col: Column | str) -> Column:
    """A value as ``<UTF-8 byte count>:<value>``, null as ``-``."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*cols: Column | str) -> Column:
    """SHA-256 (binary) of the encoded values, concatenated."""
    return F.unhex(F.sha2(F.concat(*map(encoded, cols)), 256))


@dataclass
class Manifest:
    """``leaves``: the rows that were given with their links, ``nodes``: the links above them. A
    link: ``tree, level, pos`` of the node, ``up_tree, up_level, up_pos`` of the one it leads to,
    ``path`` (the siblings on the way; null where a node is alone) and ``subroot`` (where it leads
    to one). ``root``: lower-case hex, none of an empty table. ``height``: levels of the top tree.
    ``links``: most links from a leaf to the root."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    height: int
    links: int


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``tree`` (rank of the group value, from 0, null first), ``pos`` (place in the
    group by ``order``, from 0) and ``total`` (rows of the group), without a group in one task:
    a range sort, counts per partition and group, and sums over the partitions before."""
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    keys = [F.asc_nulls_first(k) for k in (group, *order)] + [F.col("_row")]  # equal rows are split, too
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    dealt = staged(dealt.withColumn("_idx", F.monotonically_increasing_id()), "merkle-sorted")
    dealt = dealt.withColumn("_part", F.shiftright("_idx", 33))
    runs = dealt.groupBy("_part", F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    of_group = Window.partitionBy("_group")
    runs = runs.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("_n").over(of_group),
            "_start": F.min("_part").over(of_group),
        }
    )
    runs = staged(runs, "merkle-runs")
    # groups that start in a partition, summed over the partitions before: a row per partition
    starts = runs.where("_part = _start").groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    earlier = starts.select(
        F.col("_part").alias("_start"),
        F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    in_part = Window.partitionBy("_part").orderBy(F.asc_nulls_first("_group"))
    ranked = runs.where("_part = _start").select("_part", "_group", (F.row_number().over(in_part) - 1).alias("_rank"))
    trees = ranked.join(earlier, ranked["_part"] == earlier["_start"]).select(
        F.col("_group").alias("_tree_of"), (F.col("_offset") + F.col("_rank")).cast("long").alias("tree")
    )
    runs = runs.join(trees, runs["_group"].eqNullSafe(trees["_tree_of"])).drop("_tree_of", "_start", "_n")
    r = runs.withColumnRenamed("_part", "_of")
    placed = dealt.join(r, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    place = (F.col("_before") + F.col("_idx") - F.col("_first")).alias("pos")
    return placed.select(*[c for c in dealt.columns if c not in ("_idx", "_part")], "tree", place, "total")


def height_of(total: Column | str) -> Column:
    """Levels above ``total`` leaves: the bits of ``total - 1``."""
    n = F.col(total) if isinstance(total, str) else total
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _links(members: DataFrame, level: int, stride: int) -> DataFrame:
    """Nodes (``tree, pos, height, digest`` and what else they carry, all at ``level``) with their
    links ``steps`` levels up and ``up_digest``, the digest of the node that the link leads to."""
    # digests are hashed as hex text; lv0 is the block in order, lv<i> the level i above it
    carried = [c for c in members.columns if c not in ("tree", "height")]
    out = members.groupBy("tree", "height", F.shiftright("pos", stride).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(*carried))).alias("m")  # pos comes first
    )
    steps = F.least(F.lit(stride), F.col("height") - level)
    out = out.withColumn("steps", steps).withColumn("lv0", F.expr("transform(m, x -> lower(hex(x.digest)))"))
    for i in range(1, stride + 1):
        pairs = f"sequence(0, (size(lv{i - 1}) - 1) div 2)"
        up = f"transform({pairs}, k -> sha2(concat(lv{i - 1}[2 * k], coalesce(get(lv{i - 1}, int(2 * k + 1)), '')), 256))"
        out = out.withColumn(f"lv{i}", F.expr(f"if(steps >= {i}, {up}, cast(array() as array<string>))"))
    levels = ", ".join(f"lv{i}" for i in range(stride))
    path = "transform(slice(levels, 1, steps), (lv, i) -> unhex(get(lv, int(shiftright(j, i) ^ 1))))"
    out = out.withColumns({"levels": F.expr(f"array({levels})"), "top": F.expr(f"array({levels}, lv{stride})[steps][0]")})
    out = out.select(
        "tree", "height", (F.lit(level) + F.col("steps")).alias("up_level"), "block", F.unhex("top").alias("up_digest"),
        F.expr(f"explode(transform(m, (x, j) -> struct(x as node, {path} as path)))").alias("x"),
    )
    at_top = F.col("up_level") == F.col("height")
    inner = (F.col("tree") != TOP) & at_top  # the link leads to a subroot, a leaf of the top tree
    return out.select(
        "tree",
        F.lit(level).alias("level"),
        *(F.col(f"x.node.{c}").alias(c) for c in carried),
        F.when(inner, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("up_tree"),
        F.when(inner, 0).otherwise(F.col("up_level")).alias("up_level"),
        F.when(inner, F.col("tree")).otherwise(F.col("block")).alias("up_pos"),
        "height",
        at_top.alias("at_top"),
        "up_digest",
        F.col("x.path").alias("path"),
        F.when(inner, F.col("up_digest")).alias("subroot"),
    )


def _tops(links: DataFrame, stride: int) -> DataFrame:
    """What the links lead to, each node once."""
    once = links.where(F.col("pos") % (1 << stride) == 0)
    return once.select("tree", F.shiftright("pos", stride).alias("pos"), "height", F.col("up_digest").alias("digest"), "at_top")


def _build(members: DataFrame, height: int, stride: int) -> tuple[list[DataFrame], DataFrame]:
    """Links of all levels, bottom first, and the tops of the trees."""
    links, tops, level = [], [], 0
    while not links or level < height:
        links.append(staged(_links(members, level, stride), "merkle-links"))
        made = _tops(links[-1], stride)
        tops.append(made.where("at_top").select("tree", "digest"))
        members = made.where("not at_top").select("tree", "pos", "height", "digest")
        level += stride
    return links, _union(tops)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_LINK = ["tree", "level", "pos", "up_tree", "up_level", "up_pos", "path", "subroot"]


def build_manifest(leaves: DataFrame, group: str, order: str, digest: str = "leaf", stride: int = STRIDE) -> Manifest:
    """Build all trees over ``leaves`` (one row per leaf; ``digest`` is its binary hash, the other
    columns have to be orderable; names of links and ``height`` are taken)."""
    placed = numbered(leaves, group, order, digest).withColumn("height", height_of("total")).drop("total", group)
    placed = staged(placed.withColumnRenamed(digest, "digest"), "merkle-leaves")
    placed = placed.select("tree", "height", "pos", *[c for c in placed.columns if c not in ("tree", "height", "pos")])
    shape = placed.agg(F.max("height"), F.max("tree")).first()
    trees = 0 if shape[1] is None else shape[1] + 1
    (bottom, *upper), subroots = _build(placed, shape[0] or 0, stride)
    height = max(trees - 1, 0).bit_length()
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(height).alias("height"), "digest")
    top_links, top = _build(top, height, stride) if height else ([], top)
    root = top.select(F.lower(F.hex("digest"))).first()
    nodes = [x.select(_LINK) for x in upper + top_links] or [bottom.select(_LINK).where(F.lit(False))]
    leaves = bottom.drop("height", "at_top", "up_digest").withColumnRenamed("digest", digest)
    return Manifest(leaves, _union(nodes), root[0] if root else None, height, len(nodes) + 1)


def _climbed(path: str, pos: str, proof: str, folded: str) -> str:
    """The proof with the siblings of a path, and the hash folded with them, as SQL."""
    step = (
        "CASE WHEN x IS NULL THEN hex(a.h) WHEN a.p & 1 = 1 THEN concat(hex(x), hex(a.h)) ELSE concat(hex(a.h), hex(x)) END"
    )
    return f"""aggregate({path}, {proof}, (p, x) -> concat(p, coalesce(x, X''))),
    aggregate({path}, struct({folded} AS h, {pos} AS p),
      (a, x) -> struct(unhex(sha2(lower({step}), 256)) AS h, shiftright(a.p, 1) AS p), a -> a.h)"""


_CLIMB = f"""
WITH RECURSIVE climb(row, tree, level, pos, subroot, proof, folded) MAX RECURSION LEVEL {{most}} AS (
  SELECT row, up_tree, up_level, up_pos, subroot, {_climbed('path', 'pos', "X''", 'found')} FROM {{leaves}}
  UNION ALL
  SELECT c.row, n.up_tree, n.up_level, n.up_pos, coalesce(c.subroot, n.subroot), {_climbed('n.path', 'c.pos', 'c.proof', 'c.folded')}
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos
)
SELECT row, subroot, proof, folded FROM climb WHERE tree = {TOP} AND level = {{height}}
"""


def climb(manifest: Manifest, row: Column, found: Column, *results: Column) -> DataFrame:
    """Let the leaves ascend to the root: ``found`` is the binary hash that a leaf starts with,
    ``row`` what it carries along. Returns ``row``, ``subroot``, ``proof`` (the siblings in order)
    and ``folded``, all binary, or the given ``results`` made of them."""
    spark = manifest.leaves.sparkSession
    names = {k: f"_merkle_{k}_{uuid.uuid4().hex}" for k in ("leaves", "nodes")}
    link = [c for c in _LINK if c not in ("tree", "level")]
    manifest.leaves.select(*link, row.alias("row"), found.alias("found")).createOrReplaceTempView(names["leaves"])
    manifest.nodes.createOrReplaceTempView(names["nodes"])
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:  # the steps run here, while the limit is lifted; what is returned reads their result
        out = spark.sql(_CLIMB.format(height=manifest.height, most=manifest.links + 1, **names))
        return staged(out.select(*results) if results else out, "merkle-climb")
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def verify(docs: DataFrame, cols: list[str], group: str, order: str, tampered: Column, stride: int = STRIDE) -> DataFrame:
    """Manifest of ``docs`` over the values of ``cols``, and a check of every row against it:
    ``tampered`` is the row hash as a reader finds it. Returns the order column, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (all hex) and ``verified``."""
    rows = docs.select(
        F.col(group).alias("_by"), F.col(order).alias("_order"), row_hash(*cols).alias("leaf"), tampered.alias("_found")
    )
    manifest = build_manifest(rows, "_by", "_order", stride=stride)
    root = F.lit(manifest.root)
    folded = F.lower(F.hex("folded"))
    return climb(
        manifest,
        F.struct("_order", "leaf"),
        F.col("_found"),
        F.col("row._order").alias(order),
        F.lower(F.hex("row.leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )
