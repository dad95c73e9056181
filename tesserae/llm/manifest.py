"""Merkle manifest of a table: a tree of digests for each group, and one over the groups' roots.

A leaf is H of the row's fields; H is sha256 in lower-case hexadecimal of its inputs put together. The leaves of a group stand in
order, and as long as there is more than one node, every FANOUT successive ones become their H. A window over (group, number of the
parent) gives each node the ordered list of its run: that is the parent's input, and without the node itself it is the node's
siblings. Of each parent the copy that the first node of its run made goes on to the next level. Paths (for each level the digests to
the left and to the right) go down from the root, so that only the lowest level has a row for each leaf.

Places in a group come from stretches of the order, so no task holds a group; a run has FANOUT rows at most.

Defined cases: null fields are written `-`; a null group is a group of its own, the first one; null keys come first; rows with equal
keys stand in the order of their leaves, repeated rows next to each other, each with its own place; an empty table gives no rows;
a group of one row has its leaf as root, and a single group's root is the manifest's; very long texts are hashed whole; columns other
than the fields, group and key are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import fold, in_order, keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
_PATH = "array<struct<left:string,right:string>>"


def hashed(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """H of the fields, each as `-` or as its UTF-8 bytes behind their number and a colon."""
    return hashed(*(F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda below, x: hashed(x["left"], below, x["right"]))


def proof(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return hashed(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def _runs(level: DataFrame, fanout: int) -> DataFrame:
    """Nodes that have a parent: its number `up` and digest, and the siblings to the left and right."""
    of_parent = Window.partitionBy("gid", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.col("at") % fanout).cast("int")
    rows = level.where("size > 1").withColumn("up", F.floor(F.col("at") / fanout)).withColumn("run", F.collect_list("digest").over(of_parent))
    part = lambda start, n: F.array_join(F.slice("run", start, n), "")
    return rows.withColumns({"left": part(F.lit(1), place), "right": part(place + 2, F.lit(fanout)), "parent": hashed(F.array_join("run", ""))}).drop("run")


def tree(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels of each group's tree from the nodes (gid, at, size of the group, digest) on, and the roots (gid, digest)."""
    level, levels = nodes, []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(level)
        level = _runs(level, fanout).where(F.col("at") % fanout == 0).select("gid", F.col("up").alias("at"), F.ceil(F.col("size") / fanout).alias("size"), F.col("parent").alias("digest"))
        level = keep(level)
        most = -(-most // fanout)
    levels.append(level)
    ends = [x.where("size = 1").select("gid", "digest") for x in levels]
    roots = ends[0]
    for x in ends[1:]:
        roots = roots.union(x)
    return levels, keep(roots)


def paths(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The lowest level's rows with subroot, root and path. above: gid, root and path of each group's root in the tree over the groups."""
    above = above.select(F.col("gid").alias("gid2"), "root", F.col("path").alias("path2"))
    out = None
    for level in reversed(levels):
        rest = [c for c in level.columns if c != "size"]
        ends = level.where("size = 1").join(above, F.col("gid") == F.col("gid2")).select(*rest, F.col("digest").alias("subroot"), "root", F.col("path2").alias("path"))
        if out is not None:
            up = out.select(F.col("gid").alias("gid2"), F.col("at").alias("up2"), "subroot", "root", F.col("path").alias("path2"))
            here = _runs(level, fanout).join(up, (F.col("gid") == F.col("gid2")) & (F.col("up") == F.col("up2")))
            own = F.array(F.struct("left", "right")).cast(_PATH)
            ends = ends.union(here.select(*rest, "subroot", "root", F.concat(own, "path2").alias("path")))
        out = ends
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", fanout: int = FANOUT, also: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, path of each row, and the columns `also` of the row."""
    also = also or {}
    gid = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), gid.alias("gid"), leaf(*(F.col(f) for f in fields)).alias("digest"), *(c.alias(f"also_{k}") for k, c in enumerate(also.values())))
    # written before it is counted, sampled and dealt out, so that texts are hashed once
    placed = keep(in_order(keep(rows), "gid", [F.col("key").asc_nulls_first(), F.col("digest")], name="at", total="size"))
    levels, subroots = tree(placed, fanout)
    groups = in_order(subroots.select(F.lit("").alias("gid"), F.col("gid").alias("name"), "digest"), "gid", [F.col("name")], name="at", total="size")
    tops, root = tree(keep(groups), fanout)
    over = paths(tops, root.select("gid", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path")), fanout)
    out = paths(levels, keep(over.select(F.col("name").alias("gid"), "root", "path")), fanout)
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"also_{k}").alias(name) for k, name in enumerate(also)))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what a fifth of the rows, tampered with by lower-casing A-Z, give for a root."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf(*(lower if f == "text" else F.col(f) for f in FIELDS))
    rows = manifest(docs, also={"tampered": F.when(fold("doc_id", 5) == 0, changed)})
    out = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
