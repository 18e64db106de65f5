"""Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources, and a proof for each row.

1. Each row becomes a leaf, the SHA-256 of its fields; from here on only digests move.
2. Leaves are numbered in their group (``operators.ranking``: ranges and offsets, so that a hot source lies in many partitions).
3. Level by level, a window over (group, index div ``arity``) with an ordered full frame collects the digests of a run. The run is the
   parent's preimage and holds the siblings of each of its nodes; one row of each run goes on to the next level, written as a table.
   A run that is all of its group ends it: its node is the subroot.
4. The subroots, in the order of the sources, are the leaves of one more tree.
5. From the root down, each parent hands the siblings above it to its nodes, so a row meets its own run and path in one join.

Nothing but the root (one digest) and the number of rows of a level comes to the driver. A task holds a run of ``arity`` digests at once.

Defined cases: null fields are ``-``; a null source is a group of its own, the first one; rows without an id come first in their source
and count as untampered; rows of equal id are in the order of their leaves; equal rows are leaves each; an empty table gives an empty
result; columns other than those hashed are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import indexed
from ..tables import stored
from .common import UPPER, documents

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(parts: Column) -> Column:
    """The digest of an array of texts, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**instead: Column) -> Column:
    """The leaf of a row; ``instead`` replaces fields."""
    return F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in FIELDS]), 256)


def _levels(nodes: DataFrame, arity: int, label: str) -> list[DataFrame]:
    """From nodes (grp, idx, digest), the tables of runs (grp, idx, digest, run, top) of each level. The run of a finished group is ``top``: its digest is the lone node's."""
    found = []
    while True:
        run = F.collect_list("digest").over(Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        runs = nodes.withColumn("parent", F.expr(f"idx div {arity}")).withColumn("run", run).where(f"idx = parent * {arity}")
        top = (F.col("parent") == 0) & (F.size("run") == 1)
        digest = F.when(top, F.col("digest")).otherwise(joined_hash(F.col("run")))
        level = stored(runs.select("grp", F.col("parent").alias("idx"), digest.alias("digest"), "run", top.alias("top")), f"{label}-level")
        found.append(level)
        nodes = level.where("NOT top").select("grp", "idx", "digest")
        if nodes.isEmpty():
            return found


def _beside(run: Column, at: Column) -> Column:
    """What stands before and after a node in its run."""
    place = at.cast("int")
    return F.struct(F.array_join(F.slice(run, 1, place), "").alias("before"), F.array_join(F.slice(run, place + 2, F.size(run)), "").alias("after"))


def _path(arity: int) -> Column:
    """The path of node ``idx`` from its own run up, given its parent's row."""
    return F.when(F.col("top"), F.col("above")).otherwise(F.concat(F.array(_beside(F.col("run"), F.col("idx") % arity)), F.col("above")))


def _handed_down(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level's runs (grp, parent, run, top, subroot, above); ``tops``: grp, subroot, above of the finished groups."""
    parents = None
    for level in reversed(levels):
        ended = level.where("top").join(tops, "grp").select("grp", F.col("idx").alias("parent"), "run", "top", "subroot", "above")
        if parents is not None:
            open_ones = level.where("NOT top").select("grp", "idx", F.col("run").alias("own"), F.expr(f"idx div {arity}").alias("parent"))
            rows = open_ones.join(parents, ["grp", "parent"]).select("grp", F.col("idx").alias("parent"), F.col("own").alias("run"), F.lit(False).alias("top"), "subroot", _path(arity).alias("above"))
            ended = ended.unionByName(rows)
        parents = ended
    return parents


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, run: F.sha2(F.concat(run["before"], digest, run["after"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), "")


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` (doc_id, source, leaf, and whatever else) with subroot, root and path (array of (before, after): the siblings of each level up to the root)."""
    # one text for each group, in the order of the sources: null first, then bytewise
    group = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    rows = indexed(leaves.withColumn("grp", group), ["grp"], ["doc_id", "leaf"], "idx", "merkle-leaves")
    levels = _levels(rows.select("grp", "idx", F.col("leaf").alias("digest")), arity, "merkle")
    subroots = reduce(DataFrame.unionByName, [level.where("top").select("grp", "digest") for level in levels])
    ordered = indexed(subroots, [], ["grp"], "idx", "merkle-subroots")
    above = _levels(ordered.select(F.lit("").alias("grp"), "idx", "digest"), arity, "merkle-root")
    root = above[-1].where("top").select("digest").first()
    empty = F.array().cast("array<struct<before:string,after:string>>")
    end = above[-1].where("top").select("grp", F.col("digest").alias("subroot"), empty.alias("above"))
    lowest = _handed_down(above, end, arity).drop("subroot", "grp")
    tops = ordered.withColumn("parent", F.expr(f"idx div {arity}")).join(lowest, "parent").select("grp", F.col("digest").alias("subroot"), _path(arity).alias("above"))
    runs = stored(_handed_down(levels, tops, arity), "merkle-paths")
    found = rows.withColumn("parent", F.expr(f"idx div {arity}")).join(runs, ["grp", "parent"])
    return found.select(*leaves.columns, "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), _path(arity).alias("path"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def audit(docs: DataFrame, tampered: Column, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, and whether it still holds where ``tampered`` lower-cased the text."""
    changed = F.when(tampered, leaf_of(text=lowered(F.col("text"))))
    leaves = stored(docs.select("doc_id", "source", leaf_of().alias("leaf"), changed.alias("changed")), "merkle-fields")
    proof = F.sha2(siblings(F.col("path")), 256).alias("proof_sha256")
    found = manifest(leaves, arity).select("doc_id", "leaf", "subroot", "root", proof, folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def crc_sql(column: str) -> str:
    """CRC-32 of a number's decimal text, for DuckDB, which has no such function."""
    return _CRC.format(column)


def _tree_sql(name: str, depth: int) -> str:
    """CTEs of the runs of each level over ``{name}0`` (grp, idx, digest): {name}_r0, {name}_r1 …"""
    out = []
    for k in range(depth):
        out.append(f"""{name}_q{k} AS (SELECT grp, idx // 16 AS idx, list(digest ORDER BY idx) AS run FROM {name}{k} GROUP BY 1, 2),
{name}_r{k} AS (SELECT *, idx = 0 AND len(run) = 1 AS top, CASE WHEN idx = 0 AND len(run) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {name}_q{k}),
{name}{k + 1} AS (SELECT grp, idx, digest FROM {name}_r{k} WHERE NOT top)""")
    return ",\n".join(out)


def sql(depth: int = 5, over: int = 3) -> str:
    """The same for DuckDB, for sources of up to 16 ** (depth - 1) rows and up to 16 ** (over - 1) sources."""
    one = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(one, FIELDS[:-1]), one(text)]) + ")"
    folds, sides, joins = "coalesce(changed, leaf)", [], []
    for name, count, grp, idx in (("n", depth, "l.grp", "l.idx"), ("s", over, "''", "o.idx")):
        for k in range(count):
            r = f"{name}{k}r"
            joins.append(f"LEFT JOIN {name}_r{k} {r} ON {r}.grp = {grp} AND {r}.idx = {idx} // {16 ** (k + 1)} AND NOT {r}.top")
            at = f"({idx} // {16**k}) % 16"
            before, after = f"array_to_string({r}.run[1:{at}], '')", f"array_to_string({r}.run[{at} + 2:], '')"
            folds = f"CASE WHEN {r}.run IS NULL THEN f{len(sides)} ELSE sha256({before} || f{len(sides)} || {after}) END AS f{len(sides) + 1}" if sides else f"CASE WHEN {r}.run IS NULL THEN f0 ELSE sha256({before} || f0 || {after}) END AS f1"
            sides.append((folds, f"coalesce({before} || {after}, '')"))
    return f"""WITH base AS (
  SELECT doc_id, coalesce('1' || source, '0') AS grp, {leaf("text")} AS leaf, CASE WHEN {crc_sql("doc_id")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS changed FROM documents
), l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM base),
n0 AS (SELECT grp, idx, leaf AS digest FROM l),
{_tree_sql("n", depth)},
o AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx FROM ({" UNION ALL ".join(f"SELECT grp, digest FROM n_r{k} WHERE top" for k in range(depth))})),
s0 AS (SELECT '' AS grp, idx, digest FROM o),
{_tree_sql("s", over)},
root AS ({" UNION ALL ".join(f"SELECT digest FROM s_r{k} WHERE top" for k in range(over))})
SELECT doc_id, leaf, o.digest AS subroot, root.digest AS root, sha256({" || ".join(s for _, s in sides)}) AS proof_sha256,
  coalesce(changed, leaf) AS f0, {", ".join(f for f, _ in sides)}, f{len(sides)} AS folded_root, f{len(sides)} = root.digest AS verified
FROM l JOIN o ON o.grp = l.grp CROSS JOIN root {" ".join(joins)}"""


SQL = f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({sql()})"
