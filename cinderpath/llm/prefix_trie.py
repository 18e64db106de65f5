"""A trie of conversations: which openings they share, how many go on from each, and what computing them once would save.

1. Turns are numbered in their conversation by ranges and offsets, so one very long conversation lies in many partitions.
2. A node's key is 128 bits over the turns from the root to it: the running XOR of hashes of (place, SHA-256 of the turn), computed by
   blocks. Every partition combines its rows to a node table: a partial trie.
3. Partial tries are merged by key in rounds, ``FAN_IN`` of them in each: members are summed, the smallest member kept. A node table has
   a row for each key and group of partitions, so a very common opening meets in no task in more rows than there are partial tries.
   Rows of one key must agree in parent and turn; where they don't, the query ends with an error instead of joining two nodes.
4. Lists of the conversations that end at a node are ranges of (key, conversation): partitions write sorted pieces of bounded length,
   and a node's pieces are hashed one after another.
5. Rollup from the bottom: the nodes of which a conversation is the smallest member are the end of its path, its chain. Sums run up each
   chain; what a whole chain adds is handed to the nodes above it on the same path, and summed by key.

Defined cases: null role or text is empty; turns of equal number are in the order of the digest of role and text, a null number comes
first; turns without a conversation id belong to none and are left out; repeated rows are turns each; a conversation without turns can only
arise by rebuilding and is a member of the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import indexed, looked_up, running
from ..tables import narrow, stored
from .merkle import crc_sql

#: Partial tries that one merge takes together, conversation ids in a piece of a list, turns in a block.
FAN_IN, PIECE, BLOCK = 32, 50_000, 1024
#: Openings that conversations may share with their first one: turns beyond this aren't looked up.
OPENING = 5
KEY = ["k1", "k2", "depth"]


def _word(tag: int, *of: Column) -> Column:
    return F.xxhash64(F.lit(tag), *of)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_hash (SHA-256 of role and text), chars: the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), digest.alias("turn_hash"), F.char_length(text).cast("long").alias("chars"))
    placed = indexed(stored(rows, "turns"), ["conv_id"], ["_turn", "turn_hash"], "pos", "turns-placed")
    return stored(placed.select("conv_id", "pos", "turn_hash", "chars"), "turns-indexed")


def rebuilt(rows: DataFrame, span: int = 100, share: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with the opening of the first one of their hundred: conv_id, pos, turn_hash, chars; and conv_id of all of them.

    Conversation c takes the first h = crc32(c) % ``share`` turns of c - c % ``span`` and its own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % share
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("base", F.expr(f"conv_id - conv_id % {span}"))
    sizes = stored(sizes, "conversation-sizes")
    first = F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn_hash", "chars"))), lambda t: F.struct(t["turn_hash"].alias("turn_hash"), t["chars"].alias("chars")))
    openings = rows.where((F.col("pos") < min(OPENING, share - 1)) & (F.col("conv_id") % span == 0)).groupBy(F.col("conv_id").alias("base")).agg(first.alias("opening"))
    led = sizes.join(openings, "base", "left").withColumn("taken", F.least("h", F.coalesce(F.size("opening"), F.lit(0)).cast("long")))
    led = stored(led.select("conv_id", "h", "taken", "opening"), "conversation-openings")
    borrowed = led.where("taken > 0").select("conv_id", F.posexplode(F.slice("opening", F.lit(1), F.col("taken").cast("int"))).alias("pos", "t")).select("conv_id", F.col("pos").cast("long").alias("pos"), "t.turn_hash", "t.chars")
    # own turns move forward where the first conversation had fewer turns to lend
    short = narrow(led.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("_less")))
    own = looked_up(rows.where(F.col("pos") >= h), short, ["conv_id"]).select("conv_id", (F.col("pos") - F.coalesce("_less", F.lit(0))).alias("pos"), "turn_hash", "chars")
    return borrowed.unionByName(own), sizes.select("conv_id")


def paths(rows: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, k1, k2 (the node), p1, p2 (its parent), t1, t2 (its turn), chars: the nodes that each conversation passes, root included."""
    place = F.col("pos")
    hashed = rows.select("conv_id", "pos", "chars", _word(1, place, F.col("turn_hash")).alias("w1"), _word(2, place, F.col("turn_hash")).alias("w2"), _word(3, F.col("turn_hash")).alias("t1"), _word(4, F.col("turn_hash")).alias("t2"))
    keyed = running(stored(hashed, "turn-hashes"), "conv_id", "pos", {"k1": ("bit_xor", "w1"), "k2": ("bit_xor", "w2")}, block)
    inner = keyed.select("conv_id", (place + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("w1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("w2")).alias("p2"), "t1", "t2", "chars")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = members.select("conv_id", *[zero(c) for c in ("depth", "k1", "k2", "p1", "p2", "t1", "t2", "chars")])
    return stored(inner.unionByName(root), "trie-paths")


def merged(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """k1, k2, depth, conv_id (smallest member), n_convs, p1, p2, chars: the node table, from each partition's own."""
    told = ("p1", "p2", "t1", "t2")
    parts = rows.rdd.getNumPartitions()
    tables = rows.select(*KEY, "conv_id", "chars", F.lit(1).cast("long").alias("n_convs"), *[F.col(c).alias(f"{f}_{c}") for f in ("min", "max") for c in told], F.spark_partition_id().alias("part"))
    while True:
        parts = -(-parts // fan_in)
        grouped = tables.withColumn("part", F.expr(f"part div {fan_in}").cast("int")).groupBy(*KEY, *(["part"] if parts > 1 else []))
        tables = grouped.agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), *[f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in told])
        if parts <= 1:
            break
    agree = F.lit(True)
    for c in told:
        agree = agree & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    n = F.when(agree, F.col("n_convs")).otherwise(F.raise_error(F.lit("two nodes of the trie have one key")).cast("long"))
    return stored(tables.select(*KEY, "conv_id", n.alias("n_convs"), F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"), "chars"), "trie-nodes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, depth, conv_id), sorted, to pieces (k1, k2, depth, first, ids) of at most ``PIECE`` ids."""
    key, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for *at, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != key or len(ids) >= PIECE:
                close()
                key = at
            ids.append(conv)
        if len(out) >= 10_000 or sum(len(o[-1]) for o in out) > 4_000_000:
            yield _batch(out, "k1 k2 depth first ids")
            out = []
    close()
    yield _batch(out, "k1 k2 depth first ids")


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("ids", "ends_sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (k1, k2, depth, ends_sha256), one piece at a time."""
    key, state, out = None, None, []
    for batch in batches:
        for *at, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at == key:
                state.update(b"," + ids.encode())
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
        if len(out) >= 10_000:
            yield _batch(out, "k1 k2 depth ends_sha256")
            out = []
    if key:
        out.append((*key, state.hexdigest()))
    yield _batch(out, "k1 k2 depth ends_sha256")


def ending(rows: DataFrame) -> DataFrame:
    """k1, k2, depth, ends_sha256: the digest of the ascending ids of the conversations that end at a node."""
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k"), F.max("depth").alias("depth"))
    at = [*KEY, "conv_id"]
    pieces = last.select("k.k1", "k.k2", "depth", "conv_id").repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(_pieces, "k1 long, k2 long, depth long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, "k1 long, k2 long, depth long, ends_sha256 string")


def trie(rows: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """From ``paths``, one row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = merged(rows, fan_in)
    parent = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = looked_up(nodes, children, KEY).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = nodes.withColumn("_saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("_leaf", (F.col("n_children") == 0).cast("long"))
    own = stored(own, "trie-children")
    summed = stored(running(own, "conv_id", "depth", {"chain_saved": ("sum", "_saved"), "chain_leaves": ("sum", "_leaf")}, block, backwards=True), "trie-chains")
    # what a chain adds to the nodes above it
    chains = summed.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("chain_saved").alias("add_saved"), F.max("chain_leaves").alias("add_leaves")).where("top > 0")
    above = looked_up(rows.select(*KEY, "conv_id"), narrow(chains), ["conv_id"], "inner").where("depth < top")
    above = above.groupBy(*KEY).agg(F.sum("add_saved").alias("add_saved"), F.sum("add_leaves").alias("add_leaves"))
    heads = nodes.where("n_children > 0").select("k1", "k2", "depth", F.col("conv_id").alias("parent_conv_id"))
    found = looked_up(summed, above, KEY)
    found = looked_up(found, ending(rows), KEY)
    found = looked_up(found.withColumns({"_depth": F.col("depth"), "k1": F.when(F.col("depth") > 0, F.col("p1")), "k2": F.col("p2"), "depth": F.col("depth") - 1}), heads, KEY)
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("long"))
    return found.select(
        "conv_id", F.col("_depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", plus("chain_leaves", "add_leaves").alias("n_leaves"), plus("chain_saved", "add_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def shared_openings(conversations: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """The trie of conversations rebuilt by ``rebuilt``."""
    return trie(paths(*rebuilt(turns(conversations)), block), block, fan_in)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_openings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc_sql("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
made AS (
  SELECT ids.conv_id, 0 AS part, pos, role, text FROM ids JOIN t ON t.conv_id = ids.base AND pos <= h
  UNION ALL SELECT ids.conv_id, 1, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND pos > h
), whole AS (SELECT ids.conv_id, coalesce(turns, []) AS turns FROM ids LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, pos) AS turns FROM made GROUP BY 1) m ON m.conv_id = ids.conv_id),
passed AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM whole),
node AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM passed GROUP BY 1, 2
), child AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
told AS (SELECT node.*, coalesce(child.n, 0) AS n_children, CASE WHEN node.depth > 0 THEN (n_convs - 1) * length(node.path[node.depth].text) ELSE 0 END AS own FROM node LEFT JOIN child ON child.path = node.path AND child.depth = node.depth),
over AS (SELECT path, depth, n_children, own, unnest(range(depth + 1)) AS up FROM told),
sums AS (SELECT path[1:up] AS path, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM over GROUP BY 1, 2)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM told a JOIN sums ON sums.path = a.path AND sums.depth = a.depth LEFT JOIN told p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.path = a.path[1:a.depth - 1]"""
