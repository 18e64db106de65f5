"""Near-duplicate detection by MinHash with tensored banding, verified on full sets.

A document's set holds the distinct 2-word shingles of its lower-cased words (A-Z only). Two documents are linked if
100 * |intersection| >= 80 * |union|; the components of these links are the groups.

1. Signatures: in one pass over whole texts each document gets ``halves`` small collections of ``width`` minhashes, and a 128-bit hash
   of its whole set. Documents with equal sets form a class; only its smallest id goes on, so copies cost nothing below.
2. Tensored banding: a table key is a *pair* of collections, so 14 collections of 3 minhashes make 91 tables of 6 minhashes from 42
   minhash computations instead of 546. Two sets with a similarity of 0.8 share a key unless fewer than 2 of 14 collections agree, that
   is with probability 0.9993; of 0.85 with 0.99996. What is missed there is in most groups still linked through a third document.
3. First stars: each class is compared with the smallest id of all buckets it is in, one pair for each class. Buckets are formed by a
   partial aggregation and a join that adaptive execution splits, never by collecting a bucket.
4. Second stars: in each bucket whose rows are still in several components, the rows outside its largest component are compared
   with a pivot, the member of that component with the fewest shingles of its own - in a family of copies the least edited one.
5. Rest: rows that are still outside may yet be linked with any row of another component of the bucket. Exact bounds leave few of
   these pairs, and no link is lost. Let D be the symmetric difference of a row and the pivot, n its size and ``own`` the number of
   shingles that no other open class has. Two rows x and y are linked exactly if |Dx| + |Dy| - 2 |Dx and Dy| <= (n_x + n_y) / 9 (for
   80 %), and no more than |D| - own can be shared. So a row is out, by itself, if |D| - n / 9 is beyond the largest
   |D| - 2 own + n / 9 of the others at its pivot: copies edited at random fall away here, one by one. What is left is paired if what
   the two share inside the pivot (known from bit masks over its shingles) and at most share outside it (the smaller part without
   own shingles) allows the link. Pairs are looked for by pivot.
6. Every candidate pair that passes the size bound is verified on the full sets (as sorted 64-bit shingle hashes).
7. Components: smallest labels are passed along links, with pointer jumping, each round written to the shared folder. Later links
   only join components, so they are handled between these.

Defined cases: a text without words has an empty set, is linked with nothing and kept; a text of one word has one shingle, the word; a
row with a null id is linked with nothing and kept, its component_id null; rows that share an id are one document; ties go to
the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, id_and_text, sized, unbroadcast, written

HALVES, WIDTH, SHINGLE = 14, 3, 2
CACHE = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of whole texts as sorted arrays of 64-bit shingle hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def set_of(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = min(self.size, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * _ODD
                mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def collections_of(shingles: np.ndarray, halves: int, width: int) -> list[int]:
    """One 64-bit number for each small collection of minhashes of a set."""
    n = halves * width
    factors = (np.random.default_rng(20).integers(1, 1 << 63, n, np.uint64) << np.uint64(1)) | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            least = np.minimum(least, (shingles[at : at + 4096] * factors[:, None]).min(axis=1))
        key = np.zeros(halves, np.uint64)
        for column in least.reshape(halves, width).T:
            key = (key ^ column) * _ODD
            key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def signatures(docs: DataFrame, halves: int = HALVES, width: int = WIDTH, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_hash, halves; the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(size)
        for batch in batches:
            sizes, hashes, keys = [], [], []
            for text in batch.column("text"):
                s = shingler.set_of(text.as_py())
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(collections_of(s, halves, width) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "halves"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, halves array<long>")


def keys_of(halves: int) -> Column:
    """The tensored keys of a class: one for each pair of its collections, in the order of ``combinations``."""
    return F.expr(f"flatten(transform(sequence(0, {halves - 2}), i -> transform(sequence(i + 1, {halves - 1}), j -> xxhash64(i, j, halves[i], halves[j]))))")


def open_rows(members: DataFrame, components: DataFrame) -> DataFrame:
    """key, id, component, main (the bucket's largest component): the rows of buckets that hold several components."""
    placed = members.join(components, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("rows", "component")).alias("main")).where("parts > 1").select("key", "main")
    return written(placed.join(mixed, "key"), "open-buckets")


def own_shingles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """id, own: the number of shingles that no other open class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("shingles")]
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["id", "shingle"])

    exploded = sets.join(rows.select("id").distinct(), "id").mapInArrow(run, "id long, shingle long")
    once = exploded.groupBy("shingle").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return written(once.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "own-shingles")


def with_pivots(rows: DataFrame, own: DataFrame) -> DataFrame:
    """``rows`` with each bucket's pivot."""
    central = rows.where("component = main").join(own, "id", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("own", F.lit(0)).alias("own"), "id")).alias("p"))
    return rows.join(central.select("key", F.col("p.id").alias("pivot")), "key")


def masks(rows: DataFrame, sets: DataFrame, own: DataFrame) -> DataFrame:
    """id, pivot, n, delta, own, free, bits: how each open class lies to the pivots of its buckets.

    delta: size of the symmetric difference; own: shingles of no other open class; free: other shingles outside the pivot; a bit for
    each shingle of the pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, own in zip(batch.column("shingles"), batch.column("center"), batch.column("own").to_pylist(), strict=True):
                s, center = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                inside = np.isin(center, s, assume_unique=True)
                bits = np.packbits(np.pad(inside, (0, -len(inside) % 64))).view(np.int64)
                both = int(inside.sum())
                found.append((len(s), len(s) + len(center) - 2 * both, own, len(s) - both - own, bits.tolist()))
            columns = zip(*found, strict=True) if found else [[]] * 5
            kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pivot"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "pivot", "n", "delta", "own", "free", "bits"])

    # the pivot's own shingles are in the difference of every other row, not in its own
    mine = F.when(F.col("id") == F.col("pivot"), 0).otherwise(F.coalesce("own", F.lit(0))).cast("long")
    pairs = rows.select("id", "pivot").distinct().join(own, "id", "left").select("id", "pivot", mine.alias("own")).join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("center")), "pivot")
    return pairs.select("id", "pivot", "own", "shingles", "center").mapInArrow(run, "id long, pivot long, n long, delta long, own long, free long, bits array<long>")


def able_to_link(lying: DataFrame, percent: int) -> DataFrame:
    """The rows of ``masks`` that some other row at their pivot can be linked with, by sizes alone."""
    wide, narrow = 100 + percent, 100 - percent
    bounded = lying.withColumns({"least": F.expr(f"{wide} * delta - {narrow} * n"), "most": F.expr(f"{wide} * (delta - 2 * own) + {narrow} * n")})
    first = bounded.groupBy("pivot").agg(F.max(F.struct("most", "id")).alias("top"))
    ranked = bounded.join(first, "pivot")
    second = ranked.where("id <> top.id").groupBy("pivot").agg(F.max("most").alias("next"))
    return ranked.join(second, "pivot").where("least <= CASE WHEN id = top.id THEN next ELSE top.most END").drop("top", "next")


def across_components(rows: DataFrame, sets: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components that meet at a pivot and that the bounds don't exclude; rows: with pivots.

    All rows of a bucket meet at its pivot, and most buckets of a group have the same one, so a pair is looked at about once, not once
    for each key that it shares.
    """
    lying = written(masks(rows, sets, own), "masks")
    full = written(able_to_link(lying, percent).join(rows.select("id", "component").distinct(), "id").join(rows.select("pivot", "main").distinct(), "pivot"), "able")
    columns = ("id", "component", "n", "free", "least", "most", "bits")
    x = full.where("component <> main").select("pivot", *[F.col(c).alias(c + "_x") for c in columns])
    y = full.select("pivot", *[F.col(c).alias(c + "_y") for c in columns])
    shared = "(aggregate(zip_with(bits_x, bits_y, (p, q) -> CAST(bit_count(p & q) AS BIGINT)), 0L, (s, v) -> s + v) + least(free_x, free_y))"
    met = unbroadcast(x).join(unbroadcast(y), "pivot").where(f"component_x <> component_y AND least_x <= most_y AND least_y <= most_x AND {100 + percent} * {shared} >= {percent} * (n_x + n_y)")
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes, as bytes) of the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingler.set_of(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["id", "shingles"])

    wanted = id_and_text(docs).join(sized(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, shingles binary")


def fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity."""
    n = lambda side: sizes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"))
    return pairs.join(n("a"), "a").join(n("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    return with_sets.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """id, component (its smallest id): of every id that has a link."""
    edges = written(links.select("a", "b").union(links.select("b", "a")), f"{label}-edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), f"{label}-labels")
    before = labels
    while True:
        around = edges.join(labels.select(F.col("id").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        moved = written(lower.join(jump, "now", "left").select("id", "old", F.least("now", "further").alias("component")), f"{label}-labels")
        discard(before)
        labels, before = moved.select("id", "component"), moved
        if moved.where("component < old").isEmpty():
            discard(edges)
            return labels


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` with the components that further links join made one."""
    end = lambda side: groups.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    joined = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y"))
    between = written(joined.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "between")
    if between.isEmpty():
        return groups
    names = components(between, "merged").select(F.col("id").alias("component"), F.col("component").alias("name"))
    # classes that had no component are names of their own
    alone = names.join(groups.select("id"), names["component"] == groups["id"], "left_anti").select(F.col("component").alias("id"), F.col("name").alias("component"))
    return written(groups.join(names, "component", "left").select("id", F.coalesce("name", "component").alias("component")).unionByName(alone), "groups")


def near_groups(docs: DataFrame, percent: int = 80, halves: int = HALVES, width: int = WIDTH, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    signed = written(signatures(docs, halves, width, size), "signatures")
    classes = written(
        signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves")), "classes"
    )
    keys = classes.select(F.explode(keys_of(halves)).alias("key"), "id")
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    members = written(unbroadcast(keys).join(shared, "key"), "buckets")
    sets = written(shingle_sets(docs, members.select("id").distinct(), size), "shingle-sets")
    sizes = classes.select("id", "n")
    stars = members.where("id > hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    links = written(verified(fitting(stars, sizes, percent), sets, percent), "links")
    groups = components(links, "first")
    discard(links)
    rows = open_rows(members, groups)
    own = own_shingles(rows, sets)
    second = with_pivots(rows, own).where("component <> main").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    groups = merged(groups, verified(fitting(second, sizes, percent), sets, percent))
    discard(rows)
    rows = open_rows(members, groups)
    groups = merged(groups, verified(across_components(with_pivots(rows, own), sets, own, percent), sets, percent))
    discard(rows, own, sets, members)
    named = classes.select("set_hash", "id").join(groups, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    found = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(named, "set_hash", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
