"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, checkpoint, col, list_array, map_text, mix64
from .components import components

_A = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingles(words: list[bytes], width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a word sequence; a shorter sequence is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k * 0x2545F4914F6CDD1D % 2**64, np.uint64)
    for i in range(k):
        out = mix64(out + h[i : i + n] * np.uint64(_A[i % len(_A)]))
    return np.unique(out)


def band_plan(similarity: float, rows: int, miss: float) -> int:
    """Bands needed so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def signatures(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str, seed: int = 17) -> DataFrame:
    """id, n_shingles, a 128-bit fingerprint of the whole set and ``bands`` band keys.

    Each permutation gives two signature values, its minimum and its maximum, so
    that a band of ``rows`` values costs rows / 2 hash evaluations a shingle.
    """
    if rows % 2:
        raise ValueError("rows must be even: each permutation gives a minimum and a maximum")

    def make():
        hashes = WordHash()
        perms = bands * rows // 2
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**32, perms, np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, perms, np.uint32)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

        def f(texts, _):
            ns, fps, keys, counts = [], [], [], []
            for t in texts:
                s = shingles(t.lower().split(), width, hashes)
                ns.append(len(s))
                fps.append(int(s.sum()).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mix64(s + np.uint64(_A[0]))) if len(s) else 0).to_bytes(8, "big") + len(s).to_bytes(8, "big"))
                if not len(s):
                    counts.append(0)
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                low, high = np.full(perms, 2**32 - 1, np.uint32), np.zeros(perms, np.uint32)
                for i in range(0, len(x), 2048):
                    h = x[i : i + 2048, None] * a + b
                    np.minimum(low, h.min(0), out=low)
                    np.maximum(high, h.max(0), out=high)
                sig = np.stack([low, high], 1).reshape(bands, rows)
                k = salt.copy()
                for j in range(rows):
                    k = mix64(k + sig[:, j].astype(np.uint64) * np.uint64(_A[j % len(_A)]))
                keys.append(k.view(np.int64))
                counts.append(bands)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            return [ns, fps, list_array(flat, counts, pa.int64())]

        return f

    return map_text(docs, [id_col], "n_shingles long, __fp binary, __bands array<bigint>", make, text_col)


def shingle_sets(docs: DataFrame, width: int, id_col: str, text_col: str, repeated: str | None = None) -> DataFrame:
    """id, __fp (64 bits of the set) and __set: one row for each id and set.

    ``repeated`` names a boolean column that is true in all rows of every id with
    more than one row; only those rows are then shuffled. Without it, all are.
    """

    def make():
        hashes = WordHash()

        def f(texts, _):
            sets = [shingles(t.lower().split(), width, hashes) for t in texts]
            fps = [int(np.bitwise_xor.reduce(mix64(s + np.uint64(_A[0])))) if len(s) else 0 for s in sets]
            return [np.array(fps, np.uint64).view(np.int64), list_array(np.concatenate(sets).view(np.int64), [len(s) for s in sets], pa.int64())]

        return f

    keep = [id_col] if repeated is None else [id_col, repeated]
    sets = map_text(docs, keep, "__fp long, __set array<bigint>", make, text_col)
    key = [id_col, "__fp"]
    if repeated is None:
        return sets.dropDuplicates(key)
    sets = checkpoint(sets)
    return sets.where(~col(repeated)).unionByName(sets.where(col(repeated)).dropDuplicates(key)).drop(repeated)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v) those whose whole sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("u"), F.col("__set").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("__set").alias("sv"))
    both = pairs.join(a, "u").join(b, "v")
    n = F.size(F.array_intersect("su", "sv"))
    return both.withColumn("__n", n).where(100 * F.col("__n") >= percent * (F.size("su") + F.size("sv") - F.col("__n"))).select("u", "v")


def remaining_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of ``rest`` (id, label) with different labels that may still be linked; none that is linked is left out.

    ``sets`` has one row for each id and set; an id may have several sets.
    Shingles are put in one order: those that a single label has, which can't be
    shared, then the rarest. If the first shingle that two sets share stands at
    positions i and j, they share min(n - i, m - j) at most. Pairs meet at such
    shingles only where this suffices, which limits each set to its first few.
    """
    ids = checkpoint(rest.select("id", "label").distinct())
    each = sets.join(ids, "id").select("id", "__fp", F.size("__set").alias("n"), "label", F.explode("__set").alias("s"))
    info = each.groupBy("s").agg(F.count("*").alias("df"), (F.min("label") < F.max("label")).alias("met"))
    order = Window.partitionBy("id", "__fp").orderBy("met", "df", "s")
    first = each.join(info, "s").withColumn("left", F.col("n") - F.row_number().over(order) + 1)
    first = checkpoint(first.where("met").where(100 * F.col("left") >= percent * F.col("n")).select("s", "id", "n", "left", "label"))
    other = first.select("s", *[F.col(c).alias(c + "2") for c in ("id", "n", "left", "label")])
    near = (100 + percent) * F.least("left", "left2") >= percent * (F.col("n") + F.col("n2"))
    return first.join(other, "s").where("label < label2").where(near).select(F.col("id").alias("u"), F.col("id2").alias("v")).distinct()


def _mixed(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """``rest`` with each id's label, of the keys that have more than one."""
    rest = rest.join(labels, rest.id == labels.node, "left").select(*rest.columns, F.coalesce("label", "id").alias("label"))
    both = rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    return checkpoint(rest.join(both, "key"))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    rows: int = 6,
    miss: float = 2e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``.

    Words are runs of anything but space and \\t..\\r, with A-Z lower-cased; a
    document's set holds its distinct shingles of ``width`` words. Documents with
    equal sets form a class, named by its smallest id; only classes are compared.
    Candidates share a band of min-max values. Each bucket compares its members
    with a pivot first; a bucket whose members are then still in more than one
    component, with four more pivots from its largest component, which gathers
    most near copies by few comparisons. Documents of buckets that are mixed even
    then are all compared across components through
    ``remaining_pairs``, an exact filter, so no link between candidates is lost
    and no group emits all its pairs. Pairs are confirmed on whole sets.

    Null or wordless text: n_shingles 0, its own component. Null id: component_id
    null, kept true. Rows that share an id are one node. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    bands = band_plan(percent / 100, rows, miss)
    docs = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    sig = checkpoint(signatures(docs, width, bands, rows, "id", "text"))
    full = sig.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("__fp").agg(F.min("id").alias("rep"))
    reps = full.join(classes, "__fp").where("id = rep")
    members = checkpoint(reps.select("id", F.col("n_shingles").alias("n"), F.explode("__bands").alias("key")))
    lows = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lo"), F.max("id").alias("hi")).where("lo.id < hi")
    members = checkpoint(members.join(lows, "key").select("key", "id", "n", "lo"))
    fits = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    many = full.groupBy("id").agg((F.count("*") > 1).alias("__many"))
    ids = members.select("id").distinct().join(many, "id")
    sets = checkpoint(shingle_sets(docs.join(ids, "id"), width, "id", "text", "__many"))
    pairs = members.select("id", "n", F.col("lo.id").alias("pivot"), F.col("lo.n").alias("pn")).where("id <> pivot").where(fits)

    def _linked(pairs: DataFrame, links: DataFrame | None = None, labels: DataFrame | None = None):
        more = checkpoint(confirmed(pairs, sets, percent))
        if links is not None:
            if more.isEmpty():
                return links, labels
            more = checkpoint(links.union(more))
        return more, components(more)

    links, labels = _linked(pairs.select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct())
    rest = _mixed(members.where("id <> lo.id or n <> lo.n").select("key", "id", "n"), labels)
    if not rest.isEmpty():
        sizes = rest.groupBy("key", "label").agg(F.count("*").alias("c"))
        order = Window.partitionBy("key").orderBy(F.desc("c"), "label", F.xxhash64("id"), "id")
        first = rest.join(sizes, ["key", "label"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= 4)
        first = checkpoint(first.select("key", F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("label").alias("plabel")))
        pairs = rest.join(first, "key").where("label <> plabel").where(fits)
        links, labels = _linked(pairs.select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct(), links, labels)
        rest = rest.join(first, (rest.key == first.key) & (rest.id == first.pivot) & (rest.n == first.pn), "left_anti").select("key", "id", "n")
        rest = _mixed(rest, labels)
    if not rest.isEmpty():
        links, labels = _linked(remaining_pairs(rest, sets, percent), links, labels)
    named = classes.join(labels, classes.rep == labels.node, "left").select("__fp", F.coalesce("label", "rep").alias("component"))
    out = sig.withColumn("__fp", F.when(F.expr("n_shingles > 0 and id is not null"), F.col("__fp"))).join(named, "__fp", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
