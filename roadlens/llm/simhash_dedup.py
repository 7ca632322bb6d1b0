"""SimHash near-duplicates: an inverted index over the bytes of fingerprints, filtered by the number of shared bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, map_text
from .components import components

BITS = 64
#: Byte positions of a fingerprint, and how many of them two fingerprints that differ in few bits share for certain.
POSITIONS = BITS // 8
#: A posting list of up to so many fingerprints compares its members pair by pair; a longer one is divided by further bytes.
MOST_COMPARED = 48


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (long, the 64 bits) of every row.

    Words are runs of anything but space and \\t..\\r, with A-Z lower-cased.
    Every sequence of ``width`` words counts, repeats included; a shorter text is
    one sequence. A bit is 1 where more than half of the sequences' XXH64 have it.
    Texts that are null or have no word have fp 0. Only id and text are read.
    """

    def make():
        import xxhash

        digest = xxhash.xxh64_intdigest

        def hashes(t: bytes) -> np.ndarray:
            words = t.lower().split()
            if len(words) <= width:
                return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-width]))
            stops = ends[width - 1 :] - 1
            return np.fromiter([digest(line[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64, len(starts))

        def f(texts, _):
            out = np.zeros(len(texts), np.uint64)
            for i, t in enumerate(texts):
                h = hashes(t)
                count = np.zeros(BITS, np.int64)
                for at in range(0, len(h), 4096):
                    bits = np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS)
                    count += _column_sums(bits)
                if len(h):
                    out[i] = np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]
            return [out.view(np.int64)]

        return f

    return map_text(docs, [id_col], "fp long", make, text_col)


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of a (n, 64) array of 0 and 1 for n up to 4096: up to 255 rows are added in bytes, eight columns an addition."""
    wide = bits.view(np.uint64)
    total = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(wide), 255):
        total += np.add.reduce(wide[at : at + 255], 0).view(np.uint8)
    return total


def _bytes_at(fp: Column, at: tuple[int, ...]) -> Column:
    """The bits of ``fp`` at the byte positions ``at``; the others are 0."""
    mask = sum(255 << 8 * p for p in at)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))


def shared_bytes(a: Column, b: Column) -> Column:
    """In how many byte positions two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum((_bytes_at(x, (p,)) == 0).cast("int") for p in range(POSITIONS))


def _lists(members: DataFrame, keys: list[Column], level: int) -> DataFrame:
    """One row of ``members`` (fp, and in later levels list: where it is divided) for each key: its posting."""
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), k.alias("bytes")) for i, k in enumerate(keys)])).alias("key")
    return members.select("fp", key).select(F.lit(level).alias("level"), "key.at", "key.bytes", "fp")


def _compared(postings: DataFrame, least: int, most: int) -> DataFrame:
    """(u, v) with u < v of those in one list that share ``least`` byte positions and differ in ``most`` bits."""
    on = ["level", "at", "bytes"]
    both = postings.join(postings.select(*on, F.col("fp").alias("other")), on).where("fp < other")
    both = both.where(shared_bytes(F.col("fp"), F.col("other")) >= least)
    return both.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def fingerprint_links(prints: DataFrame, most: int = 2, compared: int = MOST_COMPARED) -> DataFrame:
    """Distinct (u, v), u < v, of the distinct fingerprints ``prints`` (fp) that differ in at most ``most`` bits; 1 to 3.

    Such a pair shares at least ``least = 8 - most`` of its 8 byte positions. The
    index lists fingerprints by bytes and positions. As lists of single bytes
    hold a 256th of all fingerprints each, whatever their number, a list is kept
    for some sets of positions together (``_covering``), of which a pair with the
    guaranteed number of shared bytes meets in at least one. There its shared
    bytes are tallied, pairs under ``least`` go, and the rest is verified bit by bit.

    A list of more than ``compared`` members is divided, and loses no pair: its
    members are listed anew under all sets of ``least`` positions, where lists
    differ in ``most`` bytes only. Members of a list that is still long are listed
    under each set of ``most`` bits of those bytes, with these bits cleared: two
    fingerprints that differ in no other bits meet there, 2 ** most at most in a list.
    So rows grow in proportion to the fingerprints, however alike they are.
    """
    if not 1 <= most <= 3:
        raise ValueError("most must be 1 to 3")
    least = POSITIONS - most
    sets = list(combinations(range(POSITIONS), least))
    on, fp = ["level", "at", "bytes"], F.col("fp")
    first = _lists(prints, [_bytes_at(fp, c) for c in _covering(least)], 0)

    def parted(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings of short lists with more than one member, and the fingerprints of long ones."""
        sizes = lists.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
        sized = checkpoint(lists.join(sizes, on))
        return sized.where(F.col("n") <= compared).drop("n"), sized.where(F.col("n") > compared)

    short, long = parted(first)
    found = [_compared(short, least, most)]
    if not long.isEmpty():
        short, long = parted(_lists(long.select("fp").distinct(), [_bytes_at(fp, c) for c in sets], 1))
        found.append(_compared(short, least, most))
        if not long.isEmpty():
            free = [[8 * p + b for p in range(POSITIONS) if p not in c for b in range(8)] for c in sets]
            rows = [(i, j, ~sum(1 << x for x in bits)) for i, f in enumerate(free) for j, bits in enumerate(combinations(f, most))]
            masks = prints.sparkSession.createDataFrame([(i, j, m + (1 << BITS) if m < -(1 << 63) else m) for i, j, m in rows], "at int, mask int, bits long")
            last = long.select("at", "fp").join(F.broadcast(masks), "at").select("at", "mask", fp.bitwiseAND(F.col("bits")).alias("bytes"), "fp")
            few = last.groupBy("at", "mask", "bytes").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
            pairs = few.select(F.explode("all").alias("u"), "all").select("u", F.explode("all").alias("v")).where("u < v")
            found.append(pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return checkpoint(out.distinct())


def _covering(least: int) -> list[tuple[int, ...]]:
    """Sets of positions of which any ``least`` of the 8 contain at least one, each as wide as halves of what may differ allow.

    Positions lie in 2 * (8 - least) blocks or less; of these, ``8 - least`` at most
    are touched by a difference, so the other blocks agree together.
    """
    differ = POSITIONS - least
    blocks = np.array_split(np.arange(POSITIONS), min(POSITIONS, 2 * differ))
    return [tuple(int(p) for b in keep for p in b) for keep in combinations(blocks, len(blocks) - differ)]


def near_fingerprints(docs: DataFrame, width: int = 3, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", compared: int = MOST_COMPARED) -> DataFrame:
    """id, fingerprint (16 lower-case hex digits) and component_id of every row of ``docs``.

    Rows with fingerprints that differ in at most ``most`` bits are linked;
    component_id is the smallest id that a row reaches, its own included. Equal
    fingerprints are one node, named by its smallest id, so copies never meet in
    pairs. Texts without words have fingerprint zero and are linked as any
    others. Null ids have no say in component_id, and get that of their
    component, null where it has no other. Rows with one id are each returned, and
    link what they are near to. Other columns are not read; no rows give none.
    """
    prints = checkpoint(fingerprints(docs, width, seed, id_col, text_col).select(col(id_col).alias("id"), "fp"))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("id")))
    same_id = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    links = fingerprint_links(nodes.select("fp"), most, compared).union(prints.join(same_id.select("id", "lo"), "id").where("fp <> lo").select("lo", "fp"))
    labels = components(links)
    named = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = named.join(least, "label").select("fp", "component_id")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
