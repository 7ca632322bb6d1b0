"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, col, map_text


def expected_fill(n: int, capacity: int, sizes: Sequence[int], left: dict[int, int]) -> int:
    """Tokens in a bin that opens for a piece of ``n`` tokens, if it then takes the longest piece that fits, again and again.

    ``sizes`` are the lengths of the pieces still to come, sorted, ``left`` how many each has.
    """
    room = capacity - n
    at = bisect_right(sizes, room) - 1
    while at >= 0:
        room -= min(left[sizes[at]], room // sizes[at]) * sizes[at]
        at = min(at, bisect_right(sizes, room)) - 1
    return capacity - room


def pack(lengths: Sequence[int], capacities: Sequence[int], overhead: float = 0.0, reach: float = math.inf) -> tuple[list[int], list[int], list[int], dict[int, int]]:
    """Bin and offset of each piece, the bins' fill, and each bin's final capacity.

    Pieces go longest first (ties: the one given first) into the open bin with least
    room left (ties: the bin opened first). If none has room, that size opens whose
    cost for each token is least (ties: the smallest size). A sequence of length c costs
    ``overhead`` + c + c * c / ``reach``, the last for attention, which grows with the
    square. The tokens are those that the pieces still to come are expected to fill
    it with, and the size is that to which it then shrinks; so a long bin opens
    where it wastes less, a short one where it fills as well. In the end every bin
    shrinks to the smallest capacity that holds its contents. No piece may exceed
    the largest capacity.
    """
    caps = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []
    room: list[tuple[int, int]] = []
    left = Counter(lengths)
    sizes = sorted(left)
    cost = {c: overhead + c + c * c / reach for c in caps}

    def price(c: int, n: int) -> float:
        full = expected_fill(n, c, sizes, left)
        return cost[caps[bisect_left(caps, full)]] / full

    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            sizes.pop()
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(fill)
            free = min((c for c in caps if c >= n), key=lambda c: (price(c, n), c))
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if free > n:
            insort(room, (free - n, b))
    final = {b: caps[bisect_left(caps, x)] for b, x in enumerate(fill)}
    return bins, offsets, fill, final


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: int = 1) -> DataFrame:
    """id and length: the words of the text and ``extra`` separators."""

    def make():
        return lambda texts, _: [[len(t.split()) + extra for t in texts]]

    return map_text(docs, [id_col], "length long", make, text_col)


def best_fit(
    lengths: DataFrame,
    capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192),
    overhead: float = 16.0,
    reach: float = 32768.0,
    shard_rows: int = 20_000,
    id_col: str = "doc_id",
    length_col: str = "length",
) -> DataFrame:
    """One row a piece: id, piece, start, length, shard, bin, bin_offset, bin_length, capacity.

    A document longer than the largest capacity becomes pieces of that length and
    a rest. Documents go to shards of about ``shard_rows`` pieces by a hash of
    their rows, so that neither a hot source nor long documents gather in one
    task; each shard is packed on its own, which costs at most a few partly
    filled bins a shard. Capacities must be positive.

    Null and non-positive lengths get one row with length 0 and no bin. Repeated
    rows are packed each: they are counted, and the hash takes each one's number among its equals too, so that copies
    spread. So the result depends on the rows alone, not on how they lie in files. An empty table gives an
    empty result.
    """
    caps = sorted(set(capacities))
    if not caps or caps[0] <= 0:
        raise ValueError("capacities must be positive")
    top = caps[-1]
    n = F.greatest(F.coalesce(col(length_col).cast("long"), F.lit(0)), F.lit(0))
    equal = lengths.select(col(id_col).alias("id"), n.alias("n")).groupBy("id", "n").agg(F.count("*").alias("c"))
    src = checkpoint(equal.select("id", "n", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k")).select("id", "n", F.xxhash64("id", "n", "k").alias("h")))
    total = src.agg(F.sum(F.greatest(F.ceil(F.col("n") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top), F.lit(1)) - 1), lambda k: F.struct(k.cast("int").alias("piece"), (k * top).alias("start")))
    src = src.select("id", "n", "h", F.explode(pieces).alias("p")).select(
        "id", "p.piece", "p.start", F.least(F.col("n") - F.col("p.start"), F.lit(top)).alias("length"), F.pmod(F.xxhash64("h", "p.piece"), F.lit(shards)).cast("int").alias("shard")
    )
    out = T.StructType([*src.schema.fields[:4], T.StructField("shard", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("bin", "bin_offset", "bin_length", "capacity"))])

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        size = t.column("length").to_pylist()
        real = [i for i, x in enumerate(size) if x > 0]
        bins, offsets, fill, final = pack([size[i] for i in real], caps, overhead, reach)
        rows = [[None] * len(size) for _ in range(4)]
        for i, b, o in zip(real, bins, offsets, strict=True):
            for x, v in zip(rows, (b, o, fill[b], final[b]), strict=True):
                x[i] = v
        for name, x in zip(("bin", "bin_offset", "bin_length", "capacity"), rows, strict=True):
            t = t.append_column(name, pa.array(x, pa.int64()))
        return t

    packed = src.groupBy("shard").applyInArrow(one, out)
    return packed.withColumnRenamed("id", id_col)
