"""Helpers shared by the corpus operators: Arrow batch mapping, checkpoints, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpoint, ensure_checkpoint_dir, saved  # noqa: F401  used by the operators

#: One slice of an Arrow batch holds about so many bytes of text, or one row that is longer.
SLICE_BYTES = 4 << 20


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(a: np.ndarray) -> bytes:
    """An array's bytes by planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened until no name of ``taken`` equals it, whatever the case of its letters."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the string column at index ``text`` holds at most about ``most`` bytes a slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def map_text(
    df: DataFrame,
    keep: Sequence[str],
    out: str,
    make: Callable[[], Callable[[list, pa.RecordBatch], list]],
    text: str = "text",
    as_bytes: bool = True,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Kept columns plus those of the DDL ``out``, which ``make()(texts, batch)`` returns as arrays.

    ``make`` runs once a task, so that a model is loaded once. Null texts come
    as empty ones. A kept column whose name ``out`` also has is left out.
    ``batch`` holds the kept columns, then the text.
    """
    fields = T._parse_datatype_string(out).fields
    names = {f.name for f in fields}
    keep = [k for k in keep if k not in names]
    src = df.select(*[col(k) for k in keep], F.coalesce(col(text).cast("string"), F.lit("")).alias(fresh("__text", keep)))
    schema = T.StructType([*src.schema.fields[:-1], *fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, arrow = make(), None
        for b in slices(batches, n, most):
            column = b.column(n)
            texts = (column.cast(pa.binary()) if as_bytes else column).to_pylist()
            arrow = arrow or to_arrow_schema(schema)
            made = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type) for i, x in enumerate(f(texts, b))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=arrow.names)

    return src.mapInArrow(run, schema)


def list_array(flat: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of byte words, kept for those seen last."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self.most, self.hash = most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo m; null ids count as empty text."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % m
