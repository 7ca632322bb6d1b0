"""Exact search and ranks by blocks: Arrow batches of a corpus times a matrix of queries, in tasks.

A query has one vector or, where it has several phrasings, one for each. Its score
for a row is the greatest of their inner products, in double precision; rows are compared
by that score to nine places, then by the first phrasing's, then by their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint
from .rank import RANKED

#: Up to so many query vectors, and numbers in them, are broadcast; more go as blocks to buckets of the corpus.
MOST_BROADCAST, MOST_NUMBERS = 4096, 16_000_000
BUCKETS, BLOCK = 64, 1024
#: So many products are made at a time.
PRODUCTS = 2_000_000
#: Up to so many rows of ground truth are broadcast to be counted against.
MOST_WANTED = 2_000_000
#: Tasks give their counts so many at a time.
COUNTS = 100_000
_FOUND = "q long, corpus_pos long, image_id string, image_path string, score double, key double, second double"


@dataclass
class Matrix:
    """Queries by number: ``q`` and their text ``name``, all vectors, and where each query's vectors begin."""

    q: np.ndarray
    name: list
    vectors: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Matrix:
        """rows: (q, name, vectors)."""
        sizes = [len(r[2]) for r in rows]
        flat = [v for r in rows for v in r[2]]
        if len({len(v) for v in flat}) > 1:
            raise ValueError("query vectors differ in length")
        return Matrix(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array(flat, np.float64).reshape(len(flat), len(flat[0]) if flat else 0), np.cumsum([0, *sizes[:-1]]) if rows else np.zeros(0, np.int64))

    def keys(self, have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """score, key and second of each row of ``have`` for each query."""
        if len(have) and have.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"vectors of {have.shape[1]} and {self.vectors.shape[1]} components")
        return reduced(have @ self.vectors.T, self.start)


def numbered(queries: DataFrame) -> DataFrame:
    """(q, query_id, name, vectors) of ``queries`` (query_id, vector and, for phrasings, query_pos); null vectors are left out."""
    place = F.col("query_pos") if "query_pos" in queries.columns else F.lit(0)
    name = F.col("query_id").cast("string").alias("name")
    each = queries.where("vector is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("vector").cast("array<double>").alias("v")))).alias("all"))
    return checkpoint(each.select(F.monotonically_increasing_id().alias("q"), "query_id", name, F.transform("all", lambda x: x["v"]).alias("vectors")))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole, and their matrix; null vectors and components are left out, different lengths an error."""
    rows = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    used = column.drop_null()
    size = np.diff(used.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors of the corpus differ in length")
    flat = used.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), size[0] if len(size) else 0)
    whole = ~np.isnan(flat).any(1)
    return rows[whole], flat[whole]


class Best:
    """The ``k`` best rows of each query among all that were offered; with ``once``, of each path only its best row."""

    def __init__(self, n: int, k: int, once: bool = False):
        self.k, self.once, self.worst = k, once, np.full(n, -np.inf)
        self.kept = {"col": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "id": np.zeros(0, object), "path": np.zeros(0, object), "score": np.zeros(0), "key": np.zeros(0), "second": np.zeros(0)}

    def offer(self, score: np.ndarray, key: np.ndarray, second: np.ndarray, pos: np.ndarray, ids: pa.Array, paths: pa.Array, allowed: np.ndarray | None = None) -> None:
        """Arrays of rows x queries, and the rows' places, ids and paths."""
        n = len(key)
        if not n or not key.shape[1]:
            return
        if (pos[1:] < pos[:-1]).any():
            by = np.argsort(pos, kind="stable")
            score, key, second, pos = score[by], key[by], second[by], pos[by]
            ids, paths = ids.take(pa.array(by)), paths.take(pa.array(by))
            allowed = allowed if allowed is None else allowed[by]
        seen = np.zeros(n, bool)  # rows whose path an earlier row of these has
        if self.once:
            _, first = np.unique(paths.dictionary_encode().indices.to_numpy(zero_copy_only=False), return_index=True)
            seen[:] = True
            seen[first] = False
        usable = key if allowed is None else np.where(allowed, key, -np.inf)
        least, single = self.worst, usable[~seen] if seen.any() else usable
        if len(single) > self.k:
            least = np.maximum(least, np.partition(single, len(single) - self.k, 0)[len(single) - self.k])
        hit = usable >= least
        if allowed is not None:
            hit &= allowed
        equal = hit & (key == least) & (second == least)  # of equal rows the first k suffice
        if equal.any():
            hit &= ~equal | (np.cumsum(equal & ~seen[:, None], 0) <= self.k)
        row, col = np.nonzero(hit)
        if not len(row):
            return
        old = self.kept
        both = {"col": col, "pos": pos[row], "score": score[row, col], "key": key[row, col], "second": second[row, col]}
        both = {c: np.concatenate((old[c], v)) for c, v in both.items()}
        order = np.lexsort((both["pos"], -both["second"], -both["key"], both["col"]))
        if self.once:
            path = np.concatenate((old["path"], paths.take(pa.array(row)).to_numpy(zero_copy_only=False)))
            code = pa.array(path[order], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            _, first = np.unique(both["col"][order] * (len(order) + 1) + code, return_index=True)
            order = order[np.sort(first)]
        cols = both["col"][order]
        begun = np.flatnonzero(np.concatenate(([True], cols[1:] != cols[:-1])))
        rank = np.arange(len(cols)) - np.repeat(begun, np.diff(np.append(begun, len(cols))))
        order, rank = order[rank < self.k], rank[rank < self.k]
        id_, path = np.empty(len(order), object), np.empty(len(order), object)
        new = order >= len(old["col"])
        id_[~new], path[~new] = old["id"][order[~new]], old["path"][order[~new]]
        take = pa.array(row[order[new] - len(old["col"])])
        id_[new], path[new] = ids.take(take).to_numpy(zero_copy_only=False), paths.take(take).to_numpy(zero_copy_only=False)
        self.kept = {c: v[order] for c, v in both.items()} | {"id": id_, "path": path}
        last = np.flatnonzero(rank == self.k - 1)
        self.worst[self.kept["col"][last]] = self.kept["key"][last]

    def batch(self, q: np.ndarray) -> pa.RecordBatch:
        x = self.kept
        arrays = [pa.array(q[x["col"]], pa.int64()), pa.array(x["pos"]), pa.array(x["id"], pa.string()), pa.array(x["path"], pa.string()), pa.array(x["score"]), pa.array(x["key"]), pa.array(x["second"])]
        return pa.RecordBatch.from_arrays(arrays, names=["q", "corpus_pos", "image_id", "image_path", "score", "key", "second"])


def reduced(each: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows x phrasings to score, key and second of rows x queries, whose phrasings begin at ``start``."""
    if len(start) == each.shape[1]:
        key = np.round(each, 9)
        return each, key, key
    score = np.maximum.reduceat(each, start, 1)
    return score, np.round(score, 9), np.round(each[:, start], 9)


def cut(found: DataFrame, asked: DataFrame, k: int, once: bool = False) -> DataFrame:
    """The ranked frame of what tasks have found for the queries ``asked`` (q, query_id)."""
    order = [F.desc("key"), F.desc("second"), F.asc("corpus_pos")]
    if once:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("q", "image_path").orderBy(*order))).where("n = 1")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(asked.select("q", "query_id"), "q").select(*RANKED)


def _offer(best: Best, m: Matrix, have: np.ndarray, pos: np.ndarray, ids: pa.Array, paths: pa.Array, least: float | None, skip_self: bool) -> None:
    """``have`` against all of ``m``, some rows at a time."""
    own = {name: i for i, name in enumerate(m.name)} if skip_self else {}
    step = max(1, PRODUCTS // max(1, len(m.vectors)))
    for at in range(0, len(have), step):
        score, key, second = m.keys(have[at : at + step])
        allowed = None if least is None else score >= least
        if skip_self:
            mine = [(i, own[x]) for i, x in enumerate(ids.slice(at, len(score)).to_pylist()) if x in own]
            if mine:
                allowed = np.ones(score.shape, bool) if allowed is None else allowed
                allowed[tuple(np.array(mine).T)] = False

        best.offer(score, key, second, pos[at : at + step], ids.slice(at, len(score)), paths.slice(at, len(score)), allowed)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, least: float | None = None, skip_self: bool = False) -> DataFrame:
    """Ranked frame: the ``k`` best rows of ``corpus`` (corpus_pos, image_id, image_path, embedding) for each of ``queries``.

    Few queries, by count and size, are broadcast, and each task keeps its best rows of each
    as its batches pass, so that only those leave it. More queries are packed into
    blocks, which meet blocks of the corpus bucket by bucket. ``least`` drops lower scores before the cut;
    ``skip_self`` drops rows whose image_id is the query's id. Rows without a vector, or with null components, take no part.
    Where queries have phrasings (query_pos), a path that several rows have is listed once, with the best of them.
    """
    asked, once = numbered(queries), "query_pos" in queries.columns
    have = corpus.select(F.col("corpus_pos").cast("long"), F.col("image_id").cast("string"), F.col("image_path").cast("string"), F.col("embedding"))
    n, numbers = asked.agg(F.coalesce(F.sum(F.size("vectors")), F.lit(0)), F.coalesce(F.sum(F.size(F.flatten("vectors"))), F.lit(0))).first()
    if n <= MOST_BROADCAST and numbers <= MOST_NUMBERS:
        found = have.mapInArrow(_broadcast_search(asked, k, least, skip_self, once), _FOUND)
    else:
        found = _block_search(have, asked, k, least, skip_self, once)
    return cut(found, asked, k, once)


def _held(asked: DataFrame) -> Matrix:
    return Matrix.of([tuple(r) for r in asked.select("q", "name", "vectors").orderBy("q").collect()])


def _broadcast_search(asked: DataFrame, k: int, least: float | None, skip_self: bool, once: bool):
    held = asked.sparkSession.sparkContext.broadcast(_held(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        best = Best(len(m.q), k, once)
        for b in batches:
            rows, have = _vectors(b.column(3))
            take = pa.array(rows)
            if len(m.q):
                _offer(best, m, have, b.column(0).to_numpy(zero_copy_only=False)[rows], b.column(1).take(take), b.column(2).take(take), least, skip_self)
        yield best.batch(m.q)

    return run


def _block_search(have: DataFrame, asked: DataFrame, k: int, least: float | None, skip_self: bool, once: bool) -> DataFrame:
    def corpus_blocks(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows, vectors = _vectors(part.column(3))
                take = pa.array(rows)
                pos = part.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"at": int(pos[0]) if len(pos) else 0, "pos": pos.tobytes(), "ids": part.column(1).take(take).to_pylist(), "paths": part.column(2).take(take).to_pylist(), "have": vectors.tobytes()}], CORPUS)

    def query_blocks(batches):
        rows: list = []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows.append(r)
                if sum(len(x[2]) for x in rows) >= BLOCK:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    def packed(rows):
        m = Matrix.of(rows)
        return pa.RecordBatch.from_pylist([{"q": m.q.tobytes(), "names": m.name, "vectors": m.vectors.tobytes(), "start": m.start.astype(np.int64).tobytes()}], QUERIES)

    CORPUS = pa.schema([("at", pa.int64()), ("pos", pa.binary()), ("ids", pa.list_(pa.string())), ("paths", pa.list_(pa.string())), ("have", pa.binary())])
    QUERIES = pa.schema([("q", pa.binary()), ("names", pa.list_(pa.string())), ("vectors", pa.binary()), ("start", pa.binary())])
    ours = have.mapInArrow(corpus_blocks, "at long, pos binary, ids array<string>, paths array<string>, have binary")
    theirs = checkpoint(asked.select("q", "name", "vectors").mapInArrow(query_blocks, "q binary, names array<string>, vectors binary, start binary"))
    theirs = theirs.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    both = ours.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(BUCKETS)).cast("int")).join(theirs, "bucket").drop("bucket", "at")

    def run(batches):
        for b in batches:
            for pos, ids, paths, have, q, names, vectors, start in zip(*[c.to_pylist() for c in b.columns], strict=True):
                start = np.frombuffer(start, np.int64)
                flat = np.frombuffer(vectors, np.float64)
                pos = np.frombuffer(pos, np.int64)
                if not len(pos):
                    continue
                own = np.frombuffer(have, np.float64).reshape(len(pos), -1)
                if len(flat) % own.shape[1]:
                    raise ValueError("vectors of the corpus and of queries differ in length")
                m = Matrix(np.frombuffer(q, np.int64), names, flat.reshape(-1, own.shape[1]), start)
                best = Best(len(m.q), k, once)
                _offer(best, m, own, pos, pa.array(ids, pa.string()), pa.array(paths, pa.string()), least, skip_self)
                yield best.batch(m.q)

    return both.mapInArrow(run, _FOUND)


def ranks(corpus: DataFrame, queries: DataFrame, wanted: DataFrame, skip_self: bool = False, most: int | None = None) -> DataFrame:
    """(query_id, corpus_pos, rank) of the rows ``wanted`` (query_id, corpus_pos): their places in the whole corpus' ranking, which is not made.

    The wanted rows are scored first. Then every task counts, for each of them, the rows that come
    before it by score and place: a row is put where it belongs between a query's sorted wanted rows, and those
    positions are summed up. Beyond ``most`` wanted rows or more queries than can be broadcast, wanted rows
    are taken in parts of that size, by hash, one pass over the corpus for each. Wanted rows that the
    corpus lacks, and those that ``skip_self`` leaves out, have no rank.
    """
    most = most or MOST_WANTED
    asked = numbered(queries)
    have = corpus.select(F.col("corpus_pos").cast("long"), F.col("image_id").cast("string"), "embedding")
    pairs = wanted.select("query_id", F.col("corpus_pos").cast("long")).distinct().join(asked, "query_id").select("q", "name", "vectors", "corpus_pos")
    scored = pairs.join(have, "corpus_pos").where(F.lit(not skip_self) | (F.col("image_id") != F.col("name"))).select("q", "corpus_pos", "vectors", "embedding")

    def keyed(batches):
        for b in batches:
            rows, have = _vectors(b.column(3))
            lists = b.column(2).take(pa.array(rows))
            many, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            of = np.repeat(np.arange(len(rows)), many)
            each = np.einsum("ij,ij->i", flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), have.shape[1] if len(flat) else 0), have[of])
            start = np.cumsum(many) - many
            key = np.round(np.maximum.reduceat(each, start), 9) if len(rows) else each
            second = np.round(each[start], 9) if len(rows) else each
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(key), pa.array(second)], names=["q", "corpus_pos", "key", "second"])

    keys = checkpoint(scored.mapInArrow(keyed, "q long, corpus_pos long, key double, second double"))
    n, q_many = keys.groupBy("q").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-n // most), -(-q_many // MOST_BROADCAST))
    out = None
    for part in range(parts):
        of = F.pmod(F.xxhash64("q", "corpus_pos") if q_many <= MOST_BROADCAST else F.xxhash64("q"), F.lit(parts)) == part
        found = _counted(have, asked, keys.where(of) if parts > 1 else keys, skip_self)
        out = found if out is None else out.unionByName(found)
    return out.join(asked.select("q", "query_id"), "q").select("query_id", "corpus_pos", "rank")


def _counted(have: DataFrame, asked: DataFrame, keys: DataFrame, skip_self: bool) -> DataFrame:
    """(q, corpus_pos, rank) of the rows of ``keys``, which a task can hold."""
    spark = have.sparkSession
    ordered = keys.orderBy("q", F.desc("key"), F.desc("second"), "corpus_pos").toArrow()
    q, pos, key, second = (ordered.column(c).to_numpy() for c in ("q", "corpus_pos", "key", "second"))
    m = _held(asked.join(keys.select("q").distinct(), "q", "left_semi"))
    bounds = np.append(np.searchsorted(q, m.q), len(q))
    several = len(m.start) != len(m.vectors)
    # places as short numbers that are exact in floating point: odd those of wanted rows, even what lies between; single phrasings need no second
    known = np.unique(pos)
    places = (2 * np.searchsorted(known, pos) + 1).astype(np.int32)
    held = spark.sparkContext.broadcast((m, bounds, known, places, key, second if several else None))

    def run(batches):
        m, bounds, known, places, key, second = held.value
        own = {name: i for i, name in enumerate(m.name)} if skip_self else {}
        count = np.zeros(len(key), np.int64)
        step = max(1, PRODUCTS // max(1, len(m.vectors)))
        for b in batches if len(key) else ():
            rows, vectors = _vectors(b.column(2))
            place, ids = b.column(0).to_numpy(zero_copy_only=False)[rows], b.column(1).take(pa.array(rows))
            before = np.searchsorted(known, place)
            place = 2 * before + (known[np.minimum(before, len(known) - 1)] == place)
            for at in range(0, len(rows), step):
                _, k, s = m.keys(vectors[at : at + step])
                p = place[at : at + step]
                if skip_self:
                    for i, x in enumerate(ids.slice(at, len(p)).to_pylist()):
                        if x in own:
                            k[i, own[x]] = -np.inf
                for j in range(len(m.q)):
                    lo, hi = bounds[j], bounds[j + 1]
                    to = _between(k[:, j], s[:, j], p, key[lo:hi], second[lo:hi] if several else None, places[lo:hi], several)
                    count[lo:hi] += np.bincount(to, minlength=hi - lo + 1)[: hi - lo]
        for at in range(0, len(count), COUNTS):
            t = np.flatnonzero(count[at : at + COUNTS]) + at
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(count[t])], names=["t", "n"])

    sums = have.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    table = spark.createDataFrame(ordered.select(["q", "corpus_pos"]).append_column("t", pa.array(np.arange(len(q), dtype=np.int64)))) if len(q) else keys.select("q", "corpus_pos", F.lit(0).cast("long").alias("t"))
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("q").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return table.join(sums, "t", "left").select("q", "corpus_pos", (before + 1).alias("rank"))


def _between(key, second, pos, keys, seconds, places, several: bool) -> np.ndarray:
    """For each row the first of the sorted wanted rows that it comes before; their number, if none."""
    if not several:
        return np.searchsorted(-keys + 1j * places, -key + 1j * pos, "right")  # complex numbers are ordered by real part, then by imaginary part
    lo, hi = np.searchsorted(-keys, -key, "left"), np.searchsorted(-keys, -key, "right")
    for i in np.flatnonzero(lo < hi):
        a, b = lo[i], hi[i]
        lo[i] = a + np.searchsorted(-seconds[a:b] + 1j * places[a:b], -second[i] + 1j * pos[i], "right")
    return lo
