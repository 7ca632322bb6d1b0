"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, col

#: Nearest nodes from which a node's links are chosen.
CANDIDATES = 48
#: Nodes that a search keeps on the levels above the last.
UPPER = 24


def _beam(x: np.ndarray, norm: np.ndarray, q: np.ndarray, rows: np.ndarray, links: np.ndarray, start: np.ndarray, ef: int, wide: int = 4) -> np.ndarray:
    """The best ``ef`` nodes found for each query, -1 where fewer; all queries walk in step, ``wide`` nodes at a time."""
    nq, qn = len(q), (q * q).sum(1)

    def distance(i: np.ndarray, who: np.ndarray) -> np.ndarray:
        d = norm[i] + qn[who, None] - 2 * np.einsum("qkd,qd->qk", x[i], q[who], optimize=True)
        return np.where(i >= 0, d, np.inf)

    seen = np.zeros((nq, len(x) + 1), bool)
    everyone = np.arange(nq)
    ids = np.full((nq, ef), -1, np.int32)
    dist = np.full((nq, ef), np.inf)
    done = np.zeros((nq, ef), bool)
    w = min(ef, start.shape[1])
    d = distance(start, everyone)
    order = np.argsort(d, 1, kind="stable")[:, :w]
    ids[:, :w], dist[:, :w] = np.take_along_axis(start, order, 1), np.take_along_axis(d, order, 1)
    np.put_along_axis(seen, np.where(start >= 0, start, len(x)).astype(np.int64), True, 1)
    live = everyone
    while len(live):
        todo = ~done[live] & np.isfinite(dist[live])
        has = todo.any(1)
        live, todo = live[has], todo[has]
        if not len(live):
            break
        order = np.argsort(~todo, 1, kind="stable")[:, :wide]
        good = np.take_along_axis(todo, order, 1)
        at = np.where(good, np.take_along_axis(ids[live], order, 1), -1)
        mark = done[live]
        np.put_along_axis(mark, order, np.take_along_axis(mark, order, 1) | good, 1)
        nb = np.where(at[:, :, None] >= 0, links[rows[at]], -1).reshape(len(live), -1)
        nb.sort(1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        nb[seen[live[:, None], nb] & (nb >= 0)] = -1
        seen[live[:, None], np.where(nb >= 0, nb, len(x))] = True
        d = distance(nb, live)
        all_ids, all_d, all_done = np.concatenate((ids[live], nb), 1), np.concatenate((dist[live], d), 1), np.concatenate((mark, np.zeros(nb.shape, bool)), 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :ef]
        ids[live], dist[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_d, all_done))
    return np.where(np.isfinite(dist), ids, -1)


def _diverse(x: np.ndarray, norm: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's candidates become links; ``near`` is nearest first, with an infinite ``dist`` where there is none.

    First those that are nearer to the row than to any chosen before, so that links
    point in different directions, then the nearest others up to ``most``.
    """
    out = np.zeros(near.shape, bool)
    for a in range(0, len(near), 512):
        c, d, pick = near[a : a + 512], dist[a : a + 512], out[a : a + 512]
        v, vn, there = x[c], norm[c], np.isfinite(d)
        between = vn[:, :, None] + vn[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        count = np.zeros(len(c), int)
        for j in range(c.shape[1]):
            pick[:, j] = there[:, j] & (count < most) & ~((between[:, j, :] <= d[:, j, None]) & pick).any(1)
            count += pick[:, j]
        for j in range(c.shape[1]):
            more = there[:, j] & (count < most) & ~pick[:, j]
            pick[:, j] |= more
            count += more
    return out


def _nearest_first(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dist, 1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _insert(x: np.ndarray, norm: np.ndarray, rows: np.ndarray, links: np.ndarray, gaps: np.ndarray, new: np.ndarray, found: np.ndarray) -> None:
    """Links the nodes ``new`` to those that their searches found and to each other, and these back to them.

    ``links`` and ``gaps`` (the distance of each link) grow in place. A node with more
    links than slots chooses anew among them and the new ones.
    """
    degree = links.shape[1]
    to = norm[found] + norm[new, None] - 2 * np.einsum("qkd,qd->qk", x[found], x[new], optimize=True)
    among = norm[new] + norm[new, None] - 2 * (x[new] @ x[new].T)
    np.fill_diagonal(among, np.inf)
    near = np.concatenate((found, np.broadcast_to(new, among.shape)), 1)
    near, dist = _nearest_first(near, np.concatenate((np.where(found >= 0, to, np.inf), among), 1), CANDIDATES)
    src, slot = np.nonzero(_diverse(x, norm, near, dist, degree // 2))
    dst, gap = near[src, slot], dist[src, slot]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    links[rows[new[src]], place], gaps[rows[new[src]], place] = dst, gap
    back = ~(links[rows[dst]] == new[src][:, None]).any(1)
    order = np.argsort(dst[back], kind="stable")
    dst, src, gap = dst[back][order], new[src][back][order], gap[back][order]
    if not len(dst):
        return
    target, first, count = np.unique(dst, return_index=True, return_counts=True)
    added, far = np.full((len(target), count.max()), -1, links.dtype), np.full((len(target), count.max()), np.inf)
    at = np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(first, count)
    added[at], far[at] = src, gap
    r = rows[target]
    ids, dist = _nearest_first(np.concatenate((links[r], added), 1), np.concatenate((gaps[r], far), 1), max(CANDIDATES, degree))
    full = np.flatnonzero(np.isfinite(dist).sum(1) > degree)
    pick = _diverse(x, norm, ids[full], dist[full], degree)
    order = np.argsort(~pick, 1, kind="stable")
    ids[full], dist[full] = np.take_along_axis(ids[full], order, 1), np.take_along_axis(dist[full], order, 1)
    wide = min(degree, ids.shape[1])
    links[r, :wide], gaps[r, :wide] = ids[:, :wide], dist[:, :wide]


def build(x: np.ndarray, m: int = 16, seed: int = 1, ef: int = 64, batch: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, neighbours) of each level, the widest first. A node is on level l with probability m ** -l.

    Nodes are inserted in a random order, each by a search of the graph as it has grown
    so far, from the top level down. Searches run in step for a batch, of at most an
    eighth of the graph and ``batch`` nodes, whose nodes also see each other. The last slot of a
    row holds the next node of the level, so that every node can be reached.
    """
    if not len(x):
        return []
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(m)).astype(int)
    norm, grown = (x * x).sum(1), []
    for l in range(level.max() + 1):
        nodes = np.flatnonzero(level >= l).astype(np.int32)
        rows = np.zeros(len(x) + 1, np.int64)
        rows[nodes] = np.arange(len(nodes))
        shape = len(nodes), 2 * m if l == 0 else m
        grown.append((nodes, rows, np.full(shape, -1, np.int32), np.full(shape, np.inf)))
    top = grown[-1][0][0]
    order = rng.permutation(len(x)).astype(np.int32)
    order = order[order != top]
    done = 0
    while done < len(order):
        new = order[done : done + min(max(1, done // 8), batch)]
        found = np.full((len(new), 1), top, np.int32)
        for l in range(len(grown) - 1, -1, -1):
            _, rows, links, gaps = grown[l]
            found = _beam(x, norm, x[new], rows, links, found, ef if l == 0 else UPPER)
            here = level[new] >= l
            if here.any():
                _insert(x, norm, rows, links, gaps, new[here], found[here])
        done += len(new)
    return [(nodes, np.concatenate((links, np.roll(nodes, -1)[:, None]), 1)) for nodes, _, links, _ in grown]


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, ef: int) -> np.ndarray:
    """[queries, ef] nodes found, -1 where fewer: each level's best are where the next one starts."""
    norm = (x * x).sum(1)
    found = np.repeat(levels[-1][0][None, :1], len(q), 0)
    rows = np.zeros(len(x) + 1, np.int64)
    for l in range(len(levels) - 1, -1, -1):
        nodes, links = levels[l]
        rows[nodes] = np.arange(len(nodes))
        found = _beam(x, norm, q, rows, links, found, ef if l == 0 else UPPER)
    return found


def _pack(levels) -> tuple[list[int], bytes, bytes]:
    return [len(n) for n, _ in levels], b"".join(n.tobytes() for n, _ in levels), b"".join(a.tobytes() for _, a in levels)


def _unpack(sizes, nodes: bytes, links: bytes, m: int):
    out, a, b = [], 0, 0
    nodes, links = np.frombuffer(nodes, np.int32), np.frombuffer(links, np.int32)
    for l, n in enumerate(sizes):
        d = (2 * m if l == 0 else m) + 1
        out.append((nodes[a : a + n], links[b : b + n * d].reshape(n, d)))
        a, b = a + n, b + n * d
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v and dim of the rows whose vector is not null, empty or zero and has finite components only."""
    v = col(vec_col)
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.where(col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def one_each(vectors: DataFrame) -> DataFrame:
    """One row an id, with its smallest vector; reduced before it is shuffled, so an id that has very many rows gathers nowhere."""
    return vectors.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("s")).select("id", "s.v", "s.dim")


def index(vectors: DataFrame, shard_rows: int = 8192, m: int = 16, copies: int = 11) -> DataFrame:
    """One row a shard and dimension: its distinct vectors, the ids behind each, and the graph as flat arrays.

    Rows go to shards by a hash of their id, so copies of a vector spread. In a
    shard, equal vectors are one node, which keeps its ``copies`` smallest ids:
    searches for copies - 1 neighbours need no more. ``vectors`` has one row an id.
    """
    vectors = checkpoint(vectors)
    shards = max(1, -(-vectors.count() // shard_rows))
    out = "shard int, dim int, shards int, x binary, members array<bigint>, ends array<int>, sizes array<int>, nodes binary, links binary"

    def one(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        ids = t.column("id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        one_each = np.concatenate(([True], ids[1:] != ids[:-1]))
        ids, x = ids[one_each], x[one_each]
        x, at = np.unique(x, axis=0, return_inverse=True)
        at = at.ravel()
        order = np.lexsort((ids, at))
        rank = np.arange(len(ids)) - np.searchsorted(at[order], at[order])
        order = order[rank < copies]
        ends = np.cumsum(np.bincount(at[order], minlength=len(x)))
        sizes, nodes, links = _pack(build(x / np.abs(x).max(), m))
        row = {"shard": [t.column("shard")[0].as_py()], "dim": [dim], "shards": [shards], "x": [x.tobytes()], "members": [ids[order].tolist()], "ends": [ends.tolist()], "sizes": [sizes], "nodes": [nodes], "links": [links]}
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("shards", pa.int32()), ("x", pa.binary()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("nodes", pa.binary()), ("links", pa.binary())]))

    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return checkpoint(sharded.groupBy("shard", "dim").applyInArrow(one, out))


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    ef: int = 128,
    m: int = 16,
    shard_rows: int = 8192,
    block_rows: int = 16_384,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score for each query's ``k`` nearest found.

    Score is the Euclidean distance, in double precision on the vectors as given;
    ties go to the smaller id; a query's own id is no candidate; only vectors of
    its dimension are. ``queries`` (default: ``vectors``) has the same columns.
    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, neither do null ids; an id that comes several times counts once, with its
    smallest vector. Every shard is searched, in blocks of queries, and the shards'
    results are merged. With at most ``ef`` distinct vectors in a shard, its
    search is exhaustive. Empty tables give an empty result.
    """
    graph = index(one_each(usable(vectors, id_col, vec_col)), shard_rows, m, k + 1)
    asked = checkpoint(one_each(usable(vectors if queries is None else queries, id_col, vec_col)))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    shards = graph.select(F.col("shard").alias("s"), F.col("dim").alias("d")).distinct()
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.join(shards, F.col("dim") == F.col("d")).select(F.col("s").alias("shard"), F.col("d").alias("dim"), "block", "id", "v")

    def one(g: pa.Table, q: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not g.num_rows or not q.num_rows:
            return kind.empty_table()
        row = {c: g.column(c)[0].as_py() for c in ("dim", "x", "members", "ends", "sizes", "nodes", "links")}
        x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
        members, ends = np.array(row["members"], np.int64), np.array(row["ends"], np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        levels = _unpack(row["sizes"], row["nodes"], row["links"], m)
        ids = q.column("id").to_numpy()
        v = q.column("v").combine_chunks().flatten().to_numpy().reshape(-1, row["dim"])
        scale, out = np.abs(x).max(), []
        for a in range(0, len(ids), 128):
            found = search(x / scale, levels, v[a : a + 128] / scale, max(ef, 2 * k))
            for i, nodes in enumerate(found, a):
                nodes = nodes[nodes >= 0]
                score = np.sqrt(((x[nodes] - v[i]) ** 2).sum(1))
                n = ends[nodes] - starts[nodes]
                each = np.repeat(starts[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                who, score = members[each], np.repeat(score, n)
                score, who = score[who != ids[i]], who[who != ids[i]]
                best = np.lexsort((who, score))[:k]
                out.append((np.full(len(best), ids[i]), who[best], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=kind)

    keys = ("shard", "dim", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(one, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
