"""Alignment of two tokenizers over the same bytes: common cuts, links of overlapping tokens, and how common each link is."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, gather
from .common import col, list_array, map_text, saved

#: Ids of a pair as one number: the first above so many bits of the second. Both are under 2 ** SHIFT.
SHIFT = 20
#: Up to so many distinct pairs are given to all tasks, 20 bytes each; more are joined.
MOST_HELD = 2_000_000
#: What has the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space and what follows it up to the next space or line end that follows other than white space.
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:(?![ \n])[{WHITE}]+[^{WHITE}]*)*|[{WHITE}]+")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_ends(first: np.ndarray, last: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each token ends in the bytes of a text.

    ``first`` and ``last``: its characters' span as its library states it, ``at``: the byte offset of each
    character and of the end. A token that begins where the one before it ended is
    cut there: coarse cuts. Tokens that share a character, or that have an empty
    span, as the bytes of a multibyte character have, end within it by the ``sizes`` of their decoded bytes.
    """
    ends = at[last].copy()
    n = len(ends)
    if not n:
        return ends
    coarse = np.ones(n, bool)
    coarse[:-1] = (first[1:] >= last[:-1]) & (last[:-1] > first[:-1])
    total = np.cumsum(sizes)
    before = np.maximum.accumulate(np.where(np.concatenate(([True], coarse[:-1])), np.arange(n), 0))  # the first token since a coarse cut
    start = np.concatenate(([0], ends[:-1]))[before]
    base = np.concatenate(([0], total[:-1]))[before]
    return np.where(coarse, ends, start + total - base)


class Aligner:
    """Both tokenizers, and what is known of the units seen last.

    A unit is white space and what follows it. Neither tokenizer has a token
    across the place where a unit begins, a space or line end after another
    character: the first one's pre-tokens end there, and no piece of the second
    has that pair of characters (checked as the vocabulary is read; where one
    had, whole texts would be the units). So a text's tokens and links are those of its units.
    """

    def __init__(self, first: str, second: str, most: int = 160_000):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.a.post_processor = ByteLevel(trim_offsets=False)
        back = {c: b for b, c in byte_symbols().items()}
        self.a_bytes = self._table({i: bytes(back.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.b_bytes = self._table({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})
        if max(len(self.a_bytes[2]), len(pieces)) > 1 << SHIFT:
            raise ValueError(f"vocabularies of more than {1 << SHIFT} entries")
        own = [p.replace("▁", " ") for i, p in pieces.items() if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        crossed = any(re.search(r"[^ ] |\n", p) for p in own)
        self.units = (lambda t: [t]) if crossed else _UNIT.findall
        self.most = most
        self.old: Units | None = None
        self.now = Units()

    @staticmethod
    def _table(of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries' bytes in one array, where each starts, and its size."""
        parts = [of.get(i, b"") for i in range(max(of) + 1)]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def _first(self, text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.a.encode(text, add_special_tokens=False)
        ids = np.array(got.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        return ids, byte_ends(spans[:, 0], spans[:, 1], self.a_bytes[2][ids], at)

    def _second(self, text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``text`` begins with a space, which this tokenizer adds by itself."""
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        ids, first, last = np.array([x for p in pieces for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3).T
        # its spans are bytes of what it was given, so that they lie one before those with the space; the space itself has an empty span
        first, last = first + 1, last + 1
        first[:1] = 0
        return ids, byte_ends(first, np.minimum(last, at[-1]), self.b_bytes[2][ids], np.arange(at[-1] + 1))

    def learn(self, new: list[str]) -> None:
        """Adds units, aligned together in texts of some 100,000 characters; one that doesn't begin as a unit in a text does is one alone."""
        block: list[str] = []
        size = 0
        for u in new:
            if u[0] not in " \n" or u[-1] in " \n" or u[-1].isspace():
                self._block([u])
                continue
            block.append(u)
            size += len(u)
            if size > 100_000:
                self._block(block)
                block, size = [], 0
        if block:
            self._block(block)

    def _block(self, units: list[str]) -> None:
        lead = " x"  # as units are, but for a text's first, after something else
        text = lead + "".join(units)
        raw = text.encode()
        is_start = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        at = np.append(np.flatnonzero(is_start), len(raw))
        (a, a_end), (b, b_end) = self._first(text, at), self._second(text, at)
        bounds = at[np.cumsum([len(lead), *map(len, units)])]  # where each unit begins in the bytes, and the end
        same = np.frombuffer(raw, np.uint8)
        wrong = np.zeros(len(raw) + 1, bool)
        for ids, ends, (flat, start, n) in ((a, a_end, self.a_bytes), (b, b_end, self.b_bytes)):
            made, _ = gather(flat, start[ids], n[ids])
            begun = np.concatenate(([0], ends[:-1]))
            if len(ends) and len(made) == len(same) and ends[-1] == len(same) and (ends - begun == n[ids]).all():
                wrong[:-1] |= made != same
            elif len(units) > 1:  # the bytes differ somewhere in it
                self._block(units[: len(units) // 2])
                self._block(units[len(units) // 2 :])
                return
            else:
                wrong[:] = True
        bad = np.logical_or.reduceat(wrong, bounds[:-1])
        keep_a, keep_b = a_end > bounds[0], b_end > bounds[0]
        self.now.add(units, ~bad, bounds, a[keep_a], a_end[keep_a], b[keep_b], b_end[keep_b])

    def place(self, texts: list[str]) -> tuple[list[np.ndarray], Units]:
        """The units of each text by index, and what holds them."""
        lists = [self.units(" " + t) if t else [] for t in texts]
        wanted = dict.fromkeys(u for x in lists for u in x)
        if len(self.now.index) + len(wanted) > self.most:
            self.old, self.now = self.now, Units()
        missing = [u for u in wanted if u not in self.now.index]
        if self.old is not None:
            kept = [u for u in missing if u in self.old.index]
            self.now.copy(self.old, kept)
            missing = [u for u in missing if u not in self.old.index]
        self.learn(missing)
        self.now.settle()
        of = self.now.index.__getitem__
        return [np.fromiter(map(of, x), np.int64, len(x)) for x in lists], self.now


class Units:
    """For each unit: whether its bytes agree, numbers of tokens, groups and links, groups as text, and its links."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = np.zeros((0, 6), np.int32)  # n_a, n_b, n_groups, n_links, bytes of the groups' text, ok
        self.links, self.text = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.link_start = self.text_start = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, units: list[str], ok: np.ndarray, bounds: np.ndarray, a, a_end, b, b_end) -> None:
        """Units that lie one after the other in a text, at byte ``bounds``; tokens and their ends, which cover the same bytes."""
        if not ok.all() and len(units) == 1:  # its tokens are not used
            a, a_end, b, b_end = a[:0], a_end[:0], b[:0], b_end[:0]
        n = len(units)
        begun = bounds[0]
        a_from, b_from = np.concatenate(([begun], a_end[:-1]))[: len(a)], np.concatenate(([begun], b_end[:-1]))[: len(b)]
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        unit_of = lambda end: np.searchsorted(bounds[1:], end)
        # links: to each first token the second ones from that which holds its first byte to that which holds its last
        lo, hi = np.searchsorted(b_end, a_from, "right"), np.searchsorted(b_end, a_end, "left")
        many = hi - lo + 1
        with_a = np.repeat(np.arange(len(a)), many)
        with_b = gather(np.arange(len(b)), lo, many)[0]
        # groups as text: tokens in the order of group, side, place, each followed by its separator
        in_group = np.concatenate((np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)))
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(in_group * 2 + side, kind="stable")
        group, side, ids = in_group[order], side[order], np.concatenate((a, b))[order]
        next_group, next_side = np.append(group[1:], -1), np.append(side[1:], -1)
        sep = np.where(next_group != group, 2, np.where(next_side != side, 1, 0)).tolist()
        signs = (",", "|", ";")
        written = [f"{i}{signs[s]}" for i, s in zip(ids.tolist(), sep, strict=True)]
        sizes = np.bincount(unit_of(np.concatenate((a_end, b_end)))[order], np.fromiter(map(len, written), np.int64, len(written)), n)
        rows = np.stack([np.bincount(unit_of(x), minlength=n) for x in (a_end, b_end, cuts, a_end[with_a])] + [sizes, ok], 1).astype(np.int32)
        at = len(self.index)
        self.index.update(zip(units, range(at, at + n), strict=True))
        self.new.append((rows, a[with_a] << SHIFT | b[with_b], np.frombuffer("".join(written).encode(), np.uint8)))

    def settle(self) -> None:
        """Makes what was added usable; arrays grow once a slice."""
        if self.new:
            rows, links, text = zip(*self.new, strict=True)
            self.counts, self.links, self.text = np.concatenate([self.counts, *rows]), np.concatenate([self.links, *links]), np.concatenate([self.text, *text])
            self.link_start, self.text_start = (np.cumsum(self.counts[:, c], dtype=np.int64) - self.counts[:, c] for c in (3, 4))
            self.new = []

    def links_of(self, at: np.ndarray) -> np.ndarray:
        return gather(self.links, self.link_start[at], self.counts[at, 3].astype(np.int64))[0]

    def text_of(self, at: np.ndarray) -> bytes:
        """The groups of units one after the other, each followed by a semicolon."""
        return gather(self.text, self.text_start[at], self.counts[at, 4].astype(np.int64))[0].tobytes()

    def copy(self, other: Units, units: list[str]) -> None:
        if not units:
            return
        of = np.fromiter(map(other.index.__getitem__, units), np.int64, len(units))
        at = len(self.index)
        self.index.update(zip(units, range(at, at + len(units)), strict=True))
        self.new.append((other.counts[of], other.links_of(of), np.frombuffer(other.text_of(of), np.uint8)))


@lru_cache(1)
def aligner(first: str, second: str) -> Aligner:
    """One for each worker, so that a task uses what earlier tasks learned; its results don't depend on that."""
    return Aligner(first, second)


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups (as ``a1,a2|b1;a3|b2,b3``), pairs (distinct links a << SHIFT | b, ascending) and times (of each pair).

    Both encode a space and the text, special tokens as plain text. Texts that are null or
    empty, or whose tokens' bytes are not those, have zeros, no pairs and an empty ``groups``.
    ``digest``: in place of groups their SHA-256, groups_sha256; of texts without tokens ''.
    """
    paths = tuple(a or b for a, b in zip((first, second), default_paths(), strict=True)) if not (first and second) else (first, second)

    def make():
        tool = aligner(*paths)

        def f(texts, _):
            placed, units = tool.place(texts)
            n = np.fromiter(map(len, placed), np.int64, len(placed))
            flat = np.concatenate(placed) if placed else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(texts)), n)
            counts = np.stack([np.bincount(of, units.counts[flat, k], len(texts)) for k in (0, 1, 2, 3, 5)], 1).astype(np.int64)
            ok = (counts[:, 4] == n) & (n > 0)
            counts[~ok] = 0
            used = ok[of]
            flat, of = flat[used], of[used]
            keys = np.sort(np.repeat(of, units.counts[flat, 3]) << 2 * SHIFT | units.links_of(flat))
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
            times = np.diff(np.append(at, len(keys)))
            keys = keys[at]
            held = np.bincount(keys >> 2 * SHIFT, minlength=len(texts))
            groups = [units.text_of(p)[:-1] if good else b"" for p, good in zip(placed, ok.tolist(), strict=True)]
            written = [hashlib.sha256(g).hexdigest() if g else "" for g in groups] if digest else [g.decode() for g in groups]
            return [*counts[:, :4].T, written, list_array(keys & (1 << 2 * SHIFT) - 1, held, pa.int64()), list_array(times.astype(np.int32), held, pa.int32())]

        return f

    return map_text(docs, [id_col], f"n_a long, n_b long, n_groups long, n_links long, {'groups_sha256' if digest else 'groups'} string, pairs array<long>, times array<int>", make, text_col, as_bytes=False, most=1 << 20)


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, n: how many rows of ``held`` (pairs: distinct in each row) have it; and best: whether no pair of the same first id has more.

    Rows are counted within tasks before any are shuffled.
    """

    def run(batches):
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged():
            pair, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.int64),) * 2
            both, back = np.unique(np.concatenate((total[0], pair)), return_inverse=True)
            return both, np.bincount(back, np.concatenate((total[1], n)), len(both)).astype(np.int64)

        for b in batches:
            waiting.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(waiting[-1])
            if size > 2_000_000:
                total, waiting, size = merged(), [], 0
                if len(total[0]) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["pair", "n"])
                    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = merged()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["pair", "n"])

    counted = saved(held.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.shiftright("pair", SHIFT)
    most = counted.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return saved(counted.join(most, first == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def rated(held: DataFrame, counted: DataFrame, most: int = MOST_HELD) -> DataFrame:
    """``held`` with n_best and count_sum in place of pairs and times.

    Up to ``most`` distinct pairs are given to the tasks; beyond, each row's pairs
    are joined with their counts and summed by row, to the same result.
    """
    keep = [c for c in held.columns if c not in ("pairs", "times")]
    n = counted.count()
    if n > most:
        row = saved(held.withColumn("row", F.monotonically_increasing_id()))  # a number that is stored, and so stays
        each = row.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
        sums = each.join(counted, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return row.join(sums, "row", "left").select(*map(col, keep), zero("n_best"), zero("count_sum"))
    table = counted.orderBy("pair").toArrow()
    context = held.sparkSession.sparkContext
    known = context.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    k = len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(keep).schema.fields) + ", n_best long, count_sum long"

    def run(batches):
        pair, count, best = known.value
        for b in batches:
            pairs, times = b.column(k), b.column(k + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pair, pairs.flatten().to_numpy(zero_copy_only=False))
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()

            def sums(x, ends=ends):
                total = np.concatenate(([0], np.cumsum(x)))[ends]
                return pa.array(total[1:] - total[:-1])

            yield pa.RecordBatch.from_arrays([*b.columns[:k], sums(times * best[at]), sums(times * count[at])], names=[*keep, "n_best", "count_sum"])

    return held.select(*map(col, keep), "pairs", "times").mapInArrow(run, schema)


def alignment(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_HELD) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Byte offsets where tokens of both end cut them into groups; tokens whose byte
    ranges overlap are linked. A pair's count is the number of rows that hold it linked. n_best: links whose count is the
    highest of their first id, ties included; count_sum: the counts of all links. Texts null, empty or not
    spelled by their tokens have zeros and '' as groups_sha256. Repeated rows and null ids are rows as any.
    Other columns are not read; no rows give none. A text is one row and never cut.
    """
    held = saved(aligned(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), first, second, "id", "text", True), compression="zstd")
    out = rated(held, pair_counts(held), most)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
