"""Byte-level BPE in Spark tasks by a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import list_array, map_text

#: The pre-token pattern of the published byte-level vocabulary, its
#: white space spelled as the Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space beside other white space or at an end: there, space-separated units are not independent.
_ODD = re.compile(r"\A | \Z|\s | \s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class Vocabulary:
    """Merges and tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids, merges = data["model"]["vocab"], data["model"]["merges"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.find = regex.compile(PRETOKEN).findall
        self.byte_id = np.array([ids[symbols[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        keys = self.left << 20 | self.right
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = a.astype(np.int64) << 20 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has.

        All words lie in one symbol array, linked to their neighbours. The index
        maps a rank to the positions of its pair; the smallest active rank is
        applied to all of its positions at once, which adds the pairs that arise
        beside them. A word is never joined with the next.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        full = size > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - size)[full]] = -1
        index: dict[int, list[np.ndarray]] = {}

        def add(pos: np.ndarray) -> list[int]:
            """Enters positions under their pairs' ranks; the ranks that were not active before."""
            r = self.ranks(sym[pos], sym[nxt[pos]])
            hit = r >= 0
            pos, r = pos[hit], r[hit]
            if not len(r):
                return []
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            new = []
            for k, p in zip(r[np.concatenate(([0], cut))].tolist(), np.split(pos, cut), strict=True):
                if k in index:
                    index[k].append(p)
                else:
                    index[k] = [p]
                    new.append(k)
            return new

        heap = add(np.flatnonzero(nxt >= 0))
        heapq.heapify(heap)
        while heap:
            k = heapq.heappop(heap)
            at = index.pop(k)
            pos = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            a, b = self.left[k], self.right[k]
            after = nxt[pos]
            ok = (sym[pos] == a) & (after >= 0)
            ok &= sym[after] == b
            pos, after = pos[ok], after[ok]
            if not len(pos):
                continue
            if a == b:  # in a run, pairs overlap: the leftmost goes first
                used, hit = set(), []
                for p, q in zip(pos.tolist(), after.tolist(), strict=True):
                    hit.append(p not in used)
                    if hit[-1]:
                        used.add(q)
                pos, after = pos[hit], after[hit]
            beyond = nxt[after]
            sym[pos], sym[after] = self.made[k], -1
            nxt[pos] = beyond
            prv[beyond[beyond >= 0]] = pos[beyond >= 0]
            before = prv[pos]
            near = np.concatenate((before[before >= 0], pos[nxt[pos] >= 0]))
            if len(near):
                near = np.unique(near)
                for r in add(near):
                    heapq.heappush(heap, r)
        alive = sym >= 0
        total = np.concatenate(([0], np.cumsum(alive)))
        return sym[alive], total[ends] - total[ends - size]


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts, with those of the units seen last kept.

    A unit is a space and what follows it up to the next; where a text has other
    white space beside a space, its pre-tokens are the units.
    """

    def __init__(self, path: str, special: bool = True, most: int = 600_000):
        self.v, self.most = vocabulary(path), most
        self.special = special and self.v.split is not None
        self.few: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.ids = self.pt_len = self.pt_tok = np.zeros(0, np.int32)
        self.id_end = self.pt_end = np.zeros(1, np.int64)

    def units(self, text: str) -> list:
        if self.special and any(t in text for t in self.v.special):
            out: list = []
            for i, part in enumerate(self.v.split.split(text)):
                out += [(part,)] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if _ODD.search(text):
            return self.v.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def place(self, units: list) -> np.ndarray:
        """The index of each unit, after those not seen yet are encoded together."""
        new = [u for u in set(units) if u not in self.index]
        if new:
            if len(self.index) + len(new) > self.most:
                self.clear()
                new = list(set(units))
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def tokens_of(self, pretokens: list[str]) -> int:
        """Tokens of a few pre-tokens together; their counts have a table of their own, which grows in place."""
        new = [p for p in set(pretokens) if p not in self.few]
        if new:
            if len(self.few) + len(new) > self.most:
                self.few.clear()
                new = list(set(pretokens))
            self.few.update(zip(new, self.v.encode_words([p.encode() for p in new])[1].tolist(), strict=True))
        return sum(map(self.few.__getitem__, pretokens))

    def _learn(self, new: list) -> None:
        words: dict[str, int] = {}
        lists = [() if isinstance(u, tuple) else [words.setdefault(p, len(words)) for p in self.v.find(u)] for u in new]
        keys = list(words)
        ids, counts = self.v.encode_words([w.encode() for w in keys])
        ends = np.cumsum(counts)
        flat = np.fromiter((w for x in lists for w in x), np.int64)
        n_pt = np.fromiter(map(len, lists), np.int64, len(lists))
        lens = np.fromiter(map(len, keys), np.int32, len(keys))
        got, of = gather(ids, (ends - counts)[flat], counts[flat])
        unit_ids = np.add.reduceat(np.concatenate((of, [0])), np.minimum(np.cumsum(n_pt) - n_pt, len(of))) * (n_pt > 0) if len(n_pt) else n_pt
        base = len(self.id_end) - 1
        for i, u in enumerate(new):
            self.index[u] = base + i
        special = [i for i, u in enumerate(new) if isinstance(u, tuple)]
        if special:
            at = np.cumsum(unit_ids)[special]
            got = np.insert(got, at, [self.v.special[new[i][0]] for i in special])
            unit_ids[special] = 1
        self.ids = np.concatenate((self.ids, got.astype(np.int32)))
        self.id_end = np.concatenate((self.id_end, self.id_end[-1] + np.cumsum(unit_ids)))
        self.pt_len = np.concatenate((self.pt_len, lens[flat]))
        self.pt_tok = np.concatenate((self.pt_tok, counts[flat].astype(np.int32)))
        self.pt_end = np.concatenate((self.pt_end, self.pt_end[-1] + np.cumsum(n_pt)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        lists = [self.units(t) for t in texts]
        place = self.place([u for x in lists for u in x])
        flat, counts = gather(self.ids, self.id_end[place], self.id_end[place + 1] - self.id_end[place])
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))]
        return flat, np.diff(ends)

    def pretokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each pre-token of a text; special tokens count as ordinary text."""
        return self.counts_of(self.place(self._plain(text)))

    def counts_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each pre-token of the units at ``place``, in order."""
        start, n = self.pt_end[place], self.pt_end[place + 1] - self.pt_end[place]
        return gather(self.pt_len, start, n)[0], gather(self.pt_tok, start, n)[0]


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + count] of each, one after the other; and count."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(start - (end - count), count) + np.arange(total)], count


def decoder(v: Vocabulary):
    """ids of several texts to their strings; ill-formed UTF-8 becomes U+FFFD, unknown ids nothing."""
    most = max(v.bytes) + 2
    parts = [v.bytes.get(i, b"") for i in range(most)]
    flat = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, most)
    start = np.cumsum(size) - size

    def decode(ids: np.ndarray, counts: np.ndarray) -> list[str]:
        ids = np.where((ids < 0) | (ids >= most), most - 1, ids)
        data, n = gather(flat, start[ids], size[ids])
        data, ends = data.tobytes(), np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]

    return decode


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", special: bool = True, decode: bool = True) -> DataFrame:
    """id, ids (array of int) and, with ``decode``, decoded: the text of those ids.

    ``special``: the strings of added tokens become those tokens, as the
    vocabulary's own library has it; else they are ordinary text. Null and empty
    texts have no ids. A long text is one row and never cut; rows pass in slices
    of bounded bytes. Repeated rows and null ids are rows as any, no rows give none. Other columns are not read.
    """
    path = path or default_vocabulary()

    def make():
        e = Encoder(path, special)
        back = decoder(e.v)

        def f(texts, _):
            ids, counts = e.encode(texts)
            out = [list_array(ids, counts, pa.int32())]
            return [*out, pa.array(back(ids, counts), pa.string())] if decode else out

        return f

    return map_text(docs, [id_col], "ids array<int>" + ", decoded string" * decode, make, text_col, as_bytes=False, most=8 << 20)


def decode_ids(df: DataFrame, path: str | None = None, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and decoded, from an array of ids; null gives an empty text, null ids are skipped."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .common import col

    path = path or default_vocabulary()
    ids = F.coalesce(F.filter(col(ids_col).cast("array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>"))
    src = df.select(*[col(k) for k in keep], ids.alias("__ids"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches):
        back = decoder(vocabulary(path))
        for b in batches:
            x = b.column(len(keep))
            counts = np.diff(x.offsets.to_numpy())
            made = pa.array(back(x.flatten().to_numpy(zero_copy_only=False), counts), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*keep, "decoded"])

    return src.mapInArrow(run, schema)
