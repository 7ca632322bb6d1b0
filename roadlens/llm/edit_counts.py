"""Token counts that follow edits: segment trees over pre-tokens."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, default_vocabulary
from .common import col, map_text, pack, saved, unpack

#: The pre-token pattern looks at most so many characters beyond the end of a match.
AHEAD = 2


class CountTree:
    """Characters and tokens of one document, summed over a binary tree whose leaves are its pre-tokens.

    A leaf that an edit touched may hold several pre-tokens or none.
    """

    def __init__(self, text: str, encoder: Encoder, counts: tuple[np.ndarray, np.ndarray] | None = None):
        self.encoder, self.text = encoder, text
        lens, toks = counts or encoder.pretokens(text)
        self.n = len(lens)
        self.m = 1 << max(0, (self.n - 1).bit_length())
        self.chars, self.toks = np.zeros(2 * self.m, np.int64), np.zeros(2 * self.m, np.int64)
        self.chars[self.m : self.m + self.n], self.toks[self.m : self.m + self.n] = lens, toks
        self.start = np.concatenate(([0], np.cumsum(lens))).tolist()
        self.changed: dict[int, list[str]] = {}
        self.encoded_chars = 0
        self._sum(0, self.m - 1)

    @property
    def tokens(self) -> int:
        return int(self.toks[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def _sum(self, lo: int, hi: int) -> None:
        """Renews the sums above leaves lo..hi."""
        lo, hi = (self.m + lo) >> 1, (self.m + hi) >> 1
        while lo:
            for x in (self.chars, self.toks):
                below = x[2 * lo : 2 * hi + 2]
                x[lo : hi + 1] = below[::2] + below[1::2]
            lo, hi = lo >> 1, hi >> 1

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character at ``pos``, and where that leaf starts."""
        i, start = 1, 0
        while i < self.m:
            i *= 2
            if pos >= start + self.chars[i]:
                start += int(self.chars[i])
                i += 1
        return i - self.m, start

    def _pieces(self, leaf: int) -> list[str]:
        if leaf in self.changed:
            return self.changed[leaf]
        return [self.text[self.start[leaf] : self.start[leaf + 1]]]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start..stop of the present text; positions beyond its end count as its end."""
        length = self.length
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        if start == stop and not new:
            return
        if not length:
            self.__init__(new, self.encoder)
            self.encoded_chars += len(new)
            return
        first, at = self._find(min(max(0, start - AHEAD), length - 1))
        last, got, ends = first, "", []
        need, more = stop - at, 8
        while True:
            while last < self.n and (len(got) < need + AHEAD + more or len(got) < need):
                for p in self._pieces(last):
                    got += p
                    ends.append(len(got))
                last += 1
            whole = last >= self.n
            fresh = got[: start - at] + new + got[need:]
            shift = len(new) - (stop - start)
            old = {x + shift: x for x in ends if x >= need}
            pieces, q = [], 0
            for p in self.encoder.v.find(fresh):
                pieces.append(p)
                q += len(p)
                if q in old and q >= start - at + len(new) and (q + AHEAD <= len(fresh) or whole) and self._leaf_end(first, old[q]) is not None:
                    break
            else:
                if not whole:
                    more *= 4
                    continue
            upto = self._leaf_end(first, old[q]) if q in old else last - 1
            break
        tokens = self.encoder.tokens_of(pieces)
        self.encoded_chars += q
        hi = max(upto, first)
        self.chars[self.m + first : self.m + hi + 1] = 0
        self.toks[self.m + first : self.m + hi + 1] = 0
        self.chars[self.m + first], self.toks[self.m + first] = q, tokens
        for i in range(first + 1, hi + 1):
            self.changed[i] = []
        self.changed[first] = pieces
        self._sum(first, hi)

    def _leaf_end(self, first: int, offset: int) -> int | None:
        """The last leaf that ends ``offset`` characters after leaf ``first`` starts, if one does."""
        i = first
        while offset > 0 and i < self.n:
            offset -= int(self.chars[self.m + i])
            i += 1
        return i - 1 if offset == 0 and i > first else None

    def current(self) -> str:
        return "".join(p for i in range(self.n) for p in self._pieces(i))


_EDITS = "array<struct<start:int,stop:int,text:string>>"


def stored_trees(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """The segment tree of every row, as a table in the shared folder, and the edits that wait for it.

    id, n_chars, n_tokens, lens and toks (packed: characters and tokens of each
    pre-token, from which the sums above follow), edits, and text where there are
    edits. Each text is encoded once, here. Null text is empty, null edits are none. Special tokens count as ordinary text.
    """
    path = path or default_vocabulary()
    edits = F.coalesce(col(edits_col), F.array().cast(_EDITS)).cast(_EDITS)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    src = df.select(col(id_col).alias("id"), edits.alias("edits"), F.when(F.size(edits) > 0, text).alias("text"), text.alias("__t"))

    def make():
        e = Encoder(path, special=False)

        def f(texts, _):
            units = [e._plain(t) for t in texts]
            place = e.place([u for each in units for u in each])
            ends = np.cumsum([len(u) for u in units]).tolist()
            rows = []
            for t, u, end in zip(texts, units, ends, strict=True):
                lens, toks = e.counts_of(place[end - len(u) : end])
                rows.append((len(t), int(toks.sum()), pack(_narrow(lens)), pack(_narrow(toks))))
            return [list(x) for x in zip(*rows, strict=True)]

        return f

    return saved(map_text(src, ["id", "edits", "text"], "n_chars long, n_tokens long, lens binary, toks binary", make, "__t", as_bytes=False, most=8 << 20))


def _narrow(a: np.ndarray) -> np.ndarray:
    """As uint8, with what is 255 or more as runs of 255 before the rest."""
    a = np.asarray(a, np.int64)
    if not len(a) or a.max() < 255:
        return a.astype(np.uint8)
    out = np.full(int((a // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(a // 255 + 1) - 1] = a % 255
    return out


def _wide(a: np.ndarray) -> np.ndarray:
    whole = np.cumsum(a, dtype=np.int64)[a < 255]
    return np.diff(whole, prepend=0)


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``stored_trees`` after their edits: id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_chars_encoded, lens, toks and text.

    Positions of edits refer to the stored text; edits apply in order of their starts,
    those that overlap an earlier one or have a null position are left out, and
    positions beyond the end count as the end. An edit re-encodes what it touches, with
    the context on which pre-token boundaries depend, up to the first boundary that
    old and new text share; n_chars_encoded sums those regions. lens, toks and
    text are the tree and text after the edits, for a next batch of them; a row
    without edits keeps its tree, and its text is not stored. Counts equal those of encoding the edited text anew.
    """
    path = path or default_vocabulary()
    names = ["id", "n_chars", "n_tokens"]
    out = "n_edits int, n_chars_after long, n_tokens_after long, n_chars_encoded long, lens binary, toks binary, after string"
    src = trees.select(*names, "edits", F.col("lens").alias("__lens"), F.col("toks").alias("__toks"), "text")

    def make():
        e = Encoder(path, special=False)

        def f(texts, batch):
            rows = []
            chars, tokens, edits, lens, toks = (batch.column(i) for i in range(1, 6))
            for i, t in enumerate(texts):
                some = edits[i].as_py()
                if not some:
                    rows.append((0, chars[i].as_py(), tokens[i].as_py(), 0, lens[i].as_py(), toks[i].as_py(), None))
                    continue
                tree = CountTree(t, e, (_wide(unpack(lens[i].as_py(), np.uint8)), _wide(unpack(toks[i].as_py(), np.uint8))))
                shift, upto, done = 0, 0, 0
                for x in sorted((x for x in some if x and x["start"] is not None and x["stop"] is not None), key=lambda x: x["start"]):
                    a, b = min(max(x["start"], 0), len(t)), min(x["stop"], len(t))
                    if a < upto or b < a:
                        continue
                    new = x["text"] or ""
                    tree.edit(a + shift, b + shift, new)
                    shift, upto, done = shift + len(new) - (b - a), b, done + 1
                leaves = tree.chars[tree.m : tree.m + tree.n], tree.toks[tree.m : tree.m + tree.n]
                full = leaves[0] > 0
                rows.append((done, tree.length, tree.tokens, tree.encoded_chars, pack(_narrow(leaves[0][full])), pack(_narrow(leaves[1][full])), tree.current()))
            return [list(x) for x in zip(*rows, strict=True)]

        return f

    got = map_text(src, [*names, "edits", "__lens", "__toks"], out, make, "text", as_bytes=False)
    return got.drop("edits", "__lens", "__toks").withColumnRenamed("after", "text")


def edited_counts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after and n_chars_encoded of each row.

    ``edits`` is array<struct<start int, stop int, text string>>: code points
    start..stop of the row's text give way to ``text``. The trees of all rows are
    stored (``stored_trees``), then the edits are applied to them (``apply_edits``).
    Repeated rows and null ids each get their row, an empty table an empty result;
    other columns are not read.
    """
    out = apply_edits(stored_trees(df, path, id_col, text_col, edits_col), path)
    return out.drop("lens", "toks", "text").withColumnRenamed("id", id_col)


def cleaning_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and edits: lines with a word that repeat an earlier line go; words with an @ become <MAIL>."""
    import re

    word = re.compile(r"[^\s]*@[^\s]*")

    def make():
        def f(texts, _):
            out = []
            for t in texts:
                seen, edits, at = set(), [], 0
                for line in t.split("\n"):
                    if line in seen:
                        edits.append({"start": max(at - 1, 0), "stop": at + len(line), "text": ""})
                    else:
                        if line.strip():
                            seen.add(line)
                        if "@" in line:
                            edits += [{"start": at + m.start(), "stop": at + m.end(), "text": "<MAIL>"} for m in word.finditer(line)]
                    at += len(line) + 1
                out.append(edits)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
            return [pa.array(out, kind)]

        return f

    src = docs.select(col(id_col), col(text_col).alias("text"), col(text_col).alias("__t"))
    return map_text(src, [id_col, "text"], "edits array<struct<start:int,stop:int,text:string>>", make, "__t", as_bytes=False)
