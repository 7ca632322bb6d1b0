"""Quality rules: ordered lists of threshold conjunctions, learned by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, map_text, mix64
from .labelled import labelled_sample

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_upper long, n_marks long, n_lines long"


def repeated_words(words: list[bytes], hashes: WordHash, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = hashes.of(words)
    k = np.zeros(n, np.uint64)
    for i in range(width):
        k = mix64(k * np.uint64(31) + h[i : i + n])
    _, where, count = np.unique(k, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def word_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns and STATS of every whole text; null texts have zeros.

    word_chars: code points in words; n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words in repeated 3-word windows; n_upper: A-Z;
    n_marks: exclamation marks; n_lines: lines with a word.
    """

    def make():
        hashes = WordHash()

        def one(t: bytes):
            words = t.split()
            dup = n_lines = 0
            seen: set[bytes] = set()
            for line in t.split(b"\n"):
                if line in seen:
                    dup += 1
                    n_lines += 1
                elif line.strip(_SPACE):
                    seen.add(line)
                    n_lines += 1
            points = sum(len(w) for w in words)
            points -= len(t) - len(t.translate(None, bytes(range(128, 192))))
            upper = len(t) - len(t.translate(None, bytes(range(65, 91))))
            return len(words), points, len(t) - len(t.translate(None, SYMBOLS)), dup, repeated_words(words, hashes), len(set(words)), upper, t.count(b"!"), n_lines

        def f(texts, _):
            rows = np.array([one(t) for t in texts], np.int64)
            return list(rows.T)

        return f

    return map_text(docs, keep, STATS, make, text_col)


#: Measures that conditions may test, from STATS; each is the same in Spark and numpy.
MEASURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        a, b = MEASURES[self.measure]
        x = F.col(a).cast("double") / (F.greatest(F.col(b), F.lit(1)).cast("double") if b else F.lit(1.0))
        return x >= self.threshold if self.above else x < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


def measured(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[a].astype(float) / (np.maximum(stats[b], 1).astype(float) if b else 1.0) for k, (a, b) in MEASURES.items()}


def _hits(rule: tuple[Condition, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= (x[c.measure] >= c.threshold) if c.above else (x[c.measure] < c.threshold)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, steps: int) -> tuple[Condition, ...]:
    """Adds the condition with the largest FOIL gain until no row of the other class is left."""
    rule: list[Condition] = []
    left = np.ones(len(y), bool)
    while y[left].sum() and (~y[left]).any() and len(rule) < 4:
        p, n = int(y[left].sum()), int((~y[left]).sum())
        best, gain = None, 1e-9
        for name, v in x.items():
            here, pos = v[left], y[left]
            order = np.argsort(here, kind="stable")
            s, ps = here[order], np.concatenate(([0], np.cumsum(pos[order])))
            cuts = np.flatnonzero(s[1:] > s[:-1]) + 1
            if len(cuts) > steps:  # even steps over the values, kept apart from the number of rows
                cuts = cuts[np.linspace(0, len(cuts) - 1, steps).astype(int)]
            below_p, below = ps[cuts], cuts
            for above in (True, False):
                cp = p - below_p if above else below_p
                ct = (p + n - below) if above else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(cp > 0, cp * (np.log2(cp / np.maximum(ct, 1)) - np.log2(p / (p + n))), -1.0)
                if len(g) and g.max() > gain:
                    i = int(g.argmax())
                    gain, best = g[i], Condition(name, above, float((s[cuts[i]] + s[cuts[i] - 1]) / 2))
        if best is None:
            break
        rule.append(best)
        left &= _hits((best,), x)
    return tuple(rule)


def tightest(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same rule without conditions that another one of the same measure and side implies."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        old = out.setdefault((c.measure, c.above), c)
        if (c.threshold > old.threshold) == c.above:
            out[c.measure, c.above] = c
    return tuple(out.values())


def _worth(rule: tuple[Condition, ...], x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, int]:
    """Precision, with two imagined rows of either class, and rows covered."""
    hit = _hits(rule, x)
    return (float(y[hit].sum()) + 1) / (float(hit.sum()) + 2), int(hit.sum())


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 16, steps: int = 128, seed: int = 5) -> list[tuple[Condition, ...]]:
    """Rules that reject, in order.

    Each rule grows on two thirds of the rows that earlier ones left and is pruned
    on the rest, dropping last conditions while that doesn't lower its precision there.
    A rule under ``precision`` ends the list, so clean documents stay. Of equal gains
    the first measure and lowest cut wins, of rules equally precise when pruned the
    shortest; which rows prune follows from ``seed`` and the rows' order.
    """
    x, y = measured(stats), bad.astype(bool)
    rng = np.random.default_rng(seed)
    rules: list[tuple[Condition, ...]] = []
    alive = np.ones(len(y), bool)
    while y[alive].any() and (~y).any() and len(rules) < most_rules:
        rows = rng.permutation(np.flatnonzero(alive))
        grow, prune = rows[: -(-2 * len(rows) // 3)], rows[-(-2 * len(rows) // 3) :]
        rule = _grow({k: v[grow] for k, v in x.items()}, y[grow], steps)
        if not rule:
            break
        held = {k: v[prune] for k, v in x.items()}
        choices = [rule[:i] for i in range(1, len(rule) + 1)]
        rule = max(choices, key=lambda r: (round(_worth(r, held, y[prune])[0], 6), -len(r)))
        hit, kept_out = _hits(rule, x) & alive, _hits(rule, held)
        if hit.sum() < 3 or y[hit].mean() < precision or (kept_out.any() and y[prune][kept_out].mean() < precision):
            break
        rules.append(tightest(rule))
        alive &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[Condition, ...]]:
    """Rules from at most ``max_rows`` rows of as many labelled ids (the bound on what the driver gathers: their statistics), by hash of the id."""
    some = labelled_sample(docs, labels, max_rows, None, id_col, label_col)
    got = word_stats(some.withColumn("__h", F.xxhash64(F.col(f"`{id_col}`"))), ["__label", "__h"], text_col)
    got = got.orderBy("__h", *[c for c in got.columns if c != "__h"]).limit(max_rows).toPandas().sort_values(["__h", "n_words"], kind="stable")
    return learn({k: got[k].to_numpy() for k in got.columns if k not in ("__label", "__h")}, got["__label"].to_numpy() == 0)


def rule_number(rules: list[tuple[Condition, ...]]) -> Column:
    """The first rule that fits a row of STATS, from 1 on; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out


def judged(docs: DataFrame, rules: list[tuple[Condition, ...]], keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns, STATS and ``rule``: the number of the rule that rejects the row, null where none does.

    Without rules, nothing is rejected. Null and empty texts are judged by zeros.
    Of several rules that fit, the first counts. Repeated rows and null ids each
    get their row, an empty table an empty result; columns that are not kept are not read.
    """
    return word_stats(docs, keep, text_col).withColumn("rule", rule_number(rules))
