"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions beside them."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, fresh, map_text, slices

#: The kinds in order, and their base patterns.
KINDS = ("email", "ip", "card", "phone")
#: What the network tags: the kinds, and keys, tokens and passwords, for which there is no base pattern.
TAGGED = (*KINDS, "secret")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The ip pattern from the start of a run of digits and without backtracking: the same matches, but long runs of digits take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: No span that the checks accept lacks these.
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in s.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = _NOT_DIGIT.sub("", s)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _emails(t: str):
    """Leftmost matches, found from each @ backwards: a scan from every word is slow on long runs."""
    pattern, at, floor = PATTERNS["email"], t.find("@"), 0
    while at >= 0:
        s = at
        while s > floor and _LOCAL.match(t[s - 1]):
            s -= 1
        m = pattern.match(t, s) if s < at else None
        if m:
            yield m.start(), m.end()
            floor = m.end()
            at = t.find("@", floor)
        else:
            floor = at + 1
            at = t.find("@", floor)


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that pass their check."""
    out = [("email", a, b) for a, b in _emails(t)]
    for kind in KINDS[1:]:
        find = _IP if kind == "ip" else PATTERNS[kind]
        out += [(kind, m.start(), m.end()) for m in find.finditer(t) if _valid(kind, m.group())]
    return out


_ADDED = {
    "email": re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}"),
    "phone": re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]"),
    "secret": re.compile(r"[A-Za-z0-9_+/-]+(?:\.[A-Za-z0-9_+/-]+)*={0,2}"),
}
#: What a piece of a span is grown to, by kind: each from its first place on, so that long runs take linear time. Cards and ips are never longer than a window.
_RUNS = {
    "email": re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]++"),
    "phone": re.compile(r"[+(]?[0-9](?:[\x20().-]*+[0-9])*+"),
    "secret": re.compile(r"[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+={0,2}"),
}
_SEPARATOR = re.compile(r"[/.=-]+")


def _scrambled(s: str, bare: str) -> bool:
    """Whether a run with separators is no path, date or name: small and capital letters and digits, which change places often between separators."""
    sort = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "_"
    parts = [[sort(c) for c in p] for p in _SEPARATOR.split(s)]
    changes = sum(a != b for p in parts for a, b in zip(p, p[1:], strict=False))
    return {"0", "a", "A"} <= {c for p in parts for c in p} and 4 * changes >= len(bare)


def acceptable(kind: str, s: str) -> bool:
    """The exact check on what the network adds, wider than the base patterns. No kind but cards, ips and phones is limited in length.

    A secret has 16 characters or more besides separators (``/ . - =``: base64 keys, signed tokens).
    """
    if not _ADDED[kind].fullmatch(s):
        return False
    digits = _NOT_DIGIT.sub("", s)
    if kind == "secret":
        bare = _SEPARATOR.sub("", s)
        mixed = len(bare) >= 16 and len(digits) >= 2 and len({c.lower() for c in bare if c.isalpha()}) >= 2 and len(set(bare)) >= 7
        return mixed and (len(bare) == len(s) or _scrambled(s, bare))
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return luhn(digits) and len(set(digits)) > 1
    return kind == "email" or (9 <= len(digits) <= 15 and (s[0] in "+(" or len(re.findall(r"[\x20().-]+", s)) >= 2))


# Characters: printable ASCII, white space, other letters, all else, padding.
N_CHARS = 99
TAGS = 1 + 2 * len(TAGGED)
WINDOW, STRIDE, HIDDEN = 128, 32, 14


def codes(t: str) -> np.ndarray:
    c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where((c >= 32) & (c < 127), c - 32, 97)
    out[(c >= 9) & (c <= 13)] = 95
    out[c >= 0xAA] = 96
    return out.astype(np.int16)


def allowed() -> np.ndarray:
    """0 where a tag may follow a tag, else a large negative number. Tags: outside, then first and further of each kind."""
    out = np.zeros((TAGS, TAGS))
    for b in range(2, TAGS, 2):
        out[:, b] = -1e4
        out[[b - 1, b], b] = 0
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (N_CHARS, 4 * HIDDEN))
            p["h" + d] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            p["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        p["o"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS))
        p["ob"] = np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states in the order of steps [L, B, H]; with ``keep``, what the backward pass needs."""
        n, length = x.shape
        wx, wh = self.p["x" + d] + self.p["c" + d], self.p["h" + d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, trace = np.empty((length, n, HIDDEN), np.float32), []
        for s in range(length):
            a = wx[x[:, s]] + h @ wh
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, hp = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[s] = h
            if keep:
                trace.append((i, f, o, g, before, tc, hp))
        return out, trace

    def emissions(self, x: np.ndarray, keep: bool = False):
        """[L, B, TAGS] for windows of character codes [B, L]."""
        forward, tf = self._run(x, "f", keep)
        backward, tb = self._run(x[:, ::-1], "b", keep)
        both = np.concatenate((forward, backward[::-1]), 2)
        e = both @ self.p["o"] + self.p["ob"]
        return (e, both, tf, tb) if keep else e

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag path [B, L] of each window, and its emissions' lead over tag 0."""
        e = self.emissions(x)
        e = np.where((x.T == N_CHARS - 1)[:, :, None] & (np.arange(TAGS) > 0), -1e4, e)
        t = self.p["t"] + allowed()
        s = e[0] + allowed()[0]
        back = np.zeros((len(e), *s.shape), np.int8)
        for k in range(1, len(e)):
            m = s[:, :, None] + t
            back[k] = m.argmax(1)
            s = m.max(1) + e[k]
        path = np.zeros((x.shape[0], len(e)), np.int8)
        path[:, -1] = s.argmax(1)
        rows = np.arange(x.shape[0])
        for k in range(len(e) - 1, 0, -1):
            path[:, k - 1] = back[k][rows, path[:, k]]
        lead = np.take_along_axis(e, path.T[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]
        return path, lead.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag paths ``y`` under the CRF, and its gradient."""
        e, both, tf, tb = self.emissions(x, True)
        length, n, _ = e.shape
        t = self.p["t"] + allowed()
        e = e.astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + allowed()[0]
        lse = lambda m, ax: m.max(ax) + np.log(np.exp(m - m.max(ax, keepdims=True)).sum(ax))
        for k in range(1, length):
            alpha[k] = e[k] + lse(alpha[k - 1][:, :, None] + t, 1)
        for k in range(length - 2, -1, -1):
            beta[k] = lse(t + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        dt = np.zeros((TAGS, TAGS))
        for k in range(1, length):
            dt += np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(0)
        yt, who = y.T, np.arange(n)
        gold = sum(e[k, who, yt[k]] for k in range(length)) + sum(t[yt[k - 1], yt[k]] for k in range(1, length))
        for k in range(length):
            de[k, who, yt[k]] -= 1
            if k:
                np.add.at(dt, (yt[k - 1], yt[k]), -1)
        de = (de / n).astype(np.float32)
        g = {"t": (dt / n).astype(np.float32), "ob": de.sum((0, 1)), "o": np.einsum("lnh,lnt->ht", both, de)}
        dh = de @ self.p["o"].T
        for d, trace, dd, xs in (("f", tf, dh[:, :, :HIDDEN], x), ("b", tb, dh[::-1, :, HIDDEN:], x[:, ::-1])):
            gx, gh = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d])
            nh = nc = np.zeros((n, HIDDEN), np.float32)
            for s in range(length - 1, -1, -1):
                i, f, o, c, before, tc, hp = trace[s]
                h = dd[s] + nh
                nc = nc + h * o * (1 - tc * tc)
                da = np.concatenate((nc * c * i * (1 - i), nc * before * f * (1 - f), h * tc * o * (1 - o), nc * i * (1 - c * c)), 1)
                gh += hp.T @ da
                np.add.at(gx, xs[:, s], da)
                nh, nc = da @ self.p["h" + d].T, nc * f
            g |= {"x" + d: gx, "h" + d: gh, "c" + d: gx.sum(0)}
        return float((z - gold).mean()), g


def train(x: np.ndarray, y: np.ndarray, updates: int = 260, batch: int = 96, rate: float = 0.02, seed: int = 4) -> Network:
    """Adam on shuffled windows of codes ``x`` and tags ``y``."""
    net, rng = Network.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, updates + 1):
        pick = rng.integers(0, len(x), min(batch, len(x)))
        _, g = net.gradient(x[pick], y[pick])
        lr = rate * min(1, 2 * (1 - step / (updates + 1)))
        for k, d in g.items():
            d = np.clip(d, -1, 1)
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.p[k] = (net.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _tags(length: int, spans: list[tuple[str, int, int]], start: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b = max(a - start, 0), min(b - start, length)
        if a < b and not out[a:b].any():
            out[a:b] = 2 * TAGGED.index(kind) + 2
            out[a] -= 1
    return out


def _invented(rng: np.random.Generator) -> tuple[str | None, str, str]:
    """A random span of a random kind, and what goes before it; the kind is null for what only looks like one."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    some = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    one = lambda *x: x[rng.integers(0, len(x))]
    kind = (*TAGGED, "secret", None)[rng.integers(0, len(TAGGED) + 2)]
    if kind == "email":
        at = one(word(), word(), "".join(one("é", "ü", "ñ", "ø", word()) for _ in range(3)))
        return kind, f"{at}{one('', '.', '_', '-', '+')}{number(rng.integers(0, 3))}@{word()}{number(rng.integers(0, 2))}.{one(word() + '.com', 'org', 'net', 'co.uk', 'de')}", ""
    if kind == "ip":
        return kind, ".".join(str(n) for n in rng.integers(0, 256, 4)), ""
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return kind, one(f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"+{rng.integers(1, 99)}-{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"), ""
    if kind == "card":
        d = number(rng.integers(12, 19))
        d += next(x for x in "0123456789" if luhn(d + x))
        return kind, one(d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))), ""
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if kind == "secret":
        name = one("", "", "key", "password", "token", "secret", "api_key", "pwd", "Bearer", "auth")
        name += one("=", " = ", ": ", " ", '="', ' = "') if name else ""
        form = one(0, 1, 2, 3, 0, 1, 2, 3, 4, 5)
        n = int(rng.integers(16, 49))
        if form > 3:
            mixed = low + up + digits
            s = some(mixed + "+/", n + 4) + one("", "=", "==") if form == 4 else ".".join(some(mixed + "-_", int(rng.integers(8, 33))) for _ in range(3))
            return kind, s if acceptable(kind, s) else some(mixed, 8) + "/9aB" + some(mixed, 16) + "4kQ", name
        s = some(digits + low[:6], n) if form == 0 else some(up + digits, n) if form == 1 else some(low + up + digits, n) if form == 2 else some(up, 4) + some(up + digits, 16)
        return kind, s if acceptable(kind, s) else s[:-3] + "7a9", name
    n, y = rng.integers(1, 1000), rng.integers(1900, 2100)
    s = one(f"{y}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(0, 24)}:{n % 60:02}", f"{n % 9}.{n % 11}.{n % 13}", f"${n},{number(3)}.{number(2)}", number(rng.integers(1, 12)), f"{y}/{n}/{word()}-{word()}-{number(2)}", f"v{n % 20}.{n % 7}", word() + number(2), word() * 3, f"{one(*up)}{number(5)}", f"@{word()}", f"{n}%")
    return None, s, ""


#: Characters of a training window.
LENGTH = 96


def _marked(t: str, spans, start: int) -> tuple[np.ndarray, np.ndarray]:
    c = codes(t[start : start + LENGTH])
    x, y = np.full(LENGTH, N_CHARS - 1, np.int16), np.zeros(LENGTH, np.int64)
    x[: len(c)], y[: len(c)] = c, _tags(len(c), spans, start)
    return x, y


def labelled_windows(t: str, seed: int):
    """(codes, tags) of windows around the digits and @ signs of a text, by its base spans.

    Windows that hold what might be a secret are left out, since no base pattern says whether it is one.
    """
    hits = np.unique(np.fromiter((m.start() for m in _TRIGGER.finditer(t)), np.int64) // LENGTH)
    if not len(hits):
        return
    spans, rng = base_spans(t), np.random.default_rng(seed)
    for h in hits.tolist():
        start = max(0, h * LENGTH - int(rng.integers(0, LENGTH)))
        part = t[start : start + LENGTH]
        if not any(acceptable("secret", m.group()) for m in _RUNS["secret"].finditer(part)):
            yield _marked(t, [s for s in spans if s[1] < start + LENGTH and s[2] > start], start)


def invented_windows(texts: list[str], n: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Windows of stretches of text with invented spans set in, each with its tags."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["lorem ipsum dolor sit amet "]
    out = []
    for _ in range(n):
        t = texts[rng.integers(0, len(texts))]
        at = int(rng.integers(0, len(t) + 1))
        kind, s, name = _invented(rng)
        before, after = t[max(0, at - LENGTH) : at], t[at : at + LENGTH]
        if rng.random() < 0.8:
            before, after = before.rstrip() + " ", rng.choice([" ", " ", ". ", ", ", '" ']) + after.lstrip()
        before += name
        text = before + s + after
        out.append(_marked(text, [(kind, len(before), len(before) + len(s))] if kind else [], max(0, len(before) - int(rng.integers(1, max(2, LENGTH - len(s)))))))
    return tuple(map(np.stack, zip(*out, strict=True)))


def training_windows(texts: list[str], invented: int = 5000, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts around digits and @, labelled with base spans, and windows with invented spans set in."""
    real = [w for i, t in enumerate(texts) for w in labelled_windows(t, i)]
    made = invented_windows(texts, invented, seed)
    return tuple(np.concatenate((np.stack(a), b)) if a else b for a, b in zip(zip(*real, strict=True) if real else ((), ()), made, strict=True))


def fit(docs: DataFrame, max_rows: int = 3000, max_windows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network from base spans in real text and from invented spans set into real text.

    Of at most ``max_rows`` ids, those with the smallest hash, whole texts are read
    in tasks. At most ``max_windows`` of their labelled windows and as many plain
    stretches of 200 characters, again by hash, are gathered for fitting, however
    many rows an id has and however long they are. Detection reads all texts.
    """
    own = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    ids = own.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)
    some = own.join(F.broadcast(ids), "id").select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("id", "text").alias("h"))

    def cut(batches):
        for batch in slices(batches, 0):
            rows = []
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng(h & 0x7FFFFFFF)
                at = int(rng.integers(0, max(1, len(t) - 200)))
                rows.append((t[at : at + 200], None, None))
                rows += [(None, x.tobytes(), y.astype(np.int8).tobytes()) for x, y in labelled_windows(t, h & 0x7FFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["t", "x", "y"])

    made = checkpoint(some.mapInArrow(cut, "t string, x binary, y binary").distinct())
    few = lambda c: made.where(f"{c} is not null").orderBy(F.xxhash64(c), "t", "x", "y").limit(max_windows)
    real, plain = few("x").toPandas(), few("t").toPandas()
    x, y = invented_windows(plain.t.tolist(), 5000)
    if len(real):
        x = np.concatenate((np.stack([np.frombuffer(b, np.int16) for b in real.x]), x))
        y = np.concatenate((np.stack([np.frombuffer(b, np.int8) for b in real.y]).astype(np.int64), y))
    return train(x, y)


def windows(t: str) -> list[int]:
    """Starts of the windows that hold a digit or an @; no other window can give a span that ``acceptable`` passes."""
    out: list[int] = []
    last = max(0, -(-(len(t) - WINDOW) // STRIDE))
    for m in _TRIGGER.finditer(t):
        p = m.start()
        lo = max(0, -(-(p - WINDOW + 1) // STRIDE))
        for k in range(max(lo, out[-1] + 1 if out else 0), min(last, p // STRIDE) + 1):
            out.append(k)
    return [k * STRIDE for k in out]


def reconcile(candidates: dict[tuple[int, int, str], float]) -> list[tuple[str, int, int]]:
    """The set of spans of greatest total weight in which none overlap; of equal sets, the one that ends first, then starts first, then the kind listed first."""
    spans = sorted(((b, a, k, w) for (a, b, k), w in candidates.items() if w > 0), key=lambda x: (x[0], x[1], TAGGED.index(x[2])))
    ends = [s[0] for s in spans]
    best, take = [0.0] * (len(spans) + 1), [False] * len(spans)
    for i, (b, a, _, w) in enumerate(spans):
        with_it = best[bisect_right(ends, a, 0, i)] + w
        take[i] = with_it > best[i]
        best[i + 1] = max(best[i], with_it)
    out, i = [], len(spans)
    while i:
        if take[i - 1]:
            b, a, k, _ = spans[i - 1]
            out.append((k, a, b))
            i = bisect_right(ends, a, 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def find_all(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text.

    The network tags overlapping windows. Spans from all windows of a text are weighed
    by how far their tags lead, summed over windows. A secret takes in the whole run of
    its characters. Of other kinds every span of up to WINDOW - STRIDE characters lies inside
    some window; pieces that a window's edge cuts count for the run of their kind's
    characters if that is longer. Spans that pass the exact check and overlap no base
    span are reconciled over the whole text and added, however long they are.
    """
    base = [base_spans(t) for t in texts]
    where = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    code = {}
    votes: list[dict] = [{} for _ in texts]
    for a in range(0, len(where), 1024):
        part = where[a : a + 1024]
        x = np.full((len(part), WINDOW), N_CHARS - 1, np.int16)
        for r, (i, s) in enumerate(part):
            if i not in code:
                code = {i: codes(texts[i])}
            c = code[i][s : s + WINDOW]
            x[r, : len(c)] = c
        path, lead = net.decode(x)
        for r in np.flatnonzero(path.any(1)).tolist():
            (i, s), tags = part[r], path[r]
            starts = np.flatnonzero((tags % 2 == 1)).tolist()
            for p in starts:
                q = p + 1
                while q < WINDOW and tags[q] == tags[p] + 1:
                    q += 1
                cut = (p == 0 and s > 0) or (q == WINDOW and s + q < len(texts[i]))
                key = (s + p, s + q, TAGGED[int(tags[p] - 1) // 2], cut)
                votes[i][key] = votes[i].get(key, 0.0) + float(lead[r, p:q].mean())
    out = []
    for t, b, v in zip(texts, base, votes, strict=True):
        added = reconcile(_fitting(t, b, v)) if v else []
        out.append((b, sorted([*b, *added], key=lambda z: (TAGGED.index(z[0]), z[1], z[2]))))
    return out


def _fitting(t: str, base: list, votes: dict[tuple[int, int, str, bool], float]) -> dict[tuple[int, int, str], float]:
    """The candidates that pass the exact check and overlap no base span: secrets, and pieces cut by a window's edge, grown to their runs.

    Each span is checked once, however many windows vote for it.
    """
    taken = sorted((x, y) for _, x, y in base)
    starts, upto = [x for x, _ in taken], np.maximum.accumulate([y for _, y in taken]) if taken else []
    runs: dict = {}
    out: dict = {}
    passed: dict = {}
    for (x, y, k, cut), w in votes.items():
        if k == "secret" or cut:
            if k not in _RUNS:
                continue
            if k not in runs:
                runs[k] = [m.span() for m in _RUNS[k].finditer(t)]
            at = bisect_right(runs[k], (x + y) // 2, key=lambda r: r[0]) - 1
            if at < 0 or runs[k][at][1] <= (x + y) // 2:
                continue
            x, y = runs[k][at]
            if k != "secret" and y - x <= WINDOW - STRIDE:
                continue
        key = (x, y, k)
        if key not in passed:
            before = bisect_right(starts, y - 1)
            passed[key] = not (before and upto[before - 1] > x) and acceptable(k, t[x:y])
        if passed[key]:
            out[key] = out.get(key, 0.0) + w
    return out


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns, base (array of kind, start, stop: base spans) and spans (with those the network adds).

    Positions are code points, ends exclusive; order is by kind as in TAGGED, then
    start. Null and empty texts have none. Whole texts are read. Repeated rows and
    null ids each get their row, an empty table an empty result; other columns
    are not read.
    """
    kind = "array<struct<kind:string,start:int,stop:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def make():
        def f(texts, _):
            found = find_all(texts, net)
            return [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in side], arrow) for side in zip(*found, strict=True)]

        return f

    return map_text(docs, keep, f"base {kind}, spans {kind}", make, text_col, as_bytes=False)


def redact(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    names = docs.columns

    def make():
        def f(texts, _):
            out = []
            for t, (_, spans) in zip(texts, find_all(texts, net), strict=True):
                parts, at = [], 0
                for k, a, b in sorted(spans, key=lambda z: (z[1], -z[2])):
                    if a >= at:
                        parts += [t[at:a], f"[{k.upper()}]"]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]))
            return [out]

        return f

    new = fresh("__redacted", names)
    got = map_text(docs, names, f"{new} string", make, text_col, as_bytes=False)
    return got.select(*[F.when(col(text_col).isNotNull(), F.col(new)).alias(c) if c == text_col else col(c) for c in names])
