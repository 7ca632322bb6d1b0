import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from roadlens.llm.conversations import damaged, plans, repaired, repairs
from roadlens.llm.grammar import SYMBOLS, Repairs, before, joined, leaf, re_pair, written
from roadlens.llm.queries import op13_grammar_repair

SPACE = " \t\n\x0b\x0c\r"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def outcomes(rows):
    """rows: (initial, fault). All (cost, audit, roles) of edits with at most three insertions at a place, by plain enumeration."""
    found = [(0, "", "")]
    for initial, fault in rows:
        more = []
        for cost, audit, roles in found:
            for k in range(4):
                for inserted in itertools.product("ua", repeat=k):
                    c, a, r = cost + 2 * k, audit + "I" * k, roles + "".join(inserted)
                    more.append((c + 3, a + "D", r))
                    if fault != "gone":
                        cut = fault == "cut"
                        more.append((c + cut, a + "K", r + initial))
                        more += [(c + 2 + cut, a + "R", r + x) for x in "ua"]
        found = [m for m in more if re.fullmatch("s?(ua)*u?", m[2])]
    found = [(c + 2 * k, a + "I" * k, r + "".join(x)) for c, a, r in found for k in range(4) for x in itertools.product("ua", repeat=k)]
    return [f for f in found if re.fullmatch("(s?(ua)+)?", f[2])]


def plain_audit(rows):
    """The same by a table over states, one row after the other, strings and all."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    table = {"": (0, "", ())}

    def fill(t):
        for _ in range(3):
            for p, (c, a, r) in list(t.items()):
                for x in "ua":
                    q = step.get((p, x))
                    if q:
                        t[q] = min(t.get(q, (1e9, "")), (c + 2, a + "I", (*r, ("I", x))))
        return t

    for initial, fault in rows:
        new = {}
        for p, (c, a, r) in fill(dict(table)).items():
            new[p] = min(new.get(p, (1e9, "")), (c + 3, a + "D", (*r, ("D", ""))))
            if fault != "gone":
                for letter, x, cost in [("K", initial, 0), ("R", "u", 2), ("R", "a", 2)]:
                    q = step.get((p, x))
                    if q:
                        new[q] = min(new.get(q, (1e9, "")), (c + cost + (fault == "cut"), a + letter, (*r, (letter, x))))
        table = new
    t = fill(dict(table))
    return min(t[p] for p in ("", "a") if p in t)


def brute(table):
    """(conv_id, turn, role, text) rows to the query's rows."""
    plain = lambda x: " " if x is None else str(x)
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = plain(role), plain(text)
            c = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
            if c:
                text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
                rows += [(turn, "user" if c == 4 else role, text)] * (1 + (c == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        kind = {"blank": "gone", "duplicate": "gone", "truncated": "cut", "": ""}
        cost, audit, edits = plain_audit([(r[1][:1], kind[f]) for r, f in zip(rows, faults, strict=True)])
        said, todo = [], iter(rows)
        for letter, x in edits:
            name = {"u": "user", "a": "assistant"}.get(x)
            if letter == "I":
                said.append(f"{name}:")
                continue
            _, role, text = next(todo)
            if letter != "D":
                said.append(f"{role if letter == 'K' else name}:{text}")
        out.append((conv, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_the_query_equals_brute_force(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = op13_grammar_repair(spark, folder).select(NAMES)
        assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
        got = sorted((tuple(r) for r in got.collect()), key=repr)
        assert got == brute(rows)
    assert all(sum(r[k] for r in got) for k in range(1, 7)) and {"D", "I", "K", "R"} <= set("".join(r[7] for r in got))


def test_cheapest_and_least_of_all_edits():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suax"), r.choice(["", "cut", "gone"])) for _ in range(r.randint(0, 3))]
        cost, audit, _ = min(outcomes(rows))
        code = bytes(3 * "suax".index(i) + ["", "cut", "gone"].index(f) for i, f in rows)
        assert Repairs().of([code]) == [(cost, audit)] == [plain_audit(rows)[:2]]


def test_grammar_and_matrices_equal_a_plain_table():
    r = random.Random(7)
    repairs = Repairs(most=50)
    for _ in range(8):
        block = [r.randrange(SYMBOLS) for _ in range(6)]
        many = [bytes(r.randrange(SYMBOLS) for _ in range(r.randint(0, 30))) for _ in range(20)] + [bytes(block * r.randint(1, 9)) for _ in range(10)] + [bytes([r.randrange(SYMBOLS)] * 77)]
        want = [plain_audit([("suax"[x // 3], ["", "cut", "gone"][x % 3]) for x in s])[:2] for s in many]
        assert repairs.of(many) == want


def test_re_pair_spells_out_and_repeats_no_pair():
    r = random.Random(3)
    for _ in range(30):
        many = [[r.randrange(3) for _ in range(r.randint(0, 60))] for _ in range(4)]
        rules, names = {}, {}

        def rule(a, b, rules=rules, names=names):
            assert (a, b) not in names
            names[a, b] = 3 + len(rules)
            rules[names[a, b]] = (a, b)
            return names[a, b]

        def spelled(x, rules=rules):
            return [y for z in rules[x] for y in spelled(z)] if x in rules else [x]

        short = re_pair(many, rule)
        assert [[y for x in s for y in spelled(x)] for s in short] == many
        pairs = [p for s in short for i, p in enumerate(itertools.pairwise(s)) if not (i and s[i - 1] == p[0] == p[1])]
        assert len(pairs) == len(set(pairs))


def test_ropes_compare_as_their_texts():
    r = random.Random(1)
    for _ in range(300):
        a, b = (["".join(r.choice("DK") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 6))] for _ in range(2))
        x, y = (leaf("") for _ in range(2))
        for t in a:
            x = joined(x, leaf(t))
        for t in reversed(b):
            y = joined(leaf(t), y)
        assert written(x) == "".join(a) and before(x, y) == ("".join(a) < "".join(b))


def test_odd_rows(spark):
    r = random.Random(9)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (2, None, "user", "x"), (2, None, "user", "x"), (2, 3, "tool", "y!"), (2, 9, "", "z?"), (3, None, None, None), (5, 4, "system", " \n"), (5, 4, "assistant", "b." * 200_000)]
    rows += [(7, i // 3, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", "é!"])) for i in range(900)]
    rows += [(8, 5, "user", "same.")] * 300
    df = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], "conv_id long, turn long, role string, text string, conv int, h int, n int")
    own = df.select("conv_id").toDF("conv")
    got = repairs(damaged(df), own, conv="conv").toDF(*NAMES)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)
    none = df.limit(0)
    assert repairs(none).count() == 0 and repaired(none).count() == 0
    alone = repairs(damaged(none), spark.createDataFrame([(4,)], "conv long"), conv="conv").collect()
    assert [tuple(x) for x in alone] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    said = repaired(df.where("conv_id = 5")).orderBy("place").collect()
    assert [(x.place, x.turn, x.edit, x.role, len(x.text)) for x in said] == [(0, None, "I", "user", 0), (1, 4, "K", "assistant", 400_000)]


@pytest.mark.parametrize("parts", [1, 13])
def test_a_long_conversation_is_split_by_turns(spark, parts):
    r = random.Random(2)
    rows = [(1, r.randrange(4000), r.choice(["user", "assistant"]), f"{r.randrange(50)}.") for _ in range(3000)] + [(2, 0, "user", "q?")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = repairs(damaged(df), df.select(F.col("conv_id").alias("conv")), conv="conv")
        assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)
        _, planned = plans(damaged(df))
        assert planned.count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
