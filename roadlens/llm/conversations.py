"""Repair of conversation structure: the cheapest edits that make turns alternate, by a grammar shared by all conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, saved, slices
from .grammar import FINE, GONE, ROLES, TRUNCATED, Repairs

_SPACE = r"\x20\x09-\x0D"
_ORDER = ["turn", "role", "h"]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _own(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role and text; a null role or text is one space."""
    plain = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    return rows.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text with faults set in by crc32("conv:turn") % 20: 0 drops a row, 1 empties its text,
    2 takes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    own = _own(rows, conv, turn, role, text)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = own.withColumn("fault", F.crc32(F.concat_ws(":", plain("conv"), plain("turn"))) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return own.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _stream(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[tuple]:
    """Rows of batches as tuples, one slice of bounded bytes at a time."""
    for b in batches if text is None else slices(batches, text):
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _segments(narrow: DataFrame) -> DataFrame:
    """One row for each conversation and partition that holds a part of it: its symbols, and what its neighbours need to know.

    Rows are dealt by ranges of (conv, turn, role, h), so a conversation of
    any length is split, and pass as a stream.
    """
    out = f"conv {dict(narrow.dtypes)['conv']}, part int, symbols binary, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string"
    schema = T._parse_datatype_string(out)
    ordered = narrow.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", "h").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "h")
    legal = {"su", "ua", "au"}

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        part, arrow, now, made = TaskContext.get().partitionId(), to_arrow_schema(schema), None, []

        def closed():
            return (now["conv"], part, bytes(now["symbols"]), *[now[k] for k in schema.names[3:]])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

        for conv, turn, role, n, blank, cut, again in _stream(batches):
            if now is None or now["conv"] != conv:
                if now is not None:
                    made.append(closed())
                    if len(made) >= 5000:
                        yield batch(made)
                        made = []
                now = {"conv": conv, "symbols": bytearray(), "low": turn, "high": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": role[:1], "last": None}
            if turn is not None and turn != now["high"]:
                now["low"] = turn if now["high"] is None else now["low"]
                now["high"] = turn
                now["distinct"] += 1
            at = 3 * (ROLES.index(role[0]) if role and role[0] in "sua" else 3)
            fault = GONE if blank or again else TRUNCATED if cut else FINE
            now["symbols"].append(at + fault)
            now["symbols"] += bytes([at + GONE]) * (n - 1)
            now["blank"] += n * blank
            now["duplicate"] += (n if again else n - 1) * (not blank)
            now["truncated"] += fault == TRUNCATED
            now["illegal"] += n - 1 + (now["last"] is not None and now["last"] + role[:1] not in legal)
            now["last"] = role[:1]
        if now is not None:
            yield batch([*made, closed()])

    cols = ["conv", "turn", "role", "n", "blank", "cut", "again"]
    return ordered.select(cols).mapInArrow(run, schema)


def _planned(segments: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv, the counts, cost and audit of every conversation, from its segments in order.

    A conversation's symbols are one string here, one byte a row, as its audit is in the result.
    """
    kind = dict(segments.dtypes)["conv"]
    none = conversations.select("conv", *[F.lit(None).cast(t).alias(c) for c, t in segments.dtypes if c != "conv"])
    whole = segments.unionByName(none).groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct(*[c for c in segments.columns if c != "conv"])))).alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.get("s", i - 1).alias("a"), F.get("s", i).alias("b")))
    pairs = F.when(F.size("s") > 1, pairs)
    met = lambda f: F.coalesce(F.size(F.filter(pairs, f)), F.lit(0))
    total = lambda c: F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x[c]).alias(c)
    low, high = F.array_min(F.transform("s", lambda x: x["low"])), F.array_max(F.transform("s", lambda x: x["high"]))
    shared = met(lambda p: p["a"]["high"] == p["b"]["low"])
    apart = met(lambda p: ~F.concat(p["a"]["last"], p["b"]["first"]).isin("su", "ua", "au"))
    told = whole.select(
        "conv", F.coalesce(high - low + 1 - (total("distinct") - shared), F.lit(0)).cast("long").alias("gaps"), total("blank"), total("duplicate"), total("truncated"),
        (total("illegal") + apart).cast("long").alias("illegal"), F.aggregate("s", F.lit(b""), lambda t, x: F.concat(t, x["symbols"])).alias("symbols"),
    )

    def run(batches):
        repairs = Repairs()
        for b in slices(batches, 6):
            cost, audit = zip(*repairs.of(b.column(6).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=["conv", *_COUNTS, "cost", "audit"])

    return told.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string")


def _merged(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number n, and h, the SHA-256 of the text, which orders rows of one turn and role."""
    return rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("h", F.unhex(F.sha2("text", 256)))


def plans(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """For rows (conv, turn, role, text): (what _merged makes of them, stored; conv, gaps, blank, duplicate, truncated, illegal, cost, audit).

    ``conversations`` (conv) names those that have a plan even without rows.
    """
    merged = saved(_merged(rows))
    blank, cut = ~F.col("text").rlike(f"[^{_SPACE}]"), ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    narrow = merged.select("conv", "turn", "role", "h", "n", blank.alias("blank"), cut.alias("cut"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = merged.groupBy("conv", "role", "h").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    narrow = narrow.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    narrow = narrow.withColumn("again", F.coalesce(order > F.col("first"), F.lit(False))).drop("c", "r", "g", "first")
    conversations = merged.select("conv") if conversations is None else conversations
    return merged, saved(_planned(_segments(narrow), conversations.distinct()))


def _replayed(merged: DataFrame, planned: DataFrame, digest: bool) -> DataFrame:
    """The plans carried out: each conversation's plan and then its rows pass through a task as a stream.

    With ``digest``, a row a conversation with its plan and the SHA-256 of what is
    repaired, which can only be made in order; else the repaired rows.
    """
    told = ["cost", "audit", *_COUNTS]
    kinds = dict(planned.dtypes)
    head = planned.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in merged.dtypes if c != "conv"], *told)
    body = merged.select("conv", F.lit(1).alias("kind"), *[c for c in merged.columns if c != "conv"], *[F.lit(None).cast(kinds[c]).alias(c) for c in told])
    both = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "h")
    both = both.select("conv", "kind", "turn", "role", "n", *told, "text")
    out = f"conv {kinds['conv']}, " + ("cost long, audit string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", repaired_sha256 string" if digest else "place long, turn long, edit string, role string, text string")
    schema = T._parse_datatype_string(out)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, made, size = to_arrow_schema(schema), [], 0
        said, at, state, place, sha, audit = None, 0, 0, 0, None, ""

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], names=arrow.names)

        def give(turn, edit, role, text):
            nonlocal place, size
            if digest:
                sha.update((("\n" if place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            else:
                made.append((said[0], place, turn, edit, role, text))
                size += len(text) + 50
            place += 1

        def fill():
            """Carries out the insertions that come next."""
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = 3 if state == 2 else 2
                give(None, "I", "assistant" if state == 3 else "user", "")
                at += 1

        def closed():
            fill()
            if digest:
                made.append((*said, sha.hexdigest()))

        for conv, kind, turn, role, n, *rest in _stream(batches, 12):
            if kind == 0:
                if said is not None:
                    closed()
                said, at, state, place, sha, audit = (conv, *rest[:-1]), 0, 0, 0, hashlib.sha256(), rest[1]
            else:
                for _ in range(n):
                    fill()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    if edit == "K" and role[0] == "s":
                        state = 1
                    else:
                        state = 3 if state == 2 else 2
                    give(turn, edit, role if edit == "K" else "assistant" if state == 3 else "user", rest[-1])
            if len(made) >= 5000 or size > 4 << 20:
                yield batch()
                made, size = [], 0
        if said is not None:
            closed()
        if made:
            yield batch()

    return both.mapInArrow(run, schema)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 0), turn, edit (K, R or I), role and text of the repaired conversations; see ``repairs``."""
    merged, planned = plans(_own(rows, conv, turn, role, text))
    return _replayed(merged, planned, False).withColumnRenamed("conv", conv)


def repairs(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What each conversation lacks, and its cheapest repair: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first; of one turn by role, then by the SHA-256 of
    the text, so equal rows are adjacent. A row's first fault counts: blank text,
    role and text of an earlier row, no ``.!?`` at its end. Edits keep a row (K), make it the user's or assistant's (R), delete
    it (D; blank and repeated rows must go) or insert an empty turn (I), so that the initials of the roles read ``(s?(ua)+)?``. The audit is
    the cheapest edits' letters in order, of equal cost the ASCII-least.

    Rows become symbols of role and fault. Sequences are compressed by Re-Pair
    in tasks; each rule has a min-plus matrix over the states of the pattern, whose
    entries hold a cost and a rope of letters, computed once from its two sides
    for all conversations of a task. Equal rows are counted before they are
    shuffled, and long conversations are split by ranges of turns until their symbols are one string.

    Null roles and texts are one space (blank, and of no role that may stay); null conv ids are one conversation; ids of ``conversations``
    (conv) without rows have zeros, an empty audit and the hash of an empty string. No
    rows and no ids give no rows. Other columns are not read.
    """
    ids = None if conversations is None else conversations.select(col(conv).alias("conv"))
    merged, planned = plans(_own(rows, conv, turn, role, text), ids)
    out = _replayed(merged, planned, True)
    return out.select(F.col("conv").alias(conv), *_COUNTS, "cost", "audit", "repaired_sha256")
