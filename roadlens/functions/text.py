"""Column functions on captions, queries and paths. All of them stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns, the heading words and stopwords of the lexical view.
TOKEN = r"[A-Za-z0-9]+|[一-鿿]+"
VIEW_TOKEN = r"[a-z0-9]+|[一-鿿]+"
HEADINGS = (
    "atmosphere", "background", "composition", "details", "environment", "foreground", "immediate", "lighting", "main",
    "mid-?ground", "overlays", "overall", "positioning", "specific", "spatial", "subjects", "surroundings",
)
STOPWORDS = ("the", "a", "an", "this", "that", "with", "and", "from", "into", "over", "under", "image")
TIMESTAMP = r"\b\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\b"
CHANNEL = r"\bch\d+\b"
PLATE = r"\b[一-鿿]?[A-Z]{1,3}[A-Z0-9]*\d[A-Z0-9]*\b"
#: The same plates for Java, which never goes back in a word: letters, then letters and digits of which one at least is a digit.
_PLATE = r"\b[一-鿿]?[A-Z]++(?:[0-9][A-Z0-9]*+(?:\d[A-Z0-9]*+)?|\d[A-Z0-9]*+)\b"
_TERM = "|".join(HEADINGS)
#: A list or title mark, heading words, and then a colon, dash, full stop or the end of the line.
HEADING = (
    r"^\s*(?:#{1,6}\s+|[-*+•]\s+|\d+[.)]\s+)?(?:\*\*|__|\*|_)?"
    rf"(?:(?:{_TERM})(?:\s+(?:{_TERM}|and|of|&))*)"
    r"(?:\*\*|__|\*|_)?[^\S\r\n]*(?:[:：\-—–.][^\S\r\n]*|$)"
)
#: Java flags that make patterns mean what they mean on Unicode text: classes, case, and \n alone as line end.
_U, _UI, _LINES = "(?U)", "(?Uiu)", "(?Uiumd)"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, and runs of CJK characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _without_marks(caption: Column) -> Column:
    """A caption in lower case without time stamps, channel names, plates and heading words."""
    x = F.lower(caption)
    x = F.regexp_replace(x, _U + TIMESTAMP, " ")
    x = F.regexp_replace(x, _UI + CHANNEL, " ")
    x = F.regexp_replace(x, _UI + _PLATE, " ")
    return F.regexp_replace(x, _LINES + HEADING, " ")


def normalized(caption: Column) -> Column:
    """A caption without time stamps, channel names, plates, heading words and asterisks, its white space single."""
    return F.trim(F.regexp_replace(F.replace(_without_marks(caption), F.lit("*"), F.lit(" ")), _U + r"\s+", " "))


def lexical_text(caption: Column) -> Column:
    """The tokens of the normalised caption, less stopwords, each once, in order of first use."""
    every = F.regexp_extract_all(normalized(caption), F.lit(VIEW_TOKEN), F.lit(0))
    return F.array_join(F.array_distinct(F.filter(every, lambda t: ~t.isin(*STOPWORDS))), " ")


def lexical_source(caption: Column) -> Column:
    """A text with the same lexical tokens: the caption itself where ``normalized`` replaces nothing but white space and asterisks, else the caption with all else replaced.

    All but headings that it replaces have a digit.
    """
    return F.when(caption.rlike(_LINES + r"\d|" + HEADING), _without_marks(caption)).otherwise(caption)


def has_cjk(text: Column) -> Column:
    """Whether a text has Han, kana or hangul."""
    return text.rlike("[\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dir_name(query: Column) -> Column:
    """A query as a folder name."""
    x = F.regexp_replace(stripped(query), r"[\x00/\\]", "_")
    x = F.rtrim(F.regexp_replace(x, r"[\r\n\t]+", "_"), F.lit(". "))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("empty_query")).otherwise(x)


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a name that starts or ends with its only dot stays."""
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def label_of(path: Column, root: str = "") -> Column:
    """The first path component below ``root``, null for paths elsewhere; a file right there is its own label."""
    root = root.rstrip("/")
    rel = F.when(path.startswith(root + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path))) if root else path
    return F.nullif(F.split_part(rel, F.lit("/"), F.lit(1)), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def candidate_count(total: Column, percent: Column) -> Column:
    """How many of ``total`` ranks a top percentage takes: at least one, at most all."""
    return F.least(total.cast("bigint"), F.greatest(F.lit(1), F.ceil(total.cast("double") * percent / 100)))


def fallback_rank(rank: Column, position: Column) -> Column:
    """A rank that parses as a positive integer, else the position."""
    r = rank.cast("string").try_cast("int")
    return F.coalesce(F.when(r > 0, r), position.cast("int"))


def expanded_queries(raw: Column, expected: int) -> Column:
    """The first ``expected`` english_queries of a model's JSON answer, fenced or not.

    Stripped, without blanks, one of each text whatever its case. Null if the
    answer doesn't parse or has too few.
    """
    fenced = F.regexp_extract(raw, r"(?s)```\s*(?:json)?\s*(\{.*?\})\s*```", 1)
    text = F.when(fenced.contains("english_queries"), fenced).otherwise(raw)
    got = F.transform(F.from_json(text, "english_queries array<string>")["english_queries"], stripped)
    got = F.filter(got, lambda x: x.isNotNull() & (x != ""))
    lower = F.transform(got, F.lower)
    first = F.filter(got, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.when(F.size(first) >= expected, F.slice(first, 1, expected))


def _class(points: list[int]) -> str:
    """A character class of code points from 0x80 on, as ranges; ASCII is ruled out by one comparison."""
    out: list[list[int]] = []
    for i in points:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return r"[\x{80}-\x{10ffff}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]]"


@lru_cache(2)
def _letters(end: int) -> tuple[str, str, dict[str, str], list[int]]:
    """What compatibility decomposition without combining marks makes of each character before ``end``, by rule from Unicode's own table.

    Characters that become one, and those characters; those that become several, by character; and the marks that go.
    Syllables of hangul, which fall into letters by arithmetic, and private planes stay.
    """
    src, dst, longer, marks = [], [], {}, []
    for i in range(0x80, end):
        c = chr(i)
        if 0xAC00 <= i < 0xF900:
            continue
        if unicodedata.combining(c):
            marks.append(i)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            src.append(c)
            dst.append(base)
        elif base != c:
            longer[c] = base
    return "".join(src), "".join(dst), longer, marks


@lru_cache(1)
def plain_letters() -> dict[str, str]:
    """What ``without_accents`` makes of each character that it changes."""
    src, dst, longer, marks = _letters(0x2FA20)
    return dict(zip(src, dst, strict=True)) | longer | dict.fromkeys(map(chr, marks), "")


def without_accents(text: Column) -> Column:
    """``text`` with each character in its compatibility decomposition, less combining marks: accents and ligatures go."""
    few_src, few_dst, few_longer, _ = _letters(0x300)
    src, dst, longer, marks = _letters(0x2FA20)
    one = F.regexp_replace(F.translate(text, src, dst), _class(marks), "")
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    several = _class(sorted(map(ord, longer)))
    # each different one that the text has is replaced throughout; there are few in a text
    found = F.array_distinct(F.regexp_extract_all(one, F.lit(several), F.lit(0)))
    every = F.when(one.rlike(several), F.aggregate(found, one, lambda done, c: F.replace(done, c, F.element_at(table, c)))).otherwise(one)
    # Latin text, which is most, needs the small table only
    return F.when(text.rlike(r"[^\x00-\x{2ff}]|" + _class(sorted(map(ord, few_longer)))), every).otherwise(F.translate(text, few_src, few_dst))


def grams(text: Column) -> Column:
    """Words of two characters or more, lower-cased and without accents, then each two in a row."""
    words = F.regexp_extract_all(without_accents(F.lower(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    n = F.size(words)
    two = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, two)
