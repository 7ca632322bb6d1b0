"""Query files: a JSON document whose list ``queries`` mixes texts, objects and other scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from .captions import require

#: The keys that may hold either side, in order of preference.
DISPLAY, SEARCH = ("query", "display_query", "zh_query"), ("english_query", "search_query", "en_query")
#: The modes of reading; which items that are neither text nor object count, and which keys.
MODES = {"search": (True, DISPLAY, SEARCH), "eval": (False, DISPLAY, SEARCH), "demo": (False, DISPLAY[:2], SEARCH[:2])}
#: The scenes that are searched for without a query.
DEFAULT_QUERIES = (
    "vehicle ahead under strong backlighting in low-light conditions",
    "oncoming vehicle approaching in the opposite lane",
    "rainy road scene with the brake lights of the vehicle ahead illuminated",
)


def parse_queries(documents: DataFrame, value: str = "value", mode: str = "search", id_col: str | None = None) -> DataFrame:
    """(query_id, display_query, search_query) of JSON documents in column ``value``.

    Each side takes the first of its keys that isn't blank, and fills the other. Items
    with both blank are dropped. Scalars that aren't text are taken as text in mode
    ``search`` and dropped otherwise. query_id is the item's place, from 0, or ``id_col``.
    """
    scalars, display, search = MODES[mode]
    doc = documents.select(*([F.col(id_col).alias("__id")] if id_col else []), F.try_parse_json(F.col(value)).alias("__v"))
    doc = require(doc, F.expr("schema_of_variant(try_variant_get(__v, '$.queries', 'variant')) like 'ARRAY%'"), "a query file must have a list named queries")
    # each item as a variant, with its place; one pass over mixed kinds
    doc = doc.withColumn("__q", F.expr("variant_get(__v, '$.queries', 'variant')"))
    items = doc.lateralJoin(doc.sparkSession.tvf.variant_explode(F.col("__q").outer())).withColumnRenamed("value", "item")
    kind = F.expr("schema_of_variant(item)")
    plain = F.when(kind == "STRING", F.expr("variant_get(item, '$', 'string')"))
    if scalars:
        plain = plain.when(~kind.like("OBJECT%") & ~kind.like("ARRAY%") & (kind != "VOID"), F.expr("variant_get(item, '$', 'string')"))
    field = lambda names: F.coalesce(*[F.nullif(stripped(F.when(kind.like("OBJECT%"), F.expr(f"try_variant_get(item, '$.{n}', 'string')"))), F.lit("")) for n in names])
    text = F.nullif(stripped(plain), F.lit(""))
    a, b = F.coalesce(text, field(display)), F.coalesce(text, field(search))
    out = items.select((F.col("__id") if id_col else F.col("pos").cast("bigint")).alias("query_id"), F.coalesce(a, b).alias("display_query"), F.coalesce(b, a).alias("search_query"))
    return out.where("display_query is not null")


def read_queries(spark: SparkSession, query: str | None = None, query_file: str | None = None, mode: str = "search") -> DataFrame:
    """Queries from one text or one file; neither gives the default scenes, both or an empty result is an error."""
    if query and query_file:
        raise ValueError("give a query or a query file, not both")
    if not query and not query_file:
        if mode != "search":
            raise ValueError("a query file is needed")
        rows = [(i, q, q) for i, q in enumerate(DEFAULT_QUERIES)]
        return spark.createDataFrame(rows, "query_id bigint, display_query string, search_query string")
    if query:
        if not query.strip():
            raise ValueError("the query must not be blank")
        return spark.createDataFrame([(0, query.strip(), query.strip())], "query_id bigint, display_query string, search_query string")
    out = parse_queries(spark.read.text(query_file, wholetext=True), mode=mode)
    if out.isEmpty():
        raise ValueError(f"no queries in {query_file}")
    return out
