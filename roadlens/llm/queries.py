"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_list, factorization, pii, suffix_tree
from .align import alignment
from .bpe import round_trip
from .common import table
from .conversations import damaged, repairs
from .edit_counts import cleaning_edits, edited_counts
from .hnsw import nearest
from .minmax_dedup import near_duplicates
from .packing import best_fit, word_lengths
from .simhash_dedup import near_fingerprints
from .url_filter import ENTITIES, TRACKING, judge_urls

#: The rules of op1.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op1_url_alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_sharded_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op3_learned_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = decision_list.judged(docs, rules, ["doc_id"]).withColumn("base_failed", base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and one separator, packed into sequences of 512 to 8192."""
    return best_fit(word_lengths(table(spark, sf_dir, "documents")))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count before and after its cleaning edits."""
    return edited_counts(cleaning_edits(table(spark, sf_dir, "documents")))


def op7_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the base spans; spans and their number, n_spans, have those that the network adds too."""
    docs = table(spark, sf_dir, "documents")
    out = pii.detect(docs, pii.fit(docs), ["doc_id"])
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factorization.fit(docs, table(spark, sf_dir, "labels"), where=lambda c: ~factorization.held_out(c))
    out = factorization.score(docs, machine, ["doc_id"])
    return out.select("doc_id", factorization.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gain: by how much a token's log10 probability is above the base model's, on average."""
    docs = table(spark, sf_dir, "documents")
    train = ~suffix_tree.held_out()
    model = suffix_tree.fit(docs, train)
    out = suffix_tree.score(docs, model, train)
    return out.select("doc_id", suffix_tree.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by a byte-level and a piece vocabulary."""
    return alignment(table(spark, sf_dir, "documents"))


def op12_byte_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word sequences, seed 42, linked at two differing bits or fewer."""
    return near_fingerprints(table(spark, sf_dir, "documents"))


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its rows' crc32, and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    out = repairs(damaged(rows), rows.select(F.col("conv_id").alias("conv")), conv="conv")
    return out.withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_alias_filter": op1_url_alias_filter,
        "op2_sharded_hnsw": op2_sharded_hnsw,
        "op3_learned_decision_list": op3_learned_decision_list,
        "op4_minmax_near_dedup": op4_minmax_near_dedup,
        "op5_variable_best_fit": op5_variable_best_fit,
        "op6_edit_aware_counts": op6_edit_aware_counts,
        "op7_pii_bilstm_crf": op7_pii_bilstm_crf,
        "op8_factorisation_machine": op8_factorisation_machine,
        "op9_suffix_tree_scoring": op9_suffix_tree_scoring,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_token_alignment": op11_token_alignment,
        "op12_byte_index_simhash": op12_byte_index_simhash,
        "op13_grammar_repair": op13_grammar_repair,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Links of the same nodes both ways, and all that each node reaches.
_REACH = """sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, sides.v FROM reach JOIN sides ON sides.u = reach.b)"""


def _address(url: str) -> dict[str, str]:
    """SQL of the parts of a url, and of the address that names its aliases."""
    rest = f"regexp_extract({url}, '(?s)^.*?://(.*)$', 1)"
    host = _LOWER.format(f"regexp_extract({rest}, '(?s)^([^/?#]*)', 1)")
    path = f"regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1)"
    asked = rf"list_sort(list_filter(string_split(regexp_extract({rest}, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})=')))"
    short = rf"regexp_replace({path}, '(/index)?(\.html?)?/*$', '')"
    plain = f"regexp_replace({host}, '^(www|m)\\.', '')"
    as_is = rf"CASE WHEN {host} <> '' THEN {host} || {path} || regexp_extract({rest}, '(?s)^[^?#]*(\?[^#]*)', 1) END"
    key = f"CASE WHEN {host} <> '' THEN {plain} || {short} || CASE WHEN len({asked}) > 0 THEN '?' || array_to_string({asked}, '&') ELSE '' END END"
    return {"host": host, "path": path, "key": key, "address": as_is}


def _op1_sql() -> str:
    page, to = _address("url"), _address("target")
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in ordered) + " END"
    decoded = "regexp_extract(tag, '(?is)(?:href\\s*=\\s*|url\\s*=\\s*)[\"'']?([^\"''\\s>]+)', 1)"
    for entity, char in ENTITIES:
        decoded = f"replace({decoded}, '{entity}', '{char}')"
    walk = r"list_reduce(string_split(path, '/')[2:], lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END, '')"
    plain = _address("target")["path"]
    return rf"""WITH RECURSIVE parts AS (SELECT page_id, url, html, coalesce({page['host']}, '') AS host, coalesce({page['path']}, '') AS path, {page['key']} AS key, {page['address']} AS address FROM pages),
    judged AS (SELECT *, {verdict} AS own FROM (SELECT *, {rule} AS rule FROM parts)),
    tags AS (SELECT address AS u, url, host, path, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM parts),
    named AS (SELECT u, url, host, path, {decoded} AS t FROM tags
      WHERE regexp_matches(tag, '(?i)rel\s*=\s*(["''][^"''>]*\bcanonical\b|canonical)|http-equiv\s*=\s*["'']?refresh')),
    sites AS (SELECT *, regexp_extract(url, '(?s)^(.*?://)', 1) || host AS site FROM named WHERE t <> '' AND NOT starts_with(t, '#')),
    targets AS (SELECT u, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN site || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t
      WHEN starts_with(t, '?') THEN site || path || t ELSE site || regexp_replace(path, '(?s)[^/]*$', '') || CASE WHEN path = '' THEN '/' ELSE '' END || t END AS target FROM sites),
    pathed AS (SELECT u, target, {plain} AS path FROM targets WHERE contains(target, '://')),
    dotless AS (SELECT u, CASE WHEN regexp_matches(path, '(^|/)\.\.?(/|$)') THEN regexp_extract(target, '(?s)^(.*?://[^/?#]*)', 1) || {walk} || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END
      || regexp_extract(target, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) ELSE target END AS target FROM pathed),
    told AS (SELECT u, {to['address']} AS v, {to['key']} AS k, {to['host']} AS host, {to['path']} AS path FROM dotless),
    links AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM told UNION ALL SELECT v, k FROM told UNION ALL SELECT address, key FROM parts) WHERE u <> v),
    nodes AS (SELECT key AS node FROM parts WHERE key IS NOT NULL UNION SELECT u FROM links UNION SELECT v FROM links), {_REACH},
    alias AS (SELECT a AS key, min(b) AS alias FROM reach GROUP BY a),
    addressed AS (SELECT key, own FROM judged UNION ALL SELECT k, {verdict} FROM (SELECT k, {rule} AS rule FROM told)),
    ruled AS (SELECT alias, bool_or(own = 'allow') AS allowed FROM addressed JOIN alias USING (key) WHERE own IS NOT NULL GROUP BY alias)
    SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict, alias
    FROM judged LEFT JOIN alias USING (key) LEFT JOIN ruled USING (alias)"""


_OP4_SQL = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
    n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
    shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)),
    nodes AS (SELECT doc_id AS node FROM documents), {_REACH},
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express; tests/llm holds the others against brute force."""
    return {"op1_url_alias_filter": _op1_sql(), "op4_minmax_near_dedup": _OP4_SQL}
