"""The registered queries of the engine's own operators on the given tables, each with its SQL where SQL can express it.

The corpus is ``documents``: a caption's text, its source as label folder, doc_id as
place. Queries are all of ``benchmark``. The semantic side of a fusion is exact
search over ``embeddings``, with the vector of the query's id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compare, dedup, evaluate, fusion, lexical, sample, vectors
from ..sources import sinks
from ..sources.captions import as_corpus, read_captions
from ..sources.queries import parse_queries
from ..sources.sinks import placed, placed_parts, report
from ..storage import checkpoint, ensure_checkpoint_dir
from ..streaming import captioning, ingest
from . import retrieval

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return d.select(
        F.col("doc_id").alias("corpus_pos"), F.col("doc_id").cast("string").alias("image_id"), path.alias("image_path"), F.col("text").alias("caption"), F.col("source").alias("label"), tx.content_hash(F.col("text")).alias("image_hash")
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("display_query"), F.col("text").alias("search_query"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``embeddings`` as images."""
    i = F.col("vec_id").cast("string")
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("corpus_pos"), i.alias("image_id"), F.concat(F.lit("v/"), i, F.lit(".jpg")).alias("image_path"), "embedding", "label")


def own_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with the vector of its id."""
    e = _t(spark, sf_dir, "embeddings")
    return e.join(asked(spark, sf_dir).select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("vector"))


def semantic(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return checkpoint(vectors.embedding_search(images(spark, sf_dir), own_vectors(spark, sf_dir), k, skip_self=True))


def lexical_ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    c = corpus(spark, sf_dir)
    return checkpoint(lexical.bm25_search(lexical.bm25_index(c), asked(spark, sf_dir), k))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth by vector label: images with the label of the query's own vector, itself left out."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = asked(spark, sf_dir).select("query_id").join(e.withColumnRenamed("label", "l"), F.col("query_id") == F.col("vec_id")).select("query_id", "l")
    same = e.join(q, F.col("label") == F.col("l")).where("vec_id <> query_id")
    return same.select("query_id", F.concat(F.lit("v/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("gt_key"))


# SQL pieces

_CORPUS = "corpus AS (SELECT doc_id AS corpus_pos, CAST(doc_id AS VARCHAR) AS image_id, source || '/' || doc_id || '.jpg' AS image_path, text AS caption, source AS label, sha256(text) AS image_hash FROM documents)"
_TOKEN = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]+"


def _bm25(k: int | None, src: str = "SELECT corpus_pos, caption FROM corpus", token: str = _TOKEN, asked_sql: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""{_CORPUS},
    src AS ({src}),
    toks AS (SELECT corpus_pos, unnest(regexp_extract_all(lower(coalesce(caption, '')), '{token}')) AS term FROM src),
    tf AS (SELECT corpus_pos, term, count(*) AS tf FROM toks GROUP BY ALL),
    dl AS (SELECT corpus_pos, count(*) AS dl FROM toks GROUP BY ALL),
    size AS (SELECT (SELECT count(*) FROM src)::DOUBLE AS n, (SELECT count(*) FROM toks)::DOUBLE / (SELECT count(*) FROM src) AS avgdl),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, size GROUP BY term),
    terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS ({asked_sql}),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM asked) GROUP BY ALL),
    matched AS (SELECT query_id, corpus_pos, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
      FROM tf JOIN qt USING (term) JOIN terms USING (term) JOIN dl USING (corpus_pos), size GROUP BY ALL),
    lex AS (SELECT * FROM (SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(s, 0.0), 9) DESC, c.corpus_pos)::INT AS rank,
        c.image_id, c.image_path, coalesce(s, 0.0) AS score
      FROM (SELECT DISTINCT query_id FROM qt) q CROSS JOIN corpus c LEFT JOIN matched m ON m.query_id = q.query_id AND m.corpus_pos = c.corpus_pos){f" WHERE rank <= {k}" if k else ""})"""


def _sem(k: int | None) -> str:
    return f"""sem AS (SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS rank,
        CAST(e.vec_id AS VARCHAR) AS image_id, 'v/' || e.vec_id || '.jpg' AS image_path, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
      FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id JOIN embeddings e ON e.vec_id <> q.vec_id){f" WHERE rank <= {k}" if k else ""})"""


_TRUTH = "truth AS (SELECT q.vec_id AS query_id, 'v/' || e.vec_id || '.jpg' AS gt_key FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id)"
_SHOW = "SELECT query_id, rank, image_id, image_path, round(score, 6) AS score"


# sources, projections, functions


@query(
    f"WITH {_CORPUS} SELECT corpus_pos, regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1') AS image_id, image_path, sha256(trim(caption, ' \t\n\r')) AS caption_sha, 'documents' AS source_result_file FROM corpus WHERE trim(caption, ' \t\n\r') <> ''"
)
def load_captions(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("corpus_pos", "image_path", "caption", F.lit("true").alias("success"))
    out = as_corpus(rows, F.lit("documents"))
    return out.select("corpus_pos", "image_id", "image_path", F.sha2("caption", 256).alias("caption_sha"), "source_result_file")


@query("""SELECT count(*) AS total_images, count(*) FILTER (lang <> 'de') AS success_images, count(*) FILTER (lang = 'de') AS failed_images,
    nullif(round(avg(CASE WHEN lang <> 'de' THEN n_chars / 1000.0 END), 6), 0) AS average_inference_seconds FROM documents""")
def caption_batch_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select((F.col("lang") != "de").alias("success"), (F.col("n_chars") / 1000.0).alias("inference_seconds"))
    return evaluate.caption_summary(rows)


@query("""SELECT item_id * 10 + p AS query_id, CASE p WHEN 0 THEN trim(text, ' \t\n\r') WHEN 1 THEN 'q' || item_id ELSE 'e' || item_id END AS display_query,
    CASE p WHEN 0 THEN trim(text, ' \t\n\r') WHEN 1 THEN trim(text, ' \t\n\r') WHEN 2 THEN 'e' || item_id END AS search_query
    FROM benchmark, (VALUES (0), (1), (2)) v(p) UNION ALL SELECT item_id * 10 + 3, item_id::VARCHAR, item_id::VARCHAR FROM benchmark""")
def parse_queries_variant(spark, sf_dir):
    """One query file for each benchmark item: a text, two objects, a number, a blank and an object without keys."""
    text, i = F.to_json(F.struct(F.col("text").alias("x"))), F.col("item_id").cast("string")
    quoted = F.expr("substring(__x, 6, length(__x) - 6)")
    d = _t(spark, sf_dir, "benchmark").withColumn("__x", text).withColumn("__t", quoted)
    doc = F.concat(F.lit('{"queries": ['), F.col("__t"), F.lit(', {"display_query": "q'), i, F.lit('", "query": " ", "en_query": '), F.col("__t"), F.lit('}, {"search_query": "e'), i, F.lit('"}, '), i, F.lit(', "  ", {"other": 1}, null]}'))
    places = parse_queries(d.select("item_id", doc.alias("value")), id_col="item_id")
    order = F.when(F.col("display_query").startswith("q") & (F.col("display_query") != F.col("search_query")), 1)
    order = order.when(F.col("display_query") == F.concat(F.lit("e"), F.col("query_id").cast("string")), 2).when(F.col("display_query") == F.col("query_id").cast("string"), 3).otherwise(0)
    return places.select((F.col("query_id") * 10 + order).alias("query_id"), "display_query", "search_query")


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKEN}') AS t FROM documents)")
def tokenize_bm25(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _re2(pattern: str) -> str:
    return pattern.replace("一-鿿", r"\x{4e00}-\x{9fff}").replace("'", "''")


_NORMAL = "lower({})"
_NORMAL = f"regexp_replace({_NORMAL}, '{_re2(tx.TIMESTAMP)}', ' ', 'g')"
_NORMAL = f"regexp_replace({_NORMAL}, '{_re2(tx.CHANNEL)}', ' ', 'gi')"
_NORMAL = f"regexp_replace({_NORMAL}, '{_re2(tx.PLATE)}', ' ', 'gi')"
_NORMAL = f"regexp_replace({_NORMAL}, '(?m){_re2(tx.HEADING)}', ' ', 'gi')"
_NORMAL = f"trim(regexp_replace(replace({_NORMAL}, '*', ' '), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _view(column: str, frm: str, keep: str) -> str:
    """First uses of each token, in order, as one text."""
    every = _NORMAL.replace("{}", column, 1)
    toks = f"regexp_extract_all({every}, '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+')"
    return f"""SELECT {keep}, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS bm25_text FROM (SELECT {keep}, term, min(pos) AS pos FROM (
      SELECT {keep}, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT {keep}, {toks} AS t FROM {frm})) WHERE term NOT IN ({_STOP}) GROUP BY ALL) GROUP BY ALL"""


@query(f"SELECT doc_id, md5(coalesce(bm25_text, '')) AS view_md5, length(coalesce(bm25_text, '')) AS n_chars FROM (SELECT doc_id FROM documents) LEFT JOIN ({_view('text', 'documents', 'doc_id')}) v USING (doc_id)")
def lexical_view(spark, sf_dir):
    v = _t(spark, sf_dir, "documents").select("doc_id", tx.lexical_text(F.col("text")).alias("v"))
    return v.select("doc_id", F.md5("v").alias("view_md5"), F.char_length("v").cast("bigint").alias("n_chars"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') AS has_cjk FROM documents")
def has_cjk(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.has_cjk(F.col("text")).alias("has_cjk"))


@query(r"""SELECT page_id, CASE WHEN d = '' THEN 'empty_query' ELSE d END AS dir_name FROM (
    SELECT page_id, rtrim(regexp_replace(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '[/\\]', '_', 'g'), '[\r\n\t]+', '_', 'g'), '. ') AS d FROM pages)""")
def sanitize_dir(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.dir_name(F.col("url")).alias("dir_name"))


@query(r"""SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS file_name, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1') AS stem, nullif(split_part(url, '/', 1), '') AS label
    FROM (SELECT page_id, url, regexp_replace(url, '/+$', '') AS p FROM pages)""")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", tx.file_name(u).alias("file_name"), tx.stem(u).alias("stem"), tx.label_of(u).alias("label"))


# search


@query(f"WITH {_bm25(1)} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, sf_dir):
    return lexical.bm25_index(corpus(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_ONE = "then the was of that thin"


@query(f"WITH {_bm25(10, asked_sql=f'''SELECT 0 AS query_id, '{_ONE}' AS text''')} {_SHOW} FROM lex")
def bm25_topk(spark, sf_dir):
    q = spark.createDataFrame([(0, _ONE)], "query_id int, search_query string")
    return shown(lexical.bm25_search(lexical.bm25_index(corpus(spark, sf_dir)), q, 10))


@query(f"WITH {_bm25(20)} {_SHOW} FROM lex")
def bm25_batch_topk(spark, sf_dir):
    return shown(lexical_ranked(spark, sf_dir, 20))


@query(f"WITH {_bm25(10)} {_SHOW} FROM lex")
def stored_index_topk(spark, sf_dir):
    """An index written and read again, which answers from its blocks."""
    folder = _folder(spark, "index")
    lexical.bm25_index(corpus(spark, sf_dir)).write(folder)
    return shown(lexical.bm25_search(lexical.Postings.read(spark, folder), asked(spark, sf_dir), 10))


_VIEW = "SELECT c.corpus_pos, v.bm25_text AS caption FROM corpus c LEFT JOIN (" + _view("caption", "corpus", "corpus_pos") + ") v ON v.corpus_pos = c.corpus_pos"


@query(f"WITH {_bm25(10, src=_VIEW)} {_SHOW} FROM lex")
def bm25_lexical_view_topk(spark, sf_dir):
    return shown(lexical.bm25_search(lexical.bm25_view_index(corpus(spark, sf_dir)), asked(spark, sf_dir), 10))


@query(f"WITH {_sem(10)} {_SHOW} FROM sem")
def embedding_batch_topk(spark, sf_dir):
    return shown(semantic(spark, sf_dir, 10))


@query(f"""WITH c AS (SELECT label AS query_id, list(s ORDER BY i) AS v FROM (SELECT label, i, sum(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label),
    sem AS (SELECT * FROM (SELECT c.query_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(list_inner_product(v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS rank,
      CAST(e.vec_id AS VARCHAR) AS image_id, CAST(e.vec_id AS VARCHAR) AS image_path, list_inner_product(v, e.embedding::DOUBLE[]) AS score FROM c CROSS JOIN embeddings e) WHERE rank <= 10) {_SHOW} FROM sem""")
def embedding_topk(spark, sf_dir):
    """The ten vectors nearest to each label's sum of vectors."""
    e = _t(spark, sf_dir, "embeddings")
    sums = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.sum(F.col("col").cast("double")).alias("s"))
    q = sums.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("vector"))
    i = F.col("vec_id").cast("string")
    return shown(vectors.embedding_search(e.select(F.col("vec_id").alias("corpus_pos"), i.alias("image_id"), i.alias("image_path"), "embedding"), q, 10))


@query(f"WITH {_sem(None)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, image_id, image_path, round(score, 6) AS score FROM sem WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5")
def min_score_topk(spark, sf_dir):
    return shown(vectors.embedding_search(images(spark, sf_dir), own_vectors(spark, sf_dir), 5, least=0.2, skip_self=True))


_GRAMS = r"""SELECT {id}, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {id}, regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM {frm})"""


def _tfidf(k: int) -> str:
    return f"""WITH {_CORPUS}, tf AS (SELECT corpus_pos, term, count(*) AS tf FROM ({_GRAMS.format(id='corpus_pos', text='caption', frm='corpus')}) GROUP BY ALL),
    terms AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    w AS (SELECT corpus_pos, term, tf * idf AS w FROM tf JOIN terms USING (term)),
    dn AS (SELECT corpus_pos, sqrt(sum(w * w)) AS n FROM w GROUP BY ALL),
    q AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM ({_GRAMS.format(id='item_id AS query_id', text='text', frm='benchmark').replace('(SELECT item_id AS query_id, regexp', '(SELECT item_id, regexp')}) JOIN terms USING (term) GROUP BY ALL),
    qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM q GROUP BY ALL),
    matched AS (SELECT query_id, corpus_pos, sum(q.w * w.w / any_value) AS s FROM (SELECT q.query_id, w.corpus_pos, q.w, w.w AS ww, qn.n * dn.n AS any_value FROM q JOIN w USING (term) JOIN qn USING (query_id) JOIN dn USING (corpus_pos)) x(query_id, corpus_pos, w, ww, any_value), LATERAL (SELECT x.w AS w) q, LATERAL (SELECT x.ww AS w) w GROUP BY ALL),
    lex AS (SELECT * FROM (SELECT b.item_id AS query_id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s, 0.0), 9) DESC, c.corpus_pos)::INT AS rank, c.image_id, c.image_path, coalesce(s, 0.0) AS score
      FROM benchmark b CROSS JOIN corpus c LEFT JOIN matched m ON m.query_id = b.item_id AND m.corpus_pos = c.corpus_pos) WHERE rank <= {k}) {_SHOW} FROM lex"""


@query(_tfidf(10))
def tfidf_topk(spark, sf_dir):
    return shown(lexical.tfidf_search(lexical.tfidf_index(corpus(spark, sf_dir)), asked(spark, sf_dir), 10))


# fusion

_BOTH = f"{_bm25(20)}, {_sem(20)}"


@query(f"""WITH {_BOTH}, u AS (SELECT *, 0 AS branch FROM sem UNION ALL SELECT *, 1 FROM lex),
    f AS (SELECT query_id, image_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(branch * 1000 + rank) AS place, arg_min(image_path, branch * 1000 + rank) AS image_path FROM u GROUP BY ALL)
    SELECT query_id, rank, image_id, image_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place)::INT AS rank FROM f) WHERE rank <= 20""")
def rrf_hybrid(spark, sf_dir):
    return shown(fusion.rrf(semantic(spark, sf_dir, 20), lexical_ranked(spark, sf_dir, 20), 20))


@query(f"""WITH {_bm25(None, asked_sql="SELECT item_id * 10 + p AS query_id, CASE p WHEN 0 THEN text ELSE array_to_string(list_slice(string_split(text, ' '), p * 4 - 3, p * 4), ' ') END AS text FROM benchmark, (VALUES (0), (1), (2)) v(p)")},
    m AS (SELECT query_id // 10 AS query_id, image_path, max(score) AS score, arg_max(image_id, score) AS image_id, min((query_id % 10) * 1000000000 + rank) AS seen FROM lex GROUP BY 1, 2)
    SELECT query_id, rank, image_id, image_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen)::INT AS rank FROM m) WHERE rank <= 10""")
def multi_query_max(spark, sf_dir):
    """Three phrasings of each query: all of it, its first four words and its next four."""
    words = F.split("display_query", " ")
    phrasings = F.array(F.col("display_query"), F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, 5, 4), " "))
    b = retrieval.Bm25(lexical.bm25_index(corpus(spark, sf_dir)))
    return shown(retrieval.retrieve(b, asked(spark, sf_dir).withColumn("expanded", phrasings), 10, expanded=True))


_RERANK = """rr AS (SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank > 5, CASE WHEN s.rank <= 5 THEN s.rank END, CASE WHEN s.rank > 5 THEN l.rank END NULLS LAST, s.rank)::INT AS rank, s.image_id, s.image_path, s.score
    FROM sem s LEFT JOIN lex l ON l.query_id = s.query_id AND l.image_id = s.image_id AND l.rank <= 10)"""


@query(f"WITH {_BOTH}, {_RERANK} {_SHOW} FROM rr")
def tail_rerank(spark, sf_dir):
    return shown(fusion.tail_rerank(semantic(spark, sf_dir, 20), lexical_ranked(spark, sf_dir, 20)))


_GATED = """gated AS (SELECT * FROM (SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank)::INT AS rank, s.image_id, s.image_path, s.score FROM sem s
    WHERE s.rank <= 10 AND EXISTS (SELECT 1 FROM lex l WHERE l.query_id = s.query_id AND l.image_id = s.image_id AND l.rank <= 8)) WHERE rank <= 10)"""


@query(f"WITH {_BOTH}, {_GATED} {_SHOW} FROM gated")
def rank_gate(spark, sf_dir):
    return shown(fusion.rank_gate(semantic(spark, sf_dir, 20), lexical_ranked(spark, sf_dir, 20)))


# deduplication


@query(f"WITH {_CORPUS} SELECT image_hash, min(corpus_pos) AS corpus_pos, arg_min(image_path, corpus_pos) AS image_path, count(*)::INT AS duplicate_count FROM corpus GROUP BY ALL")
def content_dedup(spark, sf_dir):
    return dedup.deduplicated(corpus(spark, sf_dir)).select("image_hash", "corpus_pos", "image_path", "duplicate_count")


@query(f"WITH {_CORPUS} SELECT image_hash, string_agg(image_path, '|' ORDER BY corpus_pos) AS duplicate_paths, (SELECT string_agg(l, '|' ORDER BY l) FROM (SELECT DISTINCT unnest(list(c.label)) AS l)) AS labels FROM corpus c GROUP BY ALL")
def dedup_metadata(spark, sf_dir):
    d = dedup.deduplicated(corpus(spark, sf_dir), paths=True)
    return d.select("image_hash", F.array_join("duplicate_paths", "|").alias("duplicate_paths"), F.array_join("labels", "|").alias("labels"))


@query(f"WITH {_CORPUS} SELECT image_path, corpus_pos, image_hash FROM corpus")
def hash_lookup(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return dedup.hashes_of(c.select("image_path", "corpus_pos"), c)


# evaluation

_CUTS = "(VALUES (10), (20), (30), (50)) p(percent)"


@query(f"""WITH {_sem(None)}, {_TRUTH}, n AS (SELECT count(*) AS n FROM embeddings),
    c AS (SELECT percent, least(n, greatest(1, ceil(n * percent / 100.0)))::BIGINT AS candidate_count FROM n, {_CUTS})
    SELECT t.query_id, percent, candidate_count, count(*) AS gt_count, count(*) FILTER (rank <= candidate_count) AS recalled_gt_count,
      round(count(*) FILTER (rank <= candidate_count)::DOUBLE / count(*), 6) AS recall, md5(coalesce(string_agg(gt_key, '|' ORDER BY gt_key) FILTER (rank <= candidate_count), '')) AS recalled_md5
    FROM truth t LEFT JOIN sem s ON s.query_id = t.query_id AND s.image_path = t.gt_key, c GROUP BY ALL""")
def percentile_recall(spark, sf_dir):
    r = evaluate.percentile_recall(_truth_ranks(spark, sf_dir), _detoured(spark, sf_dir), (10, 20, 30, 50), _size(spark, sf_dir))
    return r.select("query_id", "percent", "candidate_count", "gt_count", "recalled_gt_count", "recall", F.md5(F.array_join("recalled", "|")).alias("recalled_md5"))


def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"))


def _detoured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground truth with paths that are only resolved those of the images."""
    return truth(spark, sf_dir).withColumn("gt_key", F.concat(F.lit("./v/../"), F.col("gt_key")))


def _truth_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the ground truth in the exact ranking, counted."""
    return evaluate.embedding_truth_ranks(images(spark, sf_dir), own_vectors(spark, sf_dir), _detoured(spark, sf_dir), skip_self=True)


@query(f"""WITH {_bm25(None, src="SELECT min(c.corpus_pos) AS corpus_pos, arg_min(c.caption, c.corpus_pos) AS caption FROM corpus c GROUP BY c.image_hash")},
    first AS (SELECT c.image_hash, min(c.corpus_pos) AS corpus_pos FROM corpus c GROUP BY c.image_hash),
    r AS (SELECT * FROM (SELECT l.query_id, f.image_hash, row_number() OVER (PARTITION BY l.query_id ORDER BY round(l.score, 9) DESC, f.corpus_pos) AS rank FROM lex l JOIN first f ON f.corpus_pos = l.image_id::BIGINT) WHERE rank <= 50),
    gt AS (SELECT DISTINCT b.item_id AS query_id, c.image_hash FROM benchmark b JOIN corpus c ON c.label = 'src' || (b.item_id % 20)),
    n AS (SELECT query_id, count(*) AS n FROM r GROUP BY ALL)
    SELECT g.query_id, top_k, least(top_k, any_value(n))::BIGINT AS candidate_count, count(*) AS gt_count, count(*) FILTER (rank <= top_k) AS recalled_gt_count, round(count(*) FILTER (rank <= top_k)::DOUBLE / count(*), 6) AS recall, 'bm25' AS backend
    FROM gt g JOIN n USING (query_id) LEFT JOIN r ON r.query_id = g.query_id AND r.image_hash = g.image_hash, (VALUES (10), (20), (50)) k(top_k) GROUP BY g.query_id, top_k""")
def topk_hash_recall(spark, sf_dir):
    """The deduplicated flow end to end; a query's ground truth is the source numbered as its id modulo 20."""
    q = asked(spark, sf_dir)
    label = q.select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("label"))
    r = retrieval.strict_dedup_recall(corpus(spark, sf_dir), label, {"bm25": lambda c: retrieval.Bm25(lexical.bm25_index(c))}, q, (10, 20, 50))
    return r.select("query_id", "top_k", "candidate_count", "gt_count", "recalled_gt_count", "recall", "backend")


@query(f"WITH {_sem(20)}, {_TRUTH} SELECT query_id, rank, image_id, image_id || '.jpg' AS image_filename, EXISTS (SELECT 1 FROM truth t WHERE t.query_id = s.query_id AND t.gt_key = s.image_path) AS is_gt FROM sem s")
def ranked_is_gt(spark, sf_dir):
    return evaluate.judged(semantic(spark, sf_dir, 20), truth(spark, sf_dir)).select("query_id", "rank", "image_id", "image_filename", "is_gt")


_JUDGED = f"{_sem(20)}, {_TRUTH}, j AS (SELECT s.*, EXISTS (SELECT 1 FROM truth t WHERE t.query_id = s.query_id AND t.gt_key = s.image_path) AS is_gt FROM sem s)"


@query(f"""WITH {_JUDGED} SELECT query_id, top_k, count(*) FILTER (is_gt) AS hits, round(count(*) FILTER (is_gt)::DOUBLE / count(*), 6) AS "precision",
    round(coalesce(1.0::DOUBLE / min(CASE WHEN is_gt THEN rank END), 0), 6) AS reciprocal_rank FROM j, (VALUES (5), (20)) k(top_k) WHERE rank <= top_k GROUP BY ALL""")
def precision_at_k(spark, sf_dir):
    return evaluate.precision_at(evaluate.judged(semantic(spark, sf_dir, 20), truth(spark, sf_dir)), (5, 20))


@query(f"""WITH {_sem(20)}, {_TRUTH}, r AS (SELECT t.query_id, top_k, count(*) FILTER (rank <= top_k) AS hits, round(count(*) FILTER (rank <= top_k)::DOUBLE / count(*), 6) AS recall
      FROM truth t LEFT JOIN sem s ON s.query_id = t.query_id AND s.image_path = t.gt_key, (VALUES (1), (5), (20)) k(top_k) GROUP BY ALL)
    SELECT top_k, count(*) AS query_count, count(*) FILTER (hits = 0) AS zero_recall_queries, round(avg(recall), 6) AS mean_recall FROM r GROUP BY ALL""")
def zero_recall_queries(spark, sf_dir):
    gt = truth(spark, sf_dir).withColumn("gt_key", tx.stem(F.col("gt_key")))
    return evaluate.zero_recall(evaluate.topk_recall(semantic(spark, sf_dir, 20), gt, (1, 5, 20)), "top_k")


@query(f"WITH {_bm25(10)} SELECT query_id, string_agg(image_path, '|' ORDER BY rank) AS paths, string_agg(image_id || '.jpg', '|' ORDER BY rank) AS filenames, string_agg(image_id, '|' ORDER BY rank) AS ids, count(*)::INT AS recall_count FROM lex GROUP BY ALL")
def recall_summary(spark, sf_dir):
    r = evaluate.recall_summary(lexical_ranked(spark, sf_dir, 10))
    join = lambda c, n: F.array_join(c, "|").alias(n)
    return r.select("query_id", join("recalled_image_paths", "paths"), join("recalled_image_filenames", "filenames"), join("recalled_image_ids", "ids"), "recall_count")


@query(f"WITH {_bm25(10)} SELECT b.text AS query, b.text || ' | ' || b.item_id AS expanded_english_queries, rank, image_id || '.jpg' AS image_filename, image_path, image_id, round(score, 6) AS score FROM lex JOIN benchmark b ON b.item_id = query_id")
def recall_csv_flat(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("expanded", F.array("display_query", F.col("query_id").cast("string")))
    return shown(evaluate.recall_rows(lexical_ranked(spark, sf_dir, 10), q))


@query(f"WITH {_bm25(20)} SELECT query_id, split_part(image_path, '/', 1) AS label, count(*) AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM lex GROUP BY ALL")
def score_range_by_source(spark, sf_dir):
    return evaluate.score_ranges(lexical_ranked(spark, sf_dir, 20), tx.label_of(F.col("image_path")))


# manifests, samples, sinks


def _joined(df: DataFrame) -> DataFrame:
    return df.select("query_id", *[F.array_join(c, "|").alias(c) if c.endswith("_ids") else F.col(c) for c in df.columns if c != "query_id"])


def _agg(name: str, frm: str, where: str = "true") -> str:
    return f"coalesce((SELECT string_agg(image_id, '|' ORDER BY rank) FROM {frm} x WHERE x.query_id = q.query_id AND {where}), '') AS {name}"


def _in(other: str, no: str = "") -> str:
    return f"{no} EXISTS (SELECT 1 FROM {other} y WHERE y.query_id = x.query_id AND y.image_id = x.image_id)"


@query(f"""WITH {_BOTH}, hyb AS (SELECT * FROM (SELECT query_id, image_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place)::INT AS rank FROM (
      SELECT query_id, image_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(branch * 1000 + rank) AS place FROM (SELECT *, 0 AS branch FROM sem UNION ALL SELECT *, 1 FROM lex) GROUP BY ALL)) WHERE rank <= 20),
    q AS (SELECT item_id AS query_id FROM benchmark)
    SELECT query_id, {_agg('embedding_image_ids', 'sem')}, {_agg('hybrid_image_ids', 'hyb')}, {_agg('intersection_image_ids', 'hyb', _in('sem'))},
      {_agg('only_embedding_image_ids', 'sem', _in('hyb', 'NOT'))}, {_agg('only_hybrid_image_ids', 'hyb', _in('sem', 'NOT'))} FROM q""")
def comparison_manifest(spark, sf_dir):
    sem = semantic(spark, sf_dir, 20)
    return _joined(compare.comparison_manifest(asked(spark, sf_dir), sem, fusion.rrf(sem, lexical_ranked(spark, sf_dir, 20), 20)))


@query(f"""WITH {_BOTH}, {_GATED}, q AS (SELECT item_id AS query_id FROM benchmark)
    SELECT query_id, {_agg('embedding_top20_image_ids', 'sem')}, {_agg('embedding_top10_image_ids', 'sem', 'x.rank <= 10')}, {_agg('bm25_top8_image_ids', 'lex', 'x.rank <= 8')},
      {_agg('final_filtered_image_ids', 'gated')}, {_agg('filtered_out_image_ids', 'sem', 'x.rank <= 10 AND ' + _in('gated', 'NOT'))},
      (SELECT count(*) FROM gated x WHERE x.query_id = q.query_id)::INT AS final_result_count FROM q""")
def filter_manifest(spark, sf_dir):
    sem, lex = semantic(spark, sf_dir, 20), lexical_ranked(spark, sf_dir, 20)
    return _joined(compare.filter_manifest(asked(spark, sf_dir), sem, lex, fusion.rank_gate(sem, lex)))


@query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS sample_index, candidate_count FROM (
    SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS candidate_count FROM events) WHERE r <= 20""")
def stratified_sample(spark, sf_dir):
    return sample.stratified_sample(_t(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 20)


@query(f"""WITH {_bm25(5)}, d AS (SELECT item_id AS query_id, rtrim(regexp_replace(regexp_replace(trim(text, ' \t\n\r'), '[/\\\\]', '_', 'g'), '[\\r\\n\\t]+', '_', 'g'), '. ') AS query_dir FROM benchmark),
    l AS (SELECT query_dir, max(query_id) AS query_id FROM d GROUP BY ALL)
    SELECT query_id, md5(query_dir) AS dir_md5, rank, image_path AS source_path, 'hybrid/' || lpad(rank::VARCHAR, 2, '0') || '_' || image_id || '.jpg' AS target FROM lex JOIN l USING (query_id)""")
def organized_manifest(spark, sf_dir):
    p = placed(lexical_ranked(spark, sf_dir, 5), asked(spark, sf_dir), "hybrid")
    return p.select("query_id", F.md5("query_dir").alias("dir_md5"), "rank", "source_path", F.substring("target", F.char_length("query_dir") + 2, F.char_length("target")).alias("target"))


@query(f"WITH {_bm25(10)} SELECT item_id AS query_id, text AS query, coalesce(string_agg(rank || ':' || image_id, ',' ORDER BY rank), '') AS items, count(rank)::INT AS recall_count FROM benchmark LEFT JOIN lex ON query_id = item_id GROUP BY ALL")
def report_rows(spark, sf_dir):
    r = report(lexical_ranked(spark, sf_dir, 10), asked(spark, sf_dir), {"backend": "bm25"})
    items = F.transform("items", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["image_id"]))
    return r.select("query_id", "query", F.array_join(items, ",").alias("items"), "recall_count")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """``df`` written as CSV and read again."""
    folder = _folder(df.sparkSession, name)
    kept = df.select(*columns)
    sinks.write_csv(kept, folder)
    return df.sparkSession.read.schema(kept.schema).option("header", True).csv(folder)


# the same tables as the recall queries, with the query's text (a hash of it) and back end
def _csv(recall_sql: str, columns: str) -> str:
    return f"SELECT md5(b.text) AS query_md5, {columns} FROM ({recall_sql}) r JOIN benchmark b ON b.item_id = r.query_id"


@query(_csv(SQL["percentile_recall"], "'exact' AS backend, percent, candidate_count, gt_count, recalled_gt_count, recall"))
def percentile_csv(spark, sf_dir):
    r = evaluate.percentile_recall(_truth_ranks(spark, sf_dir), _detoured(spark, sf_dir), (10, 20, 30, 50), _size(spark, sf_dir))
    back = _written(evaluate.recall_table(r, asked(spark, sf_dir), "exact").withColumn("query", F.md5("query")), "percentile", sinks.PERCENTILE_COLUMNS)
    return back.withColumnRenamed("query", "query_md5")


@query(_csv(SQL["topk_hash_recall"], "backend, top_k, (SELECT count(DISTINCT coalesce(sha256(text), '')) FROM documents) AS corpus_unique_count, gt_count, recalled_gt_count, recall"))
def topk_csv(spark, sf_dir):
    """All columns of the table but query_seconds, which no SQL can repeat."""
    unique = corpus(spark, sf_dir).select("image_hash").distinct()
    r = evaluate.topk_table(topk_hash_recall(spark, sf_dir), asked(spark, sf_dir), "bm25", unique).withColumn("query", F.md5("query"))
    return _written(r, "topk", sinks.TOPK_COLUMNS).drop("query_seconds").withColumnRenamed("query", "query_md5")


@query("SELECT doc_id::VARCHAR AS image_id, source || '/' || doc_id || '.jpg' AS image_path, md5(trim(text, ' \t\n\r')) AS caption_md5 FROM documents WHERE trim(text, ' \t\n\r') <> ''")
def caption_lines_scan(spark, sf_dir):
    """Caption rows appended in two runs as JSON lines, and read as a corpus."""
    folder = _folder(spark, "captions")
    rows = corpus(spark, sf_dir).select("image_path", F.lit(True).alias("success"), "caption", "corpus_pos")
    for part in (0, 1):
        sinks.append_captions(rows.where(F.col("corpus_pos") % 2 == part).drop("corpus_pos"), folder)
    return read_captions(spark, folder, lines=True).select("image_id", "image_path", F.md5("caption").alias("caption_md5"))


@query("""SELECT doc_id::VARCHAR AS image_id, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS corpus_pos, md5(trim(text, ' \t\n\r')) AS caption_md5
    FROM documents QUALIFY trim(text, ' \t\n\r') <> ''""")
def captions_split_scan(spark, sf_dir):
    """Sixteen JSON documents, each of which tasks share by bytes."""
    folder = _folder(spark, "documents")
    one = F.to_json(F.struct("image_path", F.lit(True).alias("success"), "caption"))
    rows = corpus(spark, sf_dir).select((F.col("corpus_pos") % 16).alias("g"), F.col("corpus_pos").alias("at"), F.concat(F.lit(", "), one).alias("value"))
    ends = spark.range(16).select(F.col("id").alias("g"), F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit('{"summary": {}, "results": [{"image_path": "none", "success": false}').alias("value")), F.struct(F.lit(2**62).alias("at"), F.lit("]}").alias("value")))).alias("x")).select("g", "x.*")
    rows.unionByName(ends).repartition("g").sortWithinPartitions("g", "at").select("g", "value").write.partitionBy("g").text(folder)
    return read_captions(spark, folder, split=True).select("image_id", "corpus_pos", F.md5("caption").alias("caption_md5"))


@query(SQL["caption_batch_summary"])
def observed_summary(spark, sf_dir):
    """The summary of caption rows, observed in the pass that writes them."""
    d = _t(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("image_path"), (F.col("lang") != "de").alias("success"), (F.col("n_chars") / 1000.0).alias("inference_seconds"), F.col("text").alias("caption"))
    told = sinks.write_captions(rows, _folder(spark, "observed"))
    return spark.createDataFrame([tuple(told.values())], "total_images bigint, success_images bigint, failed_images bigint, average_inference_seconds double")


@query(f"SELECT doc_id::VARCHAR AS image_id, md5(bm25_text) AS view_md5 FROM ({_view('text', 'documents', 'doc_id')}) WHERE bm25_text <> ''")
def lexical_view_file(spark, sf_dir):
    """The lexical view written as caption rows and read as a corpus."""
    folder = _folder(spark, "view")
    sinks.write_lexical_view(retrieval.lexical_view(corpus(spark, sf_dir)), folder)
    return read_captions(spark, folder, lines=True).select("image_id", F.md5("caption").alias("view_md5"))


_PLACED = """d AS (SELECT item_id AS query_id, rtrim(regexp_replace(regexp_replace(trim(text, ' \t\n\r'), '[/\\\\]', '_', 'g'), '[\\r\\n\\t]+', '_', 'g'), '. ') AS query_dir FROM benchmark),
    l AS (SELECT max(query_id) AS query_id FROM d GROUP BY query_dir)
    SELECT query_id, part, rank, image_path AS source_path, part || '/' || lpad(rank::VARCHAR, 2, '0') || '_' || image_id || '.jpg' AS target FROM parts JOIN l USING (query_id)"""


def _below_query(p: DataFrame) -> DataFrame:
    return p.select("query_id", "part", "rank", "source_path", F.substring("target", F.char_length("query_dir") + 2, F.char_length("target")).alias("target"))


@query(f"""WITH {_BOTH}, {_RERANK}, parts AS (SELECT 'embedding' AS part, query_id, rank, image_id, image_path FROM sem UNION ALL SELECT 'hybrid', query_id, rank, image_id, image_path FROM rr
    UNION ALL SELECT 'only_embedding', query_id, rank, image_id, image_path FROM sem x WHERE {_in('rr', 'NOT')} UNION ALL SELECT 'only_hybrid', query_id, rank, image_id, image_path FROM rr x WHERE {_in('sem', 'NOT')}), {_PLACED}""")
def comparison_folders(spark, sf_dir):
    sem = semantic(spark, sf_dir, 20)
    hybrid = checkpoint(fusion.tail_rerank(sem, lexical_ranked(spark, sf_dir, 20)))
    return _below_query(placed_parts(compare.comparison_parts(sem, hybrid), asked(spark, sf_dir)))


@query(f"""WITH {_BOTH}, {_GATED}, parts AS (SELECT 'embedding_top20' AS part, query_id, rank, image_id, image_path FROM sem UNION ALL SELECT 'embedding_top10', query_id, rank, image_id, image_path FROM sem WHERE rank <= 10
    UNION ALL SELECT 'bm25_top8_candidates', query_id, rank, image_id, image_path FROM lex WHERE rank <= 8 UNION ALL SELECT 'final_filtered', query_id, rank, image_id, image_path FROM gated
    UNION ALL SELECT 'filtered_out_from_embedding_top10', query_id, rank, image_id, image_path FROM sem x WHERE rank <= 10 AND {_in('gated', 'NOT')}), {_PLACED}""")
def filter_folders(spark, sf_dir):
    sem, lex = semantic(spark, sf_dir, 20), lexical_ranked(spark, sf_dir, 20)
    return _below_query(placed_parts(compare.filter_parts(sem, lex, checkpoint(fusion.rank_gate(sem, lex))), asked(spark, sf_dir)))


@query(f"""WITH {_bm25(5)}, hit AS (SELECT DISTINCT l.query_id, t.term FROM lex l JOIN tf t ON t.corpus_pos = l.image_id::BIGINT WHERE l.rank <= 5)
    SELECT q.query_id, count(*) AS keywords, count(h.term) AS covered, round(count(h.term)::DOUBLE / count(*), 6) AS coverage FROM qt q LEFT JOIN hit h ON h.query_id = q.query_id AND h.term = q.term GROUP BY ALL""")
def keyword_coverage(spark, sf_dir):
    return evaluate.keyword_coverage(lexical_ranked(spark, sf_dir, 5), asked(spark, sf_dir), corpus(spark, sf_dir), 5)


@query("""SELECT issue, count(*) AS candidate_count, least(count(*), 20) AS sampled_count, 'ok' AS status FROM (SELECT event_type AS issue FROM events) GROUP BY ALL""")
def sample_manifest(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("issue"), F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("image_path"))
    issues = rows.select("issue").distinct().withColumns({"frames_dir": F.concat("issue", F.lit("/frames")), "has_frames": F.lit(True)})
    return sinks.sample_manifest(issues, sample.stratified_sample(rows, "issue", "image_path", 20)).select("issue", "candidate_count", "sampled_count", "status")


# an earlier report's ranking of the same documents, with lexical support from the view

_FROZEN = f"{_bm25(20, src=_VIEW)}, sem AS (SELECT * FROM ({_tfidf(20)}))"


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TF-IDF ranking of the documents, written as a report and read again."""
    folder, q = _folder(spark, "report"), asked(spark, sf_dir)
    ranked = lexical.tfidf_search(lexical.tfidf_index(corpus(spark, sf_dir)), q, 20)
    sinks.write_json(report(ranked, q, {"backend": "tfidf"}), folder)
    back = spark.read.schema("query_id bigint, items array<struct<rank:int,image_id:string,image_path:string,score:double>>").json(folder)
    return back.select("query_id", F.inline("items"))


@query(f"WITH {_FROZEN}, {_RERANK} {_SHOW} FROM rr")
def frozen_hybrid(spark, sf_dir):
    """The frozen ranking's first five, then the rest by the view's support."""
    view = lexical.bm25_view_index(corpus(spark, sf_dir))
    return shown(retrieval.frozen_hybrid(_frozen(spark, sf_dir), view, asked(spark, sf_dir))[0])


@query(f"WITH {_FROZEN}, {_GATED} {_SHOW} FROM gated")
def frozen_gate(spark, sf_dir):
    """The frozen ranking's first ten that are among the view's first eight."""
    view = lexical.bm25_view_index(corpus(spark, sf_dir))
    return shown(retrieval.frozen_gate(_frozen(spark, sf_dir), view, asked(spark, sf_dir))[0])


# model extension points, with models that need no weights


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM documents),
    h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w),
    s AS (SELECT doc_id, h % 16 AS p, sum(CASE WHEN (h >> 10) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL),
    n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY ALL)
    SELECT d.doc_id, string_agg((round(coalesce(v / nullif(n, 0), 0)::FLOAT::DOUBLE * 1000000)::BIGINT)::VARCHAR, ',' ORDER BY i) AS millionths
    FROM (SELECT doc_id, unnest(range(16)) AS i FROM documents) d LEFT JOIN s ON s.doc_id = d.doc_id AND s.p = d.i LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL""")
def embed_udf_fake(spark, sf_dir):
    v = vectors.embed(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", vectors.HashEmbedder)
    return v.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string")), ",").alias("millionths"))


@query("SELECT item_id AS query_id, md5(concat_ws('|', text, 'like ' || text, 'near ' || text, 'not ' || text)) AS expanded_md5 FROM benchmark")
def expand_udf_fake(spark, sf_dir):
    def load():
        import json

        def answer(prompt: str) -> str:
            q = prompt.split("Query: ", 1)[1].rsplit("\nAnswer only", 1)[0]
            return json.dumps({"english_queries": [q, f"like {q}", f"near {q}", f"not {q}"]})

        return answer

    return vectors.expand(asked(spark, sf_dir), load).select("query_id", F.md5(F.array_join("expanded", "|")).alias("expanded_md5"))


@query("""SELECT image_path, NOT bad AS success, CASE WHEN NOT bad THEN 'Describe the scene. ' || image_path END AS caption, CASE WHEN bad THEN 'ValueError: unreadable' END AS error
    FROM (SELECT source || '/' || doc_id || '.jpg' AS image_path, source = 'src1' AS bad FROM documents)""")
def caption_udf_fake(spark, sf_dir):
    return vectors.caption(corpus(spark, sf_dir), _captioner).select("image_path", "success", "caption", "error")


def _captioner():
    def infer(path: str, prompt: str) -> str:
        if path.startswith("src1/"):
            raise ValueError("unreadable")
        return f"{prompt} {path}"

    return infer


# streams, over files written from the tables

_ARRIVED = """arrived AS (SELECT doc_id, doc_id % 2 AS batch, source || '/' || doc_id || '.jpg' AS image_path, trim(text, ' \t\n\r') AS caption FROM documents WHERE trim(text, ' \t\n\r') <> ''),
    new AS (SELECT * FROM arrived QUALIFY row_number() OVER (PARTITION BY caption ORDER BY batch, image_path) = 1),
    live AS (SELECT row_number() OVER (ORDER BY batch, image_path) AS corpus_pos, image_path, caption FROM new)"""


@query(
    f"WITH {_bm25(10, src='SELECT corpus_pos, caption FROM live')}".replace(_CORPUS + ",", _ARRIVED + ", corpus AS (SELECT corpus_pos, regexp_extract(image_path, '([^/]*)[.]jpg$', 1) AS image_id, image_path FROM live),", 1)
    + " SELECT query_id, rank, image_id, image_path, round(score, 6) AS score FROM lex"
)
def live_index_topk(spark, sf_dir):
    """All documents arrive as caption lines in two batches, each content once; the index of both is searched."""
    folder = _folder(spark, "live")
    c = corpus(spark, sf_dir).select("image_path", F.lit(True).alias("success"), F.col("caption"), "corpus_pos")
    for part in (0, 1):
        sinks.append_captions(c.where(F.col("corpus_pos") % 2 == part).drop("corpus_pos"), f"{folder}/in")
        ingest.append_captions_to(f"{folder}/index", ingest.caption_stream(spark, f"{folder}/in", 1_000_000), f"{folder}/state").awaitTermination()
    return shown(lexical.bm25_search(ingest.live_index(spark, f"{folder}/index"), asked(spark, sf_dir), 10))


@query("""SELECT image_path, source <> 'src1' AS success, CASE WHEN source <> 'src1' THEN 'Describe the scene. ' || image_path END AS caption, CASE WHEN source = 'src1' THEN 'ValueError: unreadable' END AS error
    FROM (SELECT source || '/' || doc_id || '.jpg' AS image_path, source FROM documents)""")
def resumed_captions(spark, sf_dir):
    """Images are captioned by two runs of a stream that share their paths; the second has only what the first has not stored."""
    folder = _folder(spark, "captioned")
    c = corpus(spark, sf_dir).select("image_path", "corpus_pos")
    c.where(F.col("corpus_pos") % 2 == 0).select("image_path").write.mode("append").json(f"{folder}/in")
    for run in (0, 1):
        captioning.caption_stream_to(f"{folder}/out", captioning.path_stream(spark, f"{folder}/in", 1_000_000), _captioner, f"{folder}/state{run}").awaitTermination()
        if not run:
            c.select("image_path").write.mode("append").json(f"{folder}/in")
    return captioning.stored(spark, f"{folder}/out").select("image_path", "success", "caption", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
