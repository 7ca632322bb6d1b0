"""Search back ends behind one protocol, and the retrieval flows built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import fixed_gate, positive_int
from ..functions.text import has_cjk, lexical_text
from ..operators import compare, dedup, evaluate, fusion, lexical, vectors
from ..operators.rank import RANKED
from ..sources.captions import require
from ..storage import checkpoint


class Backend(Protocol):
    """All queries (query_id, search_query, ...) to a ranked frame of at most k rows each, or of the whole corpus for None.

    One with ``merges`` takes rows with query_pos as phrasings of their query, merged over the whole corpus.
    """

    def search(self, queries: DataFrame, k: int | None) -> DataFrame: ...


def _cut_at(k: int | None) -> int | None:
    return None if k is None else positive_int("k", k)


@dataclass
class Bm25:
    index: lexical.Postings
    merges = True

    def search(self, queries: DataFrame, k: int | None) -> DataFrame:
        return lexical.bm25_search(self.index, queries, _cut_at(k))


@dataclass
class TfIdf:
    index: lexical.Postings
    merges = True

    def search(self, queries: DataFrame, k: int | None) -> DataFrame:
        return lexical.tfidf_search(self.index, queries, _cut_at(k))


@dataclass
class Embeddings:
    """``encode`` adds a column vector to queries; the corpus has embedding."""

    corpus: DataFrame
    encode: Callable[[DataFrame], DataFrame]
    least: float | None = None
    merges = True

    def search(self, queries: DataFrame, k: int | None) -> DataFrame:
        q = self.encode(queries).select("query_id", "vector", *[c for c in queries.columns if c == "query_pos"])
        return vectors.embedding_search(self.corpus, q, _cut_at(k), self.least)


@dataclass
class Hybrid:
    semantic: Backend
    lexical: Backend
    rrf_k: int = fusion.RRF_K

    def search(self, queries: DataFrame, k: int | None) -> DataFrame:
        return fusion.rrf(checkpoint(self.semantic.search(queries, k)), checkpoint(self.lexical.search(queries, k)), k, self.rrf_k)


def with_embedder(corpus: DataFrame, load: Callable[[], vectors.Embedder], instruction: str = "", batch: int = 16) -> Embeddings:
    """Exact search with a model: captions and queries are encoded in batches on the workers."""
    def encode(q: DataFrame) -> DataFrame:
        return vectors.embed(q, "search_query", load, instruction, batch, "vector")

    return Embeddings(vectors.embed(corpus, "caption", load, instruction, batch), encode)


#: Back ends by name; each takes a corpus and, where it embeds, a loader.
REGISTRY: dict[str, Callable[..., Backend]] = {
    "bm25": lambda corpus, load=None: Bm25(lexical.bm25_index(corpus)),
    "tfidf_faiss": lambda corpus, load=None: TfIdf(lexical.tfidf_index(corpus)),
    "qwen3vl_embedding_faiss": lambda corpus, load: with_embedder(corpus, load),
    "hybrid_embedding_bm25": lambda corpus, load: Hybrid(with_embedder(corpus, load), Bm25(lexical.bm25_index(corpus))),
}


def backend(name: str, corpus: DataFrame, load: Callable[[], vectors.Embedder] | None = None) -> Backend:
    if name not in REGISTRY:
        raise ValueError(f"unknown backend {name}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name](corpus, load)


def retrieve(b: Backend, queries: DataFrame, k: int, expanded: bool = False, depth: int | None = None) -> DataFrame:
    """Ranked frame of ``queries``; blank ones fail in the job.

    With ``expanded``, queries have an array of phrasings. A path's score is its greatest over all of
    them; equal ones come in the first phrasing's order. Of rows that share a path the best one counts. Back ends that merge need no rankings
    for that. With ``depth``, or a back end that doesn't, each phrasing gives its ``depth`` best rows, and these rankings are
    merged. Without ``expanded``, search texts with CJK characters fail, since captions are English.
    """
    positive_int("k", k)
    q = require(queries, F.length(F.trim("search_query")) > 0, "the query must not be blank")
    if not expanded:
        return b.search(require(q, ~has_cjk(F.col("search_query")), "expand queries that are not English"), k)
    each = q.select("query_id", F.posexplode("expanded").alias("query_pos", "search_query")).where(F.length(F.trim("search_query")) > 0)
    if depth is None and getattr(b, "merges", False):
        return b.search(each, k)
    if depth is None:
        raise ValueError("this back end merges rankings of a given depth")
    each = each.select(F.struct("query_id", "query_pos").alias("query_id"), "search_query")
    found = b.search(each, depth).withColumn("query_pos", F.col("query_id.query_pos")).withColumn("query_id", F.col("query_id.query_id"))
    return fusion.max_merge(found, k)


def lexical_view(corpus: DataFrame) -> DataFrame:
    """The corpus with captions as the lexical view has them, source_caption beside."""
    return corpus.withColumn("source_caption", F.col("caption")).withColumn("caption", lexical_text(F.coalesce("caption", F.lit("")))).withColumn("source_result_file", F.lit("bm25_lexical_view"))


def strict_dedup_recall(corpus: DataFrame, truth: DataFrame, backends: dict[str, Callable[[DataFrame], Backend]], queries: DataFrame, top_ks: Sequence[int]) -> DataFrame:
    """Fixed top-k recall by content hash on the deduplicated corpus, of each back end.

    ``corpus`` has image_hash and label; ``truth`` is (query_id, label). A hash is
    ground truth if any of its copies has the label.
    """
    unique = dedup.deduplicated(corpus)
    by_label = unique.select("image_hash", F.explode("labels").alias("label"))
    gt = truth.join(by_label, "label").select("query_id", F.col("image_hash").alias("gt_key")).distinct()
    parts = []
    for name, make in backends.items():
        ranked = make(unique).search(evaluate.require_truth(queries, gt), max(top_ks))
        parts.append(evaluate.topk_recall(ranked, gt, top_ks).withColumn("backend", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _strict(frozen: DataFrame, queries: DataFrame, asked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both, failing in the job where a query has no frozen row or a frozen row no query.

    ``asked`` (query_id) names the queries of the frozen report, where some of its lists are empty.
    """
    have = (frozen if asked is None else asked).select("query_id").distinct()
    return dedup.lookup(frozen, queries.select("query_id").distinct(), "query_id", "query of a frozen ranking"), dedup.lookup(queries, have, "query_id", "frozen ranking of query")


def frozen_hybrid(frozen: DataFrame, view: lexical.Postings, queries: DataFrame, top_k: int = 20, freeze_top_n: int = 5, lexical_top_n: int = 10, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The frozen ranking with its tail reranked by BM25 over the lexical view, and the manifest against the frozen one. Queries and frozen rows must match (``_strict``)."""
    frozen, queries = _strict(frozen, queries, asked)
    frozen, lex = checkpoint(frozen), lexical.bm25_search(view, queries, max(top_k, lexical_top_n))
    hybrid = checkpoint(fusion.tail_rerank(frozen.select(*RANKED), lex, freeze_top_n, top_k, lexical_top_n))
    return hybrid, compare.comparison_manifest(queries, frozen.where(F.col("rank") <= top_k), hybrid)


def frozen_gate(frozen: DataFrame, view: lexical.Postings, queries: DataFrame, candidate_top_k: int = 20, semantic_top_n: int = 10, lexical_top_n: int = 8, output_max_k: int = 10, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The frozen ranking's top that BM25 over the lexical view supports, and its manifest. Queries and frozen rows must match (``_strict``)."""
    fixed_gate(candidate_top_k, semantic_top_n, lexical_top_n, output_max_k)
    frozen, queries = _strict(frozen, queries, asked)
    frozen, lex = checkpoint(frozen), checkpoint(lexical.bm25_search(view, queries, lexical_top_n))
    kept = fusion.rank_gate(frozen.select(*RANKED), lex, candidate_top_k, semantic_top_n, lexical_top_n, output_max_k)
    return kept, compare.filter_manifest(queries, frozen, lex, kept, candidate_top_k, semantic_top_n, lexical_top_n)
