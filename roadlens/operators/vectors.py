"""Exact inner-product search over embedding columns, and the embedding extension point."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import expansion_prompt
from ..functions.text import expanded_queries
from . import blocks
from .rank import top_k

def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(inner_product(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def embedding_search(corpus: DataFrame, queries: DataFrame, k: int | None, least: float | None = None, skip_self: bool = False) -> DataFrame:
    """Ranked frame of ``corpus`` (corpus_pos, image_id, image_path, embedding) for ``queries`` (query_id, vector), by ``blocks.nearest``.

    Where ``k`` is None the result is all of the corpus for each query, which are then
    met row by row. ``least`` drops lower scores before the cut; ``skip_self`` drops rows whose image_id is the query's id.
    """
    if k is not None:
        return blocks.nearest(corpus, queries, k, least, skip_self)
    score = inner_product(F.col("embedding"), F.col("vector"))
    scored = corpus.crossJoin(queries.select("query_id", "vector")).select("query_id", "corpus_pos", "image_id", "image_path", score.alias("score"))
    if skip_self:
        scored = scored.where(F.col("image_id") != F.col("query_id").cast("string"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return top_k(scored, k)


class Embedder(Protocol):
    """What a model must offer; one is loaded in each worker."""

    def process(self, inputs: list[dict], normalize: bool = True) -> list[list[float]]: ...


def embed(df: DataFrame, text: str, load: Callable[[], Embedder], instruction: str = "", batch: int = 16, out: str = "embedding") -> DataFrame:
    """``df`` with ``out``: the vectors that the embedder makes of ``text``, ``batch`` texts at a time. Null texts are empty ones."""
    size = max(1, batch)

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for part in parts:
            rows = []
            for i in range(0, len(part), size):  # of an Arrow batch, which is held as it came, only these texts are made strings
                texts = [t or "" for t in part.slice(i, size).to_pylist()]
                got = model.process([{"text": t, "instruction": instruction} for t in texts], normalize=True)
                if len(got) != len(texts) or any(not hasattr(v, "__len__") for v in got):
                    raise ValueError("an embedder must return one vector for each text")
                rows.append(pa.array([[float(x) for x in v] for v in got], pa.list_(pa.float32())))
            yield pa.concat_arrays(rows) if rows else pa.array([], pa.list_(pa.float32()))

    return df.withColumn(out, run(F.col(text)))


def load_embedder(script: str, model: str, dtype: str = "bfloat16", cls: str = "Qwen3VLEmbedder") -> Callable[[], Embedder]:
    """A loader for ``embed`` that imports class ``cls`` from a Python file on the worker."""

    def load():
        import importlib.util

        spec = importlib.util.spec_from_file_location("roadlens_embedder", script)
        if spec is None or spec.loader is None:
            raise RuntimeError(f"no embedder in {script}")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return getattr(module, cls)(model_name_or_path=model, torch_dtype=dtype if dtype in ("bfloat16", "float16", "float32") else "bfloat16")

    return load


class HashEmbedder:
    """A deterministic embedder without a model: signs at places that words' md5 gives, summed, of length one.

    Words are runs without ASCII white space, A-Z lower-cased.
    """

    def __init__(self, dim: int = 16):
        self.dim = dim

    def process(self, inputs: list[dict], normalize: bool = True) -> list[list[float]]:
        import hashlib
        import re

        lower, out = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), []
        for x in inputs:
            v = [0.0] * self.dim
            for w in re.findall(r"[^\x20\x09-\x0D]+", (x["instruction"] + " " + x["text"]).translate(lower)):
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                v[h % self.dim] += 1 if h & 1024 else -1
            n = sum(a * a for a in v) ** 0.5
            out.append([a / n for a in v] if normalize and n else v)
        return out


def expand(queries: DataFrame, load: Callable[[], Callable[[str], str]], total: int = 4) -> DataFrame:
    """``queries`` with ``expanded``: the phrasings that a model's answer to ``expansion_prompt`` names, ``total`` of them.

    ``load`` runs on each worker and gives a function from prompt to answer. A blank
    query, or an answer without enough phrasings, is an error in the job.
    """
    if total < 2:
        raise ValueError("total must be at least 2")

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = load()
        for part in parts:
            if part.isna().any() or not part.str.strip().all():
                raise ValueError("the query must not be blank")
            yield part.map(lambda q: answer(expansion_prompt(q, total)))

    # the answer is a frame of its own, so that the model runs once a query
    asked = queries.withColumn("__answer", run(F.col("display_query")))
    got = expanded_queries(F.col("__answer"), total)
    return asked.withColumn("expanded", F.coalesce(got, F.raise_error(F.lit("the answer has too few queries")).cast("array<string>"))).drop("__answer")


def caption(df: DataFrame, load: Callable[[], Callable[[str, str], str]], path: str = "image_path", prompt: str = "Describe the scene.") -> DataFrame:
    """image_path, success, caption, error and seconds of each row; an error stays with its row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        infer = load()
        for part in parts:
            rows = []
            for p in part["image_path"]:
                began = time.perf_counter()
                try:
                    rows.append((p, True, infer(p, prompt), None, time.perf_counter() - began))
                except Exception as e:  # noqa: BLE001  a model may raise anything
                    rows.append((p, False, None, f"{type(e).__name__}: {e}", time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["image_path", "success", "caption", "error", "seconds"])

    return df.select(F.col(path).alias("image_path")).mapInPandas(run, "image_path string, success boolean, caption string, error string, seconds double")
