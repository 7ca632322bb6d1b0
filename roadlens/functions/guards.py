"""Checks and parsers of parameters, on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import takewhile

BACKENDS = ("bm25", "qwen3vl_embedding_faiss")


def positive_int(name: str, value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, not {value!r}")
    return value


def int_list(raw: str | Iterable[int], name: str = "values") -> list[int]:
    """Positive integers, from a comma-separated text or an iterable; blanks are skipped."""
    parts = raw.split(",") if isinstance(raw, str) else raw
    out = [positive_int(name, int(p)) for p in parts if str(p).strip()]
    if not out:
        raise ValueError(f"{name} must not be empty")
    return out


def backend_list(raw: str, known: Sequence[str] = BACKENDS) -> list[str]:
    out = [p.strip() for p in raw.split(",") if p.strip()]
    if not out or any(p not in known for p in out):
        raise ValueError(f"backends must be some of {', '.join(known)}")
    return out


def gate_bounds(candidate_top_k: int, semantic_top_n: int, lexical_top_n: int, output_max_k: int) -> None:
    for k, v in (("candidate_top_k", candidate_top_k), ("semantic_top_n", semantic_top_n), ("lexical_top_n", lexical_top_n), ("output_max_k", output_max_k)):
        positive_int(k, v)
    if semantic_top_n > candidate_top_k:
        raise ValueError("semantic_top_n must not exceed candidate_top_k")


def fixed_gate(candidate_top_k: int, semantic_top_n: int, lexical_top_n: int, output_max_k: int, fixed: tuple[int, ...] = (20, 10, 8, 10)) -> None:
    """The rank-gate experiment has one setting only."""
    if (candidate_top_k, semantic_top_n, lexical_top_n, output_max_k) != fixed:
        raise ValueError(f"the rank gate is fixed to {fixed}")


def rerank_bounds(freeze_top_n: int, final_top_k: int, lexical_top_n: int) -> None:
    positive_int("final_top_k", final_top_k)
    positive_int("lexical_top_n", lexical_top_n)
    if isinstance(freeze_top_n, bool) or freeze_top_n < 0 or freeze_top_n > final_top_k:
        raise ValueError("freeze_top_n must be between 0 and final_top_k")


def query_text(query: str) -> str:
    if not query or not query.strip():
        raise ValueError("the query must not be blank")
    return query


def one_image(image_path: str | None, image_b64: str | None) -> None:
    if bool(image_path and image_path.strip()) == bool(image_b64 and image_b64.strip()):
        raise ValueError("give either an image path or base64 data")


def split_argv(argv: Sequence[str], mark: str = "--") -> tuple[list[str], list[str]]:
    """Arguments on either side of the first ``mark``; all are before it where there is none."""
    rest = iter(argv)
    before = list(takewhile(lambda a: a != mark, rest))
    return before, list(rest)


def without_flag(argv: Sequence[str], flag: str) -> list[str]:
    """Arguments less every ``flag``, written as two arguments or with an equals sign."""
    rest = iter(argv)
    # a flag on its own draws its value from the same iterator
    apart = (a for a in rest if a != flag or not [next(rest, None)])
    return [a for a in apart if a.partition("=")[:2] != (flag, "=")]
