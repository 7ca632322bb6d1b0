"""Prompts for the models behind the extension points."""

from __future__ import annotations

from collections.abc import Sequence

#: What a captioning model is told about its task.
SYSTEM = "You describe road scenes. Name vehicles, lanes, lights, weather and time of day that can be seen, and nothing that cannot."


def caption_messages(image: object, question: str, system: str = SYSTEM, examples: Sequence[dict] = ()) -> list[dict]:
    """A chat for one image: the task, worked examples, then the image with the question."""
    asked = {"role": "user", "content": [{"type": "image", "image": image}, {"type": "text", "text": question}]}
    return [{"role": "system", "content": system}, *examples, asked]


def expansion_prompt(query: str, total: int) -> str:
    """Asks for ``query`` in English and ``total`` - 1 phrasings close to it, as the JSON that ``expanded_queries`` reads."""
    return (
        f"Translate this road scene query into one short English phrase, then give {total - 1} English phrases for scenes close to it.\n"
        f"Query: {query.strip()}\n"
        f'Answer only with JSON: {{"english_queries": [{total} strings, the translation first]}}'
    )
