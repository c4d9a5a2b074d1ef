"""Models that are called from tasks and fail at times: stand-ins that answer by rule, after failures that the text decides."""

from __future__ import annotations

import asyncio
import json
import re
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calls import Limits
from ..functions.text import chunks
from ..operators import evaluate, generate, graph
from ..storage import table
from . import query
from .answers import PREDICTED, predicted
from .texts import CHUNKS

#: A text of n characters makes the first n % 4 calls fail; there are three.
LIMITS = Limits(concurrency=8, attempts=3, pause=0.001)
NAMES = re.compile("[A-Z][a-z]{3,}")


class Faulty:
    """Fails by exception, by a broken reply and by none in turn, then answers."""

    def __init__(self, field: str, answer) -> None:  # noqa: ANN001
        self.field, self.answer = field, answer

    @cached_property
    def calls(self) -> WeakKeyDictionary:
        return WeakKeyDictionary()

    async def __call__(self, prompt: str) -> str | None:
        text = json.loads(prompt)[-1]["content"].split(f"\n{self.field}: ", 1)[1]
        row = asyncio.current_task()  # all attempts of a row are one task's; rows may have equal prompts
        n = self.calls[row] = self.calls.get(row, 0) + 1
        if n > len(text) % 4:
            return json.dumps(self.answer(text))
        if n == 1:
            raise ConnectionError("refused")
        return "[broken" if n == 2 else None


def _next_to(text: str) -> list[list[str]]:
    names = NAMES.findall(text)
    return [[a, "next_to", b] for a, b in zip(names, names[1:], strict=False)]


def _about(text: str) -> dict[str, object]:
    names = NAMES.findall(text)
    return {"question": f"Who is {names[0]}?", "answer": names[-1]} if names else {"discard": True}


def _label(answer: str) -> dict[str, str]:
    return {"label": "correct" if len(answer) % 2 else "Incorrect", "reason": "by length"}


@query(
    f"""WITH {CHUNKS}, n AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks), p AS (SELECT doc_id, chunk_idx, n, unnest(range(1, len(n))) AS i FROM n WHERE length(text) % 4 < 3)
SELECT doc_id, chunk_idx, (i - 1)::INTEGER AS pos, n[i] AS subject, 'next_to' AS relation, n[i + 1] AS object, 'done' AS status, NULL AS error FROM p
UNION ALL SELECT doc_id, chunk_idx, NULL, NULL, NULL, NULL, 'failed', 'no reply' FROM n WHERE length(text) % 4 = 3"""
)
def triplets_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all chunks; those whose three calls failed stay as a queue."""
    return graph.extractor(Faulty("Text", _next_to), LIMITS)(chunks(table(spark, sf_dir, "documents"))).drop("source_text")


@query(
    f"""WITH {CHUNKS}, n AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks WHERE length(text) % 4 < 3)
SELECT doc_id, chunk_idx, 'Who is ' || n[1] || '?' AS question, n[-1] AS answer FROM n WHERE len(n) > 0"""
)
def questions_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each chunk; chunks whose calls failed, and those without a name, have none."""
    return generate.asker(Faulty("Document", _about), LIMITS)(chunks(table(spark, sf_dir, "documents"))).drop("text")


@query(
    f"""WITH {PREDICTED} SELECT qid, CASE WHEN lower(prediction) LIKE '%cannot answer%' OR length(prediction) % 4 IN (0, 2, 3) THEN CASE WHEN lower(prediction) LIKE '%cannot answer%' OR length(prediction) % 4 = 3 THEN 'incomplete' ELSE 'incorrect' END ELSE 'correct' END AS llm_label,
CASE WHEN lower(prediction) NOT LIKE '%cannot answer%' AND length(prediction) % 4 = 3 THEN 'failed' ELSE 'done' END AS status, CASE WHEN lower(prediction) LIKE '%cannot answer%' THEN 0 ELSE least(length(prediction) % 4 + 1, 3) END::INTEGER AS attempts FROM predicted"""
)
def labels_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals are not asked about; a label that no call could give is incomplete."""
    return evaluate.model_judged(predicted(spark, sf_dir), Faulty("Answer", _label), LIMITS)
