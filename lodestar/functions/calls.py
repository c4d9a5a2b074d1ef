"""Calls of models from tasks: bounded, timed, tried again, and none lost."""

from __future__ import annotations

import asyncio
import inspect
import json
import re
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[str], str | None] | Callable[[str], Awaitable[str | None]]
REPLY = {"reply": "string", "status": "string", "attempts": "int", "error": "string"}


@dataclass(frozen=True)
class Limits:
    """``tasks`` times ``concurrency`` calls run at once at most; without ``tasks``, ``concurrency`` in each running task.

    A call has ``timeout`` seconds; before attempt n + 1 there is a pause of ``pause`` times
    two to the power of n seconds, n counting from 0.
    """

    concurrency: int = 10
    tasks: int | None = None
    attempts: int = 3
    timeout: float = 60.0
    pause: float = 1.0


async def _tried(prompt: str, once: Callable[[str], Awaitable[str | None]], good: Callable[[str], bool], gate: asyncio.Semaphore, limits: Limits) -> tuple:
    error = ""
    for n in range(limits.attempts):
        if n:
            await asyncio.sleep(limits.pause * 2 ** (n - 1))  # outside the gate: who waits keeps no other from calling
        async with gate:
            try:
                reply = await asyncio.wait_for(once(prompt), limits.timeout)
                if reply is not None and good(reply):
                    return reply, "done", n + 1, None
                error = "no reply" if reply is None else "bad reply"
            except TimeoutError:
                error = "timeout"
            except Exception as e:  # noqa: BLE001  whatever a provider raises is a failed attempt, and is told
                error = f"{type(e).__name__}: {e}"
    return None, "failed", limits.attempts, error


async def _all(prompts: list[str | None], model: Model, good: Callable[[str], bool], limits: Limits, pool: ThreadPoolExecutor) -> list[tuple]:
    gate, loop = asyncio.Semaphore(limits.concurrency), asyncio.get_running_loop()
    direct = inspect.iscoroutinefunction(model) or inspect.iscoroutinefunction(getattr(model, "__call__", None))

    async def once(prompt: str) -> str | None:
        return await (model(prompt) if direct else loop.run_in_executor(pool, model, prompt))

    async def nothing() -> tuple:
        return None, "failed", 0, "no prompt"

    return await asyncio.gather(*(nothing() if p is None else _tried(p, once, good, gate, limits) for p in prompts))


def called(rows: DataFrame, prompt: str, model: Model, limits: Limits = Limits(), good: Callable[[str], bool] = bool) -> DataFrame:
    """``rows`` with ``reply, status, attempts, error`` of ``model`` for the text in column ``prompt``.

    The model is a coroutine function, which is cancelled when its time is over, or a plain
    one, which runs in one of ``concurrency`` threads of its task and must end by itself: its
    thread counts as taken until then.  An exception, no reply, a reply that ``good`` refuses
    and a call out of time are failed attempts.  Rows whose last attempt failed have the status
    ``failed``, no reply and the last error: they are the queue for another run.  No row is
    lost; a null prompt fails without a call, equal rows are asked once each, and an empty
    table gives no rows.  Columns of ``rows`` that bear the names of the four are replaced.

    Calls are dear: write the result, or ``cut`` it, before using it twice.
    """
    given = rows.drop(*REPLY)
    if limits.tasks is not None:
        given = given.repartition(limits.tasks)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", " + ", ".join(f"{c} {t}" for c, t in REPLY.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(limits.concurrency)
        try:
            for batch in batches:
                prompts = [p if isinstance(p, str) else None for p in batch[prompt]]
                made = asyncio.run(_all(prompts, model, good, limits, pool))
                yield batch.assign(**{c: pd.Series([m[i] for m in made], index=batch.index, dtype="Int64" if c == "attempts" else object) for i, c in enumerate(REPLY)})
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return given.mapInPandas(run, schema)


def _json(reply: str) -> object:
    """The value of a reply, with or without Markdown fences; None where there is none."""
    inner = re.search(r"```(?:json)?\s*(.*?)\s*```", reply, re.DOTALL)
    try:
        return json.loads(inner[1] if inner else reply)
    except ValueError:
        return None


def is_object(reply: str) -> bool:
    return isinstance(_json(reply), dict)


def is_list_of_lists(reply: str) -> bool:
    value = _json(reply)
    return isinstance(value, list) and all(isinstance(x, list) for x in value)
