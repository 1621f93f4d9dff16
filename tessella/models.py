"""Model hooks with deterministic offline stand-ins.

A hook maps a list of inputs to a list of outputs; operators call it in batches
on the executors. A coroutine function of one input is a hook too: a worker then keeps
a bounded number of its calls in flight, tries failed ones again and gives each a
time limit, and outputs stay in the order of the inputs. Real models are given by the user; the stand-ins make results
reproducible and claim no likeness to any model.
"""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import json
import re
from collections import Counter
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

Generate = Callable[[list[str]], list[str]] | Callable[[str], Awaitable[str]]
Embed = Callable[[list[str]], list[list[float] | None]] | Callable[[str], Awaitable[list[float] | None]]


@dataclass(frozen=True)
class Bounds:
    """Of a coroutine hook in one worker: calls in flight, tries of a call, seconds of a try and of the first pause between tries, which doubles."""

    in_flight: int = 4
    tries: int = 3
    seconds: float = 60.0
    pause: float = 0.5


def run_bounded(hook: Callable[[str], Awaitable[Any]], inputs: list[str], bounds: Bounds = Bounds()) -> list[tuple[Any, str | None]]:
    """(output, error) of each input, in order: an input whose last try fails or runs out of time has an error, and the others go on."""

    async def all_() -> list[tuple[Any, str | None]]:
        free = asyncio.Semaphore(bounds.in_flight)

        async def one(x: str) -> tuple[Any, str | None]:
            problem: BaseException | None = None
            for n in range(bounds.tries):
                if n:
                    await asyncio.sleep(bounds.pause * 2 ** (n - 1))  # another call may use the place meanwhile
                async with free:
                    try:
                        return await asyncio.wait_for(hook(x), bounds.seconds), None
                    except Exception as e:  # noqa: BLE001
                        problem = e
            return None, f"{type(problem).__name__}: {problem}"

        return await asyncio.gather(*map(one, inputs))

    return asyncio.run(all_())


@lru_cache(maxsize=1 << 16)
def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")


def hash_embedding(dims: int = 64) -> Embed:
    """U2. Signed hashes of the words, scaled to unit length."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w, n in Counter(re.findall(r"\w+", t.lower())).items():
                h = _word_hash(w)
                v[h % dims] += n if h >> 63 else -n
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else None)
        return out

    return embed


def extractive_generator(prompts: list[str]) -> list[str]:
    """U1. The first sentence of the prompt's context."""
    return [re.split(r"(?<=[.!?])\s", p.rpartition("TEXT:\n")[2].strip(), maxsplit=1)[0] for p in prompts]


def pattern_fact_extractor(prompts: list[str]) -> list[str]:
    """G14. Facts of the form "<key> was <number>", as an extractor's JSON."""
    out = []
    for p in prompts:
        facts = [
            {"entity": "", "key": m[1].lower(), "value": m[2], "unit": "", "year": 0, "evidence_text": m[0]}
            for m in re.finditer(r"\b(revenue|profit|employees|assets|liabilities) (?:was|is|of) (\d[\d,.]*\d|\d)", p, re.IGNORECASE)
        ]
        out.append(json.dumps({"entity_hint": "unknown", "facts": facts}))
    return out


def identity_translator(texts: list[str]) -> list[str]:
    """U7."""
    return list(texts)


def _answers(hook: Generate, inputs: list[str], bounds: Bounds = Bounds()) -> list[tuple[str | None, str | None]]:
    """(output, error) of each input; where a batch fails its inputs are tried one by one."""
    if inspect.iscoroutinefunction(hook):
        return run_bounded(hook, inputs, bounds)
    try:
        out = list(hook(inputs))
        if len(out) == len(inputs):
            return [(o, None) for o in out]
        problem: Exception = ValueError(f"{len(out)} outputs for {len(inputs)} inputs")
    except Exception as e:  # noqa: BLE001
        problem = e
    if len(inputs) == 1:
        return [(None, f"{type(problem).__name__}: {problem}")]
    return [pair for x in inputs for pair in _answers(hook, [x])]


def call_checked(hook: Generate, c: Column | str, bounds: Bounds = Bounds()) -> Column:
    """U1, U4, U6, U7. A text hook over a column, in batches: struct(output, error); an input that fails has an error and no output."""

    @F.pandas_udf("output string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(_answers(hook, s.fillna("").tolist(), bounds) if len(s) else [], columns=["output", "error"], dtype=object)

    return run(c)


def call(hook: Generate, c: Column | str, default: str = "") -> Column:
    """U1, U4, U6, U7. The outputs of a text hook; an input that fails gives the default. ``call_checked`` tells why."""
    return F.coalesce(call_checked(hook, c)["output"], F.lit(default))


def call_distinct(df: DataFrame, hook: Generate, c: str, out: str = "output", error: str = "error", bounds: Bounds = Bounds()) -> DataFrame:
    """U1, U2, G14. ``df`` with a hook's output and error of a column, called once for each distinct text, however many rows have it.

    What was called is written, so that neither a second reader nor a lost executor
    calls again what is done. A null text is not called and has neither output nor error.
    """
    said = df.where(F.col(c).isNotNull()).select(F.col(c).alias("_said_text")).distinct().withColumn("_said", call_checked(hook, "_said_text", bounds))
    said = written(said.select("_said_text", F.col("_said.output").alias(out), F.col("_said.error").alias(error)))
    kept = [x for x in df.columns if x not in (out, error)]
    return df.select(*kept).join(said, F.col(c) == F.col("_said_text"), "left").select(*kept, out, error)


def embed_column(hook: Embed, c: Column | str, bounds: Bounds = Bounds()) -> Column:
    """U2. Vectors of a column; null where the hook gives none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            found = [v for v, _ in run_bounded(hook, texts, bounds)] if inspect.iscoroutinefunction(hook) else hook(texts)
            yield pd.Series(found, dtype=object)

    return run(c)


def ocr_lines(lines: Column, least: float) -> Column:
    """U4. Text of the recognised lines of enough confidence; lines: array of struct(text, conf)."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["conf"] >= least), lambda x: x["text"]), "\n")


def ocr_with_retry(first: Column, second: Column, least: int) -> Column:
    """U5. The first language's text, or the second's where the first is short and the second longer."""
    return F.when((F.length(first) < least) & (F.length(second) > F.length(first)), second).otherwise(first)


def with_embeddings(df: DataFrame, hook: Embed, c: str = "text") -> DataFrame:
    return df.withColumn("embedding", embed_column(hook, c))
