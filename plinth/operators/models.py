"""Expensive functions of a provider: embeddings and generated text, and the operators around them.

A provider is a Python function over a list of texts, called once an Arrow batch; the defaults are
deterministic and need no network. Calls over the network wait for most of their time, so a task makes several at once:
at most `workers` (of a provider, or of `embedded` and `generated`), in the order of the rows, and one that fails
spoils no other. How many calls the whole job makes at once is that times the number of tasks that run. Filters on
other columns pass below these functions, as they are scalar pandas functions.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import TypeVar
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError
from ..functions.text import fenced
from ..schemas import ADVICE, RESUME

Embed = Callable[[list[str]], list[list[float] | None]]
Generate = Callable[[list[str]], list[str]]
DIMENSIONS = 1024
ATTEMPTS = 3
WORKERS = 2
A, B = TypeVar("A"), TypeVar("B")


def in_flight(call: Callable[[A], B], items: Iterable[A], workers: int = WORKERS) -> Iterator[B | Exception]:
    """call's result for each item in order, or the exception that it raised; at most workers calls are under way and at most as many results wait."""
    if workers < 1:
        raise ValueError("one worker at least")

    def one(item: A) -> B | Exception:
        try:
            return call(item)
        except Exception as error:
            return error

    todo = iter(items)
    with ThreadPoolExecutor(workers) as pool:
        under_way = [pool.submit(one, item) for item in islice(todo, workers)]
        while under_way:
            made = under_way.pop(0).result()
            under_way += [pool.submit(one, item) for item in islice(todo, 1)]
            yield made


def hashed_words(dimensions: int = DIMENSIONS, digest: str = "blake2b") -> Embed:
    """A provider: counts of hashed words with signs, of length one (no words: zeros). The first 8 bytes of the digest (blake2b, or md5, which SQL has) are a word's hash."""
    first = {"blake2b": lambda w: hashlib.blake2b(w, digest_size=8).digest(), "md5": lambda w: hashlib.md5(w, usedforsecurity=False).digest()[:8]}[digest]

    def embed(texts: list[str]) -> list[list[float]]:
        out, known = np.zeros((len(texts), dimensions)), {}
        for row, text in zip(out, texts):
            for word, n in Counter(text.lower().split()).items():
                if word not in known:
                    h = int.from_bytes(first(word.encode()), "big")
                    known[word] = h % dimensions, 1 if h >> 63 else -1
                at, sign = known[word]
                row[at] += sign * n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return embed


class HttpProvider:
    """A provider over HTTP: POST of JSON with a bearer key. Server and connection errors are tried again, others raise at once.

    Of several texts at most `workers` are asked for at once; a text whose embedding fails is None among the others.
    """

    def __init__(self, base_url: str, api_key: str, model: str, dimensions: int = DIMENSIONS, sleep: Callable[[float], None] = time.sleep, workers: int = WORKERS):
        if not api_key:
            raise ModelError("an API key is needed")
        self.base_url, self.api_key, self.model, self.dimensions, self.sleep, self.workers = base_url.rstrip("/"), api_key, model, dimensions, sleep, workers

    def _post(self, path: str, body: dict, attempts: int, timeout: float) -> dict:
        request = Request(f"{self.base_url}/{path}", json.dumps(body).encode(), {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        for k in range(attempts):
            try:
                with urlopen(request, timeout=timeout) as reply:
                    return json.loads(reply.read())
            except (HTTPError, URLError) as error:
                if k + 1 == attempts or (isinstance(error, HTTPError) and error.code < 500):
                    raise ModelError(f"{path}: {error}") from error
                self.sleep(2**k + 0.5)
        raise ModelError(f"{path}: no attempt")

    def generate(self, prompts: list[str]) -> list[str]:
        replies = [self._post("query", {"prompt": p, "model": self.model}, 1, 60) for p in prompts]
        if bad := [r for r in replies if "response" not in r]:
            raise ModelError(str(bad[0].get("message", bad[0]))[:500])
        return [r["response"] for r in replies]

    def embed_one(self, text: str) -> list[float]:
        return _vector(self._post("embeddings", {"query": text, "embeddings_model": self.model, "dimensions": self.dimensions}, ATTEMPTS, 30))

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None if isinstance(v, Exception) else v for v in in_flight(self.embed_one, texts, self.workers)]

    def describe(self) -> dict[str, str | int]:
        """What is asked for, without the key."""
        return {"base_url": self.base_url, "model": self.model, "dimensions": self.dimensions}


def _vector(reply: dict) -> list[float]:
    for name in ("response", "embeddings", "embedding"):
        if name in reply:
            return reply[name]
    if isinstance(reply.get("data"), list) and reply["data"] and "embedding" in reply["data"][0]:
        return reply["data"][0]["embedding"]
    raise ModelError("no embedding in the reply")


def embedded(text: Column, embed: Embed, dimensions: int = DIMENSIONS, workers: int = WORKERS) -> Column:
    """The embedding of each text; a text that fails gets zeros. A batch that fails is tried text by text, workers at once."""

    def one(value: str) -> list[float] | None:
        for _ in range(ATTEMPTS):
            try:
                return embed([value])[0]
            except Exception:
                continue
        return None

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        values = [t or "" for t in texts]
        try:
            made = embed(values)
        except Exception:
            made = list(in_flight(one, values, workers))
        return pd.Series([m or [0.0] * dimensions for m in made])

    return run(text)


def generated(prompt: Column, generate: Generate, workers: int = WORKERS) -> Column:
    """A struct of reply and error for each prompt, workers of them asked at once; errors become rows."""

    @F.pandas_udf("reply string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        replies = in_flight(lambda p: generate([p])[0], prompts, workers)
        return pd.DataFrame([(None, str(r)[:500]) if isinstance(r, Exception) else (r, None) for r in replies], columns=["reply", "error"])

    return run(prompt)


def stub_generate(prompts: list[str]) -> list[str]:
    """A provider without a model: it answers with empty lists."""
    return [f"```json\n{json.dumps(dict.fromkeys(('skill_gaps', 'keywords', 'improvements', 'strengths', 'skills'), []))}\n```" for _ in prompts]


def parsed_resume(answer: Column) -> Column:
    """RESUME of a generated struct; missing lists are empty, and a failure says so."""
    r = F.from_json(fenced(answer["reply"]), RESUME)
    lists = {n: F.coalesce(r[n], F.array().cast(RESUME[n].dataType)) for n in ("skills", "experience", "education", "projects", "certifications")}
    bad = answer["error"].isNotNull() | r.isNull() | ~F.coalesce(F.startswith(F.trim(fenced(answer["reply"])), F.lit("{")), F.lit(False))
    summary = F.when(bad, "Error parsing resume").otherwise(F.coalesce(r["summary"], F.lit("")))
    error = F.when(bad, F.coalesce(answer["error"], F.lit("no JSON object in the reply")))
    return F.struct(*[lists[n].alias(n) for n in lists], summary.alias("summary"), error.alias("error"), r["name"].alias("name"))


def parsed_advice(answer: Column) -> Column:
    """ADVICE of a generated struct; a failure has empty lists and its error."""
    a = F.from_json(fenced(answer["reply"]), ADVICE)
    names = ("skill_gaps", "keywords", "improvements", "strengths")
    bad = answer["error"].isNotNull() | ~F.coalesce(F.startswith(fenced(answer["reply"]), F.lit("{")), F.lit(False))
    return F.struct(*[F.coalesce(a[n], F.array().cast("array<string>")).alias(n) for n in names], F.when(bad, F.coalesce(answer["error"], F.lit("no JSON object in the reply"))).alias("error"))


def missing_embeddings(documents: DataFrame, index: DataFrame) -> DataFrame:
    """documents (job_id, document) that the index (job_id, content_hash) lacks or has with another text."""
    keyed = documents.withColumn("content_hash", F.md5(F.col("document").cast("binary")))
    return keyed.join(index.select("job_id", "content_hash"), ["job_id", "content_hash"], "left_anti")
