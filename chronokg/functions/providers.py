"""Models behind a small protocol, with deterministic offline stand-ins.

A provider is created once per Python worker. ``Offline`` needs no network: it
embeds by signed hashing of words, ranks by shared words and answers by template.
"""

from __future__ import annotations

import json
import random
import re
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]: ...


class Offline:
    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    @staticmethod
    def _answer(prompt: str) -> str:
        body = prompt.rpartition("TEXT:")[2]
        names = list(dict.fromkeys(re.findall(r"\b[A-ZА-ЯЁ][\w-]{2,}", body)))[:8]
        if prompt.startswith("EXTRACT"):
            pairs = [{"source": a, "target": b, "description": f"{a} with {b}", "type": "FACTUAL", "strength": 5} for a, b in zip(names, names[1:])]
            return json.dumps({"entities": [{"name": n, "type": "CONCEPT", "description": f"{n} in the text"} for n in names], "relationships": pairs}, ensure_ascii=False)
        if prompt.startswith("REPORT"):
            return json.dumps({"title": " / ".join(names[:3]) or "Window", "summary": body.strip()[:120], "report": body.strip()[:600]}, ensure_ascii=False)
        return f"Sources: {', '.join(dict.fromkeys(re.findall(r'book\d+_chunk_\d+', prompt))) or 'none'}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        asked = set(re.findall(r"\w+", query.lower()))
        scored = [(i, len(asked & set(re.findall(r"\w+", d.lower()))) / max(1, len(asked))) for i, d in enumerate(documents)]
        return sorted(scored, key=lambda s: (-s[1], s[0]))[:top_n]


def retry_delay(attempt: int, base: float = 5.0, most: float = 60.0, jitter: float = 0.2, draw: Callable[[], float] = random.random) -> float:
    return min(base * 2 ** (attempt - 1), most) * (1 + jitter * (2 * draw() - 1))


def retried(call: Callable, tries: int = 5, base: float = 5.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """``call()``, tried again after any error; the last error is raised."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if attempt == tries:
                raise
            sleep(retry_delay(attempt, base, most))
    raise AssertionError


class Http:
    """A model server with the usual paths ``/chat/completions``, ``/embeddings`` and ``/rerank``; errors are raised, as retries are the caller's."""

    def __init__(self, llm: str = "", embedder: str = "", reranker: str = "", models: tuple[str, str, str] = ("", "", ""), key: str = "", timeout: float = 300.0, temperature: float = 0.0, max_tokens: int | None = None, system: str | None = None):
        self.llm, self.embedder, self.reranker, self.models, self.key = llm, embedder, reranker, models, key
        self.timeout, self.temperature, self.max_tokens, self.system = timeout, temperature, max_tokens, system

    def _post(self, base: str, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        with urlopen(Request(base.rstrip("/") + path, json.dumps(body).encode(), headers), timeout=self.timeout) as reply:
            return json.load(reply)

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            messages = [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": prompt}]
            body = {"model": self.models[0], "messages": messages, "temperature": self.temperature, **({"max_tokens": self.max_tokens} if self.max_tokens else {})}
            out.append(self._post(self.llm, "/chat/completions", body)["choices"][0]["message"]["content"] or "")
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self._post(self.embedder, "/embeddings", {"model": self.models[1], "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        body = {"model": self.models[2], "query": query, "documents": documents, **({"top_n": top_n} if top_n else {})}
        return [(r["index"], float(r["relevance_score"])) for r in self._post(self.reranker, "/rerank", body)["results"]]


def _each(items: list, call: Callable, tries: int, in_flight: int = 1, base: float = 5.0) -> list[tuple[object, str | None]]:
    """``call`` of each item, ``in_flight`` at a time, in order; a failed item is a null with its error, and the rest go on."""

    def one(item):
        try:
            return retried(lambda: call(item), tries, base), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:300]

    if in_flight == 1:
        return [one(item) for item in items]
    with ThreadPoolExecutor(in_flight) as pool:
        return list(pool.map(one, items))


def generated(df: DataFrame, prompt: str, make: Callable[[], Provider] = Offline, out: str = "reply", tries: int = 5, tasks: int | None = None, in_flight: int = 8, base: float = 5.0) -> DataFrame:
    """``df`` with a reply and an ``<out>_error`` column; a task has ``in_flight`` calls under way, and ``tasks`` bounds the tasks."""
    schema = df.withColumn(out, F.lit(None).cast("string")).withColumn(f"{out}_error", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for batch in batches:
            found = _each(batch[prompt].tolist(), lambda p: own.generate([p])[0], tries, in_flight, base)
            yield batch.assign(**{out: [x for x, _ in found], f"{out}_error": [e for _, e in found]})

    return (df.coalesce(tasks) if tasks else df).mapInPandas(run, schema)


def embedded(df: DataFrame, text: str, make: Callable[[], Provider] = Offline, out: str = "embedding", most_tokens: int = 509, tries: int = 5, tasks: int | None = None, in_flight: int = 1, base: float = 5.0) -> DataFrame:
    """``df`` with the embedding of a text, null if that fails; a text over ``most_tokens`` is the mean of its pieces."""
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, step = make(), most_tokens * 4

        def one(body):
            pieces = own.embed([body[k : k + step] for k in range(0, max(1, len(body or "")), step)])
            return [sum(v) / len(pieces) for v in zip(*pieces)]

        for batch in batches:
            found = _each([x or "" for x in batch[text].tolist()], one, tries, in_flight, base)
            yield batch.assign(**{out: [x for x, _ in found]})

    return (kept.coalesce(tasks) if tasks else kept).mapInPandas(run, schema)


def reranked(df: DataFrame, query: str, document: str, k: int, id: str = "id", make: Callable[[], Provider] = Offline, order: str | None = None) -> DataFrame:
    """The k best of a question's few candidate rows by the reranker, blank ones left out; each answer keeps its row's id.

    If the reranker fails, the first k by ``order`` (or id) stay, with falling
    scores below zero.
    """
    schema = df.withColumn("score", F.lit(0.0)).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[document].fillna("").str.strip() != ""].sort_values([order or id, id]).reset_index(drop=True)
        try:
            best = make().rerank(query, rows[document].tolist(), k) if len(rows) else []
        except Exception:
            best = [(i, -1.0 - i) for i in range(min(k, len(rows)))]
        return rows.iloc[[i for i, _ in best]].assign(score=[float(s) for _, s in best])

    return df.groupBy(F.lit(query)).applyInPandas(run, schema)


def scored(df: DataFrame, query: str, document: str, make: Callable[[], Provider] = Offline, out: str = "score") -> DataFrame:
    """``df`` with the reranker's score of each row's document for the row's own query, null where the reranker fails; a batch at a time, so that no query's rows are gathered."""
    schema = df.drop(out).withColumn(out, F.lit(None).cast("double")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for batch in batches:
            found = pd.Series(None, index=batch.index, dtype="float64")
            for asked, rows in batch.groupby(query):
                try:
                    for i, score in own.rerank(asked, rows[document].fillna("").tolist(), None):
                        found[rows.index[i]] = float(score)
                except Exception:
                    continue
            yield batch.assign(**{out: found})

    return df.drop(out).mapInPandas(run, schema)
