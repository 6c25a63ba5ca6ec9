"""Adapters that turn HTTP model endpoints into the callables that search and index take.

All fail softly: they answer None (or the query alone) with a warning, and searches fall
back. A deadline shortens each call's time limit. They pickle, so embedding runs in tasks.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

EMBED_BATCH = 32


@dataclass(frozen=True)
class Endpoint:
    url: str
    model: str = ""
    key: str = ""
    timeout: float = 30.0
    until: float | None = None  # monotonic time of a deadline

    def post(self, path: str, body: dict) -> dict:
        left = self.timeout if self.until is None else min(self.timeout, self.until - time.monotonic())
        if left <= 0:
            raise TimeoutError("the deadline has passed")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=left) as reply:
            return json.load(reply)


def embed(texts: list[str], query: bool, *, endpoint: Endpoint, dim: int, instructions: tuple[str, str] | None = None, normalize: bool = False) -> tuple[list[list[float]] | None, str | None]:
    """Vectors of all texts, in order; None with a warning if any batch fails or has another dimension."""
    out: list[list[float]] = []
    for at in range(0, len(texts), EMBED_BATCH):
        some = texts[at : at + EMBED_BATCH]
        if instructions:
            some = [f"Instruct: {instructions[query]}\n{'Query' if query else 'Text'}: {t}" for t in some]
        try:
            rows = endpoint.post("/embeddings", {"model": endpoint.model, "input": some})["data"]
            if all("index" in r for r in rows):
                rows = sorted(rows, key=lambda r: r["index"])
            found = [[float(x) for x in r["embedding"]] for r in rows]
        except (OSError, KeyError, TypeError, ValueError) as e:
            return None, f"embedding failed: {e}"
        if len(found) != len(some) or any(len(v) != dim for v in found):
            return None, f"the embedder gave other than {len(some)} vectors of {dim} numbers"
        out += [unit(v) for v in found] if normalize else found
    return out, None


def unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n and math.isfinite(n) else v


def expand(query: str, *, endpoint: Endpoint, prompt: str) -> list[str]:
    """Variants of a query by a chat model; none if it has nothing usable."""
    body = {"model": endpoint.model, "temperature": 0, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": query}]}
    try:
        reply = endpoint.post("/chat/completions", body)["choices"][0]["message"]["content"]
        bare = reply.strip()
        if bare.startswith("```"):
            bare = bare.split("\n", 1)[-1].rsplit("```", 1)[0]
        found = json.loads(bare)
    except (OSError, KeyError, IndexError, TypeError, ValueError, AttributeError):
        return []
    return [str(x).strip() for x in found if str(x).strip()] if isinstance(found, list) else []


def rerank(query: str, documents: list[str], *, endpoint: Endpoint) -> tuple[list[tuple[int, float]] | None, str | None]:
    """The order of a reranking endpoint; malformed items are left out and counted in the warning."""
    try:
        items = endpoint.post("/rerank", {"model": endpoint.model, "query": query, "documents": documents, "top_n": len(documents)})["results"]
    except (OSError, KeyError, TypeError, ValueError) as e:
        return None, f"reranking failed: {e}"
    if not isinstance(items, list) or not items:
        return None, "the reranker gave no items"
    out = []
    for item in items:
        number = item.get("index") if isinstance(item, dict) else None
        try:
            score = float(item.get("relevance_score", item.get("score"))) if isinstance(number, int) and not isinstance(number, bool) else math.nan
        except (TypeError, ValueError):
            continue
        if math.isfinite(score):
            out.append((number, score))
    if not out:
        return None, "the reranker gave no usable item"
    return out, f"{len(items) - len(out)} of the reranker's {len(items)} items were malformed" if len(out) < len(items) else None


def fill(template: str, values: dict[str, str]) -> str:
    """{name} replaced once each: what a value brings in is not looked at again."""
    parts = [template]
    for name, value in values.items():
        mark = "{" + name + "}"
        nxt: list = []
        for p in parts:
            if not isinstance(p, str):
                nxt.append(p)
                continue
            pieces = p.split(mark)
            for i, piece in enumerate(pieces):
                nxt += [piece] if i == 0 else [(value,), piece]
        parts = nxt
    return "".join(p if isinstance(p, str) else p[0] for p in parts)


def yes_no(entries: list[dict]) -> float | None:
    """Of one completion's log probabilities, as evaluate.yes_no_score is of columns."""
    good = [(e["token"], float(e["logprob"])) for e in entries if isinstance(e, dict) and "token" in e and isinstance(e.get("logprob"), (int, float))]
    first = {t: p for t, p in reversed(good)}
    if not {"yes", "no"} & first.keys():
        return None
    floor = min(p for _, p in good)
    yes, no = (math.exp(first.get(t, floor)) for t in ("yes", "no"))
    return yes / (yes + no)


def judge(query: str, document: str, *, endpoint: Endpoint, template: str) -> float:
    """How sure a model is that a document answers a query: the probability that it continues with yes."""
    reply = endpoint.post("/completion", {"prompt": fill(template, {"query": query, "document": document}), "temperature": 0, "n_predict": 1, "n_probs": 20})
    score = yes_no(reply["completion_probabilities"][0]["top_logprobs"])
    if score is None:
        raise ValueError("the model answered neither yes nor no")
    return score


def rerank_by_completion(query: str, documents: list[str], *, endpoint: Endpoint, template: str, width: int = 1) -> tuple[list[tuple[int, float]] | None, str | None]:
    """Every document judged by itself, up to `width` at a time; the first that fails ends it."""
    calls = ThreadPoolExecutor(width)
    try:
        scores = list(calls.map(lambda d: judge(query, d, endpoint=endpoint, template=template), documents))
    except (OSError, KeyError, IndexError, TypeError, ValueError) as e:
        return None, f"reranking failed: {e}"
    finally:
        calls.shutdown(wait=False, cancel_futures=True)
    return sorted(enumerate(scores), key=lambda p: -p[1]), None


def reachable(endpoints: dict[str, Endpoint], timeout: float = 2.0) -> dict[str, bool]:
    out = {}
    for name, endpoint in endpoints.items():
        try:
            urllib.request.urlopen(endpoint.url, timeout=timeout).close()
            out[name] = True
        except urllib.error.HTTPError:
            out[name] = True  # it answers
        except OSError:
            out[name] = False
    return out


@dataclass(frozen=True)
class Models:
    """Which endpoints there are; callables() are what Hayrick takes."""

    embedder: Endpoint | None = None
    dim: int = 0
    expander: Endpoint | None = None
    prompt: str = "Give up to seven other phrasings of the code search query as a JSON list of strings."
    reranker: Endpoint | None = None
    completion: Endpoint | None = None
    template: str = "Does the document answer the query? Say yes or no.\nQuery: {query}\nDocument: {document}\nAnswer:"

    def callables(self) -> dict:
        rank = partial(rerank, endpoint=self.reranker) if self.reranker else partial(rerank_by_completion, endpoint=self.completion, template=self.template, width=8) if self.completion else None
        return {
            "embed": partial(embed, endpoint=self.embedder, dim=self.dim) if self.embedder else None,
            "expand": partial(expand, endpoint=self.expander, prompt=self.prompt) if self.expander else None,
            "rerank": rank,
        }
