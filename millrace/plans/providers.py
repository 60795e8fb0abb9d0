"""Language and embedding models as functions of a prompt column.

A provider maps a batch of prompts to a batch of responses. Calls run in
pandas batches on the executors, where a model or a client is made once for
each worker process. Providers that are not installed raise; none is
replaced by another silently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

COMPLETION = StructType([StructField("text", StringType()), StructField("usage", StringType()), StructField("error", StringType())])
#: Providers whose calls are known, of those that a model name may point to (fixed values).
SUPPORTED = ("openai", "anthropic", "google", "mistral", "custom", "ollama")


class Completion(Protocol):
    def __call__(self, prompt: str) -> str | dict: ...


def completion(make: Callable[[], Completion], prompt: Column) -> Column:
    """A struct (text, usage as JSON, error) for each prompt; ``make`` builds the client on the worker."""
    import json

    @F.pandas_udf(COMPLETION)
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for prompts in batches:
            rows = []
            for p in prompts:
                try:
                    out = client(p)
                    out = out if isinstance(out, dict) else {"text": out}
                    rows.append((out.get("text"), json.dumps(out.get("usage") or {}), None))
                except (OSError, ValueError, LookupError) as e:  # a failed call is a failed step, not a failed job
                    rows.append((None, None, str(e)))
            yield pd.DataFrame(rows, columns=["text", "usage", "error"])

    return complete(prompt)


def embedding(make: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column) -> Column:
    """A vector for each text; the model gets whole batches. Empty texts raise."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            if (texts.fillna("").str.strip() == "").any():
                raise ValueError("an empty text has no embedding")
            yield pd.Series(model(texts.tolist()))

    return embed(text)


def scripted(plan: str = "", formulate: str = "", draft: str = "", reflect: str = "", verify: str = "", choose: str = "", mode: str = "", external: str = "") -> Callable[[Column], Column]:
    """A deterministic stand-in for tests: the response by the prompt's first words, as a column expression.

    {query} in a response is filled with the question that the prompt holds.
    """
    starts = {"Split the": plan, "Write ": formulate, "Answer the": draft, "Given what": reflect, "Does the": verify, "Choose which": choose, "Choose how": mode, "Answer from your": external}

    def respond(prompt: Column) -> Column:
        query = F.regexp_extract(prompt, r"Question: ([^\n]*)", 1)
        out = F.lit(None).cast("string")
        for start, response in starts.items():
            out = F.when(prompt.startswith(start), F.replace(F.lit(response), F.lit("{query}"), query)).otherwise(out)
        return F.struct(out.alias("text"), F.to_json(F.struct(F.length(prompt).alias("prompt_tokens"), F.length(out).alias("completion_tokens"))).alias("usage"), F.lit(None).cast("string").alias("error"))

    return respond


#: Addresses of the providers that have one, and the version header that one of them asks for (fixed values).
ADDRESSES = {"openai": "https://api.openai.com", "anthropic": "https://api.anthropic.com", "google": "https://generativelanguage.googleapis.com", "mistral": "https://api.mistral.ai"}
_VERSION = {"anthropic-version": "2023-06-01"}


def request_of(provider: str, model: str, prompt: str, key: str | None, temperature: float, max_tokens: int) -> tuple[str, dict, dict]:
    """Path, headers and body of a completion call."""
    said = [{"role": "user", "content": prompt}]
    if provider == "anthropic":
        return "/v1/messages", {"x-api-key": key or "", **_VERSION}, {"model": model, "max_tokens": max_tokens, "temperature": temperature, "messages": said}
    if provider == "google":
        return f"/v1beta/models/{model}:generateContent", {"x-goog-api-key": key or ""}, {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, "maxOutputTokens": max_tokens}}
    headers = {"Authorization": f"Bearer {key}"} if key else {}
    return "/v1/chat/completions", headers, {"model": model, "messages": said, "temperature": temperature, "max_tokens": max_tokens}


def answer_of(provider: str, out: dict) -> dict:
    """Text and usage of a completion's JSON."""
    if provider == "anthropic":
        return {"text": "".join(p.get("text", "") for p in out["content"]), "usage": out.get("usage")}
    if provider == "google":
        return {"text": "".join(p.get("text", "") for p in out["candidates"][0]["content"]["parts"]), "usage": out.get("usageMetadata")}
    return {"text": out["choices"][0]["message"]["content"], "usage": out.get("usage")}


def client_of(provider: str, base_url: str | None, model: str, key: str | None = None, timeout: float = 60.0, temperature: float = 0.7, max_tokens: int = 4096) -> Callable[[], Completion]:
    """A maker of clients; custom and ollama servers, and mistral, have openai's chat-completion interface."""
    if provider not in SUPPORTED:
        raise ValueError(f"no client for provider {provider}")
    base = base_url or ADDRESSES.get(provider)
    if not base:
        raise ValueError(f"provider {provider} needs an address")

    def make() -> Completion:
        import json
        from urllib.request import Request, urlopen

        def call(prompt: str) -> dict:
            path, headers, body = request_of(provider, model.removeprefix(f"{provider}/"), prompt, key, temperature, max_tokens)
            with urlopen(Request(base.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}), timeout=timeout) as answer:
                return answer_of(provider, json.load(answer))

        return call

    return make
