"""Models behind small protocols, with offline stand-ins: no network is needed, and results are the same every time.

The stand-ins are rules, not language models; a real model plugs in as a function.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from datetime import date
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.expand import STOP_WORDS
from palaver.plans.query_ir import Filter, Query
from palaver.tools import Result, until_success


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> Result: ...


class Function:
    """A model from a function of the prompt, asked again while it fails."""

    def __init__(self, f: Callable[[str], str], times: int = 3, pause: float = 1.0):
        self.f, self.times, self.pause = f, times, pause

    def complete(self, prompt: str | list) -> Result:
        def once() -> Result:
            try:
                return Result(True, self.f(plain(prompt)))
            except Exception as e:
                return Result(False, error=str(e))

        return until_success(once, self.times, self.pause)


def plain(prompt: str | list) -> str:
    """A prompt's text, whether it is one string or parts."""
    return prompt if isinstance(prompt, str) else "\n".join(p if isinstance(p, str) else p.get("text", "") for p in prompt)


class Http:
    """A chat service over HTTP: address and key come from the caller or the environment variables it names."""

    def __init__(self, url: str, model: str, key_variable: str, reader: Callable[[dict], str], header: str = "Authorization", prefix: str = "Bearer "):
        self.url, self.model, self.key_variable, self.reader, self.header, self.prefix = url, model, key_variable, reader, header, prefix

    def complete(self, prompt: str | list) -> Result:
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.model, "max_tokens": 4096, "messages": [{"role": "user", "content": plain(prompt)}]}).encode()
        try:
            request = Request(self.url, body, {"Content-Type": "application/json", self.header: self.prefix + os.environ[self.key_variable]})
            with urlopen(request, timeout=120) as r:
                return Result(True, self.reader(json.load(r)))
        except Exception as e:
            return Result(False, error=str(e))


def from_config(config: dict) -> LanguageModel:
    """By ``kind``: a function, or an HTTP service."""
    if config["kind"] == "function":
        return Function(config["function"], config.get("times", 3), config.get("pause", 1.0))
    if config["kind"] == "http":
        return Http(config["url"], config["model"], config["key_variable"], config["reader"])
    raise ValueError(f"unknown kind of model: {config['kind']}")


# ---------------------------------------------------------------- embeddings


def hashed(texts: list[str], size: int = 64) -> np.ndarray:
    """Bags of words hashed into ``size`` places, of length one."""
    out = np.zeros((len(texts), size))
    for k, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % size] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def embed(chunks: DataFrame, generate: Callable[[list[str]], np.ndarray] = hashed, batch: int = 100) -> DataFrame:
    """``chunks`` with ``embedding``, asked for in batches on the executors."""

    @F.pandas_udf("array<double>")
    def embedded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            parts = [generate(s.iloc[k : k + batch].tolist()) for k in range(0, len(s), batch)]
            yield pd.Series([v.tolist() for p in parts for v in p])

    return chunks.withColumn("embedding", embedded("text"))


# ---------------------------------------------------------------- offline extraction and answers

NAME = re.compile(r"\b[A-Z][\w']+(?: [A-Z][\w']+)*")
KNOWLEDGE = "struct<entities:array<struct<name:string,type:array<string>>>,topics:array<string>>"


def extract_rules(text: str) -> dict:
    """Names as entities, longer words as topics."""
    names = list(dict.fromkeys(m[0] for m in NAME.finditer(text)))
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    topics = list(dict.fromkeys(w for w in words if len(w) >= 6 and w not in STOP_WORDS))
    return {"entities": [{"name": n, "type": ["name"]} for n in names], "topics": topics}


def extract(messages: DataFrame, rule: Callable[[str], dict] = extract_rules) -> DataFrame:
    """``messages`` with ``knowledge``, from the first chunk of each."""

    @F.pandas_udf(KNOWLEDGE)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(t or "") for t in texts], columns=["entities", "topics"])

    return messages.withColumn("knowledge", found(F.get("text_chunks", F.lit(0))))


def translate(question: str) -> Query:
    """A question as a structured query: its words but for stop words."""
    words = [w.strip(".,;:!?\"'()").lower() for w in question.split()]
    return Query((Filter(search_terms=tuple(w for w in words if w and w not in STOP_WORDS)),), question)


def prompt(question: str, context: str) -> str:
    return f"Answer the question from the context alone. If it isn't there, say NoAnswer.\n\nQuestion: {question}\n\nContext:\n{context}\n"


def answer(question: str, context: str, model: LanguageModel | None = None, today: date | None = None) -> dict:
    """{type, answer or why}: from a model, or offline the first message of the context."""
    if model is not None:
        result = model.complete(prompt(question, context))
        return {"type": "Answered", "answer": result.output} if result.success else {"type": "NoAnswer", "why": result.error or "no result"}
    messages = json.loads(context)["messages"]
    return {"type": "Answered", "answer": messages[0]["messageText"][0]} if messages else {"type": "NoAnswer", "why": "nothing was found"}
