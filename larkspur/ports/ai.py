"""The AI port: a provider that turns messages into texts and texts into vectors, and a deterministic stub."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.jsonx import parse_verdict


class Provider(Protocol):
    """One client per partition; both calls are batched and aligned with their inputs."""

    def chat(self, prompts: list[str]) -> list[str | None]: ...

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Cut(str):
    """An answer that the model had to end at its greatest length."""


class StubProvider:
    """Answers from the prompt alone: equal halves are the same; vectors are hashed character trigrams."""

    #: Trigrams whose place is remembered.
    MOST = 1 << 18

    def __init__(self, dim: int = 64):
        self.dim, self.places = dim, {}

    def _place(self, gram: str) -> tuple[int, int]:
        """Where a trigram counts, and with which sign."""
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
        if len(self.places) >= self.MOST:
            self.places.clear()
        self.places[gram] = place = (h % self.dim, 1 if h >> 32 & 1 else -1)
        return place

    def chat(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            a, _, b = p.partition("\n===\n")
            out.append(json.dumps({"same": a.strip() == b.strip()}) if b else json.dumps({"title": p.strip().split("\n")[0][:50]}))
        return out

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            sums, places = [0.0] * self.dim, self.places
            counts = Counter(map("".join, zip(t, t[1:], t[2:]))) if len(t) > 2 else {t: 1}
            for gram, times in counts.items():
                at, sign = places.get(gram) or self._place(gram)
                sums[at] += sign * times
            v = np.array(sums)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class StubClassifier(StubProvider):
    """Answers a classification prompt from the texts' lengths, with the faults that real answers have: gaps, unknown names, broken
    JSON that can be read, and ends cut off where a prompt has over `most` messages. Messages asked again are answered."""

    def __init__(self, most: int = 8):
        super().__init__()
        self.most = most

    def chat(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for prompt in prompts:
            part, names, *lines = prompt.split("\n")
            categories, told = names.split("|"), []
            for line in lines:
                number, text = line[1:].split("] ", 1)
                n = len(text)
                if n % 11 == 0 and not part.startswith("again"):
                    continue
                name = "no such name" if n % 13 == 0 else categories[n % len(categories)]
                told.append(f'{{"index": {number}, "include": {"false" if n % 7 == 0 else "true"}, category: "{name}", "key": ["k{n % 5}", " "], "time": {"true" if n % 3 == 0 else "false"},}}')
            answer = '```json\n{"task": "classify", "data": [' + " ".join(told) + "]}\n```"
            out.append(Cut(answer[: len(answer) // 2]) if len(lines) > self.most else answer)
        return out


class StubTopicJudge(StubProvider):
    """Judges two cards, as `judge_topics` lays them out: one topic where their titles share a word of three letters or more."""

    def chat(self, prompts: list[str]) -> list[str | None]:
        words = lambda card: set(re.findall(r"[^\W\d_]{3,}", card.split("\n")[0].lower()))
        return [json.dumps({"merge": bool(words(a) & words(b))}) for a, _, b in (p.partition("\n===\n") for p in prompts)]


ProviderFactory = Callable[[], Provider]


def readable_verdict(answer: str | None) -> bool:
    """Whether an answer holds a JSON object with a plain value, as `parse_verdict` reads it."""
    try:
        found = json.loads(re.search(r"\{.*\}", answer or "", re.S)[0])
        return any(str(v).strip().lower() in ("true", "1", "yes", "false", "0", "no") for v in found.values())
    except (TypeError, ValueError, AttributeError):
        return False


def ask(rows: DataFrame, prompt: Column, factory: ProviderFactory, answer: str = "answer", batch: int = 64, attempts: int = 1, readable: Callable[[str | None], bool] | None = None, finish: str | None = None) -> DataFrame:
    """rows with the provider's answer to each prompt; null where the call failed or gave another number of answers. `finish` names
    a column for how an answer ended: stop, length, or null where there is none.

    Prompts whose answer `readable` refuses are asked again where they are, up to `attempts` times in all, so that the
    plan has one call however often it asks.
    """
    ready = rows.withColumn("prompt__", prompt)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            prompts, got = pdf["prompt__"].tolist(), []
            for at in range(0, len(prompts), batch):
                part = prompts[at : at + batch]
                try:
                    one = client.chat(part)
                except Exception:  # a failed call is an unknown answer, not a failed job
                    one = []
                got += one if len(one) == len(part) else [None] * len(part)
            for _ in range(attempts - 1 if readable else 0):
                again = [i for i, a in enumerate(got) if not readable(a)]
                for at in range(0, len(again), batch):
                    part = again[at : at + batch]
                    try:
                        one = client.chat([prompts[i] for i in part])
                    except Exception:
                        one = []
                    for i, a in zip(part, one if len(one) == len(part) else [], strict=False):
                        got[i] = a
            out = pdf.drop(columns="prompt__").assign(**{answer: [None if a is None else str(a) for a in got]})
            yield out.assign(**{finish: [a if a is None else "length" if isinstance(a, Cut) else "stop" for a in got]}) if finish else out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ready.mapInPandas(call, f"{fields}, `{answer}` string" + (f", `{finish}` string" if finish else ""))


def embed(rows: DataFrame, text: Column, factory: ProviderFactory, vector: str = "vec", batch: int = 64) -> DataFrame:
    """rows with a vector for each text; null where the call failed or is not aligned."""
    ready = rows.withColumn("text__", text)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            texts, got = pdf["text__"].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    one = client.embed(part)
                except Exception:
                    one = []
                got += one if len(one) == len(part) else [None] * len(part)
            yield pdf.drop(columns="text__").assign(**{vector: got})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ready.mapInPandas(call, f"{fields}, `{vector}` array<double>")


def judge_pairs(pairs: DataFrame, a: Column, b: Column, factory: ProviderFactory, verdict: str = "same", attempts: int = 2, key: str = "same") -> DataFrame:
    """pairs with a tri-state verdict, read from the answer's field `key`; pairs whose answer cannot be read are asked again."""
    prompt = F.concat(F.coalesce(a, F.lit("")), F.lit("\n===\n"), F.coalesce(b, F.lit("")))
    rows = ask(pairs, prompt, factory, "answer__", attempts=attempts, readable=readable_verdict)
    return rows.withColumn(verdict, parse_verdict(F.col("answer__"), key)).drop("answer__")


#: Characters of a card's contents that a topic judge sees.
JUDGED_CHARS = 400


def judge_topics(pairs: DataFrame, head: str, tail: str, factory: ProviderFactory, verdict: str = "same") -> DataFrame:
    """pairs with a tri-state verdict whether two cards are of one topic. The judge sees the title and the beginning of the
    contents (title, key info, quote) of the earlier listed card, then of the new one: structs of those three columns."""

    def card(side: str) -> Column:
        parts = F.filter(F.array(*[F.col(f"{side}.{c}") for c in ("title", "key_info", "source_quote")]), lambda x: F.coalesce(x, F.lit("")) != "")
        return F.concat(F.coalesce(F.col(f"{side}.title"), F.lit("")), F.lit("\n"), F.substring(F.array_join(parts, " "), 1, JUDGED_CHARS))

    return judge_pairs(pairs, card(head), card(tail), factory, verdict, key="merge")


def classify(messages: DataFrame, factory: ProviderFactory, categories: list[str], depth: int = 6) -> DataFrame:
    """messages (batch_id, idx, content) with category and failed: one call a batch that answers with a list of categories.

    An answer that is not a list of known categories of the batch's length is retried on both halves, `depth` times.
    """
    known = set(categories)

    def call(one: pd.DataFrame) -> pd.DataFrame:
        client = factory()
        one = one.sort_values("idx", kind="stable")

        def solve(texts: list[str], left: int) -> list[str | None]:
            try:
                got = json.loads(client.chat(["\n".join(texts)])[0] or "")
                if isinstance(got, list) and len(got) == len(texts) and set(got) <= known:
                    return got
            except Exception:
                pass
            if len(texts) == 1 or not left:
                return [None] * len(texts)
            half = len(texts) // 2
            return solve(texts[:half], left - 1) + solve(texts[half:], left - 1)

        got = solve(one["content"].fillna("").tolist(), depth)
        return one.assign(category=got, failed=[g is None for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    # A batch is what one prompt holds, so a group is small.
    return messages.groupBy("batch_id").applyInPandas(call, f"{fields}, category string, failed boolean")
