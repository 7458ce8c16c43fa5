"""Models that answer requests, as iterator functions over lanes of requests.

A provider is registered by name as a function that opens a session. Requests
are dealt into lanes; a lane is worked through in order by one session, which
can keep a connection, a latch or a rate. Lanes are what bounds the number of
connections to a provider, whatever the number of executors, and they make
sessions with a state deterministic: a lane that is run again sees the same
requests in the same order.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwatch.functions.prompts import ALLOWLIST
from longwatch.functions.text import CHARS_PER_TOKEN
from longwatch.plans.transport import Latch, Line, Reply, RequestFailed

LANES = 64


@dataclass(frozen=True)
class Answer:
    """state: ok, truncated, or how else the answer ended."""

    content: str | None
    input_tokens: int = 0
    output_tokens: int = 0
    model: str | None = None
    state: str = "ok"


class Session(Protocol):
    """Answers prompts one after the other; the number of the request tells a script which one it is."""

    def complete(self, prompt: str, key: str) -> Answer: ...

    def close(self) -> None: ...


class NotConfigured(LookupError):
    """There is no such provider, or it cannot be used here."""


def tokens(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


# The finding that a mock answers where a request has no allowlist.
MOCK_FINDING = {
    "finding_type": "time_assurance_gap", "title": "Era wrap guidance may be incomplete",
    "description": "Document discusses 32-bit seconds and eras; long-horizon ops guidance should be reviewed.",
    "severity": "medium", "confidence": "medium", "domains": ["y2036", "rollover"], "section_id": "s-1", "section_title": "1. Introduction",
    "evidence": [{"quote": "Timestamps are 32-bit seconds", "note": "Representation width mentioned"}],
    "machine_interpretation": "Potential Y2036-related assurance gap.", "recommendation_level1": "Clarify era rollover and supported operational horizon.",
    "scope_relevance": "core", "scope_rationale": "This matters to time assurance because NTP seconds are a fixed-width counter that wraps on a known horizon.",
    "time_representation": {"width_bits": 32, "signed": False, "epoch": "1900-01-01T00:00:00Z", "unit": "seconds", "ticks_per_second": None, "claimed_horizon": {"value": "2036-02-07", "precision": "day"}, "rollover_behavior": "wrap"},
}


class Mock:
    """Answers with one payload, or with no findings where its first finding names a reference that the request does not allow."""

    def __init__(self, payload: dict | None = None, model: str = "mock-model"):
        self.payload, self.model = payload or {"findings": [MOCK_FINDING]}, model

    def complete(self, prompt: str, key: str) -> Answer:
        content = json.dumps(self._for(prompt))
        return Answer(content, tokens(prompt), tokens(content), self.model)

    def _for(self, prompt: str) -> dict:
        lines = prompt.split("\n")
        here = next((lines[k + 1] for k, x in enumerate(lines[:-1]) if x.endswith(ALLOWLIST)), None)
        if here is None:
            return self.payload
        refs = [r.strip() for r in here.split(",") if r.strip()]
        findings = self.payload.get("findings")
        fits = isinstance(findings, list) and findings and isinstance(findings[0], dict) and findings[0].get("section_id") in refs
        return self.payload if fits else {"findings": []}

    def close(self) -> None:
        pass


class Posted:
    """A chat provider behind a line; a request that is given up is an answer with the failure's category as its state."""

    FEATURE = "response_format"

    def __init__(self, send: Callable[[dict], Reply], model: str, wait: Callable[[float], None] | None = None, unsupported: Callable[[str], bool] = lambda body: False):
        line = Line(send, unsupported=unsupported) if wait is None else Line(send, wait=wait, unsupported=unsupported)
        self.latch, self.model = Latch(line, self.FEATURE), model

    def payload(self, prompt: str, key: str) -> dict:
        """(Y9)"""
        return {"model": self.model, "messages": [{"role": "user", "content": prompt}], self.FEATURE: {"type": "json_schema"}, "user": key}

    def complete(self, prompt: str, key: str) -> Answer:
        try:
            data = self.latch.post(self.payload(prompt, key))
        except RequestFailed as e:
            return Answer(None, model=self.model, state=e.category)
        choice = (data.get("choices") or [{}])[0]
        used = data.get("usage") or {}
        end = {"length": "truncated", "stop": "ok"}.get(choice.get("finish_reason"), "shape")
        return Answer((choice.get("message") or {}).get("content"), used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0, self.model, end)

    def close(self) -> None:
        pass


#: By name: opens a session, from the options of ask().
_OPENERS: dict[str, Callable[..., Session]] = {"mock": Mock}
# Other names of providers.
ALIASES = {"google": "gemini", "cloud-ollama": "ollama"}


def register(name: str, opener: Callable[..., Session]) -> None:
    """Adds or replaces a provider. Its opener is sent to executors, so it must be a function of a module there or picklable."""
    _OPENERS[name.lower().strip()] = opener


def names() -> list[str]:
    return sorted(_OPENERS)


def opener(name: str) -> Callable[..., Session]:
    key = name.lower().strip()
    key = ALIASES.get(key, key)
    if key not in _OPENERS:
        raise NotConfigured(f"Unknown provider '{name}'. Known: {', '.join(names())}")
    return _OPENERS[key]


ANSWERS = "content string, state string, input_tokens long, output_tokens long, model string"


def ask(requests: DataFrame, provider: str, lanes: int = LANES, **options) -> DataFrame:
    """(doc_id, request, attempt, content, state, input_tokens, output_tokens, model) for requests (doc_id, request, attempt, prompt).

    A lane's session answers in the order of documents, requests and attempts.
    """
    open_session = opener(provider)
    keys = ["doc_id", "request", "attempt"]
    rows = requests.select(F.pmod(F.xxhash64("doc_id", "request"), F.lit(lanes)).cast("int").alias("lane"), *keys, "prompt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, session = None, None
        try:
            for pdf in batches:
                out = []
                for at, *key, prompt in pdf.itertuples(index=False, name=None):
                    if at != lane:
                        if session:
                            session.close()
                        lane, session = at, open_session(**options)
                    a = session.complete(prompt or "", "/".join(map(str, key)))
                    out.append((a.content, a.state, a.input_tokens, a.output_tokens, a.model))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pdf[keys].assign(content=list(cols[0]), state=list(cols[1]), input_tokens=list(cols[2]), output_tokens=list(cols[3]), model=list(cols[4]))
        finally:
            if session:
                session.close()

    kinds = dict(rows.dtypes)
    dealt = rows.repartition(min(lanes, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "lane").sortWithinPartitions("lane", *keys)
    return dealt.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ANSWERS)


def asking(provider: str, lanes: int = LANES, **options) -> Callable[[DataFrame], DataFrame]:
    """A provider for plans.attempts."""
    return lambda requests: ask(requests, provider, lanes, **options).select("doc_id", "request", "state", "content")


def send_all(requests: DataFrame, send: Callable[[dict], Reply], unsupported: Callable[[str], bool] = lambda body: False, lane: str = "lane", key: str = "id", feature: str = "response_format") -> DataFrame:
    """(lane, id, nth, attempt, category, waited, probed): every try of requests (lane, id, payload), payload a JSON object, in the order of ids.

    nth counts the tries of a request over both the probe with the feature and
    the request without it; waited is what a real line would wait, here nothing.
    """
    rows = requests.select(lane, key, "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, latch = None, None
        for pdf in batches:
            out = []
            for here, one, payload in pdf.itertuples(index=False, name=None):
                if here != at:
                    at, latch = here, Latch(Line(send, wait=lambda _: None, unsupported=unsupported), feature)
                body, was_off = json.loads(payload), latch.off
                try:
                    latch.post(body)
                except RequestFailed:
                    pass
                probed, nth = not was_off and feature in body, 0
                for attempt, category, waited in latch.line.taken():
                    probed = probed and (nth == 0 or attempt > 1)
                    out.append((here, one, nth + 1, attempt, category, waited, probed))
                    nth += 1
            yield pd.DataFrame(out, columns=[lane, key, "nth", "attempt", "category", "waited", "probed"])

    kinds = dict(rows.dtypes)
    dealt = rows.repartition(lane).sortWithinPartitions(lane, key)
    return dealt.mapInPandas(run, f"{lane} {kinds[lane]}, {key} {kinds[key]}, nth int, attempt int, category string, waited int, probed boolean")
