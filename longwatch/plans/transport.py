"""Sending one request over an unreliable line: capped backoff, and a latch that turns a feature off.

Both are small state machines of one session; Spark gives each lane of requests
a session of its own (see providers). What is sent, how long is waited and what
time it is are functions, so that a script can stand for a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from longwatch.operators.findings import Rejected, strict_loads

# HTTP states that are worth another try, and how often.
RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504)
ATTEMPTS, CONNECT_ATTEMPTS, LONGEST_WAIT = 3, 1, 8

# Categories of failures on the line; the last two mean that no connection came about.
NETWORK = {"read_timeout": "read timeout", "write_timeout": "write timeout", "pool_timeout": "pool timeout", "timeout": "timeout", "network": "network error", "connect_timeout": "connect timeout", "connect": "connection failure"}
CONNECTING = ("connect_timeout", "connect")


@dataclass(frozen=True)
class Reply:
    """What came back: a state and a body, or the name of a failure on the line."""

    status: int = 200
    body: str = ""
    line: str | None = None


class RequestFailed(Exception):
    """A request that was given up. Its text holds no word of the provider's."""

    def __init__(self, category: str, retryable: bool, attempts: int, unsupported: bool = False):
        super().__init__(f"{category} ({'retryable' if retryable else 'non-retryable'}) after {attempts} attempt(s)")
        self.category, self.retryable, self.attempts, self.unsupported = category, retryable, attempts, unsupported


def backoff(attempt: int) -> int:
    """Seconds to wait after so many attempts: 1, 2, 4 and 8 at most."""
    return min(2 ** (attempt - 1), LONGEST_WAIT)


@dataclass
class Line:
    """Sends payloads; log holds (attempt, category, seconds waited after it) of all that was tried since it was last taken."""

    send: Callable[[dict], Reply]
    wait: Callable[[float], None] = time.sleep
    attempts: int = ATTEMPTS
    connect_attempts: int = CONNECT_ATTEMPTS
    unsupported: Callable[[str], bool] = lambda body: False
    log: list[tuple[int, str, int]] = field(default_factory=list)

    def post(self, payload: dict) -> dict:
        """The JSON object that comes back, or RequestFailed.

        Failures on the line and the states of RETRYABLE_STATUS are tried again;
        where no connection came about, only as often as connect_attempts. Any
        other state of 400 or more, and a body that is no JSON object, end at once.
        """
        for attempt in range(1, max(1, self.attempts) + 1):
            reply = self.send(payload)
            if reply.line is None and reply.status < 400:
                data = self._object(reply.body)
                if data is None:
                    self._gave_up(attempt, "unexpected response", False)
                self.log.append((attempt, "ok", 0))
                return data
            if reply.line is None and reply.status not in RETRYABLE_STATUS:
                self._gave_up(attempt, f"HTTP {reply.status}", False, reply.status == 400 and self.unsupported(reply.body))
            category = NETWORK.get(reply.line, NETWORK["network"]) if reply.line else f"HTTP {reply.status}"
            most = self.connect_attempts if reply.line in CONNECTING else self.attempts
            if attempt >= max(1, most):
                self._gave_up(attempt, category, True)
            self.log.append((attempt, category, backoff(attempt)))
            self.wait(backoff(attempt))
        raise AssertionError("unreachable")

    def _gave_up(self, attempt: int, category: str, retryable: bool, unsupported: bool = False):
        self.log.append((attempt, category, 0))
        raise RequestFailed(category, retryable, attempt, unsupported)

    @staticmethod
    def _object(body: str) -> dict | None:
        try:
            data = strict_loads(body, unique_keys=False)
        except Rejected:
            return None
        return data if isinstance(data, dict) else None

    def taken(self) -> list[tuple[int, str, int]]:
        log, self.log = self.log, []
        return log


@dataclass
class Latch:
    """A line that asks with a feature until the other side says that it does not know it, and without it ever after."""

    line: Line
    feature: str
    off: bool = False

    def post(self, payload: dict) -> dict:
        if self.off or self.feature not in payload:
            return self.line.post({k: v for k, v in payload.items() if k != self.feature})
        try:
            return self.line.post(payload)
        except RequestFailed as e:
            if not e.unsupported:
                raise
            self.off = True
        return self.line.post({k: v for k, v in payload.items() if k != self.feature})


def scripted(payload: dict) -> Reply:
    """Answers by the payload's own script, one entry a try, for tests and rehearsals.

    A number is a state and what follows it a body, ok an empty object, probe a
    refusal of response_format where it is asked for and else ok; any other name
    is a failure on the line. Beyond the script all is ok.
    """
    script = payload.get("script") or []
    what, _, body = (script.pop(0) if script else "ok").partition(" ")
    if what == "probe":
        return Reply(400, json.dumps({"error": {"message": "Unknown parameter: 'response_format'."}})) if "response_format" in payload else Reply(body="{}")
    if what == "ok":
        return Reply(body=body or "{}")
    return Reply(int(what), body) if what.isdigit() else Reply(line=what)


def names_response_format(body: str) -> bool:
    """Whether a refusal names the feature."""
    return "response_format" in body
