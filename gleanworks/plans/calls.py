"""Calls of a scorer from one task: some at a time, with retries and one pause for all after a rate limit."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from ..functions.parsing import RATE_LIMIT_MARKS, RETRY_DELAYS, pause_seconds

#: Takes prompts, returns raw responses; None for a failed call.
Scorer = Callable[[list[str]], list[str | None]]
MAX_ATTEMPTS, CONCURRENCY, BASE_DELAY = 2, 10, 1.0


def is_rate_limit(error: Exception) -> bool:
    said = f"{error}\n{type(error).__name__}".lower()
    return any(mark in said for mark in RATE_LIMIT_MARKS)


def wait_hint(error: Exception) -> float | None:
    """Seconds that an error asks to wait."""
    for pattern in RETRY_DELAYS:
        found = re.search(pattern, str(error), re.IGNORECASE)
        if found:
            return float(found.group(1))
    return None


class Pause:
    """Whoever meets a rate limit makes all calls of the worker wait; waits grow until a call succeeds."""

    def __init__(self, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.sleep, self.now = sleep, now
        self.lock, self.until, self.strikes = threading.Lock(), 0.0, 0

    def wait(self) -> None:
        left = self.until - self.now()
        if left > 0:
            self.sleep(left)

    def hit(self, error: Exception) -> float:
        with self.lock:
            self.strikes += 1
            seconds = pause_seconds(wait_hint(error), self.strikes)
            self.until = max(self.until, self.now() + seconds)
            return seconds

    def clear(self) -> None:
        with self.lock:
            self.strikes = 0


@dataclass
class Call:
    """What one prompt took: its response or last error, milliseconds and retries."""

    response: str | None
    ms: float
    retries: int
    error: str | None


def ask(scorer: Scorer, prompts: list[str], attempts: int = MAX_ATTEMPTS, concurrency: int = CONCURRENCY, base_delay: float = BASE_DELAY, pause: Pause | None = None) -> list[Call]:
    """One ``Call`` per prompt, in order, ``concurrency`` of them at a time.

    An attempt that fails waits ``base_delay`` doubled each time, after a rate limit for
    the worker's pause, which costs no attempt of its own beyond the first.
    """
    pause = pause or Pause()

    def one(prompt: str) -> Call:
        start, said = time.monotonic(), None
        for attempt in range(attempts):
            pause.wait()
            try:
                response = scorer([prompt])[0]
            except Exception as error:  # noqa: BLE001 - a scorer may raise anything; its rows fail, not the job
                said = f"{type(error).__name__}: {error}"
                if attempt + 1 < attempts:
                    if is_rate_limit(error):
                        pause.hit(error)
                    else:
                        pause.sleep(base_delay * 2**attempt)
                continue
            pause.clear()
            if response is not None:
                return Call(response, (time.monotonic() - start) * 1000, attempt, None)
            said = "no response"
        return Call(None, (time.monotonic() - start) * 1000, attempts - 1, said)

    if concurrency < 2 or len(prompts) < 2:
        return [one(p) for p in prompts]
    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(one, prompts))
