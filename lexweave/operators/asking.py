"""Many requests to a slow service: under way at the same time, within a rate, again where it may help, answers in order."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Executor, Future

#: Replies of a service that is busy rather than unwilling.
BUSY = (408, 409, 425, 429, 500, 502, 503, 504)
#: Seconds before the second attempt, which double with each, and the longest wait.
FIRST_WAIT, LONGEST_WAIT = 0.5, 60.0


def in_order(pool: Executor, ask: Callable, prompts: Iterable, ahead: int) -> Iterator:
    """ask(prompt) for each prompt, in order, with no more than `ahead` handed to the pool at a time."""
    waiting: deque[Future] = deque()
    for prompt in prompts:
        if len(waiting) >= ahead:
            yield waiting.popleft().result()
        waiting.append(pool.submit(ask, prompt))
    while waiting:
        yield waiting.popleft().result()


class RateBudget:
    """At most `per_second` turns a second, dealt to threads one after another; without a rate every turn is free."""

    def __init__(self, per_second: float | None):
        self.gap = 1.0 / per_second if per_second else 0.0
        self.next, self.lock = 0.0, threading.Lock()

    def turn(self) -> None:
        """Wait for the next turn."""
        if not self.gap:
            return
        with self.lock:
            start = max(self.next, time.monotonic())
            self.next = start + self.gap
        time.sleep(max(0.0, start - time.monotonic()))

    def hold(self, seconds: float) -> None:
        """No turn for so long: the service has asked for it."""
        if self.gap:
            with self.lock:
                self.next = max(self.next, time.monotonic() + seconds)


def wait_before(error: Exception, attempt: int) -> float | None:
    """Seconds to wait after a failed attempt (from 1); None where another one won't help."""
    code = getattr(error, "code", None)
    asked = getattr(error, "headers", None)
    if code is not None and code not in BUSY or code is None and not isinstance(error, (OSError, TimeoutError)):
        return None
    try:
        least = float((asked or {}).get("Retry-After") or 0)
    except ValueError:  # a date
        least = 0.0
    return min(LONGEST_WAIT, max(least, FIRST_WAIT * 2 ** (attempt - 1) * random.uniform(0.5, 1.0)))


def retrying(ask: Callable[[str, str], str], attempts: int, budget: RateBudget) -> Callable[[str, str], str]:
    """ask() within the budget, again after a wait that doubles, up to `attempts` times in all."""

    def run(system: str, user: str) -> str:
        for attempt in range(1, attempts + 1):
            budget.turn()
            try:
                return ask(system, user)
            except Exception as error:
                wait = wait_before(error, attempt)
                if wait is None or attempt == attempts:
                    raise
                if getattr(error, "code", None) == 429:
                    budget.hold(wait)
                time.sleep(wait)
        raise ValueError("attempts must be 1 or more")

    return run
