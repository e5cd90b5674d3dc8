"""Stopping between two steps, when the process is asked to end."""

from __future__ import annotations

import logging
import signal
import threading

from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger("actlens")


class StopOnSignal:
    """While open, an interrupt or a request to end only sets ``stop``; a writer looks at it before its next shard.

    Outside of the main thread, where Python allows no handlers, ``stop`` may be set by hand.
    """

    def __init__(self) -> None:
        self.stop = False
        self._before: dict[int, object] = {}

    def __enter__(self) -> StopOnSignal:
        if threading.current_thread() is threading.main_thread():
            self._before = {s: signal.signal(s, self._ask) for s in (signal.SIGINT, signal.SIGTERM)}
        return self

    def _ask(self, number: int, _frame: object) -> None:
        log.warning("signal %s: stops after what is being written", number)
        self.stop = True

    def __exit__(self, *_error: object) -> None:
        for number, handler in self._before.items():
            signal.signal(number, handler)

    def follow(self, query: StreamingQuery, seconds: float = 1.0) -> None:
        """Waits for a stream, and stops it when asked to; its checkpoint lets it go on later."""
        while not query.awaitTermination(seconds):
            if self.stop:
                query.stop()
                return
