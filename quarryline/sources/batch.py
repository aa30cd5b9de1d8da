"""A buffer of write operations that are committed together."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from ..config import BatchConfig


class BatchCommitter:
    """Collects operations and hands them to `commit` in one call when there are max_ops of them, when
    they have max_rows rows, or max_wait_ms after the first (checked by `tick` and `enqueue`). While a
    call runs, new operations queue up; if it fails, its operations go back to the front."""

    def __init__(self, commit: Callable[[list], None], config: BatchConfig | None = None, clock: Callable[[], float] = time.monotonic):
        self.commit, self.config, self.clock = commit, config or BatchConfig(), clock
        self.queue: list[tuple[object, int]] = []
        self.since: float | None = None
        self.lock, self.flushing = threading.RLock(), False

    def enqueue(self, operation, rows: int = 1) -> None:
        with self.lock:
            self.queue.append((operation, rows))
            self.since = self.clock() if self.since is None else self.since
        self.tick()

    @property
    def size(self) -> int:
        return len(self.queue)

    def due(self) -> bool:
        late = self.since is not None and (self.clock() - self.since) * 1000 >= self.config.max_wait_ms
        return bool(self.queue) and (late or len(self.queue) >= self.config.max_ops or sum(r for _, r in self.queue) >= self.config.max_rows)

    def tick(self) -> None:
        if self.due():
            self.flush()

    def flush(self) -> int:
        """Commits what is queued; gives the number of operations."""
        with self.lock:
            if self.flushing or not self.queue:
                return 0
            taken, self.queue, self.since, self.flushing = self.queue, [], None, True
        try:
            self.commit([op for op, _ in taken])
            return len(taken)
        except Exception:
            with self.lock:
                self.queue, self.since = taken + self.queue, self.clock()
            raise
        finally:
            self.flushing = False

    def clear(self) -> int:
        with self.lock:
            n, self.queue, self.since = len(self.queue), [], None
            return n
