"""Progress and timing of a program's steps, by ``logging``."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("cartolith")


@contextmanager
def step(name: str) -> Iterator[None]:
    """Logs the start and the end of a step, with its seconds."""
    begin = time.perf_counter()
    log.info("%s ...", name)
    try:
        yield
    finally:
        log.info("%s: %.1f s", name, time.perf_counter() - begin)
