"""State that a Python worker keeps from task to task."""

import sys
import types
from collections.abc import Callable
from typing import Any


_KEPT = 8


def worker_cached(key: Any, make: Callable[[], Any]) -> Any:
    """What `make` returned for this key in this worker process; the newest few keys are
    kept. Functions sent with a job get fresh globals in every task, so the cache hangs
    on a module of its own."""
    held = vars(sys.modules.setdefault("_guestlens_worker", types.ModuleType("_guestlens_worker")))
    cache = held.setdefault("cache", {})
    if key not in cache:
        while len(cache) >= _KEPT:
            del cache[next(iter(cache))]
        cache[key] = make()
    return cache[key]
