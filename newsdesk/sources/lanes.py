"""Calls of the outside world side by side: lanes across tasks, threads inside of a task, and a pace for each host.

Rows are dealt into lanes by the hash of a key, a partition each that adaptive execution doesn't merge, however few bytes they are; inside
of a lane a pool of threads makes so many calls at once. So ``lanes * at_once`` calls run at once at most, as far as the cluster has the
cores, and rows of one key never run in two lanes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T, R = TypeVar("T"), TypeVar("R")
#: Rows that a task works on before it hands them on, for each call at once: a memory bound.
HELD = 32


def dealt(rows: DataFrame, key: Column, lanes: int | None = None) -> DataFrame:
    """rows in as many partitions as there are lanes (by default the cluster's cores), those of equal keys in one."""
    n = lanes or rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionById(n, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


class Pace:
    """A bucket of tokens for each host: ``burst`` of them at first, one more every ``delay`` seconds; a call takes one, or waits for it."""

    def __init__(self, delay: float, burst: int = 1, pause: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.delay, self.burst, self.pause, self.clock = delay, burst, pause, clock
        self.held: dict[Hashable, tuple[float, float]] = {}

    def wait(self, host: Hashable) -> None:
        if self.delay <= 0:
            return
        now = self.clock()
        tokens, at = self.held.get(host, (float(self.burst), now))
        tokens = min(float(self.burst), tokens + (now - at) / self.delay)
        if tokens < 1:
            self.pause((1 - tokens) * self.delay)
            now, tokens = now + (1 - tokens) * self.delay, 1.0
        self.held[host] = (tokens - 1, now)


def side_by_side(call: Callable[[T], R], items: Iterable[T], at_once: int, group: Callable[[T], Hashable] | None = None) -> list[R]:
    """The results in the items' order. Items of one group (if there is a grouping) are called one after the other, others at once."""
    listed = list(items)
    groups: dict[Hashable, list[int]] = {}
    for k, item in enumerate(listed):
        groups.setdefault(k if group is None else group(item), []).append(k)
    out: list[R | None] = [None] * len(listed)

    def run(places: list[int]) -> None:
        for k in places:
            out[k] = call(listed[k])

    if at_once <= 1 or len(groups) <= 1:
        for places in groups.values():
            run(places)
    else:
        with ThreadPoolExecutor(min(at_once, len(groups))) as pool:
            for done in [pool.submit(run, places) for places in groups.values()]:
                done.result()
    return out
