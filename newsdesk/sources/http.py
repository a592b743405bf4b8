"""Fetching with state: conditional requests, errors by kind, retries, and the cache of what servers said.

A transport opens one connection; it is given (tests and other protocols bring their own) and defaults to the standard library's. TLS
certificates are always verified unless a policy allows an unverified second try after a TLS error.
"""

from __future__ import annotations

import builtins
import os
import random
import ssl
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib import error, request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.urls import host
from ..storage import stored
from .lanes import HELD, Pace, dealt, side_by_side
from .snapshots import Store

CACHE = "url string, etag string, last_modified string"
AGENT = "newsdesk"


@dataclass(frozen=True)
class Reply:
    body: str | None
    status: int
    etag: str | None = None
    last_modified: str | None = None


Transport = Callable[[str, dict, float, bool], Reply]


def over_network(url: str, headers: dict, timeout: float, relaxed: bool) -> Reply:
    """One request. A status other than success is a reply as well; what keeps it from being made raises OSError."""
    context = ssl.create_default_context()
    if relaxed:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    try:
        with request.urlopen(request.Request(url, headers=headers), context=context, timeout=timeout) as r:
            return Reply(r.read().decode("utf-8", "replace"), r.status, r.headers.get("ETag"), r.headers.get("Last-Modified"))
    except error.HTTPError as e:
        return Reply(None, e.code)


def error_status(e: BaseException) -> int:
    """The status below zero of an error, by ``fixed.ERRORS``: the first kind whose type or phrase it has."""
    said, kind = str(e).lower(), type(e).__name__.lower()
    for status, types, phrases in fixed.ERRORS:
        if isinstance(e, tuple(getattr(builtins, t) for t in types)) or any(p in said for p in phrases) or (status == fixed.TIMED_OUT and "timeout" in kind):
            return status
    return fixed.UNKNOWN_ERROR


@dataclass(frozen=True)
class Fetcher:
    """attempts: tries in all, min(2 ** k * 2, 30) seconds and up to one more apart. unverified: after a TLS error try once without verification.

    final: statuses after which there is no other try. waits: seconds before the next try after a status. keys: headers by the names that
    the environment has for their values, looked up where the request is made, so that no key is pickled.
    """

    transport: Transport = over_network
    timeout: float = 20.0
    attempts: int = 3
    unverified: bool = False
    pause: Callable[[float], None] = time.sleep
    headers: dict = field(default_factory=lambda: {"User-Agent": AGENT})
    final: frozenset[int] = frozenset()
    waits: dict[int, float] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, **options) -> Fetcher:
        """With the seconds that RSS_TIMEOUT names."""
        return cls(timeout=float(os.environ.get("RSS_TIMEOUT", "20")), **options)

    def once(self, url: str, etag: str | None = None, last_modified: str | None = None) -> Reply:
        """304 brings back what was known; an error is a status below zero."""
        headers = self.headers | {h: os.environ[name] for h, name in self.keys.items() if name in os.environ}
        if etag:
            headers["If-None-Match"] = etag
        if last_modified:
            headers["If-Modified-Since"] = last_modified
        relaxed = False
        while True:
            try:
                reply = self.transport(url, headers, self.timeout, relaxed)
            except (OSError, ValueError) as e:
                status = error_status(e)
                if status == -5 and self.unverified and not relaxed:
                    relaxed = True
                    continue
                return Reply(None, -5 if relaxed else status)
            return Reply(None, 304, etag, last_modified) if reply.status == 304 else reply

    def __call__(self, url: str, etag: str | None = None, last_modified: str | None = None) -> Reply:
        for k in range(self.attempts):
            reply = self.once(url, etag, last_modified)
            if reply.body is not None or reply.status == 304 or reply.status in self.final or k == self.attempts - 1:
                return reply
            self.pause(self.waits[reply.status] if reply.status in self.waits else min(2**k * 2, 30) + random.random())
        raise ValueError("no attempts")


def fetched(urls: DataFrame, cache: DataFrame | None, fetch: Fetcher, delay: float = 0.0, lanes: int | None = None, at_once: int = 4) -> DataFrame:
    """urls (url, any other columns) with body, status, etag and last_modified.

    Requests run side by side, ``at_once`` in each of ``lanes`` tasks. With a ``delay`` a host's pages are in one lane and are fetched one
    after the other, at least so many seconds apart, so that no host is hurried.
    """
    known = cache if cache is not None else urls.sparkSession.createDataFrame([], CACHE)
    asked = urls.join(known.select(F.col("url").alias("__url"), F.col("etag").alias("__etag"), F.col("last_modified").alias("__modified")), F.col("url") == F.col("__url"), "left").drop("__url")
    placed = asked.withColumn("__host", host(F.col("url")))
    key, names = ("__host" if delay > 0 else "url"), urls.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(delay, pause=fetch.pause)

        def one(row: tuple[str, str, str | None, str | None]) -> Reply:
            pace.wait(row[1])
            return fetch(row[0], row[2] or None, row[3] or None)

        for whole in batches:
            for k in range(0, len(whole), HELD * at_once):
                b = whole.iloc[k : k + HELD * at_once]
                rows = list(zip(b["url"], b["__host"], b["__etag"], b["__modified"], strict=True))
                replies = side_by_side(one, rows, at_once, (lambda r: r[1]) if delay > 0 else None)
                added = {c: pd.Series([getattr(r, c) for r in replies], index=b.index, dtype="int64" if c == "status" else object) for c in ("body", "status", "etag", "last_modified")}
                yield b.assign(**added)[[*names, "body", "status", "etag", "last_modified"]]

    return dealt(placed, F.col(key), lanes).mapInPandas(each, ", ".join(f"`{n}` {t}" for n, t in urls.dtypes) + ", body string, status int, etag string, last_modified string")


def renewed(cache: DataFrame, replies: DataFrame) -> DataFrame:
    """The cache after a fetch: what the replies say of their urls wins, urls that failed keep what was known.

    What they say is stored first, as it is looked at twice and every look would ask the servers again.
    """
    said = stored(replies.where("body IS NOT NULL AND (etag IS NOT NULL OR last_modified IS NOT NULL)").select("url", "etag", "last_modified"), "said")
    return cache.join(said.select("url"), "url", "left_anti").unionByName(said)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache kept there; an empty one where there is none or it can't be read."""
    return Store(spark, path).read("cache", CACHE, ignoreCorruptFiles=True)


def save_cache(cache: DataFrame, path: str) -> None:
    """Replace what is kept there as a whole: a new version of its store."""
    store = Store(cache.sparkSession, path)
    store.update(lambda _: ({"cache": cache.select("url", "etag", "last_modified")}, {}, {}))
    store.expire()


def renew_cache(replies: DataFrame, path: str) -> None:
    """Put what the replies say into the cache kept there, whichever version that is when it is written."""
    store = Store(replies.sparkSession, path)
    store.update(lambda base: ({"cache": renewed(store.read("cache", CACHE, base, ignoreCorruptFiles=True), replies)}, {}, {}))
    store.expire()
