"""Transcripts of videos from a service that wants a key and limits how often it is asked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import is_video, video_id
from . import enrich, http

#: A video without a transcript isn't asked for again; a service that is asked too often gets three seconds.
MISSING, TOO_OFTEN, WAIT = 404, 429, 3.0
WATCH = "https://www.youtube.com/watch?v="


def service(fetch: http.Fetcher) -> http.Fetcher:
    """A fetcher as the service needs it: its key from the environment, a minute's time, and what its statuses mean."""
    return replace(fetch, timeout=60.0, final=frozenset({MISSING}), waits={TOO_OFTEN: WAIT}, keys={"x-api-key": fixed.TRANSCRIPT_KEY})


def configured(env: Mapping[str, str] = os.environ) -> bool:
    return bool(env.get(fixed.TRANSCRIPT_KEY))


def with_transcripts(articles: DataFrame, fetch: http.Fetcher, base: str = fixed.TRANSCRIPT_URL, delay: float = 1.0, most: int = 3000, **lanes) -> DataFrame:
    """articles with transcript: of those whose url is a video's that the service has one for; null elsewhere.

    Each video is asked for once, however many articles show it, ``delay`` seconds after the one before.
    """
    marked = articles.withColumn("__video", F.when(is_video(F.col("url")), video_id(F.col("url"))))
    videos = marked.where("__video IS NOT NULL").select("__video").distinct()
    asked = videos.select(F.col("__video").alias("__id"), F.concat(F.lit(f"{base}?url="), F.url_encode(F.concat(F.lit(WATCH), F.col("__video"))), F.lit("&text=true")).alias("url"))
    said = http.fetched(asked, None, service(fetch), delay, **lanes)
    texts = said.select("__id", enrich.transcript(F.col("status"), F.col("body"), most).alias("transcript"))
    return marked.drop("transcript").join(texts, F.col("__video") == F.col("__id"), "left").drop("__video", "__id")
