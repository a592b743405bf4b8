"""Fetching as a stream: every micro-batch is a round of conditional requests, and a round that is run again gives the same replies.

The offset of a round is its number. What a lane of it was told is written to the state folder before the first row leaves the task, and
only the first attempt's file counts; a restarted query reads it instead of asking again, so that a sink that writes a batch once gets
every reply once. What servers said of their pages (etag, last-modified) is kept by lane and round: the state after round n is made of
the state before it and round n's replies, both of which never change, by whichever task needs it first. Nothing of it passes the driver.

The state folder is a path or uri that pyarrow's file systems reach, the same from all executors. Replies without a body (unchanged, or
failed with a status below zero) are rows as well, from which the counts of a scan come; :func:`articles` gives none for them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.urls import article_id
from ..sources.feeds import explode_items
from ..sources.http import Fetcher
from ..sources.lanes import side_by_side

REPLY = "round long, url string, status int, body string, etag string, last_modified string"


class Folder:
    """Files that are created once, as a whole, and never changed."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return [f.base_name for f in found if not f.base_name.startswith(".")]

    def read(self, name: str) -> list[dict] | None:
        """The rows of a file; None without one."""
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return [json.loads(line) for line in f.read().decode().splitlines()]
        except FileNotFoundError:
            return None

    def create(self, name: str, rows: list[dict]) -> None:
        """A file of these rows, unless there is one already."""
        folder, _, last = f"{self.root}/{name}".rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        beside = f"{folder}/.{last}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(beside) as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        if isinstance(self.fs, fs.LocalFileSystem):
            try:
                os.link(beside, f"{folder}/{last}")
            except FileExistsError:
                pass
            os.unlink(beside)
        elif self.fs.get_file_info(f"{folder}/{last}").type == fs.FileType.NotFound:
            self.fs.move(beside, f"{folder}/{last}")
        else:
            self.fs.delete_file(beside)

    def remove(self, name: str) -> None:
        target = f"{self.root}/{name}"
        if self.fs.get_file_info(target).type == fs.FileType.Directory:
            self.fs.delete_dir(target)


@dataclass
class Lane(InputPartition):
    """Some of the urls in one round; after: the round before it."""

    after: int
    round: int
    lane: int


class RoundSource(DataSource):
    """spark.readStream.format("newsdesk_rounds"): options state (folder), urls (separated by white space), lanes, at_once.

    Subclass and set ``fetch`` to a picklable :class:`Fetcher`, and register the subclass; the library itself opens no connection. The
    number of lanes is kept in the state folder with the first round.
    """

    fetch: Fetcher | None = None

    @classmethod
    def name(cls) -> str:
        return "newsdesk_rounds"

    def schema(self) -> str:
        return REPLY

    def streamReader(self, schema) -> DataSourceStreamReader:
        if type(self).fetch is None:
            raise ValueError("RoundSource needs a fetcher")
        return _Rounds(self.options["state"], self.options.get("urls", "").split(), int(self.options.get("lanes", "8")), int(self.options.get("at_once", "4")), type(self).fetch)


class _Rounds(DataSourceStreamReader):
    def __init__(self, state: str, urls: list[str], lanes: int, at_once: int, fetch: Fetcher) -> None:
        self.state, self.urls, self.lanes, self.at_once, self.fetch = state, sorted(set(urls)), lanes, at_once, fetch

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """A new round; one that no batch comes to use does no harm."""
        folder = Folder(self.state)
        new = max(map(int, folder.names("rounds")), default=0) + 1
        folder.create(f"rounds/{new}/planned", [])
        return {"round": new}

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        if start == end:
            return []
        folder = Folder(self.state)
        folder.create("lanes", [{"n": self.lanes}])
        folder.create(f"rounds/{end['round']}/after", [{"round": start["round"]}])
        return [Lane(start["round"], end["round"], k) for k in range(folder.read("lanes")[0]["n"])]

    def read(self, partition: Lane) -> Iterator[tuple]:
        folder = Folder(self.state)
        name = f"rounds/{partition.round}/{partition.lane}"
        said = folder.read(name)
        if said is None:
            known = self._known(folder, partition.after, partition.lane)
            lanes = folder.read("lanes")[0]["n"]
            mine = [u for u in self.urls if crc32(u.encode()) % lanes == partition.lane]
            replies = side_by_side(lambda u: self.fetch(u, *known.get(u, (None, None))), mine, self.at_once)
            folder.create(name, [{"url": u, **vars(r)} for u, r in zip(mine, replies, strict=True)])
            said = folder.read(name)
        for r in said:
            yield (partition.round, r["url"], r["status"], r["body"], r["etag"], r["last_modified"])

    def _known(self, folder: Folder, at: int, lane: int) -> dict[str, tuple[str | None, str | None]]:
        """What a lane's servers had said after a round; it is kept where it isn't yet."""
        if at == 0:
            return {}
        kept = folder.read(f"known/{at}/{lane}")
        if kept is None:
            before = self._known(folder, folder.read(f"rounds/{at}/after")[0]["round"], lane)
            said = {r["url"]: (r["etag"], r["last_modified"]) for r in folder.read(f"rounds/{at}/{lane}") if r["body"] is not None and (r["etag"] or r["last_modified"])}
            folder.create(f"known/{at}/{lane}", [{"url": u, "etag": e, "last_modified": m} for u, (e, m) in {**before, **said}.items()])
            kept = folder.read(f"known/{at}/{lane}")
        return {r["url"]: (r["etag"], r["last_modified"]) for r in kept}

    def commit(self, end: dict) -> None:
        """Forget the rounds before this one; the state after the one before it stays, as this round's state is made of it."""
        folder = Folder(self.state)
        after = folder.read(f"rounds/{end['round']}/after")
        for r in folder.names("rounds") if after else []:
            if int(r) < end["round"]:
                folder.remove(f"rounds/{r}")
        for r in folder.names("known") if after else []:
            if int(r) < after[0]["round"]:
                folder.remove(f"known/{r}")


def articles(replies: DataFrame) -> DataFrame:
    """feed, pos, id and the items of the replies that have a body."""
    items = explode_items(replies.where("body IS NOT NULL").select(F.col("url").alias("feed"), F.col("body").alias("xml")))
    return items.withColumn("id", article_id(F.col("link")))


