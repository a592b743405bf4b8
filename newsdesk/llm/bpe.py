"""Byte-level BPE encoding and decoding with recursive queries in DuckDB.

Each Python worker holds one in-memory database with the vocabulary and the merge table derived from its ranks: (left, right) ids
whose joined bytes are a token. The distinct pieces of a batch are laid out as token-position rows; the recursive query joins
neighbours with the merge table and contracts, in every piece, the leftmost pair of minimum rank, until no piece has a pair left.
As a recursive query keeps the rows of all its rounds, one run of it makes about ``ROWS`` rows at most; the next run goes on from the
last round's rows. Before that, pieces are cut where no token of the vocabulary crosses (merges make tokens only, so none crosses there).

A part of n bytes takes up to n rounds that way, which is as many rows as its square; so a round of a part of ``LONG`` bytes and more
contracts all pairs that the one-by-one rule is bound to contract as they are:

- every pair that has no lower rank, and no equal one before it, within twice the longest token that the part has: whatever is merged
  earlier grows tokens from a lower rank, and no token reaches from there to this pair, nor to what it grows into;
- if no longer token around the one of lowest rank has a still lower rank, all pairs of that rank from the left, every second one where
  they overlap: nothing that comes of one of them goes before the next.

The leftmost pair of minimum rank is always among them. Rounds then grow with the logarithm of the length or the number of ranks, and a
round's rows fall; a database gets ``BYTE`` bytes of memory for every byte of its longest part beside its own.

Decoding joins the ids of whole documents with the vocabulary and aggregates their bytes in order, ``RUN`` ids in one group at most.

Defined results: a null text counts as empty and has no ids; repeated rows each get their ids; a very long text is encoded whole, by
distinct chunks; an empty table gives an empty result; strings of special tokens are ordinary text; extra columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache, chunk_of
from .memory import release

#: Rows of one run of the recursive query: a memory bound.
ROWS = 1_200_000
#: Bytes from which on a piece is cut first; below, its few rounds cost less than looking for cuts. The ids are the same.
CUT = 24
#: Bytes from which on a part is contracted at many places in a round, and bytes of memory for each of its bytes.
LONG, BYTE = 64, 320
#: MB of a database's memory, without what long parts need.
MEMORY = 250
#: Ids decoded as one group, and ids decoded in one query: memory bounds.
RUN, AT_ONCE = 100_000, 500_000
#: Chunks encoded at once, so that a round's fixed cost (the merge table is hashed in each) is shared by many pieces: a memory bound.
BATCH = 30_000
#: Pieces kept per worker beside the chunks: a memory bound.
KEPT_PIECES = 20_000
_coders: dict[str, Coder] = {}

ENCODE = """
WITH RECURSIVE t(step, piece, pos, id) AS (
    SELECT 0, piece, pos, id FROM start
    UNION ALL (
        WITH near AS (
            SELECT step, piece, pos, id, CASE WHEN lead(piece) OVER w = piece THEN lead(pos * 4294967296 + id) OVER w END AS after
            FROM t WHERE step < ? WINDOW w AS (ORDER BY piece, pos)
        ), best AS (
            SELECT piece, min(merged::BIGINT * 4294967296 + pos) AS chosen, arg_min(after // 4294967296, merged::BIGINT * 4294967296 + pos) AS gone
            FROM near JOIN merges ON near.id = merges.l AND near.after % 4294967296 = merges.r GROUP BY piece
        )
        SELECT step + 1, piece, pos, CASE WHEN pos = chosen % 4294967296 THEN (chosen // 4294967296)::INTEGER ELSE id END
        FROM near JOIN best USING (piece) WHERE pos <> gone
    )
), ended AS (SELECT piece, max(step) AS step FROM t GROUP BY piece)
SELECT piece, step, list(id ORDER BY pos) AS ids FROM t JOIN ended USING (piece, step) GROUP BY piece, step ORDER BY piece
"""
MANY = """
WITH RECURSIVE t(step, piece, pos, id) AS (
    SELECT 0, piece, pos, id FROM start
    UNION ALL (
        WITH near AS (
            SELECT step, piece, pos, id, lead(id) OVER (PARTITION BY piece ORDER BY pos) AS next_id FROM t WHERE step < $steps
        ), ranked AS (
            SELECT step, piece, pos, id, coalesce(merged, 2147483647) AS rank, coalesce(safe, false) AS safe
            FROM near LEFT JOIN merges ON near.id = merges.l AND near.next_id = merges.r
        ), placed AS (
            SELECT *, min(rank) OVER (w ROWS BETWEEN $reach PRECEDING AND 1 PRECEDING) AS low_before, min(rank) OVER (w ROWS BETWEEN 1 FOLLOWING AND $reach FOLLOWING) AS low_after,
                rank < 2147483647 AND safe AND rank = min(rank) OVER (PARTITION BY piece) AS lowest, row_number() OVER w AS k
            FROM ranked WINDOW w AS (PARTITION BY piece ORDER BY pos)
        ), islands AS (
            SELECT *, k - max(CASE WHEN NOT lowest THEN k ELSE 0 END) OVER (PARTITION BY piece ORDER BY k) AS nth FROM placed
        ), chosen AS (
            SELECT step, piece, pos, id, rank, k, rank < 2147483647 AND ((rank < coalesce(low_before, 2147483647) AND rank <= coalesce(low_after, 2147483647)) OR (lowest AND nth % 2 = 1)) AS chosen FROM islands
        ), moved AS (
            SELECT *, coalesce(lag(chosen) OVER (PARTITION BY piece ORDER BY k), false) AS gone, bool_or(chosen) OVER (PARTITION BY piece) AS goes_on FROM chosen
        )
        SELECT step + 1, piece, pos, CASE WHEN chosen THEN rank ELSE id END FROM moved WHERE goes_on AND NOT gone
    )
), ended AS (SELECT piece, max(step) AS step FROM t GROUP BY piece)
SELECT piece, step, list(id ORDER BY pos) AS ids FROM t JOIN ended USING (piece, step) GROUP BY piece, step ORDER BY piece
"""
DECODE = "SELECT part, list(token ORDER BY pos) AS tokens FROM ids JOIN vocabulary USING (id) GROUP BY part ORDER BY part"


class Coder:
    """A vocabulary and its database in one worker process."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = ((self.ranks.get(t[:k]), self.ranks.get(t[k:]), r) for t, r in self.ranks.items() for k in range(1, len(t)))
        self.starts = {t[:k] for t in self.ranks for k in range(2, len(t) + 1)}
        #: left, right and merged id of every pair of tokens that join to a token
        self.rows = np.array([x for x in cuts if None not in x], np.int32)
        #: tokens that no longer token around them comes before
        self.safe = np.ones(len(self.ranks), bool)
        for side in (0, 1):
            self.safe[self.rows[self.rows[:, 2] < self.rows[:, side], side]] = False
        self.db = None
        self.cache = ChunkCache(self.encode_chunks, 1, 800_000, 6 << 20, BATCH)
        self.known_pieces: dict[bytes, bytes] = {}

    def open(self) -> None:
        """A database with the merge table and the vocabulary, for one task."""
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        self._load("merges", l=self.rows[:, 0], r=self.rows[:, 1], merged=self.rows[:, 2], safe=self.safe[self.rows[:, 2]])
        by_id = sorted((r, t) for t, r in self.ranks.items())
        self._load("vocabulary", id=np.array([r for r, _ in by_id], np.int32), token=[t for _, t in by_id])

    def close(self) -> None:
        """What is known stays for the worker's next task, the database goes."""
        self.db.close()
        self.db = None
        self.known_pieces = {}
        release()

    def _load(self, table: str, **columns) -> None:
        rows = pa.table({k: pa.array(v) for k, v in columns.items()})
        self.db.register("loaded", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def _parts(self, piece: bytes) -> list[bytes]:
        """The piece cut where no token crosses; the longest token of long parts is noted."""
        if len(piece) < CUT or piece in self.ranks:
            return [piece]
        n, reach, begin, out, longest = len(piece), 0, 0, [], 1
        for i in range(n):
            if i and reach <= i:
                out.append(piece[begin:i])
                begin = i
            j = i + 2
            while j <= n and (x := piece[i:j]) in self.starts:
                if x in self.ranks:
                    reach, longest = max(reach, j), max(longest, j - i)
                j += 1
        self.longest = max(self.longest, longest)
        return [*out, piece[begin:]]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        self.longest = 1
        cut = list(map(self._parts, pieces))
        parts = sorted({p for x in cut for p in x})
        made = dict(zip(parts, self._encode_parts(parts), strict=True))
        return [b"".join(made[p] for p in x) for x in cut]

    def _encode_parts(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = list(map(self.single.get, pieces))
        left = [k for k, x in enumerate(out) if x is None]
        left.sort(key=lambda k: len(pieces[k]))  # alike lengths end after alike rounds
        most = len(pieces[left[-1]]) if left else 0
        if most >= LONG:
            self.db.execute(f"SET memory_limit = '{MEMORY + most * BYTE // 1_000_000}MB'")
        for part in self._batches(left, pieces):
            todo = {k: self.byte_ids[np.frombuffer(pieces[k], np.uint8)] for k in part}
            while todo:
                steps = max(1, ROWS // sum(map(len, todo.values())))
                ids = self._rounds(list(todo.values()), steps, len(pieces[part[0]]) >= LONG)
                ended = {}
                for k, (step, x) in zip(list(todo), ids, strict=True):
                    if step < steps:
                        ended[k] = out[k] = x.tobytes()
                    todo[k] = x
                todo = {k: x for k, x in todo.items() if k not in ended}
        if most >= LONG:
            self.db.execute(f"SET memory_limit = '{MEMORY}MB'")
        return out

    def _rounds(self, ids: list[np.ndarray], steps: int, many: bool) -> list[tuple[int, np.ndarray]]:
        """For each piece's ids the rounds it took, ``steps`` at most, and its ids after them."""
        n = np.array(list(map(len, ids)))
        flat = np.concatenate(ids)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self._load("start", piece=np.repeat(np.arange(len(ids), dtype=np.int32), n), pos=pos.astype(np.int32), id=flat.astype(np.int32))
        # frames are part of a query's text
        query = MANY.replace("$reach", str(2 * self.longest + 4)).replace("$steps", str(steps)) if many else ENCODE.replace("?", str(steps))
        got = self.db.sql(query).to_arrow_table()
        lists = got.column("ids").combine_chunks()
        values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy().tolist()
        return [(s, values[i:j]) for s, i, j in zip(got.column("step").to_pylist(), ends[:-1], ends[1:], strict=True)]

    @staticmethod
    def _batches(which: list[int], pieces: list[bytes]) -> Iterator[list[int]]:
        """Batches whose rounds together make about ``ROWS`` rows (a piece of n bytes makes up to n * n / 2), long ones by themselves."""
        part, rows = [], 0
        for k in which:
            n = len(pieces[k])
            if part and (len(pieces[part[0]]) >= LONG) != (n >= LONG):
                yield part
                part, rows = [], 0
            part.append(k)
            rows += n**2 // 2 if n < LONG else 16 * n
            if rows > ROWS:
                yield part
                part, rows = [], 0
        if part:
            yield part

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """Bytes of each text's ids; an id without a token gives a KeyError."""
        runs = [(k, x[i : i + 4 * RUN]) for k, x in enumerate(texts) for i in range(0, len(x), 4 * RUN)]
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for at, run in enumerate(runs):
            held.append(run)
            size += len(run[1]) // 4
            if size >= AT_ONCE or at == len(runs) - 1:
                for (k, _), x in zip(held, self._decode_runs([r for _, r in held]), strict=True):
                    out[k].append(x)
                held, size = [], 0
        return list(map(b"".join, out))

    def _decode_runs(self, runs: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(runs), "<u4")
        if ids.max() >= len(self.ranks):
            raise KeyError(int(ids.max()))
        n = np.array([len(x) // 4 for x in runs], np.int64)
        self._load("ids", part=np.repeat(np.arange(len(runs), dtype=np.int32), n), pos=np.arange(len(ids), dtype=np.int64), id=ids.astype(np.int32))
        lists = self.db.sql(DECODE).to_arrow_table().column("tokens").combine_chunks()
        # the tokens of a list lie one after the other
        tokens, ends = lists.values.cast(pa.large_binary()), lists.offsets.to_numpy()
        at = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][ends].tolist()
        raw = memoryview(tokens.buffers()[2] or b"")
        return [bytes(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]

    def encode_chunks(self, keys: list[str]) -> list[bytes]:
        """Ids of each key's chunk."""
        cut = [[p.encode() for p in self.pieces(chunk_of(k))] for k in keys]
        distinct = sorted({p for x in cut for p in x}.difference(self.known_pieces))
        if len(self.known_pieces) > KEPT_PIECES:
            distinct = sorted({p for x in cut for p in x})
            self.known_pieces = {}
        self.known_pieces.update(zip(distinct, self.encode_pieces(distinct), strict=True))
        return [b"".join(self.known_pieces[p] for p in x) for x in cut]

    def round_trips(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each whole text and the bytes decoded from them; null counts as empty."""
        held, size = [], 0
        for (ids,) in self.cache.parts(texts):
            held.append(ids)
            size += len(ids) // 4
            if size >= AT_ONCE:
                yield from zip(held, self.decode(held), strict=True)
                held, size = [], 0
        yield from zip(held, self.decode(held), strict=True)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def forget(path: str) -> None:
    """Drop the worker's coder and all it knows."""
    own = _coders.pop(path)
    own.cache = None
    own.close()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded bytes of every whole text.

    As a stage among others: what a task knows goes with the task, so that idle workers leave the memory to the next stage.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        own.open()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                made = list(own.round_trips(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.binary())], ["doc_id", "ids", "decoded"])
        del own
        forget(path)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes; the bytes stay in the worker that made them."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        own.open()
        for b in batches:
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()) for x, y in own.round_trips(b.column("text"))]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
