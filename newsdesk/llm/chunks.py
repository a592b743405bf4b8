"""Cutting texts where no byte-level BPE piece can cross, so that each distinct chunk is encoded once while a worker keeps it.

In the public pre-tokenizer pattern a piece holds white space only at its start (one space before letters, digits or symbols) or
is white space alone. A space or newline that stands between two non-white characters therefore always begins a new piece, and
the text before it is split into pieces as if it stood alone. Cuts are only made there.

A full stop or comma between a Latin letter and white space begins and ends a piece as well.

A chunk is named by a key: what follows its space; itself if it begins with a newline; or ``RAW`` or ``STOP`` and itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RAW, STOP = "\x00", "\x01"
_STOPS = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,]) "
_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)")



#: Texts that don't have single spaces and newlines between words only, or that hold ``RAW`` or ``STOP``.
_ODD = (
    r"[\x00\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
)


def keys_of(text: str) -> list[str]:
    """Keys of chunks whose concatenation is ``text``, with no assumption on its white space."""
    return [RAW + x for x in _CUT.split(text) if x]


def plain_keys(texts: pa.Array) -> pa.ListArray:
    """Keys of texts that are not odd; all but the first hold no white space but a newline at the start."""
    spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _STOPS, rf"\1 {STOP}\2 ")
    return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(RAW), spaced, pa.scalar("")), " ")


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts of so many bytes at most, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield texts.slice(a, b - a)
        a = b


def chunk_of(key: str) -> str:
    return key[1:] if key[0] <= STOP else key if key[0] == "\n" else " " + key


class ChunkCache:
    """What ``encode`` makes of the chunks of keys (a byte string, or a tuple of ``columns`` of them), computed in batches.

    at_once: bytes of text that are cut together. kept: known chunks. batch: chunks encoded together; all three bound memory and don't limit what is encoded. Chunks are held in Arrow arrays and looked up by joining
    the distinct keys of a slice with them, so only new chunks become Python objects. Beyond the bound the chunks met least often
    go, with counts that are halved each time.
    """

    def __init__(self, encode: Callable[[list[str]], list], columns: int, kept: int, at_once: int, batch: int = 12_000) -> None:
        self.encode = encode
        self.kept = kept
        self.at_once = at_once
        self.batch = batch
        self.keys = pa.array([], pa.string())
        self.values = [pa.array([], pa.large_binary()) for _ in range(columns)]
        self.met = np.zeros(0, np.int32)

    def _codes(self, keys: pa.Array) -> np.ndarray:
        """Each distinct key's place among the known chunks, after the new ones have been added."""
        at = pc.index_in(keys, value_set=self.keys)
        new = pc.is_null(at)
        places = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        is_new = np.asarray(new.to_numpy(zero_copy_only=False), bool)
        if is_new.any():
            added = keys.filter(new)
            missing = added.to_pylist()
            made: list = []
            for k in range(0, len(missing), self.batch):
                made += self.encode(missing[k : k + self.batch])
            columns = zip(*made, strict=True) if len(self.values) > 1 else [made]
            self.values = [pa.concat_arrays([old, pa.array(list(x), pa.large_binary())]) for old, x in zip(self.values, columns, strict=True)]
            places[is_new] = len(self.keys) + np.arange(len(missing))
            self.keys = pa.concat_arrays([self.keys, added])
            self.met = np.concatenate([self.met, np.zeros(len(missing), np.int32)])
        self.met[places] += 1
        return places

    def _shrink(self) -> None:
        if len(self.keys) > self.kept:
            stay = np.sort(np.argpartition(-self.met, self.kept * 2 // 3)[: self.kept * 2 // 3])
            self.keys = self.keys.take(pa.array(stay))
            self.values = [v.take(pa.array(stay)) for v in self.values]
            self.met = self.met[stay] // 2

    def _joined(self, lists: pa.ListArray) -> list[tuple[bytes, ...]]:
        """Each list's values, joined."""
        coded = lists.flatten().dictionary_encode()
        places = pa.array(self._codes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)])
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        out = []
        for column in self.values:
            taken = column.take(places)
            starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends].tolist()
            raw = memoryview(taken.buffers()[2] or b"")
            out.append([bytes(raw[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)])
        self._shrink()
        return list(zip(*out, strict=True))

    def parts(self, texts: pa.Array) -> Iterator[tuple[bytes, ...]]:
        """For each whole text, each column's byte strings of its chunks, joined; null counts as empty."""
        for part in slices(texts.fill_null("") if texts.null_count else texts, self.at_once):
            odd = pc.match_substring_regex(part, _ODD)
            which = np.asarray(odd.to_numpy(zero_copy_only=False), bool)
            plain = iter(self._joined(plain_keys(part.filter(pc.invert(odd)))) if not which.all() else [])
            rest = iter(self._joined(pa.array([keys_of(t) for t in part.filter(odd).to_pylist()], pa.list_(pa.string()))) if which.any() else [])
            for x in which:
                yield next(rest) if x else next(plain)
            pa.default_memory_pool().release_unused()
