"""Word, line and character statistics of a whole text, shared by the quality operators.

Words are maximal runs of anything but the six ASCII white-space characters. Everything is counted over the whole text.
"""

from __future__ import annotations

import string

import numpy as np

SYMBOLS = "#*$%&|<>"
_UPPER = string.ascii_uppercase.encode()
_LETTERS = string.ascii_letters.encode()
_ENDS = (b".", b"!", b"?", b'"', b")", b":", b";")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window whose words occur in that order twice or more, first one included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pair = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:  # keep the three-word code inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    code = pair[:-1] * size + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def text_stats(text: str | None) -> dict[str, int]:
    """Counts over one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, n_bytes = len(words), len(raw)
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_distinct": len(set(words)),
        "n_adjacent": sum(map(bytes.__eq__, words, words[1:])),
        "n_upper": n_bytes - len(raw.translate(None, _UPPER)),
        "n_letters": n_bytes - len(raw.translate(None, _LETTERS)),
        "n_bangs": text.count("!"),
        "n_pipes": text.count("|"),
        "n_digits": sum(map(text.count, "0123456789")),
        "n_ended_lines": sum(x.rstrip().endswith(_ENDS) for x in lines),
        "n_commas": text.count(",") + text.count("."),
    }

