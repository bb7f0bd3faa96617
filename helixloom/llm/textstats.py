"""Counts of whole texts: words, characters, symbols, repeated lines and repeated three-word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import blocks

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_BEGINS_CHAR = np.ones(256, bool)
_BEGINS_CHAR[128:192] = False

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def _lines(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: lines with a word, and those equal to an earlier one."""
    n, total, again = len(edges) - 1, [], []
    data = raw.tobytes()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        lines = [x for x in data[a:b].split(b"\n") if x and not x.isspace()]
        total.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    assert len(total) == n
    return np.array(total, np.int64), np.array(again, np.int64)


def _repeated(hashes: np.ndarray, edges: np.ndarray, width: int = 3) -> np.ndarray:
    """Of each document the words in ``width``-word windows that it has twice or more."""
    out = np.zeros(len(edges) - 1, np.int64)
    if len(hashes) < width:
        return out
    every = blocks.Runs(hashes).of(np.arange(len(hashes) - width + 1), width)
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b - a <= width:
            continue
        mine = every[a : b - width + 1]
        order = np.argsort(mine, kind="stable")
        ranked = mine[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(mine), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(b - a, bool)
        for j in range(width):
            covered[j : j + len(mine)] |= twice
        out[k] = covered.sum()
    return out


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``FIELDS`` of each text of a column; a null text counts as empty."""
    parts: dict[str, list[np.ndarray]] = {f: [] for f in FIELDS}
    for block in blocks.blocks(column):
        lines, again = _lines(block.raw, block.edges)
        inside = ~blocks.SPACE[block.raw]
        for name, values in (
            ("n_words", np.diff(block.word_edges)),
            ("word_chars", _per_doc(inside & _BEGINS_CHAR[block.raw], block.edges)),
            ("n_symbols", _per_doc(_IS_SYMBOL[block.raw], block.edges)),
            ("n_dup_lines", again),
            ("n_repeat_words", _repeated(blocks.word_hashes(block), block.word_edges)),
            ("n_lines", lines),
            ("n_upper", _per_doc(_IS_UPPER[block.raw], block.edges)),
        ):
            parts[name].append(values)
    return {f: np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for f, p in parts.items()}
