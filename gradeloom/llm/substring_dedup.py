"""Repeated word sequences by level-wise doubling.

Words are numbered by what they are. A window of words is known by the numbers of its two halves, so two have one
number only if they are equal. Windows of the first length (single words) that occur once are dropped; those that
are left are extended to twice the length (the last step overlaps, so as to end at exactly the wanted
length), and so on until the wanted length is reached or none is left. Candidates come from `repeats`, which
loses none.

Each word that a repeated window covers is removed. Windows are judged on the input, so all places of a
repeat lose it, the first one included.

Cases: a null text has no words, and an empty or blank one neither; a text of fewer words than a window is
kept whole; repeated rows count as two places, so they lose all that a window covers; very long texts and words
are read whole, long texts in pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import HOT, PIECE_BYTES, Block, Search, Units, apply_stretches, named, stretches, words_at_a_time

#: Words of a window, and of the part of it by which `repeats` finds candidates.
WINDOW, ANCHOR = 35, 9
SCHEMA = "n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts value, and the first of each run of equal values in it."""
    order = np.argsort(value, kind="stable")
    inorder = value[order]
    return order, np.flatnonzero(np.concatenate([[True], inorder[1:] != inorder[:-1]]))


def doubling(last: int):
    """A decision for `repeats`: which units of a block start a repeated window of `last` units."""

    def decide(block: Block, units: Units) -> np.ndarray:
        n = len(units.hashes)
        number = np.full(n, -1, np.int64)  # of the window that starts here, if it is still a candidate
        table: dict[bytes, int] = {}
        value = np.fromiter((table.setdefault(x, len(table)) for x in units.joined.split(b" ")), np.int64, n) if n else number
        at, length = np.arange(n), 1
        while len(at):
            order, run = _runs(value)
            often = block.repeated(at[order], run, units.owner[at[order]])
            group = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(at))))
            stay = often[group]
            at, group = at[order][stay], group[stay]
            if length == last:
                hit = np.zeros(n, bool)
                hit[at] = True
                return hit
            number[:] = -1
            number[at] = group
            step = min(2 * length, last) - length
            length += step
            at = np.sort(at)
            at = at[at + step < n]
            at = at[(number[at + step] >= 0) & (units.owner[at] == units.owner[at + step])]
            value = number[at] << 32 | number[at + step]
        return np.zeros(n, bool)

    return decide


def _keep(text: bytes, spans: list[list[int]]) -> tuple[int, int, int, str, str]:
    digest, kept, at, n_kept = hashlib.sha256(), [], 0, 0
    ends = iter([*spans, [None, None]])
    low, high = next(ends)
    for words in words_at_a_time(text, PIECE_BYTES):
        here, end = 0, at + len(words)
        while here < len(words):
            if low is None or at + here < low:
                stop = len(words) if low is None else min(low - at, len(words))
                part = b" ".join(words[here:stop])
                digest.update(b" " + part if n_kept else part)
                kept.append(part)
                n_kept += stop - here
            else:
                stop = min(high - at, len(words))
            here = stop
            if low is not None and at + here >= high:
                low, high = next(ends)
        at = end
    return at, at - n_kept, len(spans), digest.hexdigest(), b" ".join(kept).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """A row for each document: its number of words, how many went, and the text that stays."""
    texts = named(docs)
    search = Search(window, anchor, words=True)
    return apply_stretches(texts, stretches(texts, search, doubling(window), hot), _keep, SCHEMA)
