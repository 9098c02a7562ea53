"""Repeated byte strings from suffix arrays by external induced sorting.

Contexts that may hold a repeat come from `repeats`, which loses none. A block of them is sorted by
`induced.suffix_order`: disk-backed queues carry suffix tuples with their common prefixes, at every level of its
recursion. Suffixes that share `window` bytes stand next to each other; where such a run has two places,
each of its suffixes starts a repeated string.

Each byte that such a string covers is removed. Strings are judged on the input, so all places of a
repeat lose it. Removal may cut a character's bytes; `kept` is bytes for that reason.

Cases: a null text is empty; a text shorter than a window is kept whole; repeated rows count as two
places; very long texts are read whole; matches never cross documents; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .induced import suffix_order
from .repeats import HOT, Block, Search, Units, apply_stretches, named, stretches

WINDOW, ANCHOR = 200, 32
SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def by_suffixes(window: int, memory: int = 128 << 20):
    """A decision for `repeats`: which bytes of a block start a repeated string of window bytes."""

    def decide(block: Block, units: Units) -> np.ndarray:
        n, contexts = len(units.joined), len(block.first) - 1
        # Contexts one after another with a symbol between them that no text has.
        text = np.zeros(n + contexts, np.uint16)
        owner_of = np.zeros(n + contexts, np.int32)
        shifted = np.arange(n) + units.owner
        text[shifted] = np.frombuffer(units.joined, np.uint8).astype(np.uint16) + 1
        owner_of[shifted] = units.owner
        owner_of[block.first[1:] + np.arange(contexts)] = np.arange(contexts)
        # Places from which a window may start: few suffixes are looked at further.
        may = np.zeros(n + contexts, bool)
        may[shifted] = np.arange(n) + window <= block.first[units.owner + 1]
        sa, common = suffix_order(text, window, memory)
        # Suffixes that share the first window bytes have one number; those that start a window are kept.
        group = np.cumsum(common < window)
        valid = may[sa]
        spot, group = sa[valid].astype(np.int64), group[valid]
        owner = owner_of[spot]
        at = spot - owner
        hit = np.zeros(n, bool)
        if len(at):
            run = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            often = np.repeat(block.repeated(at, run, owner), np.diff(np.append(run, len(at))))
            hit[at[often]] = True
        return hit

    return decide


def _keep(text: bytes, spans: list[list[int]]) -> tuple[int, int, int, str, bytes]:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    joined = b"".join([*kept, text[at:]])
    return len(text), len(text) - len(joined), len(spans), hashlib.sha256(joined).hexdigest(), joined


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, memory: int = 128 << 20, hot: int = HOT) -> DataFrame:
    """A row for each document: its bytes, how many went in how many stretches, and what stays."""
    texts = named(docs)
    search = Search(window, anchor, words=False)
    return apply_stretches(texts, stretches(texts, search, by_suffixes(window, memory), hot), _keep, SCHEMA)
