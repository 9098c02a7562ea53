"""Quality grades by ordinal regression with cumulative links on hashed text.

A rating has grades 0 < 1 < ... < K-1. One vector of weights over hashed features of the text gives
a document's score s, and ordered thresholds t(1) < ... < t(K-1), shared by all, cut the scale:
P(grade >= k) = sigmoid(s - t(k)). The expected grade is the sum of these tails; the uppermost tail
selects. The labels table gives three grades: quality plus 1 for a text that isn't toxic.

The fit takes at most `max_labelled` labelled rows, those of the least hash of doc_id and text among the documents that
have a label; the weights have a fixed size, and scoring reads all documents whole. A word's features are its
letters in lower case, their beginnings of four and five, and its other characters; rates of repeated
neighbours, bars, marks of noise and repeated lines are features too. A feature counts with the square root of the
number of different words that have it. Weights of either sign are shrunk towards 0 by a fixed amount a step.

Cases: a null or empty text has score 0; labels with nulls are not used; a document with several different labels is
used with each, equal ones and equal rows count once; without any usable label all weights are 0 and the
thresholds their first values; repeated rows are scored alike; a tail of exactly `keep_from` is kept; very long
texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

DIMENSIONS = 1 << 18
MAX_LABELLED = 12_000
SCHEMA = "doc_id long, score double, expected_grade double, tail_probability double, kept boolean"
#: Words whose features a worker remembers; a speed matter only.
CACHE_WORDS = 1_000_000


def _slot(kind: bytes, value: bytes) -> int:
    return xxhash.xxh64_intdigest(value, kind[0]) % DIMENSIONS


def word_features(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace")
    letters = "".join(c for c in text if c.isalpha()).lower()
    marks = "".join(c for c in text if not c.isalnum())
    out = []
    if letters:
        raw = letters.encode()
        out.append(_slot(b"w", raw))
        if len(letters) > 4:
            out.append(_slot(b"4", letters[:4].encode()))
        if len(letters) > 5:
            out.append(_slot(b"5", letters[:5].encode()))
    if marks:
        out.append(_slot(b"m", marks.encode()))
    return tuple(out)


def document_words(text: bytes) -> tuple[set[bytes], list[int]]:
    """The different words of a text, and the slots of its rates.

    Rates are of words that equal their neighbour, are bars alone, or end in a mark of noise, and of lines
    that repeat; each is a feature for its power of two.
    """
    words = text.split()
    if not words:
        return set(), []
    lines = [x for x in text.split(b"\n") if x]
    ends = [w[-1:] for w in words]
    counts = (
        (sum(map(bytes.__eq__, words, words[1:])), len(words)),
        (words.count(b"|"), len(words)),
        (sum(map(ends.count, (b"%", b"&", b"$", b"#", b"*"))), len(words)),
        (len(lines) - len(set(lines)), len(lines)),
    )
    return set(words), [_RATES[i][min(9, int(np.log2(n / c)))] for i, (c, n) in enumerate(counts) if c]


_RATES = [[_slot(b"r", b"%d:%d" % (i, k)) for k in range(10)] for i in range(4)]


def features(text: bytes) -> list[int]:
    """Slots of a text, once for each different word that has a feature."""
    words, rates = document_words(text)
    return [s for w in words for s in word_features(w)] + rates


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one column each."""
        return _sigmoid(score[:, None] - self.thresholds)


def fit(rows: list[tuple[np.ndarray, int]], grades: int, dimensions: int = DIMENSIONS, steps: int = 1200, batch: int = 128, rate: float = 0.5, l1: float = 0.006, seed: int = 0) -> OrdinalModel:
    """Adaptive proximal gradient steps on the likelihood, in whole passes over the rows. The slots that occur are numbered anew, and a step costs
    what its rows' slots do."""
    w, t = np.zeros(dimensions, np.float32), np.linspace(-2.0, -1.0, grades - 1)
    if not rows:
        return OrdinalModel(w, t)
    counted = [np.unique(s, return_counts=True) for s, _ in rows]
    used, number = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
    value = np.sqrt(np.concatenate([c[1] for c in counted]))
    many = np.array([len(c[0]) for c in counted])
    first = np.cumsum(many) - many
    weight, seen, seen_t = np.zeros(len(used)), np.full(len(used), 1e-4), np.full(len(t), 1e-4)
    rng = np.random.default_rng(seed)
    y = np.array([r[1] for r in rows])
    for _ in range(-(-steps * batch // len(rows))):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            part = order[a : a + batch]
            n = many[part]
            row = np.repeat(np.arange(len(part)), n)
            at = np.repeat(first[part] - np.cumsum(n) + n, n) + np.arange(len(row))
            slot, x = number[at], value[at]
            s = np.bincount(row, weight[slot] * x, len(part))
            cut = _sigmoid(np.concatenate([[-np.inf], t, [np.inf]])[None, :] - s[:, None])
            k, line = y[part], np.arange(len(part))
            above, below = cut[line, k + 1], cut[line, k]
            chance = np.maximum(above - below, 1e-12)
            by = slot.argsort(kind="stable")
            slot = slot[by]
            starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
            if len(starts):
                own = slot[starts]
                g = np.add.reduceat(((above + below - 1)[row] * x)[by], starts) / len(part)
                seen[own] += g * g
                step = rate / np.sqrt(seen[own])
                new = weight[own] + step * g
                weight[own] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            gt = np.array([(np.where(k == c, above * (1 - above) / chance, 0) - np.where(k == c + 1, below * (1 - below) / chance, 0)).sum() / len(part) for c in range(len(t))])
            seen_t += gt * gt
            t = np.sort(t + rate / np.sqrt(seen_t) * gt)
    w[used] = weight
    return OrdinalModel(w, t)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def labelled_features(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple[np.ndarray, int]]:
    """Feature rows of the labelled sample, whose size is bounded by max_labelled."""
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    usable = usable.select(F.col("doc_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    found = named.select("doc_id", "h").join(usable, "doc_id").distinct()  # names alone are shuffled
    sample = found.orderBy("h", "doc_id", "grade").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int32())), batch.column(2)], names=["slots", "grade"])

    # At most max_labelled short rows are sent to every executor.
    joined = named.join(F.broadcast(sample), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "grade"]).select("doc_id", "text", "grade")
    table = joined.mapInArrow(run, "slots array<int>, grade int").toArrow()
    rows = [(np.array(s, np.int32), g) for s, g in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[1], len(r[0]), r[0].tobytes()))  # one order, however the rows came
    return rows


def score_documents(docs: DataFrame, model: OrdinalModel, keep_from: float = 0.5) -> DataFrame:
    """Score, expected grade, upper tail and the selection of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = model.weights.tolist()
        telling: dict[bytes, tuple[int, ...]] = {}  # a word's slots with a weight; most words have none
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                if len(telling) > CACHE_WORDS:
                    telling.clear()
                scores = []
                for text in text_bytes(batch.column(1)):
                    words, rates = document_words(text)
                    for x in words.difference(telling):
                        telling[x] = tuple(s for s in word_features(x) if weight[s])
                    found = Counter(s for x in words if (own := telling[x]) for s in own)
                    found.update(s for s in rates if weight[s])
                    scores.append(sum(weight[s] * sqrt(n) for s, n in sorted(found.items())))
                s = np.array(scores, float)
                tails = model.tails(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_from)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def grade_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep_from: float = 0.5) -> DataFrame:
    """Fit on the labelled sample, then score all documents."""
    return score_documents(docs, fit(labelled_features(docs, labels, max_labelled), 3), keep_from)
