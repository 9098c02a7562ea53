"""Repeated stretches of a fixed length over all documents: the search that two operators share.

A text is a row of units (words, or bytes). Wanted is every window of `window` units that starts at two
places or more, in one document or in several. Rows for all windows would be many times the input, so:

1. Anchors. In every window the part of `anchor` units with the least hash is chosen, the first of equals. The
   choice depends on the window's content alone, so equal windows choose equal anchors at the same
   offset: no repeat is lost, while only about 2 in (window - anchor + 2) positions are anchors. Parts
   that merely hash alike cost work and change nothing.
2. Anchors that occur once are dropped, counted with partial sums over all documents.
3. The context of an anchor is what the windows that choose it hold. Equal contexts are collapsed before
   any text moves: one stands for all, with their number, so a group of copies costs one context. They are
   known by 128 bits of a hash of what they hold.
4. Contexts are dealt out by anchor and decided in blocks by the operator's own method, on what they hold
   and not on hashes. What it finds for a context holds for all places that have it, and goes back to the
   documents as stretches.

An anchor with more than `hot` different contexts (a passage that very many documents share has them at its
edges) would make one task large. Such an anchor is split by the units beside it: a window that holds the anchor has
r units to its right, so it's dealt to one of `WAYS` ranges of r, and there by the units that all windows of the
range hold (so many to the left, so many to the right). What is still hot is split again; at single values
of r the units are the whole window, so equal ones are one. The operator's method decides all of them.

A document is named by 128 bits of hashes of its doc_id and text throughout; two rows that agree in both
share the name and count as two places. A very long text is read in pieces that overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, releasing, slices, text_bytes, written

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Enough for the places in a text; the rest of a hash orders parts.
_PLACE_BITS = 31
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
#: Bytes that are hashed in one go, and context bytes that are decided in one block.
CHUNK_UNITS, BLOCK_UNITS = 1 << 19, 3 << 19
#: Text of a batch that is held as separate objects at once, and of a long text that is read at once.
SLICE_BYTES, PIECE_BYTES = 4_000_000, 4_000_000
#: Different contexts of one anchor beyond which they are split by the units beside it, and into how many ranges.
HOT, WAYS = 200, 4
#: Bytes of a word that are hashed in columns; longer words are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, from the 0th to the nth at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(2 * n, 1 << 20)
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x))]) for x in (_ODD, _ODD_INVERSE))
    return _powers


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which range_hash reads the hash of any range of values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(len(values))[0][: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The hash of values[low:high]; equal ranges have equal hashes, wherever they are."""
    return (prefix[high] - prefix[low]) * _power_table(len(prefix))[1][low]


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of size values."""
    n = len(prefix) - size
    return mix((prefix[size:] - prefix[:n]) * _power_table(len(prefix))[1][:n])


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least (or greatest) value of each stretch of width values."""
    out, size, n = values, 1, len(values) - width + 1
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[:n], out[width - size : width - size + n])


@dataclass
class Units:
    """Texts cut into units: their hashes, and where they lie.

    joined holds the units as they are, words with one blank between, so equal ranges of units are equal bytes.
    """

    hashes: np.ndarray
    owner: np.ndarray  # text of each unit
    first: np.ndarray  # number of each text's first unit, and one more for the end
    starts: np.ndarray  # byte at which a unit starts, in joined
    ends: np.ndarray
    joined: bytes


def cut_bytes(texts: list[bytes]) -> Units:
    joined = b"".join(texts)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    at = np.arange(len(joined))
    return Units(_BYTE_HASH[np.frombuffer(joined, np.uint8)], np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first)), first, at, at + 1, joined)


def word_hashes(joined: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word; eight bytes at a time are mixed in, so no pattern of letters cancels out."""
    eight = np.ndarray((len(joined) + 1,), "<u8", joined + b"\0" * 8, strides=(1,))

    def part(items: np.ndarray, at: int) -> np.ndarray:
        left = np.minimum(sizes[items] - at, 8).astype(np.uint64)
        keep = np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left)
        return eight[starts[items] + at] & keep

    out = mix(part(slice(None), 0) ^ sizes.astype(np.uint64) * _ODD) if len(starts) else np.zeros(0, np.uint64)
    items, at = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD)), 8
    while len(items):
        out[items] = mix(out[items] * _ODD ^ part(items, at))
        at += 8
        items = items[sizes[items] > at]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : starts[i] + sizes[i]])
    return out


def units_of_words(words: list[bytes], first: np.ndarray) -> Units:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return Units(word_hashes(joined, ends - sizes, sizes), np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)), first, ends - sizes, ends, joined)


def cut_words(texts: list[bytes]) -> Units:
    words: list[bytes] = []
    first = [0]
    for t in texts:
        words += t.split()
        first.append(len(words))
    return units_of_words(words, np.array(first))


def _bytes_at_a_time(text: bytes, size: int) -> Iterator[bytes]:
    for a in range(0, len(text), size):
        yield text[a : a + size]


_GAP = re.compile(rb"[ \t-\r]")


def words_at_a_time(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, those of about `size` bytes at once."""
    at = 0
    while at < len(text):
        m = _GAP.search(text, min(at + size, len(text)))
        end = m.end() if m else len(text)
        yield text[at:end].split()
        at = end


@dataclass(frozen=True)
class Search:
    """What is looked for: windows of `window` units chosen by anchors of `anchor` units; units are words or bytes."""

    window: int
    anchor: int
    words: bool
    piece: int = PIECE_BYTES

    @property
    def least_bytes(self) -> int:
        """A text with fewer bytes has no window."""
        return 2 * self.window - 1 if self.words else self.window

    def cut(self, texts: list[bytes]) -> Units:
        return cut_words(texts) if self.words else cut_bytes(texts)

    def pieces(self, text: bytes) -> Iterator[tuple[int, int, Units]]:
        """A long text in pieces: (number of the first unit, windows that start in it, its units).

        A piece goes on into the next ones by a window less one unit, so each window is whole in one piece.
        """
        more = self.window - 1
        parts = words_at_a_time(text, self.piece) if self.words else _bytes_at_a_time(text, self.piece)
        held, at = next(parts, b""), 0
        for part in parts:
            if len(part) < more:
                held += part
                continue
            whole = held + part[:more]
            yield at, len(held), self._units(whole)
            at += len(held)
            held = part
        if len(held) > more:
            yield at, len(held) - more, self._units(held)

    def _units(self, whole) -> Units:
        return units_of_words(whole, np.array([0, len(whole)])) if self.words else cut_bytes([whole])

    def read(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Units]]:
        """(texts, number of each one's first unit here, windows that start in each, units) of the texts that can
        hold a window: short ones in groups of about CHUNK_UNITS bytes, a long one in pieces."""
        held, size = [], 0

        def group() -> tuple[np.ndarray, np.ndarray, np.ndarray, Units]:
            u = self.cut([texts[j] for j in held])
            return np.array(held), np.zeros(len(held), np.int64), np.maximum(np.diff(u.first) - self.window + 1, 0), u

        for i, t in enumerate(texts):
            if len(t) > self.piece:
                for at, n, u in self.pieces(t):
                    yield np.array([i]), np.array([at]), np.array([n]), u
            elif len(t) >= self.least_bytes:
                held.append(i)
                size += len(t)
                if size >= CHUNK_UNITS:
                    yield group()
                    held, size = [], 0
        if held:
            yield group()

    def anchors(self, u: Units, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each anchor: its hash, its context (first unit, one behind the last), its text, how far in the
        anchor stands, and how many windows the context holds. windows: how many start in each text."""
        w, k = self.window, self.anchor
        if len(u.hashes) < w:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        prefix = prefix_hash(u.hashes)
        part = window_hash(prefix, k)
        span = w - k + 1
        # The upper bits order parts, the lower ones name the place: the least is the first of the least.
        placed = part >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(part), dtype=np.uint64)
        chosen = (_sliding(placed, span, np.minimum) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        own = u.owner[: len(chosen)]
        chosen[np.arange(len(chosen)) - u.first[own] >= windows[own]] = -1  # not within one text, or another piece's
        # The windows that choose an anchor are neighbours.
        low = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        starts = np.diff(np.append(low, len(chosen)))
        some = chosen[low] >= 0
        low, starts = low[some], starts[some]
        at = chosen[low]
        return part[at], low, low + starts + w - 1, u.owner[low], at - low, starts


@dataclass
class Block:
    """Contexts to decide together: units one after another, each context with its place and number."""

    first: np.ndarray  # where each context's units start, and one more for the end
    place: np.ndarray  # hash of where it stands in its document
    count: np.ndarray  # how many places have it

    def repeated(self, at: np.ndarray, run: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which runs of equal windows, in order at, have two places. run: first of each run."""
        where = self.place[owner] + (at - self.first[owner]).astype(np.uint64)
        many = np.maximum.reduceat(self.count[owner], run) > 1
        return many | (np.minimum.reduceat(where, run) != np.maximum.reduceat(where, run))


def _shared(group: np.ndarray, rows: np.ndarray, have: np.ndarray) -> np.ndarray:
    """For each row the longest beginning that it shares with another row of its group, at least.

    rows holds units in columns; have says how many of them are real.
    """
    n, width = rows.shape
    item = rows.dtype.itemsize
    keyed = np.concatenate([group.reshape(n, 1).view(np.uint8), rows.view(np.uint8).reshape(n, width * item)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{8 + width * item}").ravel(), kind="stable")
    out = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        differ = np.concatenate([rows[a] != rows[b], np.ones((n - 1, 1), bool)], axis=1)
        same = np.minimum(np.argmax(differ, axis=1), np.minimum(have[a], have[b]))
        same[group[a] != group[b]] = 0
        np.maximum.at(out, a, same)
        np.maximum.at(out, b, same)
    return out


def _trimmed(search: Search, u: Units, group: np.ndarray, before: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, low, high, twin): the part of each context that can be in a repeat at all.

    A window that holds the anchor and starts elsewhere too has to the right of the anchor no more than
    the context shares with another one of the same anchor, and to the left likewise. Contexts with
    too little are left out. Those that agree in what is left have one number in twin.
    """
    w, k, n = search.window, search.anchor, len(before)
    at = u.first[:-1] + before
    right, left = u.first[1:] - at - k, before
    units = u.hashes
    if len(u.joined) == len(units):  # bytes; 255 counts as 254, which can only keep more
        units = np.minimum(np.frombuffer(u.joined, np.uint8), 254) + np.uint8(1)
    step = np.arange(w - k)

    def side(first: np.ndarray, sign: int, have: np.ndarray) -> np.ndarray:
        rows = units[np.clip(first[:, None] + sign * step, 0, len(units) - 1)]
        rows[step >= have[:, None]] = 0
        return np.where(count > 1, have, _shared(group, rows, have))

    r, lft = side(at + k, 1, right), side(at - 1, -1, left)
    use = np.flatnonzero(lft + k + r >= w)
    low, high = (at - lft)[use], (at + k + r)[use]
    table: dict[tuple[int, bytes], int] = {}
    begin, end = u.starts[low].tolist(), u.ends[high - 1].tolist()
    twin = [table.setdefault((n, u.joined[x:y]), len(table)) for n, x, y in zip(lft[use].tolist(), begin, end, strict=True)]
    return use, low, high, np.array(twin, np.int64)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two halves of the row's name."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(F.lit(1), "text", "doc_id").alias("rie"))


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


def _digests(joined: bytes, begin: np.ndarray, end: np.ndarray, shape: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """128 bits of hash for each range of bytes with its shape, in two columns."""
    digest, view = xxhash.xxh3_128_digest, memoryview(joined)
    return _halves([digest(view[x:y], s) for x, y, s in zip(begin.tolist(), end.tolist(), shape.tolist(), strict=True)])


def _anchor_rows(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = search.window
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE_BYTES)):
            names = [batch.column(i).to_numpy() for i in (0, 1)]
            for own, base, windows, u in search.read(text_bytes(batch.column(2))):
                g, low, high, i, lead, starts = search.anchors(u, windows)
                if len(g):
                    c, d = _digests(u.joined, u.starts[low], u.ends[high - 1], lead * 2 * w + starts)
                    name = [pa.array(x[own[i]]) for x in names]
                    small = [pa.array(x.astype(np.int32)) for x in (low - u.first[i] + base[i], lead, starts)]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), c, d, *name, *small], names=["g", "c", "d", "rid", "rie", "low", "lead", "starts"])

    return run


_CONTEXT = "g long, c long, d long, n long, place long, lead int, body binary"


def _context_rows(search: Search):
    """text, rid, list of (low, lead, starts, g, c, d, n) -> contexts with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = search.window
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            rids, lists = batch.column(1).to_numpy(), batch.column(2)
            flat = lists.flatten()
            off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at, starts = flat.field(0).to_numpy(), flat.field(2).to_numpy()
            for own, base, windows, u in search.read(text_bytes(batch.column(0))):
                pick = np.concatenate([np.arange(off[j], off[j + 1]) for j in own])
                text = np.repeat(np.arange(len(own)), [off[j + 1] - off[j] for j in own])
                here = (at[pick] >= base[text]) & (at[pick] < base[text] + windows[text])  # in this piece
                pick, text = pick[here], text[here]
                if not len(pick):
                    continue
                low = u.first[text] + at[pick] - base[text]
                high = low + starts[pick] + w - 1
                a, b = u.starts[low].tolist(), u.ends[high - 1].tolist()
                body = [u.joined[x:y] for x, y in zip(a, b, strict=True)]
                place = mix(rids[own[text]].view(np.uint64)) + at[pick].astype(np.uint64)
                for s in range(0, len(pick), 8192):
                    e = s + 8192
                    part = pa.array(pick[s:e])
                    yield pa.RecordBatch.from_arrays(
                        [*(flat.field(i).take(part) for i in (3, 4, 5, 6)), pa.array(place[s:e].view(np.int64)), flat.field(1).take(part), pa.array(body[s:e], pa.binary())],
                        names=["g", "c", "d", "n", "place", "lead", "body"],
                    )

    return run


def _decide_rows(search: Search, decide: Callable[[Block, Units], np.ndarray]):
    """Contexts sorted by anchor -> the stretches of each, counted from where it starts."""

    def verdicts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        g, c, d = (t.column(x).to_numpy() for x in "gcd")
        before, count = t.column("lead").to_numpy().astype(np.int64), t.column("n").to_numpy()
        u = search.cut(text_bytes(t.column("body").combine_chunks()))
        use, low, high, twin = _trimmed(search, u, g, before, count)
        _, one = np.unique(twin, return_index=True)  # a context for each set of twins
        body = [u.joined[x:y] for x, y in zip(u.starts[low[one]].tolist(), u.ends[high[one] - 1].tolist(), strict=True)]
        cut = search.cut(body)
        places = t.column("place").to_numpy().view(np.uint64)[use] + (low - u.first[use]).astype(np.uint64)
        block = Block(cut.first, places[one], np.bincount(twin, count[use], len(one)).astype(np.int64))
        hit = np.flatnonzero(decide(block, cut)) if len(one) else np.zeros(0, np.int64)  # where repeated windows start
        owner = np.searchsorted(cut.first, hit, side="right") - 1
        rel = hit - cut.first[owner]
        # Starts that are no further apart than a window's length cover one stretch.
        new = np.ones(len(hit), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (rel[1:] - rel[:-1] > search.window)
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(hit)) - 1 if len(s) else s
        # Each context of a set gets the stretches that its twin was found to have.
        per = np.bincount(owner[s], minlength=len(one))
        many = per[twin]
        at = np.repeat((np.cumsum(per) - per)[twin], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        own = np.repeat(use, many)
        begin = np.repeat(low - u.first[use], many)  # of what is left, in the context
        return pa.RecordBatch.from_arrays(
            [pa.array(g[own]), pa.array(c[own]), pa.array(d[own]), pa.array((begin + rel[s[at]]).astype(np.int32)), pa.array((begin + rel[e[at]] + search.window).astype(np.int32))],
            names=["g", "c", "d", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            held.append(batch)
            size += batch.column(6).nbytes
            if size >= BLOCK_UNITS:
                # The last anchor's contexts may go on in the next batch; the block ends before them.
                g = np.concatenate([b.column(0).to_numpy() for b in held])
                other = np.flatnonzero(g != g[-1])
                if not len(other):
                    continue
                end = int(other[-1]) + 1
                t = pa.Table.from_batches(held)
                yield verdicts(t.slice(0, end).combine_chunks().to_batches())
                held = t.slice(end).combine_chunks().to_batches()
                size = sum(b.column(6).nbytes for b in held)
        if held:
            yield verdicts(held)

    return run


_RANGE = "a int, b int"
_PARTS = f"{_CONTEXT}, {_RANGE}, g0 long, c0 long, d0 long, shift int"


def _split_rows(search: Search):
    """Contexts of hot anchors, whose windows have a to b - 1 units to the right of the anchor, -> a row for each of
    WAYS ranges of that number: the units that matter to its windows, dealt out by those that all of them hold."""
    around, w = search.window - search.anchor, search.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            u = search.cut(text_bytes(batch.column(6)))
            lead, place = batch.column(5).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            low, high = (batch.column(i).to_numpy().astype(np.int64) for i in (7, 8))
            step = -(-(high - low) // WAYS)
            at = u.first[:-1] + lead
            right = u.first[1:] - at - search.anchor
            for k in range(WAYS):
                a = low + k * step
                b = np.minimum(a + step, high)
                # A window with r units to the right has around - r to the left.
                some = np.flatnonzero((a < b) & (right >= a) & (lead > around - b))
                if not len(some):
                    continue
                a, b = a[some], b[some]
                first, last = at[some] - np.minimum(lead[some], around - a), at[some] + search.anchor + np.minimum(right[some], b - 1)
                core, end = at[some] - (around - b + 1), at[some] + search.anchor + a
                shift, new_lead = first - u.first[some], at[some] - first
                g, _ = _digests(u.joined, u.starts[core], u.ends[end - 1], a * 2 * w + b)
                c, d = _digests(u.joined, u.starts[first], u.ends[last - 1], (new_lead * 2 * w + a) * 2 * w + b)
                body = [u.joined[x:y] for x, y in zip(u.starts[first].tolist(), u.ends[last - 1].tolist(), strict=True)]
                pick = pa.array(some)
                small = [pa.array(x.astype(np.int32)) for x in (new_lead, a, b, shift)]
                yield pa.RecordBatch.from_arrays(
                    [g, c, d, batch.column(3).take(pick), pa.array((place[some].view(np.uint64) + shift.astype(np.uint64)).view(np.int64)), small[0], pa.array(body, pa.binary()),
                     small[1], small[2], *(batch.column(i).take(pick) for i in (0, 1, 2)), small[3]],
                    names=[x.split()[0] for x in _PARTS.split(", ")],
                )

    return run


_FOUND = "g long, c long, d long, low int, high int"


def _decided(contexts: DataFrame, search: Search, decide: Callable[[Block, Units], np.ndarray]) -> DataFrame:
    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(releasing(_decide_rows(search, decide)), _FOUND)


def _crowded(rows: DataFrame, hot: int) -> DataFrame:
    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("g")


def _split(contexts: DataFrame, search: Search, decide: Callable[[Block, Units], np.ndarray], hot: int, held: list[DataFrame]) -> DataFrame:
    """What is found in the contexts of hot anchors, see the module's text; a range of one number is never split.
    Tables that the result reads go into held."""
    names = [x.split()[0] for x in f"{_CONTEXT}, {_RANGE}".split(", ")]
    rows = written(contexts.select(names).mapInArrow(releasing(_split_rows(search)), _PARTS))
    one = rows.groupBy("g", "c", "d").agg(F.sum("n").alias("n"), F.min("place").alias("place"), *(F.any_value(c).alias(c) for c in ("lead", "body", "a", "b")))
    one = written(one)
    held += [rows, one]
    crowded = _crowded(one.where("b - a > 1"), hot)
    if crowded.isEmpty():
        found = _decided(one.select(names[:7]), search, decide)
    else:
        crowded = written(crowded)
        held.append(crowded)
        found = _decided(one.join(crowded, "g", "left_anti").select(names[:7]), search, decide)
        found = found.unionByName(_split(one.join(crowded, "g", "left_semi"), search, decide, hot, held))
    # With an exchange of its own for the join, Spark can split a context that very many others have become.
    found = written(found)
    held.append(found)
    members = rows.select("g", "c", "d", "g0", "c0", "d0", "shift")
    return members.join(found, ["g", "c", "d"]).select(F.col("g0").alias("g"), F.col("c0").alias("c"), F.col("d0").alias("d"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"))


def stretches(texts: DataFrame, search: Search, decide: Callable[[Block, Units], np.ndarray], hot: int = HOT) -> DataFrame:
    """(rid, rie, spans): for each document the unit ranges that repeated windows cover; texts is named()."""
    anchors = written(texts.select("rid", "rie", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(releasing(_anchor_rows(search)), "g long, c long, d long, rid long, rie long, low int, lead int, starts int"))
    # As a table of its own the smaller side has its own exchange, so Spark can split frequent anchors.
    often = written(anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    seen = written(anchors.join(often, "g", "left_semi"))
    dropped(anchors)
    dropped(often)
    held = [seen]
    groups = seen.groupBy("g", "c", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "rie", "low", "lead", "starts")).alias("one"))
    asked = groups.groupBy(F.col("one.rid").alias("rid"), F.col("one.rie").alias("rie")).agg(F.collect_list(F.struct("one.low", "one.lead", "one.starts", "g", "c", "d", "n")).alias("asked"))
    # The same exchange of texts by name serves this join and the one that applies the stretches.
    contexts = texts.join(asked, ["rid", "rie"]).select("text", "rid", "asked")
    contexts = contexts.mapInArrow(releasing(_context_rows(search)), _CONTEXT)
    crowded = _crowded(groups, hot)
    if crowded.isEmpty():
        found = _decided(contexts, search, decide)
    else:
        crowded = written(crowded)
        contexts = written(contexts)
        held += [crowded, contexts]
        found = _decided(contexts.join(crowded, "g", "left_anti"), search, decide)
        whole = contexts.join(crowded, "g", "left_semi").withColumns({"a": F.lit(0), "b": F.lit(search.window - search.anchor + 1)})
        found = found.unionByName(_split(whole, search, decide, hot, held))
    placed = seen.select("g", "c", "d", "rid", "rie", F.col("low").alias("at")).join(found, ["g", "c", "d"]).select("rid", "rie", F.struct((F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")).alias("span"))
    spans = written(placed.groupBy("rid", "rie").agg(F.collect_set("span").alias("spans")))
    for t in held:
        dropped(t)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted ranges without overlap; ranges that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def apply_stretches(texts: DataFrame, spans: DataFrame, make, schema: str) -> DataFrame:
    """make(text, merged spans) -> values of schema, for every row of texts, behind its doc_id."""
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            rows = [make(t, merged([(x["low"], x["high"]) for x in s]) if s else []) for t, s in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    joined = texts.join(spans, ["rid", "rie"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(releasing(run), f"doc_id long, {schema}")
