"""Suffix order and common prefixes by external induced sorting.

A string is sorted in four passes over monotone priority queues, at every level of the recursion alike:

1. The suffixes that begin a rise after a fall (LMS suffixes) seed the queues by their first run of symbols alone. A
   pass in ascending order of symbols induces all falling suffixes, one in descending order all rising
   ones. This sorts the LMS substrings. Tuples carry the common prefix with the tuple before, and
   `same` as long as two substrings are equal; so neighbours that aren't the same begin a new name. A level that
   fits into memory sorts its LMS substrings as they are, which gives the same.
2. If names repeat, the string of names is sorted by the same sorter, which gives the order of the LMS
   suffixes and how many names neighbours share. Their common prefix is the length of the shared names
   and that of the two names that differ, a range minimum over the neighbours of step 1.
3. The two passes again, seeded by the sorted LMS suffixes and their common prefixes, induce the order and
   the common prefixes of all suffixes: the common prefix of two neighbours is one more than the least
   between their inducers.

A queue holds a range of symbols. It is taken out whole when its turn comes and sorted by symbol. Then as
many tuples are taken at once as can't be preceded by what they induce themselves; tuples induced into
the same range are merged in. A range has few tuples or a single symbol, which is read in parts.

Memory: queues beyond `memory` bytes are written to a temporary file on the worker's disk. Text, order, common
prefixes and all other arrays as long as the text are files too, mapped into memory, where they are larger
than an eighth of that. What stays in memory is a part of the queues and one range or part of tuples.

Order and common prefixes are right up to `depth` symbols; suffixes that agree that far may stand in any
order among themselves.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a range of several symbols, and tuples that are handled at once.
RANGE, BATCH = 1 << 14, 1 << 18


class Scratch:
    """Arrays that are files on the worker's disk where they would take much memory; all go with close()."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.made = memory, None, 0

    def array(self, n: int, kind) -> np.ndarray:
        return np.empty(n, kind) if n * np.dtype(kind).itemsize <= self.memory // 8 else self.file(n, kind)

    def file(self, n: int, kind) -> np.ndarray:
        return np.memmap(self._file(), kind, "w+", shape=(n,))

    def zeros(self, n: int, kind) -> np.ndarray:
        """An array of zeros; a new file has no other content."""
        out = self.array(n, kind)
        if not isinstance(out, np.memmap):
            out[:] = 0
        return out

    def _file(self):
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="sorter")
        self.made += 1
        return open(f"{self.folder.name}/{self.made}", "w+b")  # mapped, and closed with the mapping

    def part(self) -> int:
        """Tuples that are read at once."""
        return max(64, min(BATCH, self.memory // 64))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class Queues:
    """First-in, first-out queues of (symbol, position, common prefix), one for each range of symbols.

    How many tuples a range will get is known, so on disk each queue has a stretch of its own to grow into.
    """

    def __init__(self, bounds: np.ndarray, totals: np.ndarray, kinds: tuple, scratch: Scratch):
        self.bounds, self.kinds, self.scratch, self.held = bounds, kinds, scratch, 0
        self.base = np.concatenate([[0], np.cumsum(totals)]).tolist()
        n = len(totals)
        self.chunks: list[list] = [[] for _ in range(n)]
        self.size = [0] * n  # bytes of a queue in memory
        self.written, self.read = [0] * n, [0] * n
        self.disk: tuple | None = None

    def put(self, columns: tuple[np.ndarray, ...]) -> None:
        """Tuples sorted by symbol."""
        columns = tuple(x.astype(kind, copy=False) for x, kind in zip(columns, self.kinds, strict=True))
        which = np.searchsorted(self.bounds, columns[0], side="right") - 1
        cut = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b > a:
                number = int(which[a])
                chunk = tuple(x[a:b].copy() for x in columns)
                self.chunks[number].append(chunk)
                size = sum(x.nbytes for x in chunk) + 128  # and what the objects take
                self.size[number] += size
                self.held += size
        if self.held > self.scratch.memory // 2:
            self._spill()

    def _spill(self) -> None:
        """Write out the fullest queues until most of their memory is free."""
        if self.disk is None:
            self.disk = tuple(self.scratch.file(self.base[-1], kind) for kind in self.kinds)
        for number in sorted(range(len(self.chunks)), key=self.size.__getitem__, reverse=True):
            if self.held <= self.scratch.memory // 8:
                break
            for chunk in self.chunks[number]:
                at = self.base[number] + self.written[number]
                for column, x in zip(self.disk, chunk, strict=True):
                    column[at : at + len(x)] = x
                self.written[number] += len(chunk[0])
            self.chunks[number] = []
            self.held -= self.size[number]
            self.size[number] = 0

    def take(self, number: int, limit: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """The tuples of a queue in parts, the oldest first; those that are put in meanwhile too."""
        while True:
            if self.read[number] < self.written[number]:
                a = self.base[number] + self.read[number]
                n = self.written[number] - self.read[number]
                n = n if limit is None else min(n, limit)
                self.read[number] += n
                yield tuple(np.array(x[a : a + n]) for x in self.disk)
            elif self.chunks[number]:
                # Small chunks together, as many as there are now.
                queue, n, k = self.chunks[number], 0, 0
                while k < len(queue) and (limit is None or k == 0 or n + len(queue[k][0]) <= limit):
                    n += len(queue[k][0])
                    k += 1
                got, self.chunks[number] = queue[:k], queue[k:]
                size = sum(x.nbytes for chunk in got for x in chunk) + 128 * k
                self.size[number] -= size
                self.held -= size
                yield got[0] if k == 1 else tuple(np.concatenate(x) for x in zip(*got, strict=True))
            else:
                return


class _Level:
    """A string with its types: code is twice the symbol, and one more where the suffix rises."""

    def __init__(self, source: np.ndarray, symbols: int, depth: int, scratch: Scratch):
        """source: symbols from 1 on, below `symbols`; the closing one is added."""
        self.symbols, self.depth, self.scratch = symbols, depth, scratch
        self.same = depth + 1
        self.kind = np.dtype(np.uint8 if self.same < 256 else np.uint16 if self.same < 65536 else np.int32)
        n = self.n = len(source) + 1
        self.index = np.dtype(np.int32 if n < 2**31 else np.int64)
        self.code = scratch.array(n, np.uint8 if symbols <= 128 else np.uint16 if symbols <= 32768 else np.int64 if symbols > 2**30 else np.int32)
        self.run = scratch.array(n, self.kind)  # equal symbols from a place on, up to depth
        # Falling and rising suffixes of each symbol, without the closing one, which is not induced.
        self.counts = scratch.zeros(symbols, np.int64), scratch.zeros(symbols, np.int64)
        self.code[n - 1], self.run[n - 1] = 1, 1
        # From the right, as a suffix's type depends on the next one's.
        after, rises, length, part = 0, True, 1, scratch.part() * 4
        self.lms_count = 0
        last = True  # type of the place to the right
        for b in range(n - 1, 0, -part):
            a = max(0, b - part)
            text = np.append(source[a:b], after).astype(np.int64)
            m = b - a
            ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, m + 1)
            end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:m]
            inner = end <= m  # else the run goes on to the right
            up = np.where(inner, text[np.minimum(end, m)] > text[:m], rises)
            run = end - np.arange(m) + np.where(inner, 0, length - 1)
            self.code[a:b] = (text[:m] * 2 + up).astype(self.code.dtype)
            self.run[a:b] = np.minimum(run, depth).astype(self.kind)
            for kind in (0, 1):
                _tally(self.counts[kind], text[:m][up == kind])
            kinds = np.append(up, last)
            self.lms_count += int((kinds[1:] & ~kinds[:-1]).sum())
            after, rises, length, last = int(text[0]), bool(up[0]), min(int(run[0]), depth), bool(up[0])

    def lms(self) -> np.ndarray:
        """Positions of the LMS suffixes in the order of the text."""
        out, at, part = self.scratch.array(self.lms_count, self.index), 0, self.scratch.part() * 4
        for a in range(1, self.n, part):
            kinds = np.asarray(self.code[a - 1 : a + part]) & 1
            found = np.flatnonzero((kinds[1:] == 1) & (kinds[:-1] == 0)) + a
            out[at : at + len(found)] = found
            at += len(found)
        return out


def _tally(counts: np.ndarray, symbols: np.ndarray) -> None:
    if len(counts) <= 4 * len(symbols):
        counts += np.bincount(symbols, minlength=len(counts))
    else:
        np.add.at(counts, symbols, 1)


class _Pass:
    """One pass. Symbols of a descending pass are counted from the top, so both go upwards here.

    given(a, b) reads the tuples that are there from the start, in order; what is induced comes to out.
    """

    def __init__(self, level: _Level, down: bool, given_counts: np.ndarray, given, mine: np.ndarray):
        self.level, self.down, self.given = level, down, given
        turn = (lambda x: x[::-1]) if down else (lambda x: x)
        scratch = level.scratch
        self.starts, upto = scratch.zeros(level.symbols + 1, np.int64), scratch.array(level.symbols, np.int64)
        np.cumsum(turn(given_counts), out=self.starts[1:])
        np.cumsum(turn(mine), out=upto)
        upto += self.starts[1:]
        self.out_pos = level.scratch.array(int(mine.sum()), level.index)
        self.out_common = level.scratch.array(int(mine.sum()) + 1, level.kind)  # with a place to spare for shifts
        self.done = 0
        self.ranges = self._ranges(upto, max(16, min(RANGE, scratch.memory // 64)))
        own = np.diff(np.concatenate([[0], upto[self.ranges[1:] - 1] - self.starts[self.ranges[1:]]]))
        self.queues = Queues(self.ranges, own, (np.int32 if level.symbols < 2**31 else np.int64, level.index, level.kind), scratch)
        self.least = scratch.zeros(level.symbols, level.kind)  # after the last inducer of each symbol, in its batch
        self.batch = scratch.zeros(level.symbols, np.int64)  # that inducer's batch; there is none before the first
        self.number = 1
        self.none = 4 * level.symbols  # a key beyond all
        # Least values of the batches so far as a stack: the least from a batch on stands at the first one from it on.
        self.when: list[int] = []
        self.low: list[int] = []
        self.last = (-1, -1)  # key and position of the tuple fed last

    @staticmethod
    def _ranges(upto: np.ndarray, most: int) -> np.ndarray:
        """First symbols of ranges with `most` tuples at most, or a single symbol; upto: tuples up to each symbol."""
        n, out = len(upto), [0]
        while out[-1] < n:
            a = out[-1]
            end = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right"))
            out.append(max(a + 1, end))
        return np.array(out)

    def _next_key(self, pos: np.ndarray) -> np.ndarray:
        """Twice the symbol that a tuple induces, or a key beyond all where it induces none."""
        code = np.asarray(self.level.code[pos - 1]).astype(np.int64)  # of the closing symbol for position 0
        key = (2 * self.level.symbols - 1 - code if self.down else code) & -2
        key[((code & 1) != self.down) | (code < 2)] = self.none
        return key

    def _feed(self, key: np.ndarray, pos: np.ndarray, common: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Take tuples in order: those induced before go out, and their preceding ones come back by symbol."""
        level, n = self.level, len(key)
        given = (key & 1) == 1
        before = np.empty(n, np.int64)
        before[0], before[1:] = self.last[0], key[:-1]
        first = (given & (before != key)).nonzero()[0]
        if len(first):
            # The first given tuple of a symbol is next to one of the other type, or of another symbol.
            prior = np.where(first > 0, pos[first - 1], self.last[1])
            common = common.copy()
            common[first] = np.where(before[first] == key[first] - 1, np.minimum(level.run[prior], level.run[pos[first]]), 0)
        self.last = (int(key[-1]), int(pos[-1]))
        own = (~given).nonzero()[0]
        if len(own):
            end = self.done + len(own)
            self.out_pos[self.done : end], self.out_common[self.done : end] = pos[own], common[own]
            self.done = end
        at = (nxt < self.none).nonzero()[0]
        new = None
        if len(at):
            key = nxt[at]
            order = key.argsort(kind="stable")
            at, symbol = at[order], key[order] >> 1
            fresh = np.empty(len(at), bool)
            fresh[0] = True
            np.not_equal(symbol[1:], symbol[:-1], out=fresh[1:])
            starts = fresh.nonzero()[0]
            begin, seen = at[starts], symbol[starts]
            final = np.empty(len(starts), np.int64)
            final[:-1], final[-1] = at[starts[1:] - 1], at[-1]
            value = np.empty(len(at), np.int64)
            if len(starts) < len(at):
                inner = (~fresh).nonzero()[0]
                value[inner] = range_min(common, at[inner - 1] + 1, at[inner])
            batch = self.batch[seen]
            upto = np.minimum.accumulate(common)[begin]
            between = np.array([*self.low, level.same], np.int64)[np.array(self.when, np.int64).searchsorted(batch + 1)]
            value[starts] = np.minimum(np.minimum(self.least[seen], between), upto)
            more = np.minimum(value + 1, level.depth)
            more[value == level.same] = level.same
            more[starts[batch == 0]] = 0
            tail = np.empty(n + 1, level.kind)
            tail[n], tail[:n] = level.same, np.minimum.accumulate(common[::-1])[::-1]
            self.least[seen] = tail[final + 1]
            self.batch[seen] = self.number
            new = symbol, (pos[at] - 1).astype(level.index, copy=False), more.astype(level.kind)
        low = int(common.min())
        while self.low and self.low[-1] >= low:
            self.low.pop()
            self.when.pop()
        self.low.append(low)
        self.when.append(self.number)
        self.number += 1
        return new

    def run(self) -> _Pass:
        for number, (a, b) in enumerate(zip(self.ranges.tolist(), self.ranges.tolist()[1:], strict=False)):
            if b - a == 1:
                self._one_symbol(number, a)
            else:
                self._several(number, a, b)
        return self

    def _one_symbol(self, number: int, symbol: int) -> None:
        part = self.level.scratch.part()
        for _, pos, common in self.queues.take(number, part):
            new = self._feed(np.full(len(pos), 2 * symbol), pos, common, self._next_key(pos))
            if new:
                self.queues.put(new)
        for x in range(int(self.starts[symbol]), int(self.starts[symbol + 1]), part):
            pos, common = self.given(x, min(x + part, int(self.starts[symbol + 1])))
            new = self._feed(np.full(len(pos), 2 * symbol + 1), pos, common, self._next_key(pos))
            if new:
                self.queues.put(new)

    def _several(self, number: int, a: int, b: int) -> None:
        x, y = int(self.starts[a]), int(self.starts[b])
        pos, common = self.given(x, y)
        key = 2 * np.repeat(np.arange(a, b), np.diff(self.starts[a : b + 1])) + 1
        got = list(self.queues.take(number))
        if got:
            key = np.concatenate([*(2 * g[0].astype(np.int64) for g in got), key])
            order = np.argsort(key, kind="stable")
            key, pos, common = key[order], np.concatenate([*(g[1] for g in got), pos])[order], np.concatenate([*(g[2] for g in got), common])[order]
        nxt = self._next_key(pos) if len(pos) else key
        while len(key):
            # Up to the first tuple that what was induced before it has to precede.
            bound = np.minimum.accumulate(nxt[:8192])
            late = (key[1 : len(bound)] > bound[:-1]).nonzero()[0]
            end = int(late[0]) + 1 if len(late) else len(bound)
            new = self._feed(key[:end], pos[:end], common[:end], nxt[:end])
            key, pos, common, nxt = key[end:], pos[end:], common[end:], nxt[end:]
            if new is None:
                continue
            here = int(new[0].searchsorted(b))
            if here < len(new[0]):
                self.queues.put(tuple(c[here:] for c in new))
            if here:
                symbol, at, value = (c[:here] for c in new)
                # Behind the tuples of its symbol that are there, before the given ones.
                place = key.searchsorted(2 * symbol, side="right") + np.arange(here)
                old = np.ones(len(key) + here, bool)
                old[place] = False

                def both(had: np.ndarray, more: np.ndarray, place=place, old=old) -> np.ndarray:
                    out = np.empty(len(old), had.dtype)
                    out[place], out[old] = more, had
                    return out

                key, pos, common, nxt = both(key, 2 * symbol), both(pos, at), both(common, value), both(nxt, self._next_key(at))


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range from low to high, both included."""
    length = high - low + 1
    out = np.empty(len(low), values.dtype)
    level, step = values, 1
    top = int(length.max())
    while True:
        if 2 * step > top:
            own = (length >= step).nonzero()[0]
            out[own] = np.minimum(level[low[own]], level[high[own] - step + 1])
            return out
        own = ((length >= step) & (length < 2 * step)).nonzero()[0]
        if len(own):
            out[own] = np.minimum(level[low[own]], level[high[own] - step + 1])
        level = np.minimum(level[:-step], level[step:])
        step *= 2


class _RangeMin:
    """Least values of ranges over an array that may be on disk, by blocks of 64."""

    def __init__(self, values: np.ndarray, scratch: Scratch):
        n = -(-len(values) // 64) * 64
        self.block, self.values = None, values
        if not isinstance(values, np.memmap):
            return
        self.left, self.right, self.block = scratch.array(n, values.dtype), scratch.array(n, values.dtype), np.empty(n // 64, values.dtype)
        top, part = np.iinfo(values.dtype).max, max(64, scratch.part() // 64 * 64)
        for a in range(0, n, part):
            own = np.asarray(values[a : a + part])
            rows = np.append(own, np.full(-len(own) % 64, top, values.dtype)).reshape(-1, 64)
            self.left[a : a + rows.size] = np.minimum.accumulate(rows, axis=1).ravel()  # from the block's start
            self.right[a : a + rows.size] = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()  # to its end
            self.block[a // 64 : a // 64 + len(rows)] = rows.min(axis=1)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if self.block is None:
            return range_min(self.values, low, high)
        a, b = low >> 6, high >> 6
        out = np.minimum(np.asarray(self.right[low]), np.asarray(self.left[high]))
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            out[wide] = np.minimum(out[wide], range_min(self.block, a[wide] + 1, b[wide] - 1))
        one = np.flatnonzero(a == b)
        if len(one):
            spots = low[one, None] + np.arange(64)
            rows = np.asarray(self.values[np.minimum(spots, len(self.values) - 1)])
            rows[spots > high[one, None]] = np.iinfo(rows.dtype).max
            out[one] = rows.min(axis=1)
        return out


def _two_passes(level: _Level, seeds: np.ndarray, common: np.ndarray) -> tuple[_Pass, _Pass]:
    """The ascending pass from seeds in order of their symbols, and the descending one from what it gives."""
    counts, part = level.scratch.zeros(level.symbols, np.int64), level.scratch.part()
    for a in range(0, len(seeds), part):
        _tally(counts, np.asarray(level.code[seeds[a : a + part]]).astype(np.int64) >> 1)
    up = _Pass(level, False, counts, lambda a, b: (np.asarray(seeds[a:b]), np.asarray(common[a:b])), level.counts[0]).run()
    n = up.done
    up.out_common[n] = 0
    # From the last one on; the common prefix with the one above is that one's with the one before it.
    above = lambda a, b: (np.asarray(up.out_pos[n - b : n - a])[::-1], np.asarray(up.out_common[n - b + 1 : n - a + 1])[::-1])
    down = _Pass(level, True, level.counts[0], above, level.counts[1]).run()
    return up, down


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, different keys, their numbers, place of each in its group) for keys in that order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    return order, key[first], size, np.arange(len(key)) - np.repeat(first, size)


def _seeds(level: _Level, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions by first symbol, longer runs of it first, as these are less; and their common prefixes: `same`
    for equal runs, so that substrings that end there are held to be equal. A counting sort in parts."""
    scratch, m = level.scratch, level.lms_count
    part, out, common = scratch.part(), scratch.array(m, level.index), scratch.array(m, level.kind)
    wide = level.depth + 1

    def read(a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = np.asarray(lms[a : a + part])
        return mine, np.asarray(level.code[mine]).astype(np.int64) >> 1, np.asarray(level.run[mine]).astype(np.int64)

    counts = scratch.zeros(level.symbols + 1, np.int64)
    keys, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of runs of two and more, which are few
    for a in range(0, m, part):
        _, symbol, run = read(a)
        np.add.at(counts, symbol + 1, 1)
        many = run > 1
        if many.any():
            found, n = np.unique(symbol[many] * wide + wide - 1 - run[many], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            sizes = np.bincount(back, np.concatenate([sizes, n])).astype(np.int64)
    np.cumsum(counts, out=counts)
    owner, at_many = keys // wide, np.zeros(0, np.int64)
    if len(keys):
        _, own, n, place = _grouped(owner)
        before = np.cumsum(sizes) - sizes
        at_many = counts[owner] + before - np.repeat(before[place == 0], n)
        np.add.at(counts, owner, sizes)
    for a in range(0, m, part):
        mine, symbol, run = read(a)
        for some, at, number in ((np.flatnonzero(run == 1), counts, None), (np.flatnonzero(run > 1), at_many, keys)):
            if len(some):
                key = symbol[some] if number is None else np.searchsorted(number, symbol[some] * wide + wide - 1 - run[some])
                order, own, n, place = _grouped(key)
                out[np.repeat(at[own], n) + place] = mine[some][order]
                at[own] += n
    before = -1
    for a in range(0, m, part):
        run = np.asarray(level.run[out[a : a + part]]).astype(np.int64)
        common[a : a + part] = np.where(run == np.append(before, run[:-1]), level.same, run)
        before = int(run[-1])
    return out, common


def _words(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Eight bytes from each position on as one number, the first symbol on top; and symbols a number."""
    width = 8 // values.itemsize
    padded = np.append(values, np.zeros(width - 1, values.dtype)).astype(values.dtype.newbyteorder(">"))
    return np.ndarray((len(values),), ">u8", padded, strides=(values.itemsize,)).astype(np.uint64), width


def _substrings(level: _Level, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the two passes of naming give, for a level in memory: LMS substrings in order, by radix from the first word
    of symbols and types on, and the common prefixes of neighbours, `same` for equal substrings."""
    m, n = len(lms), level.n
    lms = lms.astype(np.int64)
    length = np.append(lms[1:], n - 1) - lms + 1  # up to the next one's first symbol
    words, width = _words(level.code)
    bits = np.uint64(64 // width)

    def word(items: np.ndarray, t: int) -> np.ndarray:
        # Symbols beyond the substring's end are cleared.
        cut = (width - np.minimum(length[items] - t * width, width)).astype(np.uint64) * bits
        return words[np.minimum(lms[items] + t * width, n - 1)] >> cut << cut

    key = word(np.arange(m), 0)
    order = key.argsort(kind="stable")
    key = key[order]
    new = np.empty(m, bool)  # whether a place differs from the one before
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])

    def split(places: np.ndarray, key: np.ndarray) -> None:
        """Sort the items of equal groups, which the places are all of, by key."""
        group = np.cumsum(new)[places]
        by = np.lexsort((key, group))
        order[places], key, group = order[places][by], key[by], group[by]
        new[places[1:][(group[1:] == group[:-1]) & (key[1:] != key[:-1])]] = True

    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places whose group has others
    t, open_ = 1, tied[length[order[tied]] > width]
    while len(open_):
        split(open_, word(order[open_], t))
        t += 1
        open_ = open_[~(new & np.append(new[1:], True))[open_]]
        open_ = open_[length[order[open_]] > t * width]
    # Of equal substrings that with the longer last run is less.
    tied = tied[~(new & np.append(new[1:], True))[tied]]
    if len(tied):
        split(tied, -level.run[(lms + length - 1)[order[tied]]].astype(np.int64))
    common = np.full(m, level.same, np.int64)
    first = np.flatnonzero(new)
    common[first] = _neighbours(level, words, width, lms[order[np.maximum(first - 1, 0)]], lms[order[first]])
    common[0] = 0
    return lms[order].astype(level.index), common.astype(level.kind)


def _neighbours(level: _Level, words: np.ndarray, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, whose substrings differ: equal codes, then the equal symbols where
    types part, which are the shorter of the two runs."""
    out, pair, at, n = np.zeros(len(a), np.int64), np.arange(len(a)), 0, level.n
    while len(pair) and at < level.depth:
        x, y = words[np.minimum(a, n - 1)], words[np.minimum(b, n - 1)]
        off = np.flatnonzero((x != y) | (np.maximum(a, b) >= n))
        if len(off):
            differ = x[off] ^ y[off]
            for k in (1, 2, 4, 8, 16, 32):
                differ |= differ >> np.uint64(k)
            equal = (64 - np.bitwise_count(differ).astype(np.int64)) * width // 64
            p, q = np.minimum(a[off] + equal, n - 1), np.minimum(b[off] + equal, n - 1)
            parted = (level.code[p] >> 1) == (level.code[q] >> 1)
            out[pair[off]] = at + equal + np.where(parted, np.minimum(level.run[p], level.run[q]).astype(np.int64), 0)
        stay = (x == y) & (np.maximum(a, b) < n)
        a, b, pair = a[stay] + width, b[stay] + width, pair[stay]
        at += width
    out[pair] = level.depth
    return np.minimum(out, level.depth)


def _sorted_lms(level: _Level, deeper: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order, and each one's common prefix with the one before."""
    scratch, m, part = level.scratch, level.lms_count, level.scratch.part()
    lms = level.lms()
    if level.n * 24 <= scratch.memory and m > 1:
        return _resolved(level, lms, *_substrings(level, lms), deeper)
    _, down = _two_passes(level, *_seeds(level, lms))
    # The LMS ones among the rising suffixes, in ascending order, and the closing one before them all.
    order, common = scratch.array(m, level.index), scratch.array(m, level.kind)
    order[0], common[0] = level.n - 1, 0
    # What comes down in order holds for each tuple the common prefix with the one above it.
    at, low = m, level.same
    for a in range(0, down.done, part):
        pos = np.asarray(down.out_pos[a : min(a + part, down.done)])
        value = np.asarray(down.out_common[a : a + len(pos)])
        is_lms = np.flatnonzero(((np.asarray(level.code[pos - 1]) & 1) == 0) & (pos > 0))
        if len(is_lms):
            least = np.minimum.reduceat(value[: is_lms[-1] + 1], np.append(0, is_lms[:-1] + 1)).astype(np.int64)
            least[0] = min(int(least[0]), low)
            order[at - len(is_lms) : at] = pos[is_lms][::-1]
            # The least from an LMS suffix up to the one above it is that one's common prefix.
            spots = np.arange(at, at - len(is_lms), -1)
            fit = spots < m
            common[spots[fit]] = least[fit]
            at -= len(is_lms)
            rest = value[is_lms[-1] + 1 :]
            low = int(rest.min()) if len(rest) else level.same
        else:
            low = min(low, int(value.min()))
    if m > 1:
        common[1] = 0  # after the closing one
    del down
    return _resolved(level, lms, order, common, deeper)


def _resolved(level: _Level, lms: np.ndarray, order: np.ndarray, common: np.ndarray, deeper: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes from sorted LMS substrings: done if all differ, else by the order of the string of names.

    A name that only one place has is in order already. Such places are left out of the string, but for
    those that end a stretch of other names and so end every comparison in it.
    """
    scratch, m, part = level.scratch, level.lms_count, level.scratch.part()
    names = 0
    name = scratch.array(level.n // 2 + 1, level.index)  # LMS positions are two apart at least
    between, many = scratch.array(m, level.kind), scratch.array(m, bool)
    for a in range(0, m, part):
        value = np.asarray(common[a : a + part + 1])
        new = value != level.same
        after = np.append(new[1:], True) if len(value) <= part else new[1:]
        new = new[:part]
        number = names + np.cumsum(new)
        name[np.asarray(order[a : a + part]) >> 1] = number
        fresh = value[:part][new]
        between[names : names + len(fresh)] = fresh
        names += len(fresh)
        many[a : a + part] = ~(new & after)
    if names == m:
        return order, common
    several = scratch.zeros(names + 1, bool)  # of each name: whether more than one place has it
    for a in range(0, m, part):
        several[np.asarray(name[np.asarray(order[a : a + part]) >> 1])] = many[a : a + part]
    reduced, held = scratch.array(m, level.index), scratch.array(m, level.index)
    size, before = 0, True
    for a in range(0, m, part):
        own = np.asarray(name[np.asarray(lms[a : a + part]) >> 1])
        tied = np.asarray(several[own])
        kept = np.flatnonzero(tied | np.append(before, tied[:-1]))
        before = bool(tied[-1])
        reduced[size : size + len(kept)], held[size : size + len(kept)] = own[kept], a + kept
        size += len(kept)
    del name
    reduced = reduced[:size]
    inner = _Level(reduced, names + 1, level.depth, scratch) if names <= 2 * size else _Level(_renumbered(reduced, names, scratch), size + 1, level.depth, scratch)
    deeper.append(size)
    inner_order, shared = _suffixes(inner, deeper)
    del inner
    least = _RangeMin(between[:names], scratch)
    # The places of names that several have are filled in order; of one name, all but the first get their common prefix.
    at, before = 0, -1
    for a in range(0, size, part):
        item = np.asarray(inner_order[a : a + part]).astype(np.int64)
        n_shared = np.asarray(shared[a : a + part]).astype(np.int64)
        prior = np.append(before, item[:-1])
        before = int(item[-1])
        tied = np.flatnonzero(several[np.asarray(reduced[item])])
        item, prior, n_shared = item[tied], prior[tied], n_shared[tied]
        spots, at = _spots(many, at, len(item), part)
        start = np.asarray(lms[np.asarray(held[item])]).astype(np.int64)
        order[spots] = start
        inside = np.flatnonzero(np.asarray(common[spots]) == level.same)
        item, prior, n_shared, start, spots = item[inside], prior[inside], n_shared[inside], start[inside], spots[inside]
        i, j = np.minimum(prior + n_shared, size - 1), np.minimum(item + n_shared, size - 1)
        value = np.asarray(lms[np.asarray(held[j])]).astype(np.int64) - start
        x, y = np.asarray(reduced[i]).astype(np.int64), np.asarray(reduced[j]).astype(np.int64)
        differ = np.flatnonzero((x < y) & (n_shared < level.depth))
        if len(differ):
            value[differ] += least(x[differ], y[differ] - 1)  # names count from 1, their neighbours from 0
        value[n_shared >= level.depth] = level.depth
        common[spots] = np.minimum(value, level.depth)
    return order, common


def _renumbered(reduced: np.ndarray, names: int, scratch: Scratch) -> np.ndarray:
    """The names that are left, numbered from 1 on."""
    part, there = scratch.part(), scratch.zeros(names + 1, bool)
    for a in range(0, len(reduced), part):
        there[reduced[a : a + part]] = True
    number, out = scratch.array(names + 1, np.int64), scratch.array(len(reduced), reduced.dtype)
    np.cumsum(there, out=number)
    for a in range(0, len(reduced), part):
        out[a : a + part] = number[reduced[a : a + part]]
    return out


def _spots(many: np.ndarray, at: int, n: int, part: int) -> tuple[np.ndarray, int]:
    """The next n places from `at` on that are marked, and where the search goes on."""
    found: list[np.ndarray] = []
    while n:
        own = np.flatnonzero(many[at : at + part])[:n]
        n -= len(own)
        found.append(at + own)
        at = int(found[-1][-1]) + 1 if not n and len(own) else at + part
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), at


def _suffixes(level: _Level, deeper: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes but the closing one in order, and each one's common prefix with the one before."""
    seeds, common = _sorted_lms(level, deeper)
    up, down = _two_passes(level, seeds, common)
    n, scratch, part = level.n - 1, level.scratch, level.scratch.part()
    sa, lcp = scratch.array(n, level.index), scratch.array(n, level.kind)
    falls, rises = level.counts
    falls_upto, rises_upto = scratch.array(level.symbols, np.int64), scratch.array(level.symbols, np.int64)
    np.cumsum(falls, out=falls_upto)
    np.cumsum(rises, out=rises_upto)
    for a in range(0, up.done, part):
        pos = np.asarray(up.out_pos[a : min(a + part, up.done)])
        symbol = np.asarray(level.code[pos]).astype(np.int64) >> 1
        place = a + np.arange(len(pos)) + np.asarray(rises_upto[symbol]) - rises[symbol]
        sa[place], lcp[place] = pos, up.out_common[a : a + len(pos)]
    for a in range(0, down.done, part):
        b = min(a + part, down.done)
        pos = np.asarray(down.out_pos[a:b])
        symbol = np.asarray(level.code[pos]).astype(np.int64) >> 1
        place = down.done - 1 - np.arange(a, b) + np.asarray(falls_upto[symbol])
        # The common prefix with the one below is the next tuple's, or that of a fall and a rise.
        value = np.asarray(down.out_common[a + 1 : b + 1]).copy()
        lowest = np.flatnonzero(place == np.asarray(falls_upto[symbol]) + rises_upto[symbol] - rises[symbol])
        if len(lowest):
            own = symbol[lowest]
            fall = np.asarray(up.out_pos[np.maximum(np.asarray(falls_upto[own]) - 1, 0)]) if up.done else np.zeros(len(own), np.int64)
            value[lowest] = np.where(falls[own] > 0, np.minimum(np.asarray(level.run[fall]), np.asarray(level.run[pos[lowest]])), 0)
        sa[place], lcp[place] = pos, value
    return sa, lcp


def suffix_order(text: np.ndarray, depth: int, memory: int = 128 << 20, deeper: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of text in suffix order, and each one's common prefix with the one before, up to depth.

    text holds integers from 0 on, and may be a file mapped into memory; so may the results, whose files
    go when the arrays do. A suffix that ends is less than one that goes on. deeper gets the number of names
    of each recursion.
    """
    scratch = Scratch(memory)
    deeper = [] if deeper is None else deeper
    n, part = len(text), scratch.part()
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    # The symbols that occur are numbered from 1 on; the closing one is 0.
    top = max(int(text[a : a + part].max()) for a in range(0, n, part))
    if top < 1 << 22:
        present = np.zeros(top + 1, bool)
        for a in range(0, n, part):
            present[text[a : a + part]] = True
        number = np.cumsum(present)
        symbols, look = int(number[-1]) + 1, lambda x: number[x]
    else:
        found = np.unique(text)
        symbols, look = len(found) + 1, lambda x: np.searchsorted(found, x) + 1
    dense = scratch.array(n, np.uint8 if symbols <= 256 else np.uint16 if symbols <= 65536 else np.int64)
    for a in range(0, n, part):
        dense[a : a + part] = look(np.asarray(text[a : a + part]))
    try:
        return _suffixes(_Level(dense, symbols, depth, scratch), deeper)
    finally:
        scratch.close()  # mapped files stay readable until their arrays go
