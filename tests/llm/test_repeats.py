import hashlib
import random
from collections import defaultdict

import pytest

from gradeloom.llm import repeats, substring_dedup, suffix_dedup
from helpers import awkward, prose, table


def brute(units, window):
    """Covered flags for each document's units."""
    places = defaultdict(int)
    for d, u in enumerate(units):
        for i in range(len(u) - window + 1):
            places[tuple(u[i : i + window])] += 1
    out = []
    for u in units:
        flags = [False] * len(u)
        for i in range(len(u) - window + 1):
            if places[tuple(u[i : i + window])] > 1:
                flags[i : i + window] = [True] * window
        out.append(flags)
    return out


def shared_rows():
    rng = random.Random(11)
    passage = prose(rng, 90)
    rows = awkward(seed=2, n=20)
    for i in range(25):
        rows.append((500 + i, prose(rng, rng.randrange(0, 60)) + " " + passage + " " + prose(rng, rng.randrange(0, 60)), "en", "s", 0, None, None, None))
    base = prose(rng, 150).split()
    for i in range(12):
        new = list(base)
        new[rng.randrange(len(new))] = f"edit{i}"
        rows.append((600 + i, "\t".join(new), "en", "s", 0, None, None, None))
    rows.append((700, " ".join(base[:34]), "en", "s", 0, None, None, None))
    rows.append((701, " ".join(base[:35]), "en", "s", 0, None, None, None))
    rows.append((702, " ".join(["x y z"] * 40) + " " + prose(rng, 40), "en", "s", 0, None, None, None))
    return rows


def runs(flags):
    return sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))


def key(x):
    return tuple(-1 if v is None else v for v in x)


@pytest.mark.parametrize("block, hot, piece", [(1 << 21, repeats.HOT, repeats.PIECE_BYTES), (3000, 5, 700), (3000, 0, 250)])
def test_words_match_brute_force(spark, block, hot, piece, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_UNITS", block)
    monkeypatch.setattr(repeats, "PIECE_BYTES", piece)
    monkeypatch.setattr(substring_dedup, "Search", lambda w, a, words: repeats.Search(w, a, words, piece))
    rows = shared_rows()
    units = [(r[1] or "").encode().split() for r in rows]
    want = []
    for r, u, flags in zip(rows, units, brute(units, 35)):
        kept = b" ".join(w for w, f in zip(u, flags) if not f)
        want.append(key((r[0], len(u), sum(flags), hashlib.sha256(kept).hexdigest())))
    got = substring_dedup.remove_repeats(table(spark, rows), hot=hot).collect()
    assert sorted(key((g.doc_id, g.n_words, g.n_removed, g.kept_sha256)) for g in got) == sorted(want)
    assert all(hashlib.sha256(g.kept_text.encode()).hexdigest() == g.kept_sha256 for g in got)
    assert sum(w[2] for w in want) > 2000


@pytest.mark.parametrize("memory, hot", [(128 << 20, repeats.HOT), (20000, 5)])
def test_bytes_match_brute_force(spark, memory, hot):
    rows = shared_rows()
    units = [(r[1] or "").encode() for r in rows]
    want = []
    for r, u, flags in zip(rows, units, brute(units, 200)):
        kept = bytes(b for b, f in zip(u, flags) if not f)
        want.append(key((r[0], len(u), sum(flags), runs(flags), hashlib.sha256(kept).hexdigest())))
    got = suffix_dedup.remove_repeats(table(spark, rows), memory=memory, hot=hot).collect()
    assert sorted(key((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256)) for g in got) == sorted(want)
    assert sum(w[2] for w in want) > 5000


def test_short_windows_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 40))), None, None, 0, None, None, None) for i in range(60)]
    units = [(r[1] or "").encode() for r in rows]
    want = sorted((r[0], sum(f)) for r, f in zip(rows, brute(units, 9)))
    assert sorted((g.doc_id, g.n_removed) for g in suffix_dedup.remove_repeats(table(spark, rows), 9, 3).collect()) == want
    words = [u.split() for u in units]
    want = sorted((r[0], sum(f)) for r, f in zip(rows, brute(words, 3)))
    assert sorted((g.doc_id, g.n_removed) for g in substring_dedup.remove_repeats(table(spark, rows), 3, 1).collect()) == want
    for module in (substring_dedup, suffix_dedup):
        assert module.remove_repeats(table(spark, [])).count() == 0


def test_words_that_hash_alike_under_a_polynomial_differ(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    # A polynomial modulo a power of two gives both the same value.
    x, y = [f"x{i}" for i in range(20)], [f"y{i}" for i in range(20)]
    rows = [(i, " ".join([*x, w, *y]), None, None, 0, None, None, None) for i, w in enumerate((a, b))]
    assert [(g.n_words, g.n_removed) for g in substring_dedup.remove_repeats(table(spark, rows)).collect()] == [(41, 0)] * 2
    rows = [(i, "-" * 150 + w + "+" * 150, None, None, 0, None, None, None) for i, w in enumerate((a[:128], b[:128]))]
    assert [g.n_removed for g in suffix_dedup.remove_repeats(table(spark, rows)).collect()] == [0, 0]


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "Search", lambda w, a, words: repeats.Search(w, a, words, 30_000))
    long = "".join(rng.choice("abcdefgh \n") for _ in range(150_000))
    rows = [(0, long, None, None, 0, None, None, None), (1, long[29_000:31_000] + "#" + long[59_900:60_100] + "é" + long[149_801:], None, None, 0, None, None, None), (2, long[70_000:70_199], None, None, 0, None, None, None)]
    rows.append((3, long[3:120_003], None, None, 0, None, None, None))
    units = [r[1].encode() for r in rows]
    want = [(r[0], len(u), sum(f), runs(f), hashlib.sha256(bytes(b for b, x in zip(u, f) if not x)).hexdigest()) for r, u, f in zip(rows, units, brute(units, 200))]
    got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want
