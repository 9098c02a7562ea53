import random

import numpy as np
import xxhash

from gradeloom.llm import simhash
from gradeloom.llm.components import components
from helpers import awkward, prose, table


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, radius=4):
    prints = [brute_print(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted((-1 if r[0] is None else r[0], f"{p:016x}", -1 if ids.get(find(i)) is None else ids[find(i)]) for i, (r, p) in enumerate(zip(rows, prints)))


def near_rows():
    rng = random.Random(8)
    rows = awkward()
    for k in range(6):
        words = prose(rng, 300).split(" ")
        for c in range(8):
            new = list(words)
            for _ in range(c // 2):
                new[rng.randrange(len(new))] = f"new{rng.randrange(99)}"
            rows.append((1000 + 10 * k + c, " ".join(new), "en", "s", 0, None, None, None))
    return rows


def test_matches_brute_force(spark):
    rows = near_rows()
    got = simhash.near_components(table(spark, rows)).collect()
    key = lambda x: -1 if x is None else x
    assert sorted((key(g.doc_id), g.fingerprint, key(g.component_id)) for g in got) == brute_components(rows)
    assert simhash.near_components(table(spark, [])).count() == 0


def test_large_shards_are_cut_without_loss(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 6)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(150):
            v = int(b)
            for bit in rng.integers(0, 63, rng.integers(1, 7)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {v: find(v) for v in values}
    for n, rows in ((len(values), 20), (10**7, 16384), (10**10, 7)):
        links = simhash.near_links(frame, n, tree_rows=rows)
        got = {r.node: r.root for r in components(links, "a", "b").collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_trees_over_wide_fingerprints():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, (400, 2), dtype=np.uint64)
    values[200:] = values[:200]
    for row in values[200:]:
        for bit in rng.integers(0, 63, 30):
            row[bit % 2] ^= np.uint64(1) << np.uint64(bit)
    forest = simhash.Forest(values, np.zeros(400, int))
    label = -np.ones(400, int)
    got = {(int(q), int(n)) for a, b in forest.search(values, np.zeros(400, int), 44, np.arange(400), label) for q, n in zip(a, b)}
    want = {(i, j) for i in range(400) for j in range(400) if sum(int(x).bit_count() for x in values[i] ^ values[j]) <= 44}
    assert got == want and len(want) >= 800
