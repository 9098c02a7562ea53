import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from gradeloom.llm import induced


def brute(text, depth):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < depth and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("memory", [1 << 27, 5000, 300])
def test_order_and_common_prefixes(memory):
    rng = random.Random(memory)
    for trial in range(200):
        n, k = rng.choice([1, 2, 3, 10, 60, 200, 600]), rng.choice([1, 2, 3, 20])
        text = [rng.randrange(k) for _ in range(n)]
        if trial % 3 == 0 and n > 20:
            text = (text[: n // 4] * 5)[:n]
        if trial % 10 == 0:
            text = [10**7 + x * 10**9 for x in text]
        depth = rng.choice([1, 2, 5, 30, 700])
        sa, lcp = induced.suffix_order(np.array(text), depth, memory)
        order, common = brute(text, depth)
        key = lambda i: text[i : i + depth]
        assert sorted(sa.tolist()) == list(range(n))
        assert [key(i) for i in sa] == [key(i) for i in order]
        assert lcp.tolist() == common
    assert len(induced.suffix_order(np.zeros(0, int), 5)[0]) == 0


def natural(size):
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text
    return np.frombuffer("\n".join(x for x in texts if x).encode()[:size], np.uint8)


def test_a_text_ten_times_the_memory(tmp_path):
    size = 600_000
    natural(size).tofile(tmp_path / "text")
    text = np.memmap(tmp_path / "text", np.uint8, "r")
    spilled, deeper = [], []
    whole = induced.Queues._spill
    induced.Queues._spill = lambda self: (spilled.append(self.held), whole(self))
    tracemalloc.start()
    try:
        sa, lcp = induced.suffix_order(text, 200, size // 10, deeper)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        induced.Queues._spill = whole
    assert len(deeper) >= 2 and deeper[1] > 100  # recursion of recursion
    assert spilled and isinstance(sa, np.memmap) and isinstance(lcp, np.memmap)
    # Queues have the bound; parts and small arrays of all levels come to some times as much. In memory alone it's 60 times.
    assert peak < 20 * (size // 10)
    big = induced.suffix_order(np.array(text), 200)
    raw = bytes(text)
    assert sorted(sa.tolist()) == list(range(size))
    assert (lcp == big[1]).all()
    for i in range(1, size):
        a, b = int(sa[i - 1]), int(sa[i])
        k = int(lcp[i])
        assert raw[a : a + k] == raw[b : b + k] and (k == 200 or raw[a + k : a + k + 1] < raw[b + k : b + k + 1])
