"""SimHash near-duplicates found with BK-trees.

A document's fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 where over half
of them have it. Equal fingerprints are collapsed at once, so exact copies cost one row. Fingerprints
that differ in at most `radius` bits are found in shards: the 64 bits are cut into blocks, and two such
fingerprints agree on all but `radius` of the blocks, so each choice of the others is a table of shards
within which all of its pairs lie (the pigeonhole argument; nothing is lost). A shard is a BK-tree:
children hang on their parent by their distance to it, and a query follows only edges within `radius`
of its own distance. All trees of a task are built and searched level by level as arrays.

A shard of more than `tree_rows` fingerprints is cut into trees of that size and its queries go to every
one of them, so the tree that a task holds for its queries has a fixed bound. Each task returns a
spanning forest of the links it found, never all pairs. The number of blocks follows the number of
fingerprints, so that shards stay small; it doesn't change what is found.

Cases: a null, empty or blank text has fingerprint zero and links like any other; a text under four
words is one shingle; ties do not arise, as a component's name is its smallest doc_id; repeated rows get
equal rows; a component without any doc_id has a null name; an empty table gives no rows; other columns
are not read. `similar` finds near copies by similarity with the same trees over wider fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, text_bytes
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
TREE_ROWS = 16_384
#: Pairs of a query and a node that are looked at in one step.
FRONTIER = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                values = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def plan_blocks(n: int, radius: int = RADIUS, bits: int = 64) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (shift, width) and the choices of blocks that are tables, cheapest for n fingerprints."""

    def cost(m: int) -> float:
        return comb(m, radius) * (1 + n / 2 ** (bits * (m - radius) / m) / 50)

    m = min(range(radius + 1, radius + 6), key=cost)
    edges = [bits * i // m for i in range(m + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return blocks, list(combinations(range(m), m - radius))


def _shard_key(fp: Column, blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> Column:
    key, at = F.lit(0).cast("long"), 0
    for b in chosen:
        shift, width = blocks[b]
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key, at = key.bitwiseOR(F.shiftleft(part, at)), at + width
    return key


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which have one word each or several in a row."""
    d = np.bitwise_count(a ^ b)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over groups of values, one for each group; groups are given in runs."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        self.base = 64 * (values.shape[1] if values.ndim > 1 else 1) + 1  # numbers that a distance can be
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.roots = dict(zip(group[first].tolist(), first.tolist(), strict=True))
        run = np.cumsum(np.isin(np.arange(len(group)), first)) - 1
        at = first[run] if len(group) else first
        rest = np.flatnonzero(np.arange(len(group)) != at)
        at = at[rest]
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):
            edge = at * self.base + distance(values[rest], values[at])
            order = np.argsort(edge, kind="stable")
            edge, rest = edge[order], rest[order]
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            keys.append(edge[new])
            kids.append(rest[new])
            at = rest[new][np.cumsum(new) - 1][~new]
            rest = rest[~new]
        self.levels = [(k // self.base, c) for k, c in zip(keys, kids, strict=True)]
        self.keys, self.kids = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def one_label(self, label: np.ndarray) -> np.ndarray:
        """For each node the label that its whole subtree has, or -1."""
        low, high = label.copy(), label.copy()
        for parent, kid in reversed(self.levels):
            np.minimum.at(low, parent, low[kid])
            np.maximum.at(high, parent, high[kid])
        return np.where(low == high, low, -1)

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, own: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) of values within radius, in parts of at most FRONTIER.

        A subtree all of whose nodes have the query's own label is left out: its links are known.
        """
        # Work that waits is held as ranges of children, which are small, and opened part by part.
        q, node = np.arange(len(queries)), roots
        stack = []
        while True:
            new = known[node] != own[q]
            q, node = q[new], node[new]
            d = distance(queries[q], self.values[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * self.base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * self.base + np.minimum(d + radius, self.base - 1), side="right") - low
            some = n > 0
            if some.any():
                stack.append((q[some], low[some], n[some]))
            if not stack:
                return
            q, low, n = stack.pop()
            upto = np.cumsum(n)
            if upto[-1] > FRONTIER and len(q) > 1:
                cut = max(1, int(np.searchsorted(upto, FRONTIER)))
                stack.append((q[cut:], low[cut:], n[cut:]))
                q, low, n, upto = q[:cut], low[:cut], n[:cut], upto[:cut]
            q = np.repeat(q, n)
            node = self.kids[np.arange(int(upto[-1])) - np.repeat(upto - n, n) + np.repeat(low, n)]


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's is a node of its component with the label itself) after joining the pairs a, b."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _search_shards(radius: int, words: int):
    """Rows (shard, part, role, name, fingerprint's words), sorted, to links of names; role 1 is in the tree, 2 asks,
    3 both."""

    def links(shard: np.ndarray, role: np.ndarray, name: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        # A name may stand in several shards; labels are kept by name.
        nodes, number = np.unique(name, return_inverse=True)
        tree, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        forest = Forest(fp[tree], shard[tree])
        root = np.array([forest.roots.get(s, -1) for s in shard[asks].tolist()], np.int64)
        asks, root = asks[root >= 0], root[root >= 0]
        label = np.arange(len(nodes))
        home, kid = forest.keys // forest.base, forest.kids
        near = forest.keys % forest.base <= radius
        label = spanning(label, number[tree[home[near]]], number[tree[kid[near]]])
        at, size = 0, 512
        while at < len(asks):
            # Labels grow from part to part, so that ever more subtrees are left out.
            part = slice(at, at + size)
            known = forest.one_label(label[number[tree]])
            mine = number[asks[part]]
            for q, node in forest.search(fp[asks[part]], root[part], radius, label[mine], known):
                label = spanning(label, mine[q], number[tree[node]])
            at, size = at + size, min(size * 4, 65_536)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def parts(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t, key, part, role, name, *fp = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            end = len(t) if last else int(np.flatnonzero(new)[-1])  # the last group may go on
            if end:
                value = np.stack([x[:end] for x in fp], axis=1).view(np.uint64) if words > 1 else fp[0][:end].view(np.uint64)
                yield links(np.cumsum(new)[:end], role[:end], name[:end], value)
            held = [[x[end:] for x in (t, key, part, role, name, *fp)]] if end < len(t) else []
            rows = len(t) - end

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rows += batch.num_rows
                if rows > 200_000:
                    yield from parts(False)
        if held:
            yield from parts(True)

    return run


def tree_links(shards: DataFrame, radius: int, tree_rows: int, words: int = 1) -> DataFrame:
    """Links (a, b) of names that join all pairs within radius in their shard; shards has t, key, name, fp0, fp1 and so
    on, as many as words."""
    prints = [f"fp{i}" for i in range(words)]
    large = shards.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_rows)
    large = large.select("t", "key", F.ceil(F.col("n") / tree_rows).cast("int").alias("parts"))
    dealt = shards.join(large, ["t", "key"], "left")
    # In a large shard each value is in one part's tree and asks the trees of all the others.
    home = F.pmod(F.xxhash64("name"), F.col("parts").cast("long")).cast("int")
    spread = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(3).alias("role")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.when(p == home, 3).otherwise(2).alias("role"))))
    dealt = dealt.select("t", "key", F.explode(spread).alias("x"), "name", *prints).select("t", "key", "x.part", "x.role", "name", *prints)
    dealt = dealt.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "role")
    kind = shards.schema["name"].dataType.simpleString().replace("bigint", "long")
    return dealt.mapInArrow(_search_shards(radius, words), f"a {kind}, b {kind}")


def near_links(values: DataFrame, n: int, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) of distinct fp values that join all pairs within radius; n is their number."""
    blocks, tables = plan_blocks(n, radius)
    shards = values.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("t"), _shard_key(F.col("fp"), blocks, chosen).alias("key")) for i, chosen in enumerate(tables)))).alias("s"))
    return tree_links(shards.select("s.t", "s.key", F.col("fp").alias("name"), F.col("fp").alias("fp0")), radius, tree_rows)


def component_names(prints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(fp, component_id) for each distinct fp of prints(doc_id, fp)."""
    values = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    n = values.count()
    links = checkpointed(near_links(values.select("fp"), n, radius, tree_rows).distinct())
    roots = components(links, "a", "b").withColumnRenamed("node", "fp")
    named = values.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # With an exchange of its own for the join, Spark can split a component that has very many fingerprints.
    names = names.repartition("component_id")
    return named.join(names, "root").select("fp", "component_id")


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of docs."""
    prints = checkpointed(fingerprints(docs, shingle))
    names = component_names(prints, radius, tree_rows)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(names, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")
