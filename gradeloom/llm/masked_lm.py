"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are words in lower case, known by `IDS` hash values. The network sees the `REACH` tokens on both sides of
a masked place, never the token itself: their embeddings, weighted per offset and dimension, are summed and
passed through tanh. From there it predicts the token down a tree: a softmax over `CLASSES` classes, then the binary
decisions of the class's Huffman tree, each with weights of its own, to a leaf. The `OWN` most frequent
tokens have a leaf each; rarer ones share `SHARED` leaves, and within these a token has its corpus share.
So P(token | sides) is a distribution over all hash values, and frequent tokens are predicted one by one. A
document's score is the sum of the log-probabilities of all its tokens.

Everything comes from the whole corpus. Token counts are summed over all documents and give the tree. Documents are
dealt out by their hash to shards, as many as the corpus has millions of tokens, and ordered by it; a shard
is trained on by one copy of the network, on every place of every text, and the copies are averaged by
their numbers of tokens in a fixed order. So the result doesn't depend on how rows are
partitioned. Only counts and parameters, of a fixed size, reach the driver.

Cases: a null, empty or blank text has no tokens, score 0 and no mean; a single word has only padding at its
sides; repeated rows are scored alike to the bit, as log-probabilities are summed as whole numbers of 2^-32;
copies of one row in very large numbers are dealt to several shards; very long texts are read whole; ties in the
order of tokens go by hash value; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, releasing, slices, text_bytes, written
from .repeats import cut_words, mix

IDS, CLASSES, OWN, SHARED = 1 << 18, 64, 1 << 15, 1 << 15
WIDTH, REACH = 8, 2
#: Embeddings: of the most frequent tokens one each, the others share as many.
INPUTS = 1 << 13
PAD = INPUTS  # the embedding beyond a text's ends
BATCH, RATE = 8192, 0.2
SHARD_TOKENS = 3_000_000
#: Copies of one row, seen by one task, that go to one shard.
SAME = 1000
BLOCK = 4096  # parameters a row
UNIT = 2.0**32
SCHEMA = "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double"


@dataclass
class Tree:
    """What the corpus counts say: each token's input and leaf, and each leaf's way through the tree."""

    counts: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.counts)
        order = np.argsort(-self.counts, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        half = INPUTS // 2
        self.input = np.where(rank < half, rank, half + rank % half).astype(np.uint16)
        self.leaf = np.where(rank < OWN, rank, OWN + rank % SHARED).astype(np.uint16)
        weight = self.counts + 0.5  # half a count keeps unseen tokens possible
        leaves = np.bincount(self.leaf, weight, OWN + SHARED)
        leaves[leaves == 0] = 0.5
        self.share = np.log(weight / leaves[self.leaf])
        self.klass = (np.arange(len(leaves)) % CLASSES).astype(np.uint8)
        of_class = np.bincount(self.klass, leaves, CLASSES)
        self.class_bias = np.log(of_class / of_class.sum())
        nodes, bits, self.first, bias = [], [], np.zeros(len(leaves) + 1, np.int64), []
        ways: list[tuple[list[int], list[int]]] = [([], [])] * len(leaves)
        for c in range(CLASSES):
            own = range(c, len(leaves), CLASSES)
            heap = [(float(leaves[x]), x, None) for x in own]
            heapq.heapify(heap)
            number = len(leaves)
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
                number += 1
            stack = [(heap[0], [], [])]
            while stack:
                (total, name, both), way, turns = stack.pop()
                if both is None:
                    ways[name] = way, turns
                    continue
                mine = len(bias)
                bias.append(np.log(both[1][0] / both[0][0]))
                stack += [(both[k], [*way, mine], [*turns, k]) for k in (0, 1)]
        for x, (way, turns) in enumerate(ways):
            nodes += way
            bits += turns
            self.first[x + 1] = len(nodes)
        self.nodes, self.bits, self.long = np.array(nodes, np.uint16), np.array(bits, np.uint8), np.diff(self.first).astype(np.int8)
        self.node_bias = np.array(bias)

    def steps(self, leaf: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """An order of the leaves, longest way first, and for each step of the way the nodes and turns of those that
        go that far, which stand at the beginning of the order."""
        low, many = self.first[leaf], self.long[leaf]
        order = np.argsort(127 - many, kind="stable")
        low = low[order]
        going = np.cumsum(np.bincount(many, minlength=1)[::-1])[::-1].tolist()  # how many have so many steps at least
        return order, [(self.nodes[at := low[:n] + d], self.bits[at]) for d, n in enumerate(going[1:])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _segments(key: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of their rows."""
    order = np.argsort(key, kind="stable")  # 16 bits are sorted by counting
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *(np.add.reduceat(x[order], first, axis=0) for x in rows)


@dataclass
class Network:
    embed: np.ndarray  # (INPUTS + 1, WIDTH)
    offset: np.ndarray  # (2 * REACH, WIDTH)
    out: np.ndarray  # (WIDTH, CLASSES)
    bias: np.ndarray  # (CLASSES,)
    node: np.ndarray  # (nodes, WIDTH): weights of a decision
    node_bias: np.ndarray  # (nodes,)

    @staticmethod
    def first(tree: Tree, seed: int = 0) -> Network:
        """Before training: the corpus shares, whatever the sides are, but for small random weights."""
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (INPUTS + 1, WIDTH)).astype(np.float32), np.full((2 * REACH, WIDTH), 0.5, np.float32),
            rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32), tree.class_bias.astype(np.float32), np.zeros((len(tree.node_bias), WIDTH), np.float32), tree.node_bias.astype(np.float32))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.embed, self.offset, self.out, self.bias, self.node, self.node_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def of(self, flat: np.ndarray) -> Network:
        """A network of this one's shapes with other values."""
        ends = np.cumsum([x.size for x in self.parts()])
        return Network(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat[: ends[-1]], ends[:-1]), self.parts(), strict=True)))

    def hidden(self, sides: np.ndarray) -> np.ndarray:
        total = self.embed[sides[:, 0]] * self.offset[0]
        for k in range(1, sides.shape[1]):
            total += self.embed[sides[:, k]] * self.offset[k]
        return np.tanh(total)

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Of all classes, so that their exponentials have a sum in range."""
        out = h @ self.out
        out += self.bias
        if np.abs(self.out).sum(axis=0).max() + np.abs(self.bias).max() > 60:  # h is within 1
            out -= out.max(axis=1, keepdims=True)
        return out

    def leaf_log_probabilities(self, sides: np.ndarray, leaf: np.ndarray, tree: Tree) -> np.ndarray:
        h = self.hidden(sides)
        logits = self.logits(h)
        target = logits[np.arange(len(leaf)), tree.klass[leaf]].astype(np.float64)
        out = target - np.log(np.exp(logits, out=logits).sum(axis=1).astype(np.float64))
        order, steps = tree.steps(leaf)
        h, chance = h[order], np.ones(len(leaf))
        for nodes, bits in steps:
            n = len(nodes)
            z = np.einsum("ij,ij->i", self.node[nodes], h[:n]) + self.node_bias[nodes]
            chance[:n] *= _sigmoid(np.where(bits == 1, z, -z))
        out[order] += np.log(np.maximum(chance, 1e-300))
        return out


class Trainer:
    """Adaptive gradient steps; embeddings and decisions that a batch doesn't touch stay as they are."""

    def __init__(self, net: Network, tree: Tree, rate: float = RATE):
        self.net, self.tree, self.rate, self.tokens = net, tree, rate, 0
        self.seen = [np.ones(len(net.embed), np.float32), np.ones_like(net.offset), np.ones_like(net.out), np.ones_like(net.bias), np.ones(len(net.node), np.float32), np.ones(len(net.node), np.float32)]

    def gradients(self, sides: np.ndarray, leaf: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Of the summed negative log-probability: (inputs, their rows), offsets, output, bias, (nodes, their rows, their biases)."""
        net, n = self.net, len(leaf)
        order, steps = self.tree.steps(leaf)
        sides, leaf = sides[order], leaf[order]
        h = net.hidden(sides)
        p = net.logits(h)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), self.tree.klass[leaf]] -= 1
        back = p @ net.out.T
        total, at = sum(len(x) for x, _ in steps), 0
        step, own_bias = np.empty((total, net.node.shape[1]), net.node.dtype), np.empty(total, net.node.dtype)
        for nodes, bits in steps:
            own, m = net.node[nodes], len(nodes)
            g = own_bias[at : at + m]
            np.subtract(_sigmoid(np.einsum("ij,ij->i", own, h[:m]) + net.node_bias[nodes]), bits, out=g)
            np.multiply(h[:m], g[:, None], out=step[at : at + m])
            own *= g[:, None]
            back[:m] += own
            at += m
        back *= 1 - h * h
        offset = np.empty_like(net.offset)
        spread = np.empty((sides.shape[1], n, back.shape[1]), back.dtype)
        for k in range(sides.shape[1]):
            np.multiply(back, net.offset[k], out=spread[k])
            offset[k] = np.einsum("ij,ij->j", back, net.embed[sides[:, k]])
        embed = _segments(sides.T.ravel(), spread.reshape(-1, back.shape[1]))
        return embed, offset, h.T @ p, p.sum(axis=0), _segments(np.concatenate([x for x, _ in steps]), step, own_bias)

    def step(self, sides: np.ndarray, leaf: np.ndarray) -> None:
        net = self.net
        (inputs, embed), offset, out, bias, (nodes, node, node_bias) = self.gradients(sides, leaf)
        for value, seen, rows, g in ((net.embed, self.seen[0], inputs, embed), (net.node, self.seen[4], nodes, node)):
            total = seen[rows] + np.einsum("ij,ij->i", g, g) / g.shape[1]
            seen[rows] = total
            value[rows] -= g * (self.rate / np.sqrt(total))[:, None]
        total = self.seen[5][nodes] + node_bias * node_bias
        self.seen[5][nodes] = total
        net.node_bias[nodes] -= self.rate * node_bias / np.sqrt(total)
        for value, seen, g in zip((net.offset, net.out, net.bias), self.seen[1:4], (offset, out, bias), strict=True):
            seen += g * g
            value -= self.rate * g / np.sqrt(seen)
        self.tokens += len(leaf)


def token_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash value of each token of the texts, and where each text's tokens start (with the end of the last)."""
    u = cut_words([t.lower() for t in texts])
    return (mix(u.hashes) & np.uint64(IDS - 1)).astype(np.int32), u.first


class Line:
    """Inputs of texts in a row, with padding between them, so that a place's sides are where they stand."""

    def __init__(self, inputs: np.ndarray, first: np.ndarray):
        n = np.diff(first)
        self.at = np.arange(len(inputs)) + REACH * (1 + np.repeat(np.arange(len(n)), n))
        self.row = np.full(len(inputs) + REACH * (len(n) + 1), PAD, np.uint16)
        self.row[self.at] = inputs

    def sides(self, low: int, high: int) -> np.ndarray:
        """Inputs on both sides of the tokens from low to high - 1, nearest last on the left and first on the right."""
        return np.stack([self.row[self.at[low:high] + o] for o in (*range(-REACH, 0), *range(1, REACH + 1))], axis=1)


def token_table(docs: DataFrame) -> DataFrame:
    """doc_id, ids of the tokens, and a hash by which rows are dealt out and ordered; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                texts = text_bytes(batch.column(1))
                ids, first = token_ids(texts)
                deal = []
                for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                    name = xxhash.xxh3_64_digest(t, 0 if i is None else (2 * i + 1) % 2**64)
                    if i is None:  # only rows without an id can be equal in large numbers
                        seen[name] += 1
                        deal.append(xxhash.xxh3_64_intdigest(name, seen[name] // SAME))
                    else:
                        deal.append(int.from_bytes(name, "big"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), pa.array(np.array(deal, np.uint64).view(np.int64))],
                    names=["doc_id", "ids", "deal"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, ids array<int>, deal long")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets - offsets[0]


def count_tokens(tokens: DataFrame) -> np.ndarray:
    """Corpus counts of all hash values; one row for each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0))[0], minlength=IDS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(IDS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts


_PART = "block int, shard int, tokens double, total array<double>"


def _added(table: pa.Table) -> pa.Table:
    """Sums of a block's rows, in the order of their shards."""
    table = table.sort_by("shard")
    total, tokens = np.zeros(BLOCK), 0.0
    for row, n in zip(table.column("total"), table.column("tokens").to_pylist(), strict=True):
        total += row.values.to_numpy()
        tokens += n
    return pa.table({"block": table.column("block").slice(0, 1), "shard": table.column("shard").slice(0, 1), "tokens": pa.array([tokens]), "total": pa.array([total], pa.list_(pa.float64()))})


def train(tokens: DataFrame, net: Network, tree: Tree, n_tokens: int, number: int = 0, shard_tokens: int = SHARD_TOKENS) -> Network:
    """One round from net over every place of every text: the average of what the shards come to."""
    shards = max(1, -(-n_tokens // shard_tokens))
    shared = tokens.sparkSession.sparkContext.broadcast((net, tree))  # of a fixed size

    def learn(trainer: Trainer, held: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> None:
        ids = np.concatenate([x[0] for x in held])
        n = np.concatenate([np.diff(x[1]) for x in held])
        line, leaf = Line(trainer.tree.input[ids], np.concatenate([[0], np.cumsum(n)])), trainer.tree.leaf[ids]
        sides = line.sides(0, len(ids))
        order = rng.permutation(len(ids))
        for a in range(0, len(ids), BATCH):
            part = order[a : a + BATCH]
            trainer.step(sides[part], leaf[part])

    def result(trainer: Trainer, shard: int) -> Iterator[pa.RecordBatch]:
        if trainer.tokens:
            flat = trainer.net.flat().astype(np.float64) * trainer.tokens
            flat = np.append(flat, np.zeros(-len(flat) % BLOCK)).reshape(-1, BLOCK)
            n = len(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, float(trainer.tokens))), pa.FixedSizeListArray.from_arrays(flat.ravel(), BLOCK).cast(pa.list_(pa.float64()))],
                names=["block", "shard", "tokens", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tree = shared.value
        now, trainer, rng, held, size = None, None, None, [], 0
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cut, cut[1:], strict=False):
                if shard[a] != now:
                    if held:
                        learn(trainer, held, rng)
                    if trainer:
                        yield from result(trainer, now)
                    now, held, size = int(shard[a]), [], 0
                    trainer, rng = Trainer(net.of(net.flat()), tree), np.random.default_rng([number, now])
                # Row by row, as batches may be cut anywhere.
                ids, first = _ids(batch.column(1).slice(a, b - a))
                for x, y in zip(first.tolist(), first.tolist()[1:], strict=False):
                    if y > x:
                        held.append((ids[x:y], np.array([0, y - x])))
                        size += y - x
                    if size >= 16 * BATCH:
                        learn(trainer, held, rng)
                        held, size = [], 0
        if held:
            learn(trainer, held, rng)
        if trainer:
            yield from result(trainer, now)

    dealt = tokens.select(F.pmod("deal", F.lit(shards)).cast("int").alias("shard"), "ids", "deal").repartitionById(shards, "shard").sortWithinPartitions("shard", "deal")
    parts = dealt.select("shard", "ids").mapInArrow(releasing(run), _PART)
    some = parts.groupBy("block", F.floor(F.col("shard") / 64)).applyInArrow(_added, _PART)
    rows = some.groupBy("block").applyInArrow(_added, _PART).toArrow()
    if not rows.num_rows:
        return net
    rows = rows.sort_by("block")
    total = np.concatenate([x.values.to_numpy() / n for x, n in zip(rows.column("total"), rows.column("tokens").to_pylist(), strict=True)])
    return net.of(total)


@dataclass
class MaskedModel:
    net: Network
    tree: Tree


def fit(tokens: DataFrame, rounds: int = 1, seed: int = 0, shard_tokens: int = SHARD_TOKENS) -> MaskedModel:
    """A model of all rows of token_table()."""
    tree = Tree(count_tokens(tokens))
    net = Network.first(tree, seed)
    for r in range(rounds):
        net = train(tokens, net, tree, int(tree.counts.sum()), r, shard_tokens)
    return MaskedModel(net, tree)


def score_ids(model: MaskedModel, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-probability of every token from its sides, in whole numbers of 1 / UNIT.

    Batches have one size, filled up with padding, so that a token's value doesn't depend on its neighbours in the batch.
    """
    line, leaf = Line(model.tree.input[ids], first), model.tree.leaf[ids]
    out = np.empty(len(ids))
    sides, own = np.full((BATCH, 2 * REACH), PAD, np.uint16), np.zeros(BATCH, np.uint16)
    for a in range(0, len(ids), BATCH):
        b = min(a + BATCH, len(ids))
        sides[: b - a], own[: b - a] = line.sides(a, b), leaf[a:b]
        out[a:b] = model.net.leaf_log_probabilities(sides, own, model.tree)[: b - a]
    return np.rint((out + model.tree.share[ids]) * UNIT).astype(np.int64)


def score_tokens(tokens: DataFrame, model: MaskedModel) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = _ids(batch.column(1))
            upto = np.concatenate([[0], np.cumsum(score_ids(shared.value, ids, first))])
            n = np.diff(first)
            total = (upto[first[1:]] - upto[first[:-1]]) / UNIT
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), mean], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return tokens.select("doc_id", "ids").mapInArrow(releasing(run), SCHEMA)


def grade_documents(docs: DataFrame, rounds: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Train on all documents, then score each of them."""
    tokens = written(token_table(docs))
    out = written(score_tokens(tokens, fit(tokens, rounds, shard_tokens=shard_tokens)))
    dropped(tokens)
    return out
