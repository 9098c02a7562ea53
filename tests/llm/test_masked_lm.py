import math
import random

import numpy as np
import pandas as pd
import pytest

from gradeloom.llm import masked_lm as lm
from helpers import awkward, prose, table


def grammar(rng, n):
    """Sentences whose middle words follow from both neighbours."""
    out = []
    for _ in range(n):
        a, b = rng.randrange(6), rng.randrange(6)
        out += [f"left{a}", f"mid{(a + b) % 6}", f"right{b}", "stop."]
    return out


def counted(texts):
    return np.bincount(lm.token_ids(texts)[0], minlength=lm.IDS)


def trained(texts, epochs=1, sides=lambda x: x):
    """Network and tree of texts, in one task without Spark."""
    tree = lm.Tree(counted(texts))
    trainer, rng = lm.Trainer(lm.Network.first(tree), tree), np.random.default_rng(0)
    ids, first = lm.token_ids(texts)
    x, y = sides(lm.Line(tree.input[ids], first).sides(0, len(ids))), tree.leaf[ids]
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for a in range(0, len(ids), lm.BATCH):
            trainer.step(x[order[a : a + lm.BATCH]], y[order[a : a + lm.BATCH]])
    return lm.MaskedModel(trainer.net, tree)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    tree = lm.Tree(rng.integers(0, 50, lm.IDS))
    net = lm.Network.first(tree)
    net = lm.Network(*(x.astype(np.float64) for x in net.parts()))
    net.node[:] = rng.normal(0, 0.1, (len(net.node), lm.WIDTH))
    sides, leaf = rng.integers(0, 50, (20, 2 * lm.REACH)), rng.integers(0, lm.OWN + lm.SHARED, 20).astype(np.uint16)
    (inputs, embed), offset, out, bias, (nodes, node, node_bias) = lm.Trainer(net, tree).gradients(sides, leaf)
    total = lambda: -net.leaf_log_probabilities(sides, leaf, tree).sum()
    for value, spot, got in ((net.embed, (inputs[3], 3), embed[3, 3]), (net.offset, (2, 5), offset[2, 5]), (net.out, (4, tree.klass[leaf[0]]), out[4, tree.klass[leaf[0]]]), (net.bias, (7,), bias[7]), (net.node, (nodes[2], 6), node[2, 6]), (net.node_bias, (nodes[5],), node_bias[5])):
        keep = value[spot]
        value[spot] = keep + 1e-5
        up = total()
        value[spot] = keep - 1e-5
        down = total()
        value[spot] = keep
        assert got == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_a_masked_token_is_not_seen():
    ids, first = lm.token_ids([b"a b c d e f g", b"x y z"])
    line = lm.Line(np.arange(10), first)
    sides = line.sides(0, 10)
    assert sides[3].tolist() == [1, 2, 4, 5] and sides[7].tolist() == [lm.PAD, lm.PAD, 8, 9] and sides[6].tolist() == [4, 5, lm.PAD, lm.PAD]
    assert len(ids) == 10 and all(i not in s for i, s in enumerate(sides.tolist()))


def test_probabilities_of_all_tokens_sum_to_one():
    model = trained([" ".join(grammar(random.Random(1), 200)).encode()])
    sides = np.repeat(np.array([[3, 4, 5, 6]]), lm.OWN + lm.SHARED, axis=0)
    leaves = np.exp(model.net.leaf_log_probabilities(sides, np.arange(len(sides)).astype(np.uint16), model.tree))
    assert leaves.sum() == pytest.approx(1, rel=1e-4)
    assert np.allclose(np.bincount(model.tree.leaf, np.exp(model.tree.share), len(leaves))[np.unique(model.tree.leaf)], 1)


def test_scores_are_the_plain_sums(spark):
    rows = awkward()
    docs = table(spark, rows)
    tokens = lm.token_table(docs)
    model = lm.fit(tokens)
    net, tree = model.net, model.tree
    got = {(g.doc_id, g.n_tokens, g.pseudo_log_likelihood) for g in lm.score_tokens(tokens, model).collect()}
    for r in rows:
        ids = lm.token_ids([(r[1] or "").encode()])[0].tolist()
        if len(ids) > 300:
            continue
        total = 0.0
        for i, x in enumerate(ids):
            sides = [int(tree.input[ids[i + o]]) if 0 <= i + o < len(ids) else lm.PAD for o in (-2, -1, 1, 2)]
            h = np.tanh(sum(net.embed[s].astype(float) * net.offset[k] for k, s in enumerate(sides)))
            logits = h @ net.out + net.bias
            leaf = int(tree.leaf[x])
            total += logits[tree.klass[leaf]] - math.log(np.exp(logits).sum()) + tree.share[x]
            for k in range(tree.first[leaf], tree.first[leaf + 1]):
                z = net.node[tree.nodes[k]] @ h + net.node_bias[tree.nodes[k]]
                total -= math.log1p(math.exp(-z if tree.bits[k] else z))
        found = [g[2] for g in got if g[0] == r[0] and g[1] == len(ids)]
        assert any(abs(x - total) < 1e-3 * (1 + len(ids)) for x in found)
    blank = [g for g in lm.grade_documents(docs).collect() if g.n_tokens == 0]
    assert len(blank) == 4 and all(g.pseudo_log_likelihood == 0 and g.mean_log_probability is None for g in blank)
    assert lm.grade_documents(table(spark, [])).count() == 0


def test_equal_texts_score_alike_and_partitions_do_not_matter(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([3, 40, 333])) for _ in range(80)]
    rows = [(i, texts[i % 70] if i % 3 else texts[0], "en", "s", 0, None, None, None) for i in range(240)] + [(None, texts[1], None, None, 0, None, None, None)] * 5
    scores = []
    for parts in (1, 7):
        got = lm.grade_documents(table(spark, rows, parts), shard_tokens=4000).collect()
        scores.append(sorted((-1 if g.doc_id is None else g.doc_id, g.n_tokens, g.pseudo_log_likelihood) for g in got))
    assert scores[0] == scores[1]
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1], set()).update(s for i, _, s in scores[0] if i == (-1 if r[0] is None else r[0]))
    assert all(len(s) == 1 for s in by_text.values())


def test_held_out_documents_are_better_known_than_by_frequency_or_one_side():
    texts = [t.encode() for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").drop_duplicates("text").text if t]
    random.Random(2).shuffle(texts)
    held, rest = texts[:100], texts[100:]

    def left(x):
        out = x.copy()
        out[:, lm.REACH :] = lm.PAD
        return out

    def score(model, change=lambda x: x):
        ids, first = lm.token_ids(held)
        sides = change(lm.Line(model.tree.input[ids], first).sides(0, len(ids)))
        return (model.net.leaf_log_probabilities(sides, model.tree.leaf[ids], model.tree) + model.tree.share[ids]).mean()

    both, one = trained(rest), trained(rest, sides=left)
    start = lm.MaskedModel(lm.Network.first(both.tree), both.tree)
    start.net.out[:] = 0
    unigram, left_only, full = score(start), score(one, left), score(both)
    print(unigram, left_only, full)
    assert unigram < left_only < full and full > unigram + 0.1


def test_middle_words_follow_from_both_sides():
    model = trained([" ".join(grammar(random.Random(i), 300)).encode() for i in range(20)], epochs=4)
    fresh = " ".join(grammar(random.Random(99), 100)).encode()
    mixed = fresh.split()
    random.Random(5).shuffle(mixed)
    good, bad = (lm.score_ids(model, *lm.token_ids([t])).sum() for t in (fresh, b" ".join(mixed)))
    assert good > bad + 100 * lm.UNIT
