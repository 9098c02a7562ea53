import random

import numpy as np

import corpus_pipeline
from gradeloom.llm import similar
from helpers import prose, table
from test_simhash import near_rows


def brute_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]


def brute_kept(rows):
    """Texts, with their doc_ids, that stay: the least doc_id of each component of pairs of similarity 0.8."""
    sets = brute_sets([r[1] for r in rows])
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def edited_rows():
    """Copies with up to a dozen words of 200 changed: similarities on both sides of 0.8."""
    rng = random.Random(31)
    rows = []
    for k in range(40):
        words = prose(rng, 200).split(" ")
        for c in range(6):
            new = list(words)
            for x in rng.sample(range(len(new)), min(len(new), rng.randrange(13))):
                new[x] = f"new{rng.randrange(999)}"
            rows.append((10 * k + c, " ".join(new), "en", "s", 0, None, None, None))
    return rows


def ids(out):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())


def test_the_stage_keeps_one_of_each_group_by_similarity(spark):
    rows = [r for r in near_rows() if r[0] is not None and r[0] != 7 and r[0] != 4] + [(9000 + r[0], *r[1:]) for r in edited_rows()]
    docs = table(spark, rows)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and ids(out) == brute_kept(rows)


def test_parts_of_a_large_component_give_the_same(spark):
    rows = edited_rows()
    want = brute_kept(rows)
    assert 40 < len(want) < len(rows)
    assert ids(similar.drop_similar(table(spark, rows), load=150)) == want
    assert ids(similar.drop_similar(table(spark, rows), tree_rows=2, few=0)) == want


def test_fingerprints_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(5)
    worst = 0
    for _ in range(4000):
        union = rng.integers(0, 2**63, int(rng.choice([5, 6, 10, 15, 50, 300])), dtype=np.uint64)
        both = -(-8 * len(union) // 10)
        cut = rng.integers(both, len(union) + 1)  # shared ones, then some of the first set alone
        a, b = union[:cut], np.concatenate([union[:both], union[cut:]])
        x, y = similar.wide_print(a), similar.wide_print(b)
        worst = max(worst, sum(int(z).bit_count() for z in x ^ y))
    assert worst <= similar.RADIUS


def test_groups_are_exact():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5)}" for _ in range(rng.randrange(9))) for _ in range(300)]
    got = similar.groups(similar.shingle_sets([t.encode() for t in texts])).tolist()
    sets = brute_sets(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == label


def test_rows_are_told_apart_by_doc_id_and_text(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    row = lambda i, t: (i, t, "en", "s", 0, None, None, None)
    rows = [row(1, a), row(1, b), row(2, b + " more"), row(None, c), row(None, c), row(None, c + " more"), row(None, a), row(3, d), row(3, d)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text.removesuffix(" more")) for r in corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect())
    assert got == sorted([(False, 1, a), (False, 1, b), (False, 3, d), (True, 0, c)])
