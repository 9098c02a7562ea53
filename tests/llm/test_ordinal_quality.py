import random

import numpy as np

from gradeloom.llm import ordinal_quality as oq
from helpers import awkward, prose, table

BAD = ["vilea", "vileb", "vilec", "viled"]


def graded(n, seed):
    """Documents of three grades: vile words make 1, vile words and noise 0, else 2."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.choice([5, 30, 150])).split()
        kind = rng.choice([0, 0, 1, 2, 3])
        if kind in (1, 3):
            words[rng.randrange(len(words))] = rng.choice(BAD)
            words.append(rng.choice(BAD) + ".")
        if kind in (2, 3):
            words = [w + rng.choice(["%%%", "&&&", "###"]) for w in words]
        rows.append((i, " ".join(words), "en", "s", 0, None, None, None))
        labels.append((i, int(kind < 2), int(kind in (1, 3))))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = graded(1200, 3)
    docs, table_ = table(spark, rows), spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in oq.grade_documents(docs, table_).collect()}
    assert len(got) == 1200
    grade = {i: q + 1 - t for i, q, t in labels}
    held = range(700, 1200)
    assert np.mean([got[i].kept == (grade[i] == 2) for i in held]) > 0.98
    means = [np.mean([got[i].expected_grade for i in held if grade[i] == g]) for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2]
    again = {r.doc_id: r.score for r in oq.grade_documents(docs, table_).collect()}
    assert all(again[i] == got[i].score for i in got)


def test_thresholds_are_ordered_and_tails_fall():
    rows = [(np.array([1] * g + [2], np.int32), 2 - g) for g in (0, 1, 2) for _ in range(50)]
    model = oq.fit(rows, 3, dimensions=8)
    assert list(model.thresholds) == sorted(model.thresholds)
    tails = model.tails(np.array([-3.0, 0.0, 3.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails, axis=0) > 0).all()


def test_awkward_tables(spark):
    rows = awkward()
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert oq.grade_documents(table(spark, rows), empty).count() == len(rows)
    assert oq.grade_documents(table(spark, []), empty).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert oq.grade_documents(table(spark, rows), odd).where("kept is null").count() == 0
    few = oq.labelled_features(table(spark, rows), odd, max_labelled=1)
    assert len(few) <= 2


def test_bound_of_the_sample(spark):
    rows, labels = graded(60, 4)
    found = oq.labelled_features(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_labelled=25)
    assert len(found) == 25


def test_repeated_documents_and_lost_labels_keep_the_bound(spark):
    rows, labels = graded(40, 5)
    rows = rows + rows[:20] + [(3, "another text", None, None, 0, None, None, None)]
    labels = labels + labels[:10] + [(1000 + i, 1, 0) for i in range(100)]
    found = oq.labelled_features(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_labelled=30)
    assert len(found) == 30
    assert len(oq.labelled_features(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == 41


def test_scores_are_the_plain_sums(spark):
    import math

    import xxhash

    rng = np.random.default_rng(1)
    model = oq.OrdinalModel(rng.normal(0, 1, oq.DIMENSIONS).astype(np.float32), np.array([-1.0, 0.5]))
    slot = lambda kind, value: xxhash.xxh64_intdigest(value.encode(), ord(kind)) % oq.DIMENSIONS
    rows = awkward()
    got = {r.doc_id: r for r in oq.score_documents(table(spark, rows), model).collect()}
    for r in rows:
        words = (r[1] or "").encode().split()
        count = {}
        for w in {x.decode() for x in words}:
            letters = "".join(c for c in w if c.isalpha()).lower()
            marks = "".join(c for c in w if not c.isalnum())
            own = [slot("w", letters)] if letters else []
            own += [slot("4", letters[:4])] * (len(letters) > 4) + [slot("5", letters[:5])] * (len(letters) > 5)
            for s in own + ([slot("m", marks)] if marks else []):
                count[s] = count.get(s, 0) + 1
        lines = [x for x in (r[1] or "").split("\n") if x]
        rates = [(sum(a == b for a, b in zip(words, words[1:])), len(words)), (words.count(b"|"), len(words)), (sum(w[-1:] in b"%&$#*" for w in words), len(words)), (len(lines) - len(set(lines)), len(lines))]
        for i, (c, n) in enumerate(rates):
            if c and words:
                s = slot("r", f"{i}:{min(9, int(math.log2(n / c)))}")
                count[s] = count.get(s, 0) + 1
        score = sum(float(model.weights[s]) * math.sqrt(n) for s, n in count.items())
        if sum(x[0] == r[0] for x in rows) == 1:
            assert abs(got[r[0]].score - score) < 1e-6 * (1 + abs(score))
            tails = [1 / (1 + math.exp(t - score)) for t in (-1.0, 0.5)]
            assert abs(got[r[0]].expected_grade - sum(tails)) < 1e-6 and got[r[0]].kept == (got[r[0]].tail_probability >= 0.5)


def test_held_out_documents_of_the_tables():
    import pandas as pd

    folder = "/root/testdata/sf0.01"
    rows = pd.read_parquet(f"{folder}/labels.parquet").merge(pd.read_parquet(f"{folder}/documents.parquet"), on="doc_id").dropna(subset=["quality", "toxic", "text"])
    rows = rows.sample(frac=1, random_state=3)
    made = [(np.array(oq.features(t.encode()), np.int32), int(q + 1 - x)) for t, q, x in zip(rows.text, rows.quality, rows.toxic)]
    n = len(made) * 3 // 4
    model = oq.fit(made[:n], 3)
    kept = []
    for slots, grade in made[n:]:
        u, c = np.unique(slots, return_counts=True)
        kept.append((model.tails(np.array([(model.weights[u] * np.sqrt(c)).sum()]))[0, -1] >= 0.5, grade))
    assert np.mean([k for k, g in kept if g == 2]) > 0.95 and np.mean([not k for k, g in kept if g < 2]) > 0.75
