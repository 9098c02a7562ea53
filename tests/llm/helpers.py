"""Small document tables with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, fingerprint string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(rng, n):
    out, line = [], []
    for i, w in enumerate(words(rng, n)):
        line.append(w)
        if i % 12 == 11:
            out.append(" ".join(line) + ".")
            line = []
    if line:
        out.append(" ".join(line) + ".")
    return "\n".join(out)


def awkward(seed=1, n=40):
    """Rows of (doc_id, text, lang, source, n_chars) and columns whose names clash with results."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 5, 30, 80, 200])) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5], None, None, "", "   \n\t ", "ÄÖ é 　x 汉字 \x1c y", "a" * 5000, "the. " * 700]
    texts += [prose(rng, 6000), texts[7] + "\n" + texts[8], " ".join(texts[9].split()[:60])]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or ""), False, -1, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here. " * 30, None, "src0", 0, None, None, None), (7, "same id, other text. " * 20, "en", "src1", 3, True, 1, "y")]
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def asc_words(text):
    return (text or "").encode().split()
