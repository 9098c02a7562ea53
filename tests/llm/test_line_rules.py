import re

from gradeloom.llm import line_rules
from helpers import asc_words, awkward, table


def brute(text):
    text = text or ""
    words = asc_words(text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if asc_words(x)]
    n, repeat = len(words), len(covered)
    return n, len(b"".join(words).decode()), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 20 or 100 * repeat > 30 * n


def test_counts_match_brute_force(spark):
    rows = awkward(n=30)
    rows = [r for r in rows if len(r[1] or "") < 20000]
    rows.append((900, "a b c d e f g h i\nx a b c d e f g h i\nx\n\nx\r\n" * 2, "en", "s", 0, None, None, None))
    docs = table(spark, rows)
    got = line_rules.judge_documents(docs.select("doc_id", "text")).collect()
    want = sorted((r[0] if r[0] is not None else -1, *brute(r[1])) for r in rows)
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got) == want
    assert all(not g.kept for g in got if g.base_failed)


def test_lines(spark):
    lines = {
        "Plain prose with a closing mark.": True,
        "": True,
        "Home | News | About | Contact | Help": False,
        "this%%% has&&& noise### in$$$ it***": False,
        "no no no no no no no no no": False,
        "Accept our Cookie Policy": False,
        " ".join(f"w{i}" for i in range(45)): False,
        " ".join(f"w{i}" for i in range(45)) + ".": True,
        "short heading": True,
    }
    frame = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r.line: r.ok for r in frame.select("line", line_rules.line_passes(line_rules.read_lines(frame.line)[0]).alias("ok")).collect()}
    assert got == lines


def test_clean_documents_keeps_columns_and_good_lines(spark):
    good = "\n".join(f"Sentence number {i} says something new about subject {i * 7}." for i in range(10))
    rows = [(1, good + "\nHome | News | About | Contact", "en", "s", 1, True, 2, "z"), (2, "Home | News | About | Contact\n" * 12, "en", "s", 1, True, 2, "z")]
    out = line_rules.clean_documents(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    assert [(r.doc_id, r.text, r.fingerprint) for r in out.collect()] == [(1, good, "z")]
    assert line_rules.clean_documents(table(spark, [])).count() == 0
