import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gradeloom.llm import packing, pseudonyms
from helpers import asc_words, prose, table
from test_line_rules import brute
from test_mixing_packing import brute_mix
from test_similar import brute_kept
from test_simhash import near_rows


def plain(rows):
    return sorted((r[0], r[1], r[3]) for r in rows)


def test_each_stage_against_plain_python(spark):
    import random

    rng = random.Random(5)
    rows = [r for r in near_rows() if r[0] is not None and len(r[1] or "") < 20000]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(2000 + i, prose(rng, 60) + f" mail a{i}.b@mail.example.org and 4068516892505468 end.", "en", f"src{i % 3}", 0, None, None, None) for i in range(30)]
    rows += [(3000, "Home | News | About | Contact\n" * 20, "en", "src0", 0, None, None, None)]
    docs = table(spark, rows)
    columns = docs.columns

    one = corpus_pipeline.quality_rules(spark, docs, "")
    # The fixture's lines all pass or belong to documents that fail as a whole.
    kept = [r for r in rows if not brute(r[1])[5] and r[0] not in (3000,)]
    got = [tuple(r) for r in one.collect()]
    assert one.columns == columns
    assert {r[0] for r in got} <= {r[0] for r in kept} and len(got) > 60
    assert all(r[1] == dict((x[0], x[1]) for x in rows)[r[0]] for r in got)

    two = corpus_pipeline.near_dedup(spark, table(spark, got), "")
    after = [tuple(r) for r in two.collect()]
    stay = {d for _, d in brute_kept(got)}
    assert two.columns == columns and plain(after) == plain([r for r in got if r[0] in stay])

    three = corpus_pipeline.pseudonymise(spark, table(spark, after), "")
    made = pseudonyms.Pseudonyms(pseudonyms.key_of(spark))
    masked = [tuple(r) for r in three.collect()]
    assert three.columns == columns
    assert plain(masked) == plain([(r[0], pseudonyms.mask_text(r[1], made)[0], *r[2:]) for r in after])
    assert not any("4068516892505468" in r[1] for r in masked)

    four = corpus_pipeline.mix_sources(spark, table(spark, masked), "")
    mixed = [tuple(r) for r in four.collect()]
    want, _ = brute_mix(masked)
    words = Counter()
    for r in mixed:
        words[r[0]] += len(asc_words(r[1]))
    assert four.columns == columns and words == Counter({d: t for d, _, _, t in want if t})
    texts = {r[0]: r[1] for r in masked}
    assert all(r[1] == texts[r[0]] or r[1].split() == texts[r[0]].split()[: len(r[1].split())] for r in mixed)

    five = corpus_pipeline.pack(spark, table(spark, mixed), "").collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = [tok.encode(r[1], add_special_tokens=False).ids + [1] for r in mixed]
    assert sum(g.length for g in five) == sum(map(len, ids))
    full = Counter((r[0], zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(mixed, ids))
    assert not Counter((g.doc_id, g.ids_crc32) for g in five if g.length == g.doc_tokens) - full


def test_run_and_empty_input(spark, tmp_path):
    from test_simhash import near_rows

    rows = near_rows()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 30
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
