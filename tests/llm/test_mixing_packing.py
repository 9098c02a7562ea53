import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from gradeloom.llm import mixing, packing
from helpers import asc_words, awkward, table


def test_packing_round_trip(spark):
    rows = awkward()
    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(table(spark, rows), block_tokens=5000).collect()
    want = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for r in rows for ids in [tok.encode(r[1] or "", add_special_tokens=False).ids + [1]])
    sequences = defaultdict(list)
    whole = [g for g in got if g.length == g.doc_tokens]
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(g.length for g in got) == sum(w[2] for w in want)
    ids = {(w[0], w[1]) for w in want}
    assert all((g.doc_id if g.doc_id is not None else -1, g.ids_crc32) in ids for g in whole)
    used = sum(g.length for g in got)
    assert len(sequences) * 2048 - used <= 3 * 2048 + used * 2048 / 5000  # under a sequence a block


def test_packing_pieces_hold_each_id_once(spark):
    text = " ".join(f"word{i} and more" for i in range(4000))
    got = sorted(packing.pack_documents(table(spark, [(1, text, "en", "s", 0, None, None, None)]), block_tokens=100).collect(), key=lambda g: g.start)
    ids = np.frombuffer(packing.encode_documents([text.encode()], packing.default_tokenizer())[0], "<u4")
    at = 0
    for g in got:
        assert g.start == at and g.ids_crc32 == zlib.crc32(ids[at : at + g.length].astype("<u4").tobytes())
        at += g.length
    assert at == len(ids) == got[0].doc_tokens
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_balance_evens_cost():
    lengths = [1500, 1400, 700, 500] + [10] * 50
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.balance(lengths):
        cost[s] += n + n * n / 2048
    assert max(cost.values()) < 2.2 * min(cost.values())


def brute_mix(rows):
    import hashlib

    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(asc_words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not over:
            break
        share = {s: 3.0 * sizes[s] for s in over}
        target |= share
        open_ -= set(over)
        left -= sum(share.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    out = []
    for s in names:
        own = sorted(((hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or -1, len(asc_words(r[1])), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        budget = int(target[s] + 0.5)
        left = budget % sizes[s] if sizes[s] else 0
        for _, _, n, r in own:
            part = min(n, left)
            left -= part
            out.append((r[0], n, sizes[s], (budget // sizes[s] * n if sizes[s] else 0) + part))
    return out, target


def test_mixing_matches_brute_force(spark):
    rows = awkward()
    docs = table(spark, rows)
    want, target = brute_mix(rows)
    got = mixing.plan_mix(mixing.size_table(docs)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, ((g.doc_id, g["size"], g.source_size, g.taken) for g in got))) == sorted(map(key, want))
    assert all(abs(g.target - target[g.source]) < 1e-6 for g in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixed.collect()
    assert sum(len(asc_words(r.text)) for r in taken) == sum(w[3] for w in want)
    assert mixing.mix_documents(table(spark, [])).count() == 0
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.text)
    assert sorted(map(key, mixing.mix_documents(docs, few=0).collect())) == sorted(map(key, taken))


def test_equal_rows_at_the_cut_share_what_is_left(spark):
    row = lambda i, t, s: (i, t, "en", s, 0, None, None, None)
    # Source b gives 2/7 of all, so its only text is cut, and c 1 of 8 parts; copies of one row are the whole source.
    rows = [row(1, "a " * 300, "a")] + [row(2, "b " * 40, "b")] * 5 + [row(3, "c " * 30, "c")] * 4
    want, _ = brute_mix(rows)
    got = mixing.mix_documents(table(spark, rows)).collect()
    words = defaultdict(int)
    for r in got:
        words[r.doc_id] += len(asc_words(r.text))
    wanted = defaultdict(int)
    for d, _, _, t in want:
        wanted[d] += t
    assert words == {k: v for k, v in wanted.items() if v} and abs(sum(words.values()) - 620) <= 3
    assert sum(len(asc_words(r.text)) not in (300, 40, 30) for r in got) <= 3


def test_ids_are_the_tokenizers_own():
    import random

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    rng = random.Random(6)
    bits = ["The", "été", "ÉTÉ", "ß", "İstanbul", "ΣΑΣ", "Ǆ", "éa", "don't", "it's", "'s", "x1y2", "...", "%%%", "<|endoftext|>", "<|startoftext|>!", "汉字", "ﬁne", "a　b", "a\x1cb", "​z", "🎉!", "naïve,", "A.B", "K̊", "Å", "ªº", "ʰa", "٣", "Ⅷ", "foo|", "|", "#tag", "$9.99", "_x_", "힣", "ñ.", "…", "«mot»", "İ.", "ﬀ,"]
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice([" ", "\n", "", "\t", ". ", ","]) for _ in range(rng.randrange(1, 20)))
        ids = np.frombuffer(packing.encode_documents([text.encode()], path)[0], "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids + [1], text
    real = [b for b in bits if packing._LOADED[path].in_parts]
    assert real, "the quick way should be on for the usual file"
