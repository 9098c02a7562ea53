"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A document's cost in a sequence is linear plus quadratic in its tokens, as attention's is. Documents are
taken in blocks of about `block_tokens` tokens. A document of a whole sequence or more is cut into whole
sequences first. What is left is taken in descending order and put into the sequence of the lowest cost
so far that has room for it; where none has, the piece is cut to fill the cheapest one with room. A block
has as many sequences as its tokens need, so it leaves less than one sequence of padding.

A block is packed in the task that reads it: nothing is shuffled, no document waits for another task, and
the memory of a task is bounded by the block and one document. A lost task is repeated with the same
result, as a block depends on the rows of its partition only.

Cases: a null or empty text is the closing id alone; equal lengths are taken in the order read; repeated
rows are packed row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, text_bytes

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words and word parts whose ids a worker remembers; a speed matter only.
CACHE_WORDS, CACHE_PARTS = 400_000, 1_000_000
_LOADED: dict[str, Words] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of words by one tokenizer file, as little-endian unsigned 32-bit, with memory of words seen.

    Where the file's rules are the common ones (lower case, letters apart from other characters, bytes
    as characters), a run of letters with marks behind it is looked up in two parts, and a new part
    goes to the merge model directly. Any other word, and any other file, takes the whole way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.in_parts = _rule_names(rules["normalizer"]) == ["NFC", "Replace", "Lowercase"] and _letter_rule(rules["pre_tokenizer"])
        special = [x["content"] for x in rules["added_tokens"]]
        self.in_parts &= all(not x.isalpha() and not set(x.encode()) <= set(MARKS) for x in special)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.as_chars = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(others)})

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: bytes) -> bytes:
        """Ids of a lower-case run of letters or a run of marks."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            seen = part.decode("ascii") if part.isascii() else part.decode("latin-1").translate(self.as_chars)
            found = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        return found

    def _new(self, raw: bytes) -> bytes:
        if self.in_parts:
            core = raw.rstrip(MARKS)
            if core.isalpha():  # of ASCII letters alone
                low = core.lower()
            else:
                text = core.decode("utf-8", "replace")
                low = text.lower().encode() if text.isalpha() and _plain_lower(text) else b""
            if low:
                ids = self._part(low)
                return ids + self._part(raw[len(core) :]) if len(core) < len(raw) else ids
        return self._whole(raw.decode("utf-8", "replace"))

    def ids(self, words: list[bytes]) -> bytes:
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self._new(w)
        return b"".join([known[w] for w in words])


#: Marks that may follow a word; an apostrophe is not among them, as it starts a part of its own with letters.
MARKS = b".,;:!?*%&$#|"


def _plain_lower(text: str) -> bool:
    """Lower case goes character by character and stays letters of the same form."""
    low = text.lower()
    return len(low) == len(text) and unicodedata.is_normalized("NFC", text) and "\u03c3" not in low and "\u03c2" not in low and unicodedata.is_normalized("NFC", low)


def _rule_names(rule: dict | None) -> list[str]:
    return [x["type"] for x in rule["normalizers"]] if rule and rule["type"] == "Sequence" else []


def _letter_rule(rule: dict | None) -> bool:
    """Letters in runs, digits one by one, other marks in runs; then bytes as characters."""
    steps = rule["pretokenizers"] if rule and rule["type"] == "Sequence" else []
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return False
    pattern = steps[0]["pattern"].get("Regex", "")
    return pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and all(x.startswith("'") for x in pattern.split("|")[:-3])


def encode_documents(texts: list[bytes], path: str, end_id: int = END_ID) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit, with the closing id.

    The vocabulary's rules drop white space and never join across it, so a text's ids are those of
    its words in turn; words seen before are looked up.
    """
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    words, end = _LOADED[path], int(end_id).to_bytes(4, "little")
    return [words.ids(t.split()) + end for t in texts]  # bytes.split() cuts at the six ASCII white space characters


def balance(lengths: list[int], capacity: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for one block of token counts."""
    out, rest, full = [], [], 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((d, start, capacity, full, 0))
            full, start = full + 1, start + capacity
        if n > start:
            rest.append((n - start, d, start))
    rest.sort(key=lambda x: -x[0])
    count = -(-sum(x[0] for x in rest) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity)
    for n, d, start in rest:
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits) == 0:
                fits = np.flatnonzero(room > 0)
            k = int(fits[np.argmin(cost[fits])])
            m = min(n, int(room[k]))
            out.append((d, start, m, full + k, capacity - int(room[k])))
            room[k] -= m
            cost[k] += linear * m + quadratic * m * m
            n, start = n - m, start + m
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence."""
    path = tokenizer_path or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, tokens, held, first
            pieces = balance([len(t) // 4 for t in tokens], capacity)
            cut = [tokens[d] if n * 4 == len(tokens[d]) else tokens[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [
                pa.array([ids[p[0]] for p in pieces], pa.int64()), [p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(c) for c in cut],
                [len(tokens[p[0]]) // 4 for p in pieces], [first + p[3] for p in pieces], [p[4] for p in pieces],
            ]
            first += max(p[3] for p in pieces) + 1
            ids, tokens, held = [], [], 0
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for whole in batches:
            for batch in slices(whole, 1, 2_000_000):
                fresh = encode_documents(text_bytes(batch.column(1)), path)
                for d, t in zip(batch.column(0).to_pylist(), fresh, strict=True):
                    ids.append(d)
                    tokens.append(t)
                    held += len(t) // 4
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)
