"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints in BK-trees, exact where it decides.

Two documents are near copies where their sets of 5-word shingles have a similarity of 0.8 or more; a group is
what such pairs join. Equal sets are collapsed at once, so exact copies cost one row.

1. Fingerprints. A set has a SimHash of 128 bits. Sets of similarity 0.8 are at most 27.3 degrees apart, so a
   bit differs with a probability of 0.152 at most, or of 0.19 for the smallest sets; `RADIUS` bits are
   4.5 standard deviations and more above what is then expected (5e-6). `simhash`'s blocks can't serve
   so wide a radius: two fingerprints that differ in 44 of 128 bits need not agree on any block worth the name.
2. Shards. So shards come from MinHash: a signature is cut into `BANDS` bands of `ROWS` values, and sets that share
   a band are in its shard. No band is left out for its size. A pair of similarity 0.8 shares none of
   them with a probability of (1 - 0.8^4)^32 = 5e-8, a closer pair with less; most share many.
3. Candidates. Each shard is a BK-tree over fingerprints that is searched within the radius. A shard of more than
   `TREE_ROWS` sets hangs on its least set as a whole, which may join too much and loses nothing.
   The components of these links hold all candidate pairs. Only their texts move, once each.
4. A task works out the exact groups of its components: from each set it takes the exact overlaps with all
   sets that no group has yet. What only lies near is not joined. A component of more than `LOAD` shingles
   is cut into parts, and each two of them make a task.

Cases: a null, empty or blank text has one shingle, which stands for no words; a text under five words is one
shingle; rows are told apart by doc_id and text, so unlike rows with one doc_id both stay and copies without
a doc_id go; of a group the row with the least doc_id stays, then the least by hash, and rows without a doc_id
come last; of rows equal in doc_id and text one stays; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped, releasing, slices, text_bytes, written
from .components import components
from .repeats import cut_words, mix, prefix_hash, range_hash, window_hash
from .simhash import TREE_ROWS, tree_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Words of a fingerprint, and differing bits within which sets are candidates.
WORDS, RADIUS = 2, 44
#: Names of rows that are sent to every executor at most.
FEW_NAMES = 500_000
#: Shingles of a component that one task takes.
LOAD = 2_000_000
_rng = np.random.default_rng(8)
_FLIP = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    u = cut_words([t.lower() for t in texts])
    prefix = prefix_hash(u.hashes)
    whole = window_hash(prefix, shingle) if len(u.hashes) >= shingle else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(u.first[:-1].tolist(), u.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        else:
            one = range_hash(prefix, np.array([a]), np.array([b])) + np.uint64(b - a)
            out.append(mix(one))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of the set's MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(least, ((low[a : a + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(bands[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of WORDS words: a bit is 1 where over half of the shingles' hashes have it."""
    out = np.empty(WORDS, np.uint64)
    for w in range(WORDS):
        count = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 65_536):
            raw = mix(hashes[a : a + 65_536] ^ _SALT[w]).view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


_VALUES = "doc_id long, row binary, v binary, n long, fp0 long, fp1 long, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2, 500_000):
            sets = shingle_sets(text_bytes(batch.column(2)))
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            bands = np.concatenate([signature(s) for s in sets])
            prints = np.array([wide_print(s) for s in sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, w])) for w in range(WORDS)),
                 pa.FixedSizeListArray.from_arrays(pa.array(bands), BANDS).cast(pa.list_(pa.int64()))],
                names=[x.split()[0] for x in _VALUES.split(", ")],
            )


def groups(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the number of the first set of its group; exact."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    held = owner[order]  # sets of each token, those that no group has yet
    first = np.concatenate([[0], np.cumsum(np.bincount(token))])
    root, free, indexed = np.full(n, -1), n, n
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        free -= 1
        while queue and free:
            if free * 2 < indexed:
                tokens = np.repeat(np.arange(len(first) - 1), np.diff(first))[root[held] < 0]
                held = held[root[held] < 0]
                first = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(first) - 1))])
                indexed = free
            i = queue.pop()
            mine = token[bounds[i] : bounds[i + 1]]
            low, many = first[mine], first[mine + 1] - first[mine]
            total = int(many.sum())
            if not total:
                continue
            at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            other, shared = np.unique(held[at], return_counts=True)
            near = other[(shared >= similarity * (sizes[i] + sizes[other] - shared) - 1e-9) & (root[other] < 0)]
            root[near] = start
            free -= len(near)
            queue += near.tolist()
    return root


@releasing
def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, p, q, v, text), sorted by the first three, to links between the sets of a group."""
    now, names, sets = None, [], []

    def links() -> pa.RecordBatch:
        root = groups(sets)
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in joined], pa.binary()), pa.array([names[i] for i in root[joined]], pa.binary())], names=["a", "b"])

    for whole in batches:
        for batch in slices(whole, 4, 500_000):
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for key, v, s in zip(keys, batch.column(3).to_pylist(), shingle_sets(text_bytes(batch.column(4))), strict=True):
                if key != now:
                    if len(names) > 1:
                        yield links()
                    now, names, sets = key, [], []
                names.append(v)
                sets.append(s)
    if len(names) > 1:
        yield links()


def row_name() -> Column:
    """128 bits that tell rows apart by doc_id and text, both of which may be null."""
    part = lambda c: F.coalesce(F.concat(F.lit("t"), F.col(c).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(part("doc_id"), F.lit("\n"), part("text")).cast("binary")))


def candidate_components(values: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(v, root) for the sets of values(v, bands, fp0, fp1) that are near in a band's shard, directly or through others."""
    bands = values.select("v", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("v").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = written(bands.join(shared, "key"))
    trees = rows.where(F.col("m") <= tree_rows).join(values.select("v", "fp0", "fp1"), "v")
    near = tree_links(trees.select(F.lit(0).alias("t"), "key", F.col("v").alias("name"), "fp0", "fp1"), radius, tree_rows, WORDS)
    whole = rows.where((F.col("m") > tree_rows) & (F.col("v") != F.col("lead"))).select(F.col("v").alias("a"), F.col("lead").alias("b"))
    links = checkpointed(near.unionByName(whole).distinct())
    dropped(rows)
    return components(links, "a", "b").withColumnRenamed("node", "v")


def similar_links(docs: DataFrame, values: DataFrame, load: int = LOAD, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) of sets, which join all pairs of candidates that are similar enough, and no others' groups."""
    found = checkpointed(values.select("v", "n", F.col("least.row").alias("row")).join(candidate_components(values, RADIUS, tree_rows), "v"))
    sizes = found.groupBy("root").agg(F.sum("n").alias("all")).select("root", F.ceil(F.col("all") / load).cast("int").alias("parts"))
    dealt = found.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("v"), F.col("parts").cast("long")).cast("int"))
    # Equal rows are the same text; one of them is enough.
    texts = docs.select(row_name().alias("row"), "text").join(found.select("row"), "row", "left_semi").dropDuplicates(["row"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("mine")).alias("p"), F.greatest(p, F.col("mine")).alias("q")))
    dealt = dealt.join(texts, "row").select("root", "v", "text", F.explode(pairs).alias("x")).select("root", "x.p", "x.q", "v", "text")
    return dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(_exact_links, "a binary, b binary")


def drop_similar(docs: DataFrame, load: int = LOAD, tree_rows: int = TREE_ROWS, few: int = FEW_NAMES) -> DataFrame:
    """One row of each group of near copies, in the columns of docs.

    Texts stay where they are: the names of the rows that go are sent to them where these are few, and joined where
    they are many. Rows that occur several times are taken out whole, and those that stay come back once.
    """
    q = "__similar_row"
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_name().alias("row"), "text").mapInArrow(_signatures, _VALUES))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    values = written(prints.groupBy("v").agg(least, *(F.any_value(c).alias(c) for c in ("n", "fp0", "fp1", "bands"))))
    links = checkpointed(similar_links(docs, values, load, tree_rows).distinct())
    named = values.select("v", "least").join(components(links, "a", "b").withColumnRenamed("node", "v"), "v", "left")
    stay = named.groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    rows = prints.groupBy("row").agg(F.count(F.lit(1)).alias("m")).join(stay.withColumn("stays", F.lit(True)), "row", "left")
    rows = written(rows.where("stays IS NULL OR m > 1").select(F.col("row").alias(q), F.coalesce("stays", F.lit(False)).alias("stays")))
    dropped(prints)
    dropped(values)
    small = (lambda x: F.broadcast(x)) if rows.count() <= few else (lambda x: x)  # at most few names, of 16 bytes
    marked = docs.withColumn(q, row_name())
    once = marked.join(small(rows.select(q)), q, "left_anti").drop(q)
    again = marked.join(small(rows.where("stays").select(q)), q, "left_semi").dropDuplicates([q]).drop(q)
    return once.unionByName(again)
