"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in the order of that
key; a document's words are taken by the prefix sums of the sizes in this order, and cut at exactly the
source's budget. A budget above the source's size repeats the source: whole epochs first, then the
part of the order that is left.

The prefix sums are distributed: a source is cut into ranges of the key, the ranges' sums are added up
in one small pass (at most MAX_RANGES rows a source), and rows are added up within their range only, so
a source that holds a third of all rows is spread over as many tasks as any other rows.

Targets fill the budget by weight. A target stops at `max_epochs` times its source's size and what is
over goes to the others by weight. With the sources in ascending order of cap / weight, let
level(i) = (budget - caps before i) / (weights from i on). level(i) grows while sources are capped and
falls after, so its maximum is the common level, and target = min(cap, level * weight).

Cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, the
last; rows that are repeated are taken row by row; null doc_id gets the key of the empty string; an
empty table gives no rows. Further columns are not read by `plan_mix` and stay in `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, dropped, words_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix"
ROWS_PER_RANGE = 500
MAX_RANGES = 1 << 20
#: Rows of sources that are sent to every executor at most.
FEW_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Number of words."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, WS_CLASS))).cast("long")


def _ranges(n: int) -> int:
    """Bits of the range number for n rows; it only says how the work is dealt out."""
    return min(20, max(4, (n // ROWS_PER_RANGE).bit_length()))


def _weight(rank: Column, weights: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))


def _keyed(sized: DataFrame, seed: str, bits: int, *more: str) -> DataFrame:
    rows = sized.select(
        "source", "size", *more, F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("name"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
    )
    return rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 5), 16, 10).cast("int"), 20 - bits))


def _range_sums(rows: DataFrame) -> DataFrame:
    """Sum of sizes before and in each range of a source, and of the source."""
    by_range = rows.groupBy("absent", "name", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("absent", "name").orderBy("range")
    return by_range.withColumns({
        "range_start": F.sum("range_size").over(upto) - F.col("range_size"),
        "source_size": F.sum("range_size").over(Window.partitionBy("absent", "name")),
    })


def _targets(rows: DataFrame, weights: tuple[float, ...], max_epochs: int, share: float) -> DataFrame:
    """absent, name, target, budget of each source; one row a source throughout."""
    sources = rows.groupBy("absent", "name").agg(F.sum("size").alias("all_size"))
    one = Window.partitionBy(F.lit(0))
    in_order = one.orderBy("absent", "name")
    sources = sources.withColumn("weight", _weight(F.row_number().over(in_order), weights)).withColumn("cap", F.col("all_size") * max_epochs)
    by_ratio = one.orderBy(F.col("cap") / F.col("weight"), "absent", "name")
    before = F.sum("cap").over(by_ratio) - F.col("cap")
    rest = F.sum("weight").over(one) - F.sum("weight").over(by_ratio) + F.col("weight")
    budget = F.sum("all_size").over(one) * F.lit(float(share))
    sources = sources.withColumn("level_here", (budget - before) / rest)
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.greatest(F.max("level_here").over(one), F.lit(0.0)) * F.col("weight")))
    return sources.select("absent", "name", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """doc_id, source, size of every row -> the same with source_size, target, budget and taken.

    The sizes are written down once: they are read for the sums and again for the placing, and counting them
    says how finely the work is dealt out.
    """
    sized = written(sized)
    rows = _keyed(sized, seed, _ranges(sized.count()), "doc_id")
    placed = rows.join(_range_sums(rows).drop("range_size"), ["absent", "name", "range"]).join(_targets(rows, weights, max_epochs, share), ["absent", "name"])
    within = Window.partitionBy("absent", "name", "range").orderBy("key", "doc_id", "size")
    start = F.col("range_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = placed.withColumn("start", start).withColumn("epochs", _epochs())
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "budget", taken.alias("taken"))


def size_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))


def _text_name() -> Column:
    """Orders rows of one key; a null text is before all others."""
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))


def cut_table(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, share: float, seed: str) -> DataFrame:
    """A row for each source: its whole epochs, and the row (key, text_name) up to which it is taken once more.

    equal: how many rows are that one; extra: the words that these get together in the last epoch. A source
    that ends with a whole epoch has no such row.
    """
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _text_name().alias("text_name")))
    rows = _keyed(sized, seed, _ranges(sized.count()), "text_name")
    sums = _range_sums(rows).join(_targets(rows, weights, max_epochs, share), ["absent", "name"]).withColumn("epochs", _epochs())
    sums = sums.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    last = sums.where((F.col("rest") > F.col("range_start")) & (F.col("rest") <= F.col("range_start") + F.col("range_size")))
    # The rows of one range a source.
    near = rows.join(last.select("absent", "name", "range", "range_start", "rest"), ["absent", "name", "range"])
    same = near.groupBy("absent", "name", "key", "text_name", "range_start", "rest").agg(F.count(F.lit(1)).alias("equal"), F.max("size").alias("size"), F.sum("size").alias("all"))
    upto = Window.partitionBy("absent", "name").orderBy("key", "text_name")
    same = same.withColumn("start", F.col("range_start") + F.sum("all").over(upto) - F.col("all"))
    cut = same.where((F.col("rest") > F.col("start")) & (F.col("rest") <= F.col("start") + F.col("all")))
    cut = cut.select("absent", "name", F.col("key").alias("cut_key"), F.col("text_name").alias("cut_name"), "equal", F.col("size").alias("cut_size"), (F.col("rest") - F.col("start")).alias("extra"))
    plan = written(sums.select("absent", "name", "epochs").distinct().join(cut, ["absent", "name"], "left"))
    dropped(sized)
    return plan


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED, few: int = FEW_SOURCES) -> DataFrame:
    """The mixed corpus in the columns of docs: a document that is taken k times stands there k times,
    and one that is taken in part stands there once more, cut after the words that the mix takes.

    What a row gets follows from its key and its source's row in `cut_table`, so texts are not shuffled where there
    are at most `few` sources. Rows that agree in doc_id, source and text and are the last that is taken are one
    row, which gets what all of them are given.
    """
    q = "__mix_"
    plan = cut_table(docs, weights, max_epochs, share, seed)
    plan = plan.select(*(F.col(c).alias(q + c) for c in plan.columns))
    plan = F.broadcast(plan) if plan.count() <= few else plan
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    marked = docs.withColumns({f"{q}key": key, f"{q}text": _text_name(), f"{q}a": F.col("source").isNull(), f"{q}n": F.coalesce("source", F.lit(""))})
    marked = marked.join(plan, (F.col(f"{q}a") == F.col(f"{q}absent")) & (F.col(f"{q}n") == F.col(f"{q}name")))
    place, cut = F.struct(f"{q}key", f"{q}text"), F.struct(F.col(f"{q}cut_key"), F.col(f"{q}cut_name"))
    is_cut = F.coalesce(place == cut, F.lit(False))
    last = F.col(f"{q}cut_key").isNotNull() & is_cut
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(WS_CHARS)) == ""
    marked = marked.where(~blank).withColumn(f"{q}last", last)
    before = F.coalesce(F.col(f"{q}cut_key").isNotNull() & (place < cut), F.lit(False))
    whole = F.when(F.col(f"{q}last"), F.col(f"{q}epochs") * F.col(f"{q}equal") + F.floor(F.col(f"{q}extra") / F.col(f"{q}cut_size"))).otherwise(F.col(f"{q}epochs") + before.cast("int")).cast("int")
    part = F.when(F.col(f"{q}last"), F.col(f"{q}extra") % F.col(f"{q}cut_size")).otherwise(F.lit(0)).cast("int")
    none = F.array().cast("array<int>")

    def copies(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(f"{q}words", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(none))))
        cut_text = F.when(F.col(f"{q}words") < 0, F.col("text")).otherwise(F.array_join(F.slice(words_of(F.col("text")), 1, F.greatest(F.col(f"{q}words"), F.lit(1))), " "))
        return rows.select(*(cut_text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))

    several = F.col(f"{q}last") & (F.col(f"{q}equal") > 1)
    out = copies(marked.where(~several))
    if plan.where(F.col(f"{q}equal") > 1).isEmpty():
        return out
    return out.unionByName(copies(marked.where(several).dropDuplicates([f"{q}a", f"{q}n", f"{q}key", f"{q}text"])))
