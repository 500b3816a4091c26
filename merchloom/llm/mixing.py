"""Mixing sources to target weights by systematic sampling.

Every source gets a share of the words to take, by weight; a source's target stops at
``max_repeat`` times its words, and the excess goes to the others by weight until no
target is above. The expected copies of a document are target / words of its source.
Within a source these are prefix-summed in the order of document size, one random
offset (a hash of seed and source, so that reruns agree) is added, and a document is
emitted once per integer boundary that its stretch crosses. Ordering by size makes the
sample stratified: the words taken differ from the target by about one document.

The prefix sum is distributed: rows are range-partitioned by source, size and a hash,
sorted within partitions and written; the counts per partition and source are
prefix-summed (as many rows as partitions plus sources) and joined back. No source is
gathered in one task.

Defined results: a null text has size 0; null sources are one source, ordered last; a
source without words has target 0 and its documents are not taken; repeated rows are
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, renamed

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MAX_REPEAT = 150, 2
SEED = 7
_PARTITION_BITS = 33


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the 1-based rank of each row within its group in the column ``rank``, without
    gathering a group: global order by partitions, ranks by offsets of the partitions."""
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, name).withColumn("__part", F.shiftright("__at", _PARTITION_BITS))
    counts = placed.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = (F.col("__part") == F.col("__p"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rank = (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("rank")
    return placed.join(offsets, same, "left").select(*df.columns, rank)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sources`` (source, source_size) with the target of each source.

    All sources below their ceiling share one rate of words per weight. A source is at its
    ceiling when the ceiling per weight is at most that rate, so the rate follows from the
    sums over the sources that are at their ceiling; they grow from round to round until
    none is added. Each round is one aggregation over the table of sources.
    """
    placed = ranked(sources.withColumn("__all", F.lit(0)), ["__all"], ["source"], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    placed = materialize(placed.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    ceiling = max_repeat * F.col("source_size")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    whole = share_percent * total / 100
    rate = -1.0
    while True:
        full = ceiling <= rate * F.col("weight")
        spent, free = placed.agg(F.sum(F.when(full, ceiling).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))).first()
        new = (whole - (spent or 0)) / free if free else rate
        if not free or new <= rate:
            break
        rate = new
    return placed.withColumn("target", F.least(ceiling.cast("double"), F.col("weight") * F.lit(float(rate))))


def offset_of(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, carry: tuple[str, ...] = (), size_col: str | None = None, **shares) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies to take, and the columns to carry.
    ``size_col`` holds the sizes where they are known; else the texts are counted."""
    others = [docs[c].alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), (docs[size_col] if size_col else size_of(docs[text_col])).alias("size"), *others)
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = ranked(rows.withColumn("tie", tie), ["source"], ["size", "tie", "doc_id"], "sizes")
    shared = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    shared = shared.select(F.col("source").alias("of_source"), "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset_of(F.col("source"), seed)
    count = F.floor(start + F.col("rank") * each) - F.floor(start + (F.col("rank") - 1) * each)
    return placed.join(shared, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id", "source", "size", "source_size", "target", count.cast("long").alias("copies"), *[f"c{i}" for i in range(len(carry))]
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows are numbered and written once. Only ids and sizes are ranked: a range partition of whole texts
    in the order of their size would hold nothing but the longest ones.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = materialize(docs.select(*[docs[c].alias(n) for c, n in own.items()], size_of(docs[text_col]).alias("size"), F.monotonically_increasing_id().alias("row")), "mix")
    taken = copies(rows, own[id_col], own[text_col], own[source_col], carry=("row",), size_col="size", **options).where("copies > 0")
    repeated = rows.drop("size").join(taken.select(F.col("c0").alias("row"), "copies"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(n).alias(c) for c, n in own.items()])
