"""Entity resolution across sources: blocked edit-distance similarity and greedy canonical choice.

Rows with the same key are one class, counted by source, so copies never meet pairwise; distances are between distinct keys.

* Merging. Keys of a block share their first characters, so only the rest counts. Cut
  into d + 1 pieces, a key within distance d of a longer one has a piece that stands in that
  one, shifted by at most as many places as pieces before or after it allow. Keys meet by (block, lengths, piece), not by block.
* Warnings allow a quarter of a key to change, so pieces would be too short to tell keys apart: keys meet by
  (block, length), which deals a block out over tasks, and the distance is given up beyond its bound.
* The greedy choice, most similar pair first, is made by local dominance: a pair that comes first among
  the open pairs of both its present clusters can be decided at once, whatever happens elsewhere.
  Blocks with more than ``TOGETHER`` open pairs go on in rounds, all others are finished in a task each.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .trees import held

MIN_LENGTH, PREFIX = 15, 12
MERGE, WARN = 0.9, 0.75
#: Open pairs of a block that one task decides.
TOGETHER = 50_000


def key_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` (id, key, source) by key and source: block, number of rows and smallest id."""
    usable = rows.where((F.length("key") >= MIN_LENGTH) & F.col("source").isNotNull())
    return usable.groupBy(F.substring("key", 1, PREFIX).alias("block"), "key", "source").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def _bound(longest: str, least: float) -> Column:
    """The largest edit distance that leaves keys, the longer of which has so many characters, similar enough."""
    return F.floor((1 - least) * F.col(longest) + 1e-9).cast("int")


def near_keys(keys: DataFrame, least: float) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: the distinct ``keys`` (block, key) of a block that are at least so similar.
    They meet by (block, length): a key and each length that a shorter one may have."""
    sized = keys.withColumn("length", F.length("key"))
    longer = sized.withColumn("d", _bound("length", least)).withColumn("shorter", F.explode(F.sequence(F.greatest(F.lit(MIN_LENGTH), F.col("length") - F.col("d")), F.col("length"))))
    shorter = sized.select(F.col("block").alias("block_"), F.col("key").alias("other"), F.col("length").alias("length_"))
    on = (F.col("block") == F.col("block_")) & (F.col("shorter") == F.col("length_")) & ((F.col("length") > F.col("length_")) | (F.col("key") < F.col("other")))
    return _verified(longer.join(shorter, on).select("key", "other", "d"), least)


def candidate_keys(keys: DataFrame, least: float) -> DataFrame:
    """(key, other, d): pairs of distinct ``keys`` (block, key) of a block that share a piece, the longer one first; a pair comes once
    for each piece that it shares. Every pair within the distance d that ``least`` allows is among them."""
    rest = F.substring("key", PREFIX + 1, 1_000_000)
    sized = keys.select("block", "key", F.length("key").alias("length"), rest.alias("rest"))
    pieces = F.sequence(F.lit(0), F.col("d"))

    def edge(i: Column) -> Column:
        return F.floor(i * (F.col("shorter") - PREFIX) / (F.col("d") + 1)).cast("int")

    def place(piece: Column, part: Column) -> Column:
        return F.xxhash64("block", "longer", "shorter", piece, part)

    # A key as the shorter of two: its own pieces, for every length that the longer may have.
    short = sized.withColumn("shorter", F.col("length")).withColumn("longer", F.explode(F.sequence(F.col("length"), F.floor(F.col("length") / least + 1).cast("int"))))
    short = short.withColumn("d", _bound("longer", least)).where("longer - d <= shorter")
    short = short.withColumn("i", F.explode(pieces)).select("key", place(F.col("i"), F.col("rest").substr(edge(F.col("i")) + 1, edge(F.col("i") + 1) - edge(F.col("i")))).alias("piece"))
    # As the longer one: what may stand in the place of each piece.
    long = sized.withColumn("longer", F.col("length")).withColumn("d", _bound("longer", least))
    long = long.withColumn("shorter", F.explode(F.sequence(F.greatest(F.lit(PREFIX), F.col("length") - F.col("d")), F.col("length")))).withColumn("i", F.explode(pieces))
    i, more, right = F.col("i"), F.col("longer") - F.col("shorter"), F.col("d") - F.col("i")
    long = long.withColumn("at", edge(i)).withColumn("size", edge(i + 1) - F.col("at"))
    first = F.greatest(F.lit(0), F.col("at") - i, F.col("at") + more - right)
    last = F.least(F.col("longer") - PREFIX - F.col("size"), F.col("at") + i, F.col("at") + more + right)
    long = long.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("q", F.explode(F.sequence("first", "last")))
    long = long.select("key", "length", "d", place(i, F.col("rest").substr(F.col("q") + 1, F.col("size"))).alias("piece"))
    other = short.select(F.col("key").alias("other"), "piece")
    met = long.join(other, "piece").where((F.col("length") > F.length("other")) | ((F.col("length") == F.length("other")) & (F.col("key") < F.col("other"))))
    return met.select("key", "other", "d")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """(key_a, key_b, similarity) of the pairs (key, other, d) that are at least so similar."""
    distance = F.expr("levenshtein(key, other, d)")  # -1 beyond d
    near = pairs.withColumn("distance", distance).where("distance >= 0")
    similarity = 1 - F.col("distance") / F.greatest(F.length("key"), F.length("other"))
    return near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"), similarity.alias("similarity")).where(F.col("similarity") >= least)


def class_pairs(rows: DataFrame, least: float = WARN) -> DataFrame:
    """(key_a, key_b, similarity, links): the classes of rows whose keys are at least so similar, with
    the number of pairs of rows from different sources that they stand for. A class of several
    sources is paired with itself. No link is lost."""
    nodes = held(key_nodes(rows))
    by_key = nodes.groupBy("block", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    # Links are all pairs of rows but those within a source.
    own = by_key.where("squares < n * n").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("similarity"), ((F.col("n") * F.col("n") - F.col("squares")) / 2).cast("long").alias("links"))
    a, b = (nodes.select(F.col("key").alias(f"key_{s}"), F.col("source").alias(f"source_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    total = by_key.select(F.col("key").alias("key_b"), F.col("n").alias("total"))
    mixed = near_keys(by_key.select("block", "key"), least).join(a, "key_a").join(total, "key_b")
    mixed = mixed.join(b.withColumnRenamed("key_b", "same_key"), (F.col("key_b") == F.col("same_key")) & (F.col("source_a") == F.col("source_b")), "left")
    links = F.sum(F.col("n_a") * (F.col("total") - F.coalesce("n_b", F.lit(0))))
    others = mixed.groupBy("key_a", "key_b").agg(F.first("similarity").alias("similarity"), links.alias("links")).where("links > 0")
    return own.union(others)


def membership(rows: DataFrame) -> DataFrame:
    """(id, key, class_id): the class of each usable row, named by its smallest id."""
    classes = key_nodes(rows).groupBy("key").agg(F.min("least").alias("class_id"))
    usable = rows.where((F.length("key") >= MIN_LENGTH) & F.col("source").isNotNull())
    return usable.select("id", "key").join(classes, "key")


def link_counts(rows: DataFrame) -> DataFrame:
    """(id, class_id, n_merge, n_warn): per row of ``rows`` its class, named by the smallest id with its key, and how
    many rows of other sources are as similar as merging asks for, or as a warning does. Rows whose
    keys are too short, or without a source, are alone and have no links. No pair of rows is formed."""
    nodes = key_nodes(rows)
    pairs = class_pairs(rows).select("key_a", "key_b", "similarity")
    both = pairs.union(pairs.where("key_a <> key_b").select("key_b", "key_a", "similarity"))
    of = nodes.select(F.col("key").alias("key_b"), F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    mine = nodes.select(F.col("key").alias("key_a"), F.col("source").alias("source_a"))
    near = both.join(of, "key_b").join(mine, "key_a").where("source_a <> source_b")
    merge = F.col("similarity") >= MERGE
    summed = near.groupBy("key_a", "source_a").agg(F.sum(F.when(merge, F.col("n_b")).otherwise(0)).alias("n_merge"), F.sum(F.when(~merge, F.col("n_b")).otherwise(0)).alias("n_warn"))
    classes = nodes.groupBy(F.col("key").alias("of_key")).agg(F.min("least").alias("class_id"))
    named = rows.select("id", "key", "source").join(classes, (F.col("key") == F.col("of_key")) & F.col("source").isNotNull(), "left")
    joined = named.join(summed, (F.col("key") == F.col("key_a")) & (F.col("source") == F.col("source_a")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_merge", zero).alias("n_merge"), F.coalesce("n_warn", zero).alias("n_warn"))


def merge_candidates(nodes: DataFrame, least: float = MERGE) -> DataFrame:
    """Pairs of ``nodes`` of ``key_nodes`` (key, source) of different sources and similar keys, with the smallest row of each
    as its id. Copies of a name within a source are one node, so they never multiply."""
    keys = nodes.select("block", "key").distinct()
    near = _verified(candidate_keys(keys, least).distinct(), least).union(keys.select("key", F.col("key").alias("key_b"), F.lit(1.0)))
    a, b = (nodes.select(F.col("key").alias(f"key_{s}"), F.col("source").alias(f"source_{s}"), F.col("least").alias(f"id_{s}")) for s in "ab")
    met = near.join(a, "key_a").join(b, "key_b").where("source_a <> source_b").where((F.col("key_a") < F.col("key_b")) | (F.col("id_a") < F.col("id_b")))
    turned = F.col("id_a") > F.col("id_b")
    ends = [F.when(turned, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s, t in ("ab", "ba") for c in ("id", "source")]
    return met.select(F.substring("key_a", 1, PREFIX).alias("block"), *ends, "similarity")


def greedy(pairs: pd.DataFrame, order: dict[str, int]) -> list[tuple]:
    """(loser, canonical) in the order in which pairs merge: most similar first, then by id.

    Both sides (``end_a`` and ``end_b``, if those are not the ids) are followed to their present canonical; nodes of one source never merge; the node of
    the source that comes first in ``order``, or else the one with the smaller id, is the canonical of the two.
    """
    parent: dict = {}
    ends = ["end_a", "end_b"] if "end_a" in pairs else ["id_a", "id_b"]
    source = dict(zip(pairs[ends[0]], pairs["source_a"])) | dict(zip(pairs[ends[1]], pairs["source_b"]))

    def end_of(x):
        while x in parent:
            x = parent[x]
        return x

    for a, b in pairs.sort_values(["similarity", "id_a", "id_b"], ascending=[False, True, True])[ends].itertuples(index=False):
        met = {end_of(a), end_of(b)}
        if len({source[x] for x in met}) == 2:
            keep, lose = sorted(met, key=lambda x: (order.get(source[x], 999), x))
            parent[lose] = keep
    return list(parent.items())


def _decided(pairs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(open pairs, pointers) after a round of local dominance among ``pairs``, whose ends are the canonicals of their present clusters."""
    turn = F.struct((-F.col("similarity")).alias("s"), "id_a", "id_b")
    both = pairs.select(F.col("end_a").alias("end"), turn.alias("t")).union(pairs.select(F.col("end_b").alias("end"), turn.alias("t")))
    first = both.groupBy("end").agg(F.min("t").alias("t"))
    of_a, of_b = (first.select(F.col("end").alias(f"end_{s}"), F.col("t").alias(f"first_{s}")) for s in "ab")
    marked = pairs.join(of_a, "end_a").join(of_b, "end_b").withColumn("now", (F.col("first_a") == turn) & (F.col("first_b") == turn))
    marked = held(marked.drop("first_a", "first_b"))
    rank = [F.struct(text.ranked_value(F.col(f"source_{s}"), order).alias("r"), F.col(f"end_{s}").alias("e")) for s in "ab"]
    kept = rank[0] < rank[1]
    pick = [F.when(kept, F.col(x)).otherwise(F.col(y)) for x, y in (("end_b", "end_a"), ("end_a", "end_b"), ("source_a", "source_b"))]
    # No two pairs decided at once share a cluster, so a loser has one canonical, which loses to nobody in this round.
    pointers = marked.where("now AND source_a <> source_b").select(*(c.alias(n) for c, n in zip(pick, ("node", "canonical", "source"))))
    left = marked.where("NOT now").drop("now")
    for s in "ab":
        to = pointers.select(F.col("node").alias(f"end_{s}"), F.col("canonical").alias("to"), F.col("source").alias("of"))
        left = left.join(to, f"end_{s}", "left").withColumn(f"end_{s}", F.coalesce("to", f"end_{s}")).withColumn(f"source_{s}", F.coalesce("of", f"source_{s}")).drop("to", "of")
    return left.where("end_a <> end_b"), pointers.select("node", "canonical")


def choose(pairs: DataFrame, order: list[str], together: int = TOGETHER) -> DataFrame:
    """(node, canonical): the pointers of the greedy choice among ``pairs`` (block, id_a, id_b, source_a, source_b, similarity).

    Blocks of at most ``together`` pairs are decided in a task each, pair after pair. Larger ones go through rounds, each of which decides
    every pair that is first at both ends, until they are small enough. Rounds are few unless similarities fall along
    a chain of clusters, where each round decides as many pairs as there are such chains.
    """
    ranks = {s: i for i, s in enumerate(order)}
    kind = dict(pairs.dtypes)["id_a"]
    open_ = held(pairs.withColumns({"end_a": F.col("id_a"), "end_b": F.col("id_b")}))
    done, found = [], []
    while True:
        sizes = open_.groupBy(F.col("block").alias("of_block")).agg(F.count("*").alias("n")).where(F.col("n") > together)
        if sizes.isEmpty():
            done.append(open_)
            break
        in_large = F.col("block") == F.col("of_block")
        done.append(open_.join(sizes, in_large, "left_anti"))
        left, pointers = _decided(open_.join(sizes, in_large, "left_semi"), order)
        found.append(held(pointers))
        open_ = held(left.select(*open_.columns))

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(greedy(group, ranks), columns=["node", "canonical"])

    out = reduce(DataFrame.union, done).groupBy("block").applyInPandas(chosen, f"node {kind}, canonical {kind}")
    return reduce(DataFrame.union, [*found, out])


def resolve(rows: DataFrame, order: list[str], least: float = MERGE, together: int = TOGETHER) -> DataFrame:
    """(loser, canonical): the immediate pointers of the greedy choice, for rows (id, key, source).

    The choice is made between nodes, all rows of a source with one name, and candidates never leave
    their block. All rows of a node that loses point to the canonical row.
    """
    nodes = held(key_nodes(rows))
    pointers = choose(merge_candidates(nodes, least), order, together)
    losing = nodes.select("key", "source", F.col("least").alias("node")).join(pointers, "node").select("key", "source", "canonical")
    return rows.join(losing, ["key", "source"]).select(F.col("id").alias("loser"), "canonical")


def merged_samples(rows: DataFrame, pointers: DataFrame, slugs: DataFrame, n: int = 30) -> DataFrame:
    """(canonical_slug, merged_slug, similarity): the most similar merges of ``pointers`` (loser, canonical) with the ``slugs`` (id, slug)
    of both rows, ids where a slug is missing; a sample for a report, so a limit by nature."""
    out = pointers
    for s in ("canonical", "loser"):
        own = rows.select(F.col("id").alias(s), F.col("key").alias(f"key_{s}")).join(slugs.select(F.col("id").alias(s), F.col("slug").alias(f"slug_{s}")), s, "left")
        out = out.join(own, s)
    alike = out.withColumn("similarity", text.half_up(text.similarity(F.col("key_canonical"), F.col("key_loser")), 3)).orderBy(F.col("similarity").desc(), "canonical", "loser").limit(n)
    return alike.select(F.coalesce("slug_canonical", F.col("canonical").cast("string")).alias("canonical_slug"), F.coalesce("slug_loser", F.col("loser").cast("string")).alias("merged_slug"), "similarity")


def reconcile_report(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: pairs to look at, groups and merged rows."""
    warned = class_pairs(rows).where(F.col("similarity") < MERGE).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("warned_pairs"))
    merged = resolve(rows, order).agg(F.countDistinct("canonical").alias("merge_groups"), F.count("*").alias("products_merged"))
    return warned.join(merged, F.lit(True))


def samples(rows: DataFrame, names: DataFrame, n: int = 25) -> DataFrame:
    """The most similar pairs below merging with their rounded similarity and names: a sample for a
    report, so a limit by nature."""
    pairs = class_pairs(rows).where(F.col("similarity") < MERGE).orderBy(F.col("similarity").desc(), "key_a", "key_b").limit(n)
    shown = names.groupBy("key").agg(F.substring(F.min("name"), 1, 120).alias("name"))
    one, two = (shown.select(F.col("key").alias(f"key_{s}"), F.col("name").alias(f"name_{s}")) for s in "ab")
    return pairs.join(one, "key_a").join(two, "key_b").select(text.half_up(F.col("similarity"), 3).alias("similarity"), "name_a", "name_b", "links")
