"""Category trees and merge pointers.

Questions about ancestors go through ``Jumps``, a table of ancestors at doubled distances; ``closure`` lists all pairs and is for
shallow trees, where the pairs themselves are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the checkpoint folder, or in the cache where there is none. A checkpoint alone computes
    its input twice, and fails on some optimised plans, so it is written from a cache that is given up after."""
    cached = df.cache()
    if not df.sparkSession.sparkContext.getCheckpointDir():
        return cached
    written = cached.checkpoint()
    cached.unpersist()
    return written


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(id, ancestor) from (id, parent), by joining paths with paths: as many rounds as the logarithm of
    the depth. Cycles are harmless: the set of pairs is finite, and a node of a cycle is its own ancestor."""
    pairs = edges.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor")).distinct()
    pairs = held(pairs)
    size = pairs.count()
    for _ in range(rounds):
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.ancestor").alias("ancestor"))
        grown = held(pairs.union(longer).distinct())
        now = grown.count()
        if now == size:
            return grown
        pairs, size = grown, now
    raise RuntimeError("the tree is deeper than 2 ** rounds")


class Jumps:
    """Ancestors of all nodes at distances 1, 2, 4 …: n log(depth) rows, from which questions about ancestors are answered
    in as many rounds as the logarithm of the depth, without a row for each pair of node and ancestor."""

    def __init__(self, edges: DataFrame):
        """``edges`` (id, parent); a parent need not be a node. Nodes of cycles are ``looped``, those below them ``lost`` too."""
        level = held(edges.where("parent IS NOT NULL").select("id", F.col("parent").alias("up")).distinct())
        n = level.count()
        #: (id, up) for each distance.
        self.levels: list[DataFrame] = []
        self.looped = level.select("id").limit(0)
        self.lost = self.looped
        while not level.isEmpty():
            self.levels.append(level)
            if 2 ** (len(self.levels) - 1) > n:  # no path is so long: only cycles are left, and every node of one is the end of such a jump
                self.looped, self.lost = held(level.select(F.col("up").alias("id")).distinct()), level.select("id")
                break
            above = level.select(F.col("id").alias("up"), F.col("up").alias("next"))
            level = held(level.join(above, "up").select("id", F.col("next").alias("up")))

    def upward(self, seeds: DataFrame) -> DataFrame:
        """``seeds`` (id) and all their ancestors."""
        found = seeds.select("id").distinct()
        for level in self.levels:
            found = held(found)
            found = found.union(level.join(found, "id").select(F.col("up").alias("id"))).distinct()
        return found

    def downward(self, seeds: DataFrame) -> DataFrame:
        """``seeds`` (id) and all their descendants."""
        found = seeds.select("id").distinct()
        for level in self.levels:
            found = held(found)
            found = found.union(level.join(found.select(F.col("id").alias("up")), "up").select("id")).distinct()
        return found

    def summed_below(self, values: DataFrame) -> DataFrame:
        """(id, value): the sum of ``values`` (id, value) over each node and its descendants; without cycles."""
        sums = values
        for level in self.levels:
            sums = held(sums)
            more = level.join(sums, "id").groupBy(F.col("up").alias("id")).agg(F.sum("value").alias("more"))
            sums = sums.join(more, "id", "left").select("id", (F.col("value") + F.coalesce("more", F.lit(0))).alias("value"))
        return held(sums)

    def summed_above(self, values: DataFrame, columns: list[str]) -> DataFrame:
        """``values`` (id, columns) summed over each node and its ancestors; without cycles."""
        sums = values
        for level in self.levels:
            sums = held(sums)
            of_up = sums.select(F.col("id").alias("up"), *[F.col(c).alias(f"{c}_up") for c in columns])
            above = level.join(of_up, "up").drop("up")
            sums = sums.join(above, "id", "left").select("id", *[(F.col(c) + F.coalesce(f"{c}_up", F.lit(0))).alias(c) for c in columns])
        return held(sums)


def descendants(edges: DataFrame, root: Column) -> DataFrame:
    """The ids below a root, without itself."""
    start = edges.sparkSession.range(1).select(root.alias("id"))
    return Jumps(edges).downward(start).where(F.col("id") != root)


def siblings() -> list[Column]:
    """The order of siblings: by sort_order, then by name in Ukrainian order, then by id; nulls come last, as in SQL."""
    return [F.col("sort_order").asc_nulls_last(), F.expr("name COLLATE uk").asc_nulls_last(), F.col("id")]


def intervals(nodes: DataFrame) -> DataFrame:
    """(id, first, last, depth) of ``nodes`` (id, parent, sort_order, name): the place of each node in tree order, siblings as in ``sorted_tree``, and the
    place of its last descendant. A node is below another if its place lies within the other's, so that is a range test and needs no
    ancestors. A node whose parent is not among the nodes is a root; nodes of cycles and those below them are left out."""
    known = nodes.select(F.col("id").alias("known_id"))
    rooted = held(nodes.join(known, nodes["parent"] == F.col("known_id"), "left").select("id", "sort_order", "name", F.col("known_id").alias("parent")))
    jumps = Jumps(rooted)
    sound = rooted.join(jumps.lost, "id", "left_anti")
    size = jumps.summed_below(sound.select("id", F.lit(1).cast("long").alias("value"))).withColumnRenamed("value", "size")
    # A child comes after its parent and the whole trees of the siblings before it.
    before = Window.partitionBy("parent").orderBy(*siblings()).rowsBetween(Window.unboundedPreceding, -1)
    child = F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")
    steps = sound.join(size, "id").select("id", "size", (child + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("first"), child.alias("depth"))
    placed = jumps.summed_above(steps.select("id", "first", "depth"), ["first", "depth"])
    return placed.join(size, "id").select("id", "first", (F.col("first") + F.col("size") - 1).alias("last"), "depth")


def parent_choices(nodes: DataFrame, of: Column) -> DataFrame:
    """(id, label, sort_order): the nodes that may become the parent of the node ``of``, all but itself and those below it, in their order; labels
    name the present parent too. ``nodes`` (id, parent, sort_order, name); a node that is not there may go anywhere."""
    placed = held(intervals(nodes).select("id", "first", "last"))
    own = placed.where(F.col("id") == of).select(F.col("first").alias("low"), F.col("last").alias("high"))  # one row
    inside = placed.join(F.broadcast(own), F.col("first").between(F.col("low"), F.col("high")), "left_semi").select("id")
    p = nodes.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    labelled = nodes.join(inside, "id", "left_anti").where(F.col("id") != of).join(p, F.col("parent") == F.col("p_id"), "left")
    return labelled.select("id", F.concat_ws(" → ", "p_name", "name").alias("label"), "sort_order", "name").orderBy("sort_order", "name", "id").drop("name")


def sorted_tree(nodes: DataFrame, rounds: int = 32) -> DataFrame:
    """``nodes`` (id, parent, sort_order, name) in tree order, with depth: siblings by sort_order and then by
    name in Ukrainian order; a node whose parent is not among the nodes is a root. Nodes of cycles, and those below
    them, are left out. As many rounds as the logarithm of the depth, which is not limited."""
    known = nodes.select(F.col("id").alias("known_id"))
    rooted = nodes.join(known, nodes["parent"] == F.col("known_id"), "left").select("id", "sort_order", "name", F.col("known_id").alias("parent"))
    place = Window.partitionBy("parent").orderBy(*siblings())
    # Siblings are numbered first; the path of numbers is then the sort key of the whole tree.
    numbered = rooted.withColumn("path", F.lpad(F.row_number().over(place).cast("string"), 9, "0"))
    # A path is known up to the node ``up``; each round puts the path of that node before it, so lengths double.
    paths = held(numbered.select("id", "name", F.col("parent").alias("up"), "path", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    left = paths.where("up IS NOT NULL").count()
    for _ in range(rounds):
        above = paths.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("depth").alias("more"))
        longer = paths.where("up IS NOT NULL").join(above, "up").select("id", "name", F.col("next").alias("up"), F.concat_ws("/", "before", "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = held(paths.where("up IS NULL").union(longer))
        now = paths.where("up IS NOT NULL").count()
        # A round that finishes no node has only nodes of cycles and below them left, which are in no tree.
        if now == left:
            return paths.where("up IS NULL").select("id", "name", "depth", "path")
        left = now
    raise RuntimeError("the tree is deeper than 2 ** rounds")


def prune(nodes: DataFrame, occupied: Column, protected: Column) -> DataFrame:
    """(id, kept) of ``nodes`` (id, parent, ...): removing leaves that are neither occupied nor protected
    until none is left keeps exactly the occupied and protected nodes, the nodes of cycles and the
    ancestors of all these. Flags go up in rounds of doubled distance. One row per node: rows of one id share their flag, a null id has none."""
    return marked(nodes, occupied, protected).select("id", "kept")


def marked(nodes: DataFrame, occupied: Column, protected: Column) -> DataFrame:
    """``nodes`` with the flags of ``prune`` as a column ``kept``."""
    jumps = Jumps(nodes.select("id", "parent"))
    kept = jumps.upward(nodes.where(occupied | protected).select("id").union(jumps.looped)).withColumn("kept", F.lit(True))
    return nodes.join(kept, "id", "left").withColumn("kept", F.when(F.col("id").isNotNull(), F.coalesce("kept", F.lit(False))))


def first_round(nodes: DataFrame, occupied: Column, protected: Column) -> DataFrame:
    """What a dry run reports: the leaves that the first round would remove."""
    leaves = nodes.join(nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
    return leaves.where(~(occupied | protected)).select("id")


def breadcrumbs(nodes: DataFrame, root: Column) -> DataFrame:
    """Each node's name and its parent's; a parent that is the hidden root is left out."""
    p = nodes.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    joined = nodes.join(p, nodes["parent"] == F.col("p_id"), "left")
    shown = F.when(F.col("p_id").isNotNull() & (F.col("p_id") != root), F.col("p_name"))
    return joined.select("id", F.concat_ws(" / ", shown, F.col("name")).alias("crumbs"))


def unique_slugs(new: DataFrame, taken: DataFrame, limit: int = 180) -> DataFrame:
    """``new`` (id, base) with a free slug each: the base, cut to ``limit``, or it with -2, -3 and so on, in the order
    of the ids, skipping what ``taken`` (slug) holds. A slug that is another new row's base is left to that row,
    so all slugs differ: from one another and from the taken ones."""
    new = new.withColumn("base", F.substring("base", 1, limit))
    wanted = new.groupBy("base").agg(F.count("*").alias("n_new"))
    suffix = r"-([2-9]|[1-9][0-9]{1,8})$"

    def numbers_in(slugs: DataFrame) -> DataFrame:
        """(base, i) of the slugs that a base with a number would give."""
        i = F.regexp_extract("slug", suffix, 1)
        return slugs.where(i != "").select(F.regexp_replace("slug", suffix, "").alias("base"), i.cast("int").alias("i"))

    used = taken.select(F.col("slug").alias("base"), F.lit(1).alias("i")).union(numbers_in(taken)).union(numbers_in(wanted.select(F.col("base").alias("slug"))))
    used = used.join(wanted, "base", "left_semi").groupBy("base").agg(F.collect_set("i").alias("used"))
    free = wanted.join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = free.withColumn("free", F.array_except(F.sequence(F.lit(1), (F.col("n_new") + F.size("used")).cast("int")), F.col("used"))).select("base", "free")
    turn = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    placed = new.withColumn("turn", turn).join(free, "base").withColumn("i", F.element_at("free", F.col("turn")))
    return placed.select("id", "base", F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "i")).alias("slug"))


def ultimate(pointers: DataFrame) -> DataFrame:
    """(loser, canonical, ultimate): where the chain of immediate pointers ends; the pointer itself where it leads into a cycle.
    Ends double their distance each round."""
    ends = held(pointers.select("loser", "canonical", F.col("canonical").alias("ultimate")))
    losers = pointers.select(F.col("loser").alias("ultimate"))
    for _ in range(ends.count().bit_length() + 1):
        if ends.join(losers, "ultimate", "left_semi").isEmpty():
            return ends
        further = ends.select(F.col("loser").alias("ultimate"), F.col("ultimate").alias("further"))
        ends = held(ends.join(further, "ultimate", "left").select("loser", "canonical", F.coalesce("further", "ultimate").alias("ultimate")))
    looped = losers.distinct().withColumn("looped", F.lit(True))
    return ends.join(looped, "ultimate", "left").select("loser", "canonical", F.when(F.col("looped"), F.col("canonical")).otherwise(F.col("ultimate")).alias("ultimate"))


def may_reparent(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (id, new_parent) with the verdict: ok, self, descendant or missing. The new parent is lifted to the depth of the moved node by
    jumps: that node is met if the parent is below it. In and below cycles, which hold no sound node, all ancestors are looked at."""
    jumps = Jumps(edges)
    sound = edges.select("id").distinct().join(jumps.lost, "id", "left_anti")
    rooted = edges.where("parent IS NOT NULL").select("id").distinct().withColumn("child", F.lit(1).cast("long"))
    depth = jumps.summed_above(sound.join(rooted, "id", "left").select("id", F.coalesce("child", F.lit(0).cast("long")).alias("depth")), ["depth"])
    at = depth.select(F.col("id").alias("new_parent"), F.col("depth").alias("from"))
    lifted = moves.select("id", "new_parent").distinct().join(depth, "id").join(at, "new_parent").where("from > depth").select("id", "new_parent", (F.col("from") - F.col("depth")).alias("way"), F.col("new_parent").alias("now"))
    for k, level in enumerate(jumps.levels):
        up = level.select(F.col("id").alias("now"), "up")
        lifted = lifted.join(up, "now", "left").withColumn("now", F.when(F.col("way").bitwiseAND(2**k) > 0, F.col("up")).otherwise(F.col("now"))).drop("up")
    below = lifted.where("now = id").select("id", "new_parent")
    if not jumps.lost.isEmpty():
        below = below.union(closure(edges.join(jumps.lost, "id", "left_semi")).select(F.col("ancestor").alias("id"), F.col("id").alias("new_parent")))
    below = below.withColumn("below", F.lit(True))
    known = edges.select(F.col("id").alias("new_parent"), F.lit(True).alias("known")).distinct()
    verdict = (
        F.when(F.col("new_parent").isNull(), "ok").when(F.col("new_parent") == F.col("id"), "self")
        .when(F.col("below"), "descendant").when(F.col("known").isNull(), "missing").otherwise("ok")
    )
    return moves.join(below, ["id", "new_parent"], "left").join(known, "new_parent", "left").select("id", "new_parent", verdict.alias("verdict"))
