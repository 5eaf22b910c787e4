"""Components of the links inside buckets, without all pairs of a bucket.

Nodes meet in buckets; two nodes are linked if they share a bucket and ``verify`` confirms the pair.
Only the components of these links are wanted, so pairs inside a component that is already
known need no test. Each round picks one leader for every bucket that still holds several components,
tests it against the members of other components, and joins the components of confirmed pairs.
A large group of copies so collapses in a few rounds of at most one pair for each member. When the rounds
stop paying, ``narrow`` may bound which pairs can be linked at all; a last step tests every pair of
different components left in a bucket that the bounds allow. So no link is lost: rounds and bounds only
save work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import drop, stage

#: All pairs are tested once there are at most so many for each member left in the buckets; rounds go
#: on while each leaves at most the share ``PAYS`` of the pairs before it.
PAIRS_PER_MEMBER, PAYS = 2, 0.5

Narrow = Callable[[DataFrame], tuple[DataFrame, Callable[[str, str], Column]]]


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], narrow: Narrow | None = None,
         near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(id, root) of the nodes that are not the least of their component.

    ``members`` has (bucket long, id long), each once, and columns that ``near`` needs: a condition that
    any two linked nodes fulfil, made from the columns' prefixes of either side. ``verify`` takes pairs (a < b), each once, and
    returns those that are linked. ``narrow`` takes (id, comp) and returns the nodes (id) that can have a
    link outside their component, with columns of bounds, and a condition that any two linked nodes of
    different components fulfil, made from the columns' prefixes of either side.
    """
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = stage(members.join(shared, "bucket", "left_semi").withColumn("comp", F.col("id")), "link-members")
    found: DataFrame | None = None
    turn, before = 0, None
    while True:
        sizes = active.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
        left = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).agg(
            F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if not left[0] or not left[1]:
            break
        few = left[1] <= PAIRS_PER_MEMBER * left[0]
        if few or (before is not None and left[1] > PAYS * before):
            links = stage(verify(_all_pairs(active, None if few else narrow, near)), "links")
            found = _join(found, links)
            break
        links = stage(verify(_leader_pairs(active, turn, near)), "links")
        if links.isEmpty():
            drop(links)
        else:
            found, old = _join(found, links), active
            active = _mixed(found, active)
            drop(old)
        turn, before = turn + 1, left[1]
    drop(active)
    if found is None:
        return members.select("id", F.col("id").alias("root")).limit(0)
    return found


def _pairs(one: DataFrame, two: DataFrame, allowed: Column, near: Callable[[str, str], Column] | None) -> DataFrame:
    """Distinct (a, b), a < b, of different components in a bucket that the conditions allow."""
    apart = (F.col("one.bucket") == F.col("two.bucket")) & (F.col("one.comp") != F.col("two.comp")) & allowed
    if near is not None:
        apart = apart & near("one", "two")
    return one.alias("one").join(two.alias("two"), apart).select(
        F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b")).distinct()


def _leader_pairs(active: DataFrame, turn: int, near: Callable[[str, str], Column] | None) -> DataFrame:
    order = F.xxhash64("id", F.lit(turn))  # the same in all buckets, so that copies meet few leaders
    rest = [c for c in active.columns if c != "bucket"]
    leaders = active.groupBy("bucket").agg(F.min(F.struct(order.alias("__order"), *rest)).alias("__leader")).select(
        "bucket", *[F.col("__leader")[c].alias(c) for c in rest])
    return _pairs(active, leaders, F.lit(True), near)


def _all_pairs(active: DataFrame, narrow: Narrow | None, near: Callable[[str, str], Column] | None) -> DataFrame:
    """Pairs of different components in a bucket that can be linked; within a component none."""
    allowed = F.col("one.id") < F.col("two.id")
    if narrow is not None:
        bounds, condition = narrow(active.select("id", "comp").distinct())
        active = stage(active.join(bounds, "id"), "link-narrowed")
        allowed = allowed & condition("one", "two")
    return _pairs(active, active, allowed, near)


def _join(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """All components so far; the tables that they are made of go."""
    edges = links.select("a", "b")
    if found is not None:
        edges = edges.unionAll(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = components(edges)
    drop(edges)
    return joined


def _mixed(found: DataFrame, active: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components."""
    active = active.drop("comp").join(found, "id", "left").select(
        *[c for c in active.columns if c != "comp"], F.coalesce("root", "id").alias("comp"))
    mixed = active.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return stage(active.join(mixed, "bucket", "left_semi"), "link-members")
