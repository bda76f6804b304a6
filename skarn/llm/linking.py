"""Classes of similar items from locality-sensitive buckets, without a list of any bucket's pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import components, cut

#: Rows up to which a table of a few numbers a row is broadcast after it has been counted; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000
#: Comparisons (rows outside a bucket's largest class x all its rows) up to which a bucket is closed at once.
CROWDED = 2500
#: Heads of a bucket, about, in the rounds before the one that takes all rows that are left.
HEADS = (4, 64)
#: Pairs of a bucket, about, that one task looks at.
TASK_PAIRS = 1 << 23
#: Rows of a few numbers that a task takes when a table has become small.
TASK_ROWS = 50_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (computed before), to be broadcast if it has been counted and is small."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def with_likely(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """df with the boolean ``likely``: true where the long ``column`` is one of values' (computed, one column), and for a few others.

    A bitmap of 16 bits a value, up to 16 MB, is broadcast in rows of 4 KB, so
    that what values don't hold need not be shuffled. With more values it
    tells apart less, and stays right.
    """
    size = min(27, max(15, (16 * values.count()).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - size)
    word, bit = F.shiftright("p", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    words = values.select(place(values.columns[0]).alias("p")).groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    rows = words.groupBy(F.shiftright("w", 9).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("w", F.lit(512)).alias("w"), "bits"))).alias("m"))
    rows = rows.select("_row", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(511).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_bits"))
    placed = df.withColumn("_p", place(column)).withColumn("_row", F.shiftright("_p", 15))
    own = F.get("_bits", F.pmod(F.shiftright("_p", 6), F.lit(512)).cast("int"))
    likely = F.coalesce(F.getbit(own, F.pmod("_p", F.lit(64)).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(cut(rows)), "_row", "left").withColumn("likely", likely).drop("_row", "_p", "_bits")


def likely_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows of df whose ``column`` is one of values', and a few others."""
    return with_likely(df, column, values).where("likely").drop("likely")


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another node has, too. A node has a key once."""
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    return cut(likely_in(keyed, "key", shared).join(shared, "key").select("key", "node"))


def _plausible(pairs: DataFrame, traits: DataFrame, plausible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    x, y = (lambda name, of=of: F.col(f"{of}.{name}") for of in "xy")
    both = pairs.join(traits.alias("x"), F.col("a") == x("node")).join(traits.alias("y"), F.col("b") == y("node"))
    return both.where(plausible(x, y)).select("a", "b")


def link_classes(members: DataFrame, traits: DataFrame, plausible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], verify: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, comp): classes of nodes that verified links join, comp the least node, for every node with a link.

    members has (key, node). traits has a row for each node (others do no
    harm) with size, by which similar nodes differ by a factor of
    ``similarity`` at most, and further columns. plausible tells of two nodes'
    traits whether they can be similar; it must hold for all that are. verify
    takes rows with a and b and returns, computed, those rows that are similar.

    First each node is compared with the least of all nodes that share a
    bucket with it, which joins most of what belongs together at one
    comparison a node. From then on only buckets that hold several classes are
    open. Rows outside a bucket's largest class (heads) are compared with the
    members of all other classes and leave the bucket: all of them at once
    where that takes at most CROWDED comparisons; elsewhere a few chosen by a
    hash, then some more, which mostly leaves one class, and in the last round
    all that are left. So any two members of different classes that share a
    key are compared before the bucket closes, and the number of rounds is
    fixed. A bucket of similar items costs about one comparison an item,
    however large it is; one of n unlike items costs n x n looks at traits of
    those of about one size, which are dealt to tasks by parts of TASK_PAIRS
    and make no rows.
    """
    tasks = max(8, members.count() // TASK_ROWS)
    few = lambda df: cut(df.coalesce(tasks))
    least = members.groupBy("key").agg(F.min("node").alias("lo"))
    x, y = (lambda name, of=of: F.col(f"{of}.{name}") for of in "xy")
    pairs = members.join(least, "key").groupBy("node").agg(F.min("lo").alias("lo")).where("lo < node")
    links = verify(few(_plausible(pairs.select(F.col("lo").alias("a"), F.col("node").alias("b")), traits, plausible)))
    members, classes = members.coalesce(tasks), cut(components(links))
    step = math.log(1 / similarity)
    for heads in (*HEADS, None):
        members = members.select("key", "node").join(small(classes), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        counts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        mixed = few(counts.agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all")).select("key", F.col("most.comp").alias("most"), (F.col("all") - F.col("most.n")).alias("others"), "all").where("others > 0"))
        if mixed.isEmpty():
            break
        wanted = F.col("others") if heads is None else F.when(F.col("others") * F.col("all") > CROWDED, F.least("others", F.lit(heads))).otherwise(F.col("others"))
        # by a power of two: a node that is a head in a large bucket is one in its smaller ones, so their pairs are mostly the same
        thin = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("others") / wanted))).cast("long")
        is_head = (F.col("comp") != F.col("most")) & ((F.col("others") <= wanted) | (F.pmod(F.xxhash64("node", F.lit(heads or 0)), thin) == 0))
        # heads and others are both dealt to that many parts, so that each row is copied to the root of the number of tasks only
        side = F.ceil(F.sqrt(wanted * F.col("all") / TASK_PAIRS)).cast("int")
        # few are compared whatever their sizes; in crowded buckets sizes are told apart by bins
        crowded = F.col("others") * F.col("all") > CROWDED
        open_ = few(members.join(small(mixed), "key").select("key", "node", "comp", side.alias("side"), crowded.alias("crowded"), is_head.alias("is_head")))
        # a pair that shares several buckets is looked for in the first of those in which it has a head
        held = open_.groupBy("node").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("key", "side", "crowded", "is_head")).alias("at"))
        held = held.select("node", "comp", "at", F.col("at.key").alias("keys"), F.transform(F.filter("at", lambda k: k["is_head"]), lambda k: k["key"]).alias("led"))
        held = held.join(traits.withColumn("bin", F.floor(F.log("size") / step).cast("int")), "node")
        rows = lambda at: held.select("*", F.inline(at)).drop("at")
        every, own = F.explode(F.sequence(F.lit(0), F.col("side") - 1)), lambda salt: F.pmod(F.hash("node", F.lit(salt)), "side")
        # heads are picked before their keys become rows, so that the members of a bucket are made once
        asked = rows(F.filter("at", lambda k: k["is_head"])).withColumn("row", own(1)).withColumn("column", every).withColumn("bin", F.explode(F.when(F.col("crowded"), F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).otherwise(F.array(F.lit(0)))))
        others = rows(F.col("at")).withColumn("column", own(2)).withColumn("row", every).withColumn("bin", F.when(F.col("crowded"), F.col("bin")).otherwise(0))
        first = F.array_min(F.concat(F.array_intersect(x("led"), y("keys")), F.array_intersect(x("keys"), y("led"))))
        once = (~x("is_head") | (x("node") < y("node"))) & (x("comp") != y("comp"))
        met = (x("key") == y("key")) & (x("row") == y("row")) & (x("column") == y("column")) & (x("bin") == y("bin")) & once & plausible(x, y) & (first == x("key"))
        both = others.alias("x").join(asked.alias("y").hint("shuffle_hash"), met)
        pairs = few(both.select(F.least(x("node"), y("node")).alias("a"), F.greatest(x("node"), y("node")).alias("b")).distinct())
        found = verify(pairs)
        members = open_.where("not is_head")
        if not found.isEmpty():
            links = cut(links.union(found).coalesce(tasks))
            classes = cut(components(links))
    return classes
