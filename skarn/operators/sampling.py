"""Samples and splits that match the make-up of one class: quotas of strata, give-back of what is short, held-out families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.ranking import hash_key, hash_rank


def _wanted(share: float) -> Column:
    """Negative rows that bring ``P`` positive ones to ``share`` of all."""
    return F.bround(F.col("P") * ((1 - share) / share)).cast("long")


def quotas(cells: DataFrame, strata: list[str], slack: dict[str, float], share: float, rounds: int = 4) -> DataFrame:
    """cells with ``taken``: how many negative rows each cell of strata gives.

    cells: strata, pos, neg. A stratum's quota is the positive rows' share in
    it (plus its slack) of all negative rows wanted; no stratum gets more.
    Each cell asks for its own share at first and for all that it has left in
    the later rounds, in which cells take over what others could not give. A
    round grants requests stratum by stratum, in the order of the cells, until
    the quota is used up. Only the table of cells is sorted, never the rows.
    """
    total = F.broadcast(cells.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P")).withColumn("W", _wanted(share)))
    out = cells.join(total).withColumn("taken", F.lit(0).cast("long"))
    for s in strata:
        part = F.sum("pos").over(Window.partitionBy(s)) / F.greatest("P", F.lit(1)) + slack.get(s, 0.0)
        exact = part * F.col("W")
        out = out.withColumn(f"_q_{s}", F.coalesce((F.floor(exact) if slack.get(s) else F.bround(exact)).cast("long"), F.lit(0)))
    for j in range(rounds):
        left = F.col("neg") - F.col("taken")
        own = F.least(left, F.ceil(F.col("pos") * F.col("W") / F.greatest("P", F.lit(1)))) if j == 0 else left
        out = out.withColumn("_ask", own.cast("long"))
        for s in [*strata, None]:
            if s is None:  # all strata together: quotas with slack or rounded up may exceed what is wanted
                room, w = F.col("W") - F.sum("taken").over(Window.partitionBy()), Window.partitionBy()
            else:
                room, w = F.col(f"_q_{s}") - F.sum("taken").over(Window.partitionBy(s)), Window.partitionBy(s)
            before = F.coalesce(F.sum("_ask").over(w.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            out = out.withColumn("_room", F.greatest(room - before, F.lit(0))).withColumn("_ask", F.least("_ask", "_room"))
        out = out.withColumn("taken", F.col("taken") + F.col("_ask"))
    return out.select(*strata, "pos", "neg", "taken")


def matched_sample(df: DataFrame, positive: Column, strata: list[str], slack: dict[str, float], share: float, seed: int, id_col: str) -> DataFrame:
    """L4: all positive rows, and negative ones to (1 - share) of the sample that are spread over the strata as the positive ones are.

    A stratum with a slack may exceed the positive rows' share by that much of
    all negative rows. Which rows of a cell are taken is decided by the
    reproducible random order. Rows whose class is null take no part; null
    strata are strata of their own.
    """
    rows = df.withColumn("_pos", positive).where("_pos is not null")
    cells = rows.groupBy(*strata).agg(F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg"))
    given = quotas(cells, strata, slack, share).where("taken > 0").select(F.struct(*strata).alias("_cell"), "taken")
    # the struct makes null strata comparable
    negative = hash_rank(rows.where("not _pos").withColumn("_cell", F.to_json(F.struct(*strata))), ["_cell"], seed, id_col, "_r")
    chosen = negative.join(given.withColumn("_cell", F.to_json("_cell")), "_cell").where("_r <= taken").drop("_cell", "_r", "taken")
    return rows.where("_pos").unionByName(chosen).withColumnRenamed("_pos", "positive")


def water_level(bins: DataFrame, bin_col: str, want: Column) -> DataFrame:
    """(bin, taken): what bins of n rows give when one row after another is taken from each in turn, until ``want`` are.

    The level is found from the sorted counts: below the largest count c of
    which sum(least(n, c)) fits, every bin is drawn from in full turns; what is
    left goes round the bins that have more, the lowest bins first.
    """
    w = Window.partitionBy().orderBy("n", bin_col)
    upto, n_bins = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.count(F.lit(1)).over(Window.partitionBy())
    at = bins.withColumn("_want", want.cast("long")).withColumn("_full", upto + F.col("n") * (n_bins - F.row_number().over(w)))
    base = F.coalesce(F.max(F.when(F.col("_full") <= F.col("_want"), F.col("n"))).over(Window.partitionBy()), F.lit(0))
    at = at.withColumn("_base", base)
    spent = F.sum(F.least("n", "_base")).over(Window.partitionBy())
    more = F.greatest(F.count_if(F.col("n") > F.col("_base")).over(Window.partitionBy()), F.lit(1))
    at = at.withColumn("_left", F.greatest(F.col("_want") - spent, F.lit(0))).withColumn("_more", more)
    at = at.withColumn("_level", F.col("_base") + F.floor(F.col("_left") / F.col("_more"))).withColumn("_rest", F.col("_left") % F.col("_more"))
    place = F.count_if(F.col("n") > F.col("_base")).over(Window.partitionBy().orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0))
    extra = ((F.col("n") > F.col("_base")) & (place <= F.col("_rest"))).cast("long")
    return at.select(bin_col, F.least("n", F.col("_level") + extra).alias("taken"))


def restore_share(df: DataFrame, positive: Column, bin_col: str, share: float, seed: int, id_col: str) -> DataFrame:
    """All positive rows; of the negative ones, if they are more than (1 - share) of the sample, as many as that, drawn from the bins in turn."""
    rows = df.withColumn("_pos", positive).where("_pos is not null")
    n_pos = F.broadcast(rows.agg(F.count_if("_pos").alias("P")))
    negative = rows.where("not _pos")
    bins = negative.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n")).join(n_pos)
    given = water_level(bins, bin_col, _wanted(share))
    chosen = hash_rank(negative, [bin_col], seed, id_col, "_r").join(given, bin_col).where("_r <= taken").drop("_r", "taken")
    return rows.where("_pos").unionByName(chosen.select(*rows.columns)).withColumnRenamed("_pos", "positive")


def even_sample(df: DataFrame, group: str, n: int, seed: int, id_col: str) -> DataFrame:
    """L8 (L7 is cap_per_key): n rows spread evenly: n // groups, at least one, of each group (all, if fewer)."""
    per = F.broadcast(df.agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count_distinct(group))).alias("_per")))
    return hash_rank(df, [group], seed, id_col, "_r").join(per).where("_r <= _per").drop("_r", "_per")


def random_negatives(df: DataFrame, group: str, positive: Column, per_positive: int, seed: int, id_col: str) -> DataFrame:
    """For each positive row of a group, per_positive of its other rows, without repetition (all, if fewer)."""
    rows = df.withColumn("_pos", F.coalesce(positive, F.lit(False)))
    want = rows.groupBy(group).agg((F.count_if("_pos") * per_positive).alias("_k")).where("_k > 0")
    return hash_rank(rows.where("not _pos"), [group], seed, id_col, "_r").join(want, group).where("_r <= _k").drop("_pos", "_r", "_k")


def family_splits(df: DataFrame, family: str, positive: Column, n_families: int, share: float, seed: int, id_col: str) -> DataFrame:
    """Split of each row: cross (a held-out family), within (held out by label of the other families) or train.

    Families are held out of those with a positive row and of those without in
    proportion, at least one of each (none where there is none), by a
    reproducible random order; of the rest round(n * share) rows of each label
    are held out.
    """
    rows = df.withColumn("_pos", positive).where(F.col("_pos").isNotNull() & F.col(family).isNotNull())
    families = rows.groupBy(family).agg(F.max("_pos").alias("_any"))
    n = families.agg(F.count(F.lit(1)).alias("_n"), F.count_if("_any").alias("_p"))
    k_pos = F.greatest(F.lit(1), F.bround(n_families * F.col("_p") / F.greatest("_n", F.lit(1))).cast("long"))
    k = F.broadcast(n.select(k_pos.alias("_kp"), F.greatest(F.lit(1), n_families - k_pos).alias("_kn")))
    # the constant bound lets Spark cut before it sorts
    first = families.withColumn("_i", F.row_number().over(Window.partitionBy("_any").orderBy(hash_key(seed, family), family))).where(F.col("_i") <= max(1, n_families))
    held = first.join(k).where(F.col("_i") <= F.when(F.col("_any"), F.col("_kp")).otherwise(F.col("_kn"))).select(family, F.lit(True).alias("_held"))
    # at most two times n_families rows
    marked = rows.join(F.broadcast(held), family, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    rest = marked.where("not _held")
    size = F.broadcast(rest.groupBy("_pos").agg(F.bround(F.count(F.lit(1)) * share).alias("_k")))
    dealt = hash_rank(rest, ["_pos"], seed, id_col, "_r").join(size, "_pos").withColumn("split", F.when(F.col("_r") <= F.col("_k"), "within").otherwise("train")).drop("_r", "_k")
    out = dealt.unionByName(marked.where("_held").withColumn("split", F.lit("cross")))
    return out.drop("_held").withColumnRenamed("_pos", "positive")
