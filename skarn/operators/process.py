"""The fourteen process measures of a change, from the history before it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.history import apart

#: Parts of a subject that tell of a fix.
FIX_WORDS = ("fix", "bug", "defect", "patch", "issue", "crash", "regression", "hotfix")
YEAR, DAY = 365.25 * 86400, 86400
#: Parts that the later side of an author's pairs of times is dealt to.
SPREAD = 16
#: Rows of a bucket of paths or authors up to which each of them is read in order by one task; others are dealt by month.
PATH_ROWS, AUTHOR_ROWS = 1_000_000, 100_000
BUCKETS = 16_384


def before(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], ts: str = "ts", id_col: str = "id") -> DataFrame:
    """df with sums, counts or maxima over the rows of the same keys that come strictly before, by ts and id.

    values: name -> ("sum" or "max", column). Rows that share ts and id are one event and don't see
    each other. Keys are dealt by month: a window holds a key's rows of one month, and what earlier
    months hold is added from a table of one row a key and month, so that
    no task holds the history of a frequent key.
    """
    month = F.trunc(F.col(ts).cast("date"), "month")
    rows = df.withColumn("_month", month).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    agg = {"sum": F.sum, "max": F.max}
    per_event = rows.groupBy(*keys, "_month", ts, id_col).agg(*(agg[kind](f"_v_{n}").alias(f"_v_{n}") for n, (kind, _) in values.items()))
    per_month = per_event.groupBy(*keys, "_month").agg(*(agg[kind](f"_v_{n}").alias(f"_v_{n}") for n, (kind, _) in values.items()))
    upto = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = per_month.select(*keys, "_month", *(agg[kind](f"_v_{n}").over(upto).alias(f"_m_{n}") for n, (kind, _) in values.items()))
    inner = Window.partitionBy(*keys, "_month").orderBy(ts, id_col).rowsBetween(Window.unboundedPreceding, -1)
    events = per_event.select(*keys, "_month", ts, id_col, *(agg[kind](f"_v_{n}").over(inner).alias(f"_i_{n}") for n, (kind, _) in values.items())).join(apart(months), [*keys, "_month"])
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    seen = events.select(*keys, ts, id_col, *(both[kind](F.col(f"_i_{n}"), F.col(f"_m_{n}")).alias(n) for n, (kind, _) in values.items()))
    return df.join(apart(seen), [*keys, ts, id_col])


def recent_experience(commits: DataFrame) -> DataFrame:
    """(id, rexp): sum over an author's earlier commits of 1 / (years since + 1); those of the same time count 1.

    Commits are counted by author and time first; an author's times meet the
    earlier ones, dealt to SPREAD parts.
    """
    times = commits.groupBy("author", "ts").agg(F.count(F.lit(1)).alias("n"))
    later = times.select("author", F.col("ts").alias("now"), F.pmod(F.xxhash64("ts"), F.lit(SPREAD)).alias("_part"))
    earlier = times.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    score = F.sum(F.col("n") / ((seconds("now") - seconds("ts")) / YEAR + 1))
    past = later.join(apart(earlier), ["author", "_part"]).where("ts < now").groupBy("author", "now").agg(score.alias("past")).withColumnRenamed("now", "ts")
    order = Window.partitionBy("author", "ts").orderBy("id")
    rows = commits.select("id", "author", "ts", (F.row_number().over(order) - 1).alias("same"))
    return rows.join(apart(past), ["author", "ts"], "left").select("id", (F.coalesce("past", F.lit(0.0)) + F.col("same")).alias("rexp"))


def crowded(keys: DataFrame, most: int) -> Column | None:
    """Whether a key (the one column of keys) is in a bucket of more than so many rows; None if there is no such bucket."""
    bucket = F.pmod(F.xxhash64(keys.columns[0]), F.lit(BUCKETS))
    full = keys.where(F.col(keys.columns[0]).isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    found = [r.b for r in full.collect()]
    return F.coalesce(bucket.isin(found), F.lit(False)) if found else None


def whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by their first column, in tables that no key goes beyond. Null is no key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1]
        cut = pc.index(batch.column(0), last).as_py() if last.is_valid else batch.num_rows
        if rest and (cut or rest[0].column(0)[-1] != last):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        if cut < batch.num_rows:
            rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def differs(column: pa.Array) -> np.ndarray:
    """Whether a row's value is unlike that of the row before; null is unlike all."""
    out = np.ones(len(column), bool)
    out[1:] = np.asarray(pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))), True))
    return out


def starts(new: np.ndarray) -> np.ndarray:
    """Of each row the last one up to it that is new."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


def earlier(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x from the row ``first`` up to, but without, each row."""
    c = np.cumsum(x) - x
    return c - c[first]


def in_order(rows: DataFrame, key: str, passed: list[str], add: str, use: Callable[[dict[str, pa.Array], np.ndarray, np.ndarray], list[pa.Array]], hashed: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``passed`` and those that ``use`` gives, of rows dealt by key and ordered by time and id.

    rows: key, ts, id, passed and others. A task reads its keys one after the other, and holds one of them and a
    batch. use gets the columns of what has a key and a time (micros, in place of ts), of each row the first of its key
    and the first of its event (same time and id); what lacks either gets its zeros. It sees 64-bit hashes of the columns ``hashed``, made after the shuffle.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed)
    rest = [c for c in rows.columns if c not in (key, "ts")]
    known = F.col(key).isNotNull() & F.col("ts").isNotNull()
    dealt = rows.repartition(F.col(key), F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1024)))).sortWithinPartitions(key, "ts", "id")
    dealt = dealt.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) if c in hashed else c for c in rest))
    names = [*passed, *(x.split()[0] for x in add.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches):
            table = table.combine_chunks()
            known = pc.and_(pc.is_valid(table.column(key)), pc.is_valid(table.column("ts")))
            for part, has in ((table.filter(known), True), (table.filter(pc.invert(known)), False)):
                part = part.combine_chunks()
                if not part.num_rows:
                    continue
                columns = {c: pa.concat_arrays(part.column(c).chunks) for c in part.column_names}
                fresh = differs(columns[key]) if has else np.ones(part.num_rows, bool)
                event = fresh | differs(columns["id"]) | differs(columns["ts"])
                made = use(columns, starts(fresh), starts(event))
                yield from pa.Table.from_arrays([*(columns[c] for c in passed), *made], names).to_batches(max_chunksize=1 << 16)

    return dealt.mapInArrow(run, f"{kinds}, {add}")


def _of_paths(columns: dict[str, pa.Array], first: np.ndarray, event: np.ndarray) -> list[pa.Array]:
    n = len(first)
    row = np.arange(n)
    ts = np.asarray(columns["ts"].fill_null(0))
    who = np.asarray(columns["author"].fill_null(0))
    order = np.lexsort((row, who, first))
    fresh = np.ones(n, bool)
    fresh[1:] = (who[order][1:] != who[order][:-1]) | (first[order][1:] != first[order][:-1])
    new = np.zeros(n, np.int64)
    new[order] = fresh
    new &= np.asarray(columns["author"].is_valid())
    ndev, lt = (earlier(x, first)[event] for x in (new, np.asarray(columns["delta"].fill_null(0))))
    since = (ts - ts[np.maximum(event - 1, 0)]) / 1e6
    return [pa.array((event - first).astype(np.int64)), pa.array(ndev), pa.array(lt, mask=np.asarray(columns["delta"].is_null())), pa.array(since, mask=event == first)]


def _of_authors(columns: dict[str, pa.Array], first: np.ndarray, event: np.ndarray) -> list[pa.Array]:
    n = len(first)
    ts = np.asarray(columns["ts"].fill_null(0))
    # of an author's different times the earlier ones, one step further back at a time
    new = np.ones(n, bool)
    new[1:] = (ts[1:] != ts[:-1]) | (first[1:] != first[:-1])
    at = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    times, count, begin = ts[at], np.diff(np.append(at, n)), which[first[at]]
    past, live, k = np.zeros(len(at)), np.arange(len(at)), 1
    while len(live := live[live - k >= begin[live]]):
        past[live] += count[live - k] / ((times[live] - times[live - k]) / 1e6 / YEAR + 1)
        k += 1
    rexp = past[which] + (event - starts(new))
    # an entry for each commit, subsystem and folder
    own, flat = np.asarray(pc.list_parent_indices(columns["dirs"])), pc.list_flatten(columns["dirs"])
    sub, files = (np.asarray(pc.struct_field(flat, k)) for k in (0, 1))
    order = np.lexsort((own, sub, first[own]))
    own, sub, files = own[order], sub[order], files[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (sub[1:] != sub[:-1]) | (first[own][1:] != first[own][:-1])
    one = fresh.copy()
    one[1:] |= event[own][1:] != event[own][:-1]
    seen = earlier(files, starts(fresh))[starts(one)] if len(own) else files
    each = fresh.copy()
    each[1:] |= own[1:] != own[:-1]
    sexp = np.zeros(n, np.int64)
    np.add.at(sexp, own[each], seen[each])
    return [pa.array((event - first).astype(np.int64)), pa.array(rexp), pa.array(sexp)]


def process_measures(commits: DataFrame, changes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Ns, nd, nf, entropy, la, ld, lt, fix, ndev, age, nuc, exp, rexp, sexp of each commit.

    commits: id, author, ts, subject; changes: id, path, added, deleted, one row a commit and file. History
    is what comes before by (ts, id). Subsystem and folder of a path are its
    part up to the first and last slash (without one "."). lt is the mean
    over files of their lines before (what was added less what was deleted),
    ndev and nuc are means over files of distinct authors and commits before,
    age the mean of days since a file's last commit over files that have
    one, exp the author's earlier commits, sexp their earlier changes of files in
    the commit's subsystems. A commit without files has zeros for all that concern files. What has no author, path or time has no history.

    Changes are dealt by id, by path and by id, commits by author and by id, once each; a path or author in a bucket
    of very many rows is dealt by month instead (``before``). paths: one column, from which those are
    counted (each path at least as often as in changes); else changes are read for it.
    """
    path = F.col("path")
    busy_path, busy_author = crowded(changes.select("path") if paths is None else paths.toDF("path"), PATH_ROWS), crowded(commits.select("author"), AUTHOR_ROWS)
    light = lambda busy, df: df if busy is None else df.where(~busy | F.col("ts").isNull())
    heavy = lambda busy, df: df.where(busy & F.col("ts").isNotNull())
    seconds = F.col("ts").cast("timestamp").cast("double")

    # of each file of a commit what came before
    # (a change without a path is none's: a filter here would be another shuffle than that of the sums below)
    lines = changes.select("id", "path", F.when(path.isNotNull(), F.coalesce("added", F.lit(0)) - F.coalesce("deleted", F.lit(0))).cast("long").alias("delta"))
    lines = lines.join(apart(commits.select("id", "author", "ts")), "id")
    files = in_order(light(busy_path, lines), "path", ["id"], "nuc long, ndev long, lt long, since double", _of_paths, ("author",))
    if busy_path is not None:
        old = heavy(busy_path, lines.where("path is not null"))
        first = old.where("author is not null").groupBy("path", "author").agg(F.min(F.struct("ts", "id")).alias("f")).select("path", "author", "f.ts", "f.id", F.lit(1).alias("_new"))
        old = before(old.join(apart(first), ["path", "author", "ts", "id"], "left"), ["path"], {"nuc": ("sum", F.lit(1)), "last": ("max", seconds), "lt": ("sum", F.col("delta")), "ndev": ("sum", F.coalesce("_new", F.lit(0)))})
        files = files.union(old.select("id", F.col("nuc").cast("long"), F.col("ndev").cast("long"), F.col("lt").cast("long"), seconds - F.col("last")))
    files = files.where("lt is not null").repartition("id").groupBy("id").agg(F.avg("lt").alias("lt"), F.avg("ndev").alias("ndev"), F.avg("nuc").alias("nuc"), F.avg(F.col("since") / DAY).alias("age"))

    # of each commit its files; its subsystems are hashed
    added, deleted, real = F.coalesce("added", F.lit(0)), F.coalesce("deleted", F.lit(0)), path.isNotNull()
    churn = added + deleted
    places = changes.groupBy(
        "id", F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(".").alias("subsystem"), F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/", 1)).otherwise(".").alias("folder")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(real).alias("nf"), F.sum(F.when(real, added)).alias("la"), F.sum(F.when(real, deleted)).alias("ld"),
        F.sum(churn).alias("t"), F.sum(F.when(churn > 0, churn * F.log2(churn.cast("double"))).otherwise(0.0)).alias("tl"),
    )
    sums = places.groupBy("id").agg(
        F.collect_list(F.struct(F.xxhash64("subsystem").alias("h"), "n", F.when(F.col("nf") > 0, F.xxhash64("folder")).alias("d"))).alias("dirs"), F.sum("nf").alias("nf"),
        F.sum("la").alias("la"), F.sum("ld").alias("ld"), F.sum("n").alias("_n"), F.sum("t").alias("_t"), F.sum("tl").alias("_tl"),
    )
    distinct = lambda get: F.size(F.array_distinct(F.transform(F.filter("dirs", lambda x: x["d"].isNotNull()), get)))
    sums = sums.withColumns({"ns": distinct(lambda x: x["h"]), "nd": distinct(lambda x: x["d"]), "dirs": F.transform("dirs", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n")))})
    entropy = F.when((F.col("_n") < 2) | (F.col("_t") == 0), 0.0).otherwise((F.log2(F.col("_t").cast("double")) - F.col("_tl") / F.col("_t")) / F.log2(F.col("_n").cast("double")))
    whole, parts = ["ns", "nd", "nf", "la", "ld"], ["id", "fix", "ns", "nd", "nf", "la", "ld", "entropy"]
    fix = F.lower(F.coalesce("subject", F.lit(""))).rlike("|".join(FIX_WORDS)).cast("int")
    rows = commits.select("id", "author", "ts", fix.alias("fix")).join(apart(sums), "id", "left")
    rows = rows.select("id", "author", "ts", "fix", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in whole), F.coalesce(entropy, F.lit(0.0)).alias("entropy"), "dirs")

    out = in_order(light(busy_author, rows), "author", parts, "exp long, rexp double, sexp long", _of_authors)
    if busy_author is not None:
        old = heavy(busy_author, rows)
        touched = old.select("id", "author", "ts", F.inline("dirs")).groupBy("id", "author", "h", "ts").agg(F.sum("n").alias("n"))
        sexp = before(touched, ["author", "h"], {"sexp": ("sum", F.col("n"))}).groupBy("id").agg(F.sum("sexp").alias("sexp"))
        exp = before(old.select("id", "author", "ts"), ["author"], {"exp": ("sum", F.lit(1))}).select("id", "exp")
        old = old.join(apart(sexp), "id", "left").join(apart(exp), "id", "left").join(apart(recent_experience(old)), "id", "left")
        out = out.union(old.select(*parts, F.coalesce("exp", F.lit(0)).cast("long"), F.coalesce("rexp", F.lit(0.0)), F.coalesce("sexp", F.lit(0)).cast("long")))
    out = out.join(apart(files), "id", "left")
    return out.select("id", "fix", *whole, "exp", "sexp", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("entropy", "lt", "ndev", "age", "nuc", "rexp")))
