"""Label votes, answer verification, blame joins and dataset constructors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority_vote(findings: DataFrame, samples: DataFrame) -> DataFrame:
    """A4: categories that more than half of a commit's samples give, with the first explanation.

    findings: commit, sample, pos, category, explanation; samples: commit, sample. Distinct samples are counted.
    """
    need = samples.groupBy("commit").agg((F.floor(F.count_distinct("sample") / 2) + 1).alias("need"))
    votes = findings.groupBy("commit", "category").agg(F.count_distinct("sample").alias("votes"), F.min(F.struct("sample", "pos", "explanation")).alias("f"))
    return votes.join(need, "commit").where("votes >= need").select("commit", "category", "votes", F.col("f.explanation").alias("explanation"))


def verify_reason(rows: DataFrame, hinted: bool = True, least: int = 30) -> DataFrame:
    """why an analysis is refused, or ok. rows: id, buggy, summary, explanations (null: none).

    Of a teacher that was not hinted, silence on a defect is its verdict and stays.
    """
    found = F.coalesce("explanations", F.array().cast("array<string>"))
    reason = (
        F.when(F.exists(found, lambda x: F.length(F.trim(x)) < least), "explanation too thin to learn from")
        .when(F.trim(F.coalesce("summary", F.lit(""))) == "", "no summary")
        .when(F.lit(hinted) & F.col("buggy") & (F.size(found) == 0), "SZZ says buggy, teacher found nothing")
        .when(~F.col("buggy") & (F.size(found) > 2), "SZZ says clean, teacher found several defects")
        .otherwise("ok")
    )
    return rows.select("id", reason.alias("reason"))


def szz_origins(removed: DataFrame, blame: DataFrame, least: int = 2, top: int = 3) -> DataFrame:
    """The commits that wrote a fix's removed lines, by number of lines.

    removed: fix, fix_ts, path, line; blame: fix, path, line, origin, origin_ts. Origins must be older than the
    fix and have at least ``least`` of its lines; the ``top`` heaviest stay.
    """
    w = Window.partitionBy("fix").orderBy(F.desc("n_lines"), "origin")
    joined = removed.join(blame, ["fix", "path", "line"]).where("origin_ts < fix_ts")
    out = joined.groupBy("fix", "origin").agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= least)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def szz_insertion_window(inserted: DataFrame, blame: DataFrame, reach: int = 3) -> DataFrame:
    """Origins of lines around a pure insertion: a range join by blocks of lines.

    inserted: fix, path, at; blame: fix, path, line, origin. Each insertion enters the blocks that its window touches.
    """
    block = 2 * reach + 1
    near = inserted.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col("at") - reach) / block), F.floor((F.col("at") + reach) / block)))))
    joined = near.join(blame.withColumn("block", F.floor(F.col("line") / block)), ["fix", "path", "block"]).where(F.abs(F.col("line") - F.col("at")) <= reach)
    return joined.groupBy("fix", "origin").agg(F.count(F.lit(1)).alias("n_lines"))


def smallest_fan(pairs: DataFrame) -> DataFrame:
    """For each inducing commit the fix with the fewest inducing ones. pairs: fix, inducing."""
    fans = pairs.groupBy("fix").agg(F.count_distinct("inducing").alias("fan"))
    return pairs.join(fans, "fix").groupBy("inducing").agg(F.min(F.struct("fan", "fix")).alias("m")).select("inducing", F.col("m.fix").alias("fix"), F.col("m.fan").alias("fan"))


def chat_records(df: DataFrame, system: str, user: str, answer: F.Column, id_col: str) -> DataFrame:
    """Three turns of each record, as rows (id, turn, role, content)."""
    turns = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", F.col(user)), ("assistant", answer))))
    return df.select(id_col, F.posexplode(turns).alias("turn", "m")).select(id_col, "turn", "m.role", "m.content")


def preference_pairs(df: DataFrame, id_col: str, positive: F.Column, predicted: F.Column, defect: str, clean: str) -> DataFrame:
    """For each wrong verdict the right answer as chosen and the given one as rejected; right ones give no pair."""
    rows = df.select(id_col, positive.alias("t"), predicted.alias("p")).where("t is not null and p is not null and t <> p")
    return rows.select(id_col, F.when(F.col("t"), defect).otherwise(clean).alias("chosen"), F.when(F.col("p"), defect).otherwise(clean).alias("rejected"), F.when(F.col("t"), "miss").otherwise("false alarm").alias("kind"))


def paired_ends(df: DataFrame, key: str, order: str, size: F.Column, low: int, high: int) -> DataFrame:
    """Both rows of a two-row pair, or none when either is outside low..high."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(size.between(low, high).cast("int")).alias("ok")).where("n = 2 and ok = 1").select(key)
    return df.join(g, key, "left_semi")


def upsample(df: DataFrame, summary: str, times: int) -> DataFrame:
    """max(1, times // k) copies of a row whose summary k rows share; copy counts from 0."""
    k = df.groupBy(summary).agg(F.count(F.lit(1)).alias("_k"))
    n = F.greatest(F.lit(1), F.floor(F.lit(times) / F.col("_k")).cast("int"))
    return df.join(k, summary).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1))).drop("_k")


def variants(df: DataFrame, text: str, renderings: dict[str, F.Column]) -> DataFrame:
    """A row for each rendering, with the first 12 hex digits of its SHA-1."""
    each = F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("rendered")) for n, c in renderings.items()))
    out = df.withColumn("_v", F.explode(each)).select(*df.columns, "_v.*")
    return out.withColumn("sha", F.substring(F.sha1("rendered"), 1, 12))
