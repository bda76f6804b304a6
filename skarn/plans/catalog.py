"""Registered queries over the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import answers, claims, coerce, diff, stats, text
from skarn.operators import audits, history, joins, labels, metrics, ranking, reuse
from skarn.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            EXPECTED_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: quality 0 is the defect, toxic stands for a predicted one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def buggy() -> Column:
    return F.col("quality") == 0


def flagged() -> Column:
    return F.col("toxic") == 1


def score() -> Column:
    return F.col("n_chars") / (F.col("n_chars") + 1000.0)


_LD = "labelled AS (SELECT d.doc_id, lang, source, n_chars, n_chars / (n_chars + 1000.0) AS score, quality, toxic, quality = 0 AS t, toxic = 1 AS p FROM documents d JOIN labels USING (doc_id))"
_PRF = """coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re"""


# --- metrics


@query(f"""
    WITH {_LD}, c AS (SELECT source, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM labelled GROUP BY source),
    r AS (SELECT *, {_PRF} FROM c)
    SELECT source, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1,
           round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM r
""")
def confusion_by_source(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir), buggy(), flagged(), ["source"])


@query(f"WITH {_LD} SELECT lang, count(*) AS n, count(*) FILTER (t) AS buggy, round(avg(t::INT), 6) AS share FROM labelled GROUP BY lang")
def label_balance(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(buggy()).alias("buggy"), F.round(F.avg(buggy().cast("double")), 6).alias("share"))


@query(f"WITH {_LD} SELECT lang, source, count(*) AS n, round(avg(t::INT), 6) AS share FROM labelled GROUP BY GROUPING SETS ((), (lang), (source))")
def split_summary_grouping_sets(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(buggy().cast("double")), 6).alias("share"))


@query(f"WITH {_LD} SELECT CASE WHEN score >= .75 THEN 'HIGH' WHEN score >= .5 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n FROM labelled GROUP BY band")
def gate_band(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy(coerce.risk_band(score(), 0.5).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN false WHEN 6 THEN o_orderstatus = 'F' ELSE o_orderkey % 8 IN (0, 1, 3, 7) END AS flag FROM orders
""")
def boolean_text_parse(spark, sf_dir):
    """Words for true and others by the order's key, and one that its status decides."""
    words = [F.lit(" Yes"), F.lit("TRUE"), F.lit("0"), F.lit("buggy "), F.lit(None).cast("string"), F.lit("yess"), F.regexp_replace("o_orderstatus", "F", "1"), F.lit("Defective")]
    said = F.element_at(F.array(*words), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.is_true(said).alias("flag"))


@query(f"WITH {_LD}, b AS (SELECT avg(t::INT) AS b FROM labelled) SELECT round(b, 6) AS base_rate, round(2 * b / (1 + b), 6) AS always_f1, round(b, 6) AS always_accuracy, round(1 - b, 6) AS never_accuracy FROM b")
def trivial_baselines(spark, sf_dir):
    return metrics.trivial_baselines(labelled(spark, sf_dir), buggy())


@query(f"WITH {_LD}, r AS (SELECT t, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM labelled), s AS (SELECT sum(k) FILTER (t) AS k, count(*) FILTER (t)::BIGINT AS np, count(*) FILTER (NOT t)::BIGINT AS nn FROM r) SELECT round((k - np * (np + 1) / 2) / (np * nn), 6) AS auc, np AS n_pos, nn AS n_neg FROM s")
def auc_rank(spark, sf_dir):
    return metrics.auc(labelled(spark, sf_dir).withColumn("score", score()), buggy(), "score")


@query(f"WITH {_LD}, s AS (SELECT score, count(*) FILTER (t) AS pos, count(*) AS n FROM labelled GROUP BY score), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS total FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos / total * tp / k), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return metrics.average_precision(labelled(spark, sf_dir).withColumn("score", score()), buggy(), "score")


@query(f"""
    WITH {_LD}, p AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM labelled WHERE t),
    thr AS (SELECT score AS s FROM p WHERE i = least(floor((1.0 - 0.95) * n), n - 1))
    SELECT round(any_value(s), 6) AS threshold, round(count(*) FILTER (t AND score >= s) / count(*) FILTER (t), 6) AS recall, round(count(*) FILTER (score < s) / count(*), 6) AS saved FROM labelled, thr
""")
def threshold_for_recall(spark, sf_dir):
    return metrics.threshold_for_recall(labelled(spark, sf_dir).withColumn("score", score()), buggy(), "score", 0.95)


@query(f"""
    WITH {_LD}, c AS (SELECT cut, count(*) FILTER (score >= cut) AS reviewed, count(*) FILTER (score >= cut AND t) AS tp, count(*) FILTER (t) AS p FROM labelled, (VALUES (.25::DOUBLE), (.5), (.75)) v(cut) GROUP BY cut)
    SELECT cut, reviewed, round(coalesce(tp / nullif(p, 0), 0), 6) AS recall, round(coalesce(tp / nullif(reviewed, 0), 0), 6) AS precision FROM c
""")
def operating_points(spark, sf_dir):
    return metrics.operating_points(labelled(spark, sf_dir).withColumn("score", score()), buggy(), "score", [0.25, 0.5, 0.75])


@query(f"WITH {_LD}, c AS (SELECT lang, count(*) FILTER (t AND p) / nullif(count(*) FILTER (t), 0) AS a, count(*) FILTER (NOT t AND p) / nullif(count(*) FILTER (NOT t), 0) AS b FROM labelled GROUP BY lang) SELECT lang, round(coalesce(a, 0), 6) AS tpr, round(coalesce(b, 0), 6) AS fpr, round(coalesce(a, 0) - coalesce(b, 0), 6) AS separation FROM c")
def separation_by_lang(spark, sf_dir):
    return metrics.separation(labelled(spark, sf_dir), buggy(), flagged(), ["lang"])


@query(f"""
    WITH {_LD}, c AS (SELECT lang, count(*) FILTER (t AND NOT p)::BIGINT AS only_a, count(*) FILTER (NOT t AND p)::BIGINT AS only_b FROM labelled GROUP BY lang),
    e AS (SELECT lang, only_a, only_b, only_a + only_b AS n, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM c)
    SELECT lang, only_a, only_b, round(CASE WHEN any_value(n) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END, 6) AS p FROM e GROUP BY lang, only_a, only_b
""")
def mcnemar_exact(spark, sf_dir):
    return metrics.mcnemar(labelled(spark, sf_dir), buggy(), flagged(), ["lang"])


_KAPPA = "round(po, 6) AS agreement, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa"


@query(f"WITH {_LD}, c AS (SELECT lang, count(*) AS n, avg((t = p)::INT) AS po, avg(t::INT) * avg(p::INT) + (1 - avg(t::INT)) * (1 - avg(p::INT)) AS pe FROM labelled GROUP BY lang) SELECT lang, n, {_KAPPA} FROM c")
def cohen_kappa(spark, sf_dir):
    return metrics.kappa(labelled(spark, sf_dir), buggy(), flagged(), ["lang"])


@query(f"""
    WITH {_LD}, g AS (SELECT CASE WHEN n_chars < 800 THEN 'a' WHEN n_chars < 3000 THEN 'b' ELSE 'c' END AS x, CASE WHEN quality = 0 THEN 'a' WHEN toxic = 1 THEN 'b' ELSE 'c' END AS y FROM labelled),
    t AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM g),
    e AS (SELECT sum(a.k * b.k) / any_value(t.n * t.n) AS pe FROM (SELECT x, count(*) AS k FROM g GROUP BY x) a JOIN (SELECT y, count(*) AS k FROM g GROUP BY y) b ON x = y, t)
    SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM t, e
""")
def kappa_3way(spark, sf_dir):
    x = F.when(F.col("n_chars") < 800, "a").when(F.col("n_chars") < 3000, "b").otherwise("c")
    y = F.when(F.col("quality") == 0, "a").when(F.col("toxic") == 1, "b").otherwise("c")
    return metrics.kappa(labelled(spark, sf_dir), x, y, [], at_chance=1.0)


@query(f"WITH {_LD}, c AS (SELECT CASE WHEN score >= .75 THEN 'HIGH' WHEN score >= .5 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n, count(*) AS graded, count(*) FILTER (t = p) AS correct FROM labelled GROUP BY band) SELECT *, round(correct / graded, 6) AS share FROM c")
def calibration_by_band(spark, sf_dir):
    return metrics.calibration(labelled(spark, sf_dir), coerce.risk_band(score(), 0.5), buggy() == flagged())


_CDF, _p, _at = [], 0.36787944117144233, 0.36787944117144233
for _k in range(1, 9):
    _CDF.append(f"(u >= {_at!r})::INT")
    _p /= _k
    _at += _p


# --- samples and splits


def _order(seed: int, key: str = "doc_id") -> str:
    return f"md5('{seed}:' || {key}), {key}"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order(7)}) AS r FROM documents) WHERE r <= 40")
def cap_per_language(spark, sf_dir):
    return ranking.cap_per_key(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 40, 7, "doc_id")


@query(f"""
    WITH had AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order(7)}) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT doc_id, r.lang FROM r LEFT JOIN had ON r.lang = had.lang WHERE r + coalesce(n, 0) <= 120
""")
def cap_with_carry_in(spark, sf_dir):
    return ranking.cap_with_carry_in(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "lang", 120, 7, "doc_id")


@query(f"""
    WITH {_LD}, r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY {_order(3)}) AS r FROM labelled), k AS (SELECT least(30, count(*)) AS k FROM r WHERE t)
    SELECT doc_id, t AS buggy FROM r, k WHERE r <= CASE WHEN t THEN k ELSE 60 - k END
""")
def balanced_sample(spark, sf_dir):
    return ranking.balanced_sample(labelled(spark, sf_dir).select("doc_id", buggy().alias("buggy")), F.col("buggy"), 60, 3, "doc_id")


@query(f"""
    WITH b AS (SELECT doc_id, CASE WHEN n_chars <= 5 THEN 0 WHEN n_chars <= 15 THEN 1 WHEN n_chars <= 40 THEN 2 WHEN n_chars <= 100 THEN 3 WHEN n_chars <= 250 THEN 4 WHEN n_chars <= 500 THEN 5 ELSE 6 END AS bin FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_order(5)}) AS slot FROM b)
    SELECT doc_id, bin, slot FROM r ORDER BY slot, bin LIMIT 50
""")
def round_robin_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", coerce.churn_bin(F.col("n_chars")).alias("bin"))
    return ranking.round_robin(rows, "bin", 50, 5, "doc_id")


@query(f"WITH {_LD}, r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_order(9)}) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labelled) SELECT doc_id, quality, r <= round_even(n * 0.2::DOUBLE, 0) AS held_out FROM r")
def stratified_holdout(spark, sf_dir):
    return ranking.stratified_holdout(labelled(spark, sf_dir).select("doc_id", "quality"), "quality", 0.2, 9, "doc_id")


@query("WITH g AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('2:' || source), source LIMIT 4) SELECT doc_id, source, source IN (SELECT source FROM g) AS held_out FROM documents")
def project_holdout(spark, sf_dir):
    return ranking.group_holdout(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 4, 2)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= floor((SELECT count(*) FROM events) * 0.8::DOUBLE) AS train FROM events")
def chronological_split(spark, sf_dir):
    return ranking.chronological_split(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 0.8).drop("ts")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order(4)}) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END")
def quota_mix(spark, sf_dir):
    return ranking.quota_mix(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 60, "de": 20, "fr": 10}, 4, "doc_id")


# --- audits


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "lang"), "doc_id").alias("r")).select("r.*")


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, max(n) AS most_repeated FROM g")
def distinct_targets(spark, sf_dir):
    return audits.distinct_targets(table(spark, sf_dir, "documents"), "text")


@query("SELECT part, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS part FROM documents) WHERE len(regexp_split_to_array(trim(part), '\\s+')) >= 8 GROUP BY part ORDER BY n DESC, part LIMIT 20")
def repeated_sentences(spark, sf_dir):
    return audits.repeated_parts(table(spark, sf_dir, "documents"), F.split("text", "\n"), 8, 20)


_FRAME = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\b[0-9]+\\b', 'N', 'g'), '\\b[a-z_][a-z0-9_]*\\b', 'ID', 'g'), '\\s+', ' ', 'g'))"
_LINE = "'Order ' || o_orderkey || ' of cust_' || o_custkey % 9 || ': ' || lower(o_orderpriority) || CASE WHEN o_orderkey % 4 = 0 THEN ' x1  y' ELSE ' Total' END"


@query(f"SELECT status, count(DISTINCT f) AS n_frames, count(*) AS n_rows, round(count(DISTINCT f) / count(*), 6) AS ratio FROM (SELECT o_orderstatus AS status, {_FRAME.format(f'({_LINE})')} AS f FROM orders) GROUP BY status")
def frame_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.expr(_LINE).alias("line"))
    return audits.frame_ratio(rows, "line", ["status"])


@query(f"WITH {_LD} SELECT source, count(*) AS n_rows, count(DISTINCT quality) AS n_labels, round(avg(quality), 6) AS positive_share, count(DISTINCT quality) = 1 AS single FROM labelled GROUP BY source")
def single_label_families(spark, sf_dir):
    return audits.single_label_families(labelled(spark, sf_dir), "source", "quality")


_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+')"


def _grams(source: str, key: str, n: int, column: str = "text") -> str:
    return f"(SELECT {key}, i - 1 AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {_TOKENS.format(column)} AS w FROM {source})))"


@query(f"SELECT gram AS phrase, count(DISTINCT doc_id) AS n_texts FROM {_grams('documents', 'doc_id', 4)} GROUP BY gram ORDER BY n_texts DESC, phrase LIMIT 15")
def top_phrase(spark, sf_dir):
    return audits.top_phrase(table(spark, sf_dir, "documents"), "text", 4, 15)


@query("SELECT count(*) AS n_shared, count(*) = 0 AS disjoint FROM (SELECT DISTINCT text FROM documents) JOIN (SELECT DISTINCT text FROM benchmark) USING (text)")
def split_disjointness(spark, sf_dir):
    return ranking.disjoint(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["text"])


@query("SELECT lower(e.event_type) AS name, count(*) AS n FROM events e GROUP BY 1")
def case_insensitive_dup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH k AS (SELECT DISTINCT gram FROM {_grams('benchmark', 'item_id', 6)}),
    c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(range(pos, pos + 6)) AS p FROM {_grams('documents', 'doc_id', 6)} WHERE gram IN (SELECT gram FROM k)) GROUP BY doc_id),
    n AS (SELECT doc_id, len({_TOKENS.format('text')})::INT AS n_words FROM documents)
    SELECT doc_id, n_words, coalesce(covered, 0) AS covered, round(coalesce(covered / nullif(n_words, 0), 0), 6) AS coverage FROM n LEFT JOIN c USING (doc_id)
""")
def ngram_coverage_vs_benchmark(spark, sf_dir):
    return reuse.against(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 6, runs=False)


@query(f"""
    WITH g AS (SELECT DISTINCT source, gram FROM {_grams('documents', 'source', 6)}), s AS (SELECT gram, count(*) AS k FROM g GROUP BY gram)
    SELECT source, count(*) AS n_grams, count(*) FILTER (k > 1) AS n_shared FROM g JOIN s USING (gram) GROUP BY source
""")
def self_similarity_leave_group_out(spark, sf_dir):
    return audits.cross_group_reuse(table(spark, sf_dir, "documents"), "source", "text", 6)


@query(f"""
    WITH h AS (SELECT a.doc_id, b.item_id, a.pos AS i, a.pos - b.pos AS d FROM {_grams('documents', 'doc_id', 6)} a JOIN {_grams('benchmark', 'item_id', 6)} b ON a.gram = b.gram),
    s AS (SELECT doc_id, item_id, d, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS isle FROM h),
    r AS (SELECT doc_id, count(*) + 5 AS run FROM s GROUP BY doc_id, item_id, d, isle)
    SELECT doc_id, max(run) AS longest_run FROM r GROUP BY doc_id
""")
def longest_verbatim_run(spark, sf_dir):
    found = reuse.against(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 6)
    return found.where("longest > 0").select("doc_id", F.col("longest").alias("longest_run"))


# --- text functions

_STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP)
_CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[A-Za-z_][A-Za-z0-9_]{{{{2,}}}}')), lambda w: w NOT IN ({_STOP_SQL}))"


@query(f"SELECT doc_id, len({_CONTENT.format('text')})::INT AS n FROM documents".replace("{{", "{").replace("}}", "}"))
def content_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.content_words(F.col("text"))).alias("n"))


@query("""
    WITH t AS (SELECT page_id, regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_.]{2,}') AS w FROM pages)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: regexp_matches(x, '_|\\.|[a-z][A-Z]')), lambda x: trim(lower(x), '.')))), ' ') AS names FROM t
""")
def decorated_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.decorated(F.col("url"))), " ").alias("names"))


@query(f"""
    WITH t AS (SELECT page_id, regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_.]{{2,}}') AS w FROM pages),
    u AS (SELECT page_id, list_transform(list_filter(w, lambda x: regexp_matches(x, '_|\\.|[a-z][A-Z]')), lambda x: trim(lower(x), '.')) AS a,
                 list_filter(list_transform(list_filter(w, lambda x: NOT regexp_matches(x, '_|\\.|[a-z][A-Z]')), lambda x: lower(x)), lambda x: x NOT IN ({_STOP_SQL})) AS b FROM t)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS names FROM u
""")
def identifiers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.identifiers(F.col("url"))), " ").alias("names"))


_TURNS = "SELECT u.conv_id, u.turn, u.text AS a, v.text AS b FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1"


def _turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.withColumnRenamed("text", "a").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


@query(f"WITH p AS ({_TURNS}), w AS (SELECT conv_id, turn, {_CONTENT.format('a')} AS x, {_CONTENT.format('b')} AS y FROM p) SELECT conv_id, turn, round(coalesce(2 * len(list_intersect(x, y)) / nullif(len(x) + len(y), 0), 0), 6) AS f1 FROM w".replace("{{", "{").replace("}}", "}"))
def word_overlap_f1(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(text.overlap_f1(F.col("a"), F.col("b")), 6).alias("f1"))


_NAMED = "{0} || ' self.turn_' || turn % {1} || ' getNext' || chr(65 + (conv_id % {1})::INT) || ' plain return'"


def _names(column: str) -> str:
    """Names of a text as T3 has them, in SQL."""
    own = f"regexp_extract_all({column}, '[A-Za-z_][A-Za-z0-9_.]{{2,}}')"
    shaped = "regexp_matches(z, '_|\\.|[a-z][A-Z]')"
    return f"list_distinct(list_concat(list_transform(list_filter({own}, lambda z: {shaped}), lambda z: trim(lower(z), '.')), list_filter(list_transform(list_filter({own}, lambda z: NOT {shaped}), lambda z: lower(z)), lambda z: z NOT IN ({_STOP_SQL}))))"


@query(f"""
    WITH p AS ({_TURNS}), t AS (SELECT conv_id, turn, {_NAMED.format('a', 2)} AS a, {_NAMED.format('b', 3)} AS b FROM p), w AS (SELECT conv_id, turn, {_names('a')} AS x, {_names('b')} AS y FROM t), n AS (SELECT *, len(list_intersect(x, y)) AS k FROM w)
    SELECT conv_id, turn, round(coalesce(k / nullif(len(x) + len(y) - k, 0), 0), 6) AS jaccard FROM n
""")
def identifier_jaccard(spark, sf_dir):
    """Turns and the ones that follow, with names as code has them."""
    named = lambda c, n: text.identifiers(F.concat(F.col(c), F.lit(" self.turn_"), F.col("turn") % n, F.lit(" getNext"), F.char(65 + F.col("conv_id") % n), F.lit(" plain return")))
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(text.jaccard(named("a", 2), named("b", 3)), 6).alias("jaccard"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])\\s', 1), ''), text) AS sentence FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


_DASHED = "concat(p_brand, '—_', p_type, '‑ ', upper(p_name), ' -')"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(lower({_DASHED}), '[-_‐-―−]+', ' ', 'g'), '\\s+', ' ', 'g') AS flat FROM part")
def flatten_dashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.flatten_dashes(F.expr(_DASHED)).alias("flat"))


# explanations made up from order lines
_EXPLAINED = "CASE l_linenumber % 5 WHEN 0 THEN concat('Missing null check on part ', l_partkey) WHEN 1 THEN 'input is never sanitized' WHEN 2 THEN concat('price ', l_extendedprice, ' changed') WHEN 3 THEN 'Division by Zero when empty' ELSE 'wrong name' END"


@query(f"""
    SELECT flag AS corpus, category, count(*) AS n, count(*) FILTER (g) AS guards, round(avg(g::INT), 6) AS share
    FROM (SELECT l_returnflag AS flag, CASE l_linenumber % 3 WHEN 0 THEN 'input-validation' WHEN 1 THEN 'logic' ELSE 'naming' END AS category, l_linenumber % 5 IN (0, 1, 3) OR l_linenumber % 3 = 0 AS g FROM lineitem) GROUP BY 1, 2
""")
def guard_share(spark, sf_dir):
    category = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'input-validation' WHEN 1 THEN 'logic' ELSE 'naming' END")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("corpus"), category.alias("category"), F.expr(_EXPLAINED).alias("explanation"))
    return audits.guard_share(rows, "category", "explanation", ["corpus"])


@query("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'done in <dur>' WHEN 1 THEN 'ok ' || event_type || chr(10) || 'next' WHEN 2 THEN 'at <repo>/x.js:3' WHEN 3 THEN 'started <time> and <time>'
        WHEN 4 THEN 'verified <ago>, took <dur> or <dur>, width 5m, total ' || event_id ELSE 'value = ' || event_id || chr(10) || '2' END AS clean FROM events
""")
def scrub_output(spark, sf_dir):
    """Outputs made of events, each with what its kind of run leaves behind."""
    forms = [
        r"concat('10%\r50%\rdone in ', event_id, ' seconds')", r"concat('\u001b[32mok ', event_type, '\u001b[0m\r\nnext  ')", "concat('at /tmp/wt-', user_id, '/x.js:3')",
        "concat('started ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '.25Z and 11:02:33')", "concat('verified ', event_id, 's ago, took 1,5s or 12 Minutes, width 5m, total ', event_id)", r"concat('value = ', event_id, ' \r\n2')",
    ]
    output = F.element_at(F.array(*map(F.expr, forms)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.scrub(output, F.concat(F.lit("/tmp/wt-"), "user_id")).alias("clean"))


# --- history


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS experience FROM events")
def author_experience(spark, sf_dir):
    return history.prior_count(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", "experience").select("event_id", "experience")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS experience FROM events")
def subsystem_experience(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return history.prior_count(rows, ["user_id", "event_type"], "ts", "event_id", "experience").select("event_id", "experience")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 / 86400, 6) AS days FROM events")
def days_since_last_touch(spark, sf_dir):
    return history.days_since_last(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", "days").select("event_id", "days")


@query("""
    WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT a.user_id, a.day, sum(b.n / ((a.day - b.day) / 365.25 + 1)) AS v FROM d a JOIN d b ON a.user_id = b.user_id AND b.day < a.day GROUP BY 1, 2)
    SELECT event_id, round(coalesce(v, 0), 6) AS recent FROM events LEFT JOIN s ON s.user_id = events.user_id AND s.day = ts::DATE
""")
def recent_experience_weighted(spark, sf_dir):
    return history.recent_experience(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", "recent").select("event_id", "recent")


@query("""
    WITH f AS (SELECT event_type, user_id, min(struct_pack(ts := ts, id := event_id)) AS m FROM events GROUP BY ALL)
    SELECT e.event_id, coalesce(sum((f.m IS NOT NULL)::INT) OVER (PARTITION BY e.event_type ORDER BY e.ts, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_users
    FROM events e LEFT JOIN f ON f.event_type = e.event_type AND f.user_id = e.user_id AND f.m.id = e.event_id
""")
def distinct_devs_before(spark, sf_dir):
    return history.first_touches_before(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "event_type", "user_id", "ts", "event_id", "n_users").select("event_id", "n_users")


@query("""
    WITH p AS (SELECT user_id, event_type, sum(CASE WHEN length(event_type) % 2 = 0 THEN value ELSE 0 END) AS w FROM events GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM p)
    SELECT user_id, round(CASE WHEN any_value(n) < 2 OR any_value(t) = 0 THEN 0 ELSE -sum(CASE WHEN w > 0 THEN w / t * log2(w / t) ELSE 0 END) / log2(any_value(n)) END, 6) AS entropy FROM t GROUP BY user_id
""")
def churn_entropy(spark, sf_dir):
    weight = F.when(F.length("event_type") % 2 == 0, F.col("value")).otherwise(0.0)
    return history.entropy(table(spark, sf_dir, "events").withColumn("w", weight), ["user_id"], "event_type", "w")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_run_per_id(spark, sf_dir):
    return history.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


# --- constructors


@query(f"""
    WITH {_LD}, m AS (SELECT doc_id, [{{'role': 'system', 'content': 'Judge the change.'}}, {{'role': 'user', 'content': source}}, {{'role': 'assistant', 'content': CASE WHEN t THEN 'defect' ELSE 'clean' END}}] AS m FROM labelled)
    SELECT doc_id, i AS turn, m[i + 1].role AS role, m[i + 1].content AS content FROM m, range(0, 3) r(i)
""")
def chat_records(spark, sf_dir):
    return labels.chat_records(labelled(spark, sf_dir), "Judge the change.", "source", F.when(buggy(), "defect").otherwise("clean"), "doc_id")


@query(f"WITH {_LD} SELECT doc_id, CASE WHEN t THEN 'defect' ELSE 'clean' END AS chosen, CASE WHEN p THEN 'defect' ELSE 'clean' END AS rejected, CASE WHEN t THEN 'miss' ELSE 'false alarm' END AS kind FROM labelled WHERE t <> p")
def onpolicy_pairs(spark, sf_dir):
    return labels.preference_pairs(labelled(spark, sf_dir), "doc_id", buggy(), flagged(), "defect", "clean")


@query("SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND min(l_quantity) >= 5 AND max(l_quantity) <= 45)")
def reverse_pairs(spark, sf_dir):
    rows = labels.paired_ends(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber", F.col("l_quantity"), 5, 45)
    return table(spark, sf_dir, "orders").select("o_orderkey").join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("WITH k AS (SELECT n_chars, count(*) AS k FROM documents GROUP BY n_chars) SELECT doc_id, unnest(range(0, greatest(1, 4 // k)))::INT AS copy FROM documents JOIN k USING (n_chars)")
def upsample_shared_summary(spark, sf_dir):
    return labels.upsample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 4).select("doc_id", "copy")


@query("""
    WITH v AS (SELECT item_id, 'base' AS variant, text AS r FROM benchmark UNION ALL SELECT item_id, 'lower', lower(text) FROM benchmark UNION ALL SELECT item_id, 'flat', replace(text, chr(10), ' ') FROM benchmark)
    SELECT item_id, variant, substr(sha1(r), 1, 12) AS sha FROM v
""")
def variant_expansion(spark, sf_dir):
    t = F.col("text")
    return labels.variants(table(spark, sf_dir, "benchmark"), "text", {"base": t, "lower": F.lower(t), "flat": F.replace(t, F.lit("\n"), F.lit(" "))}).select("item_id", "variant", "sha")


# --- votes, blame and claims, on literal rows


def _values(rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


_FINDINGS = [("c1", 0, 0, "logic", "a"), ("c1", 1, 0, "logic", "b"), ("c1", 2, 0, "race", "c"), ("c1", 2, 1, "race", "d"), ("c2", 0, 0, "leak", "e"), ("c2", 1, 0, "leak", "f"), ("c2", 2, 0, "leak", "g"), ("c3", 0, 0, "race", "h")]
_SAMPLES = [(c, s) for c in ("c1", "c2", "c3") for s in range(3)]


@query(f"""
    WITH f AS (SELECT * FROM {_values(_FINDINGS)} f(c, s, pos, category, explanation)), n AS (SELECT c, count(DISTINCT s) // 2 + 1 AS need FROM {_values(_SAMPLES)} x(c, s) GROUP BY c)
    SELECT f.c AS commit, category, count(DISTINCT s) AS votes, arg_min(explanation, s * 100 + pos) AS explanation FROM f JOIN n ON f.c = n.c GROUP BY f.c, category HAVING count(DISTINCT s) >= any_value(need)
""")
def majority_vote(spark, sf_dir):
    return labels.majority_vote(spark.createDataFrame(_FINDINGS, "commit string, sample int, pos int, category string, explanation string"), spark.createDataFrame(_SAMPLES, "commit string, sample int"))


_CATEGORIES = [(1, " NPE "), (2, "off by one"), (3, "Logic-Error"), (4, "what"), (5, None), (6, "race"), (7, "security")]


@query("SELECT * FROM (VALUES (1, 'null-dereference'), (2, 'off-by-one'), (3, 'logic-error'), (4, 'other'), (5, NULL), (6, 'concurrency'), (7, 'security')) v(id, category)")
def coerce_category(spark, sf_dir):
    return spark.createDataFrame(_CATEGORIES, "id int, raw string").select("id", coerce.category(F.col("raw")).alias("category"))


@query("SELECT * FROM (VALUES (1, 'post-breaks'), (2, 'post-fixes'), (3, 'unchanged'), (4, 'unclear'), (5, NULL)) v(id, direction)")
def coerce_direction(spark, sf_dir):
    rows = [(1, "Regression"), (2, "post-fixes"), (3, " no change "), (4, "sideways"), (5, None)]
    return spark.createDataFrame(rows, "id int, raw string").select("id", coerce.direction(F.col("raw")).alias("direction"))


@query("SELECT * FROM (VALUES (1, 'likely'), (2, 'possible'), (3, 'possible'), (4, NULL)) v(id, confidence)")
def coerce_confidence(spark, sf_dir):
    rows = [(1, "High"), (2, "weak"), (3, "hm"), (4, None)]
    return spark.createDataFrame(rows, "id int, raw string").select("id", coerce.confidence(F.col("raw")).alias("confidence"))


@query("""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 1 AS buggy, l_orderkey % 4 AS n, l_suppkey % 5 = 0 AS thin, l_partkey % 7 = 0 AS blank FROM lineitem)
    SELECT concat(l_orderkey, '-', l_linenumber) AS id, CASE WHEN n > 0 AND thin THEN 'explanation too thin to learn from' WHEN blank THEN 'no summary' WHEN buggy AND n = 0 THEN 'SZZ says buggy, teacher found nothing'
           WHEN NOT buggy AND n > 2 THEN 'SZZ says clean, teacher found several defects' ELSE 'ok' END AS reason FROM a
""")
def verify_reason(spark, sf_dir):
    explanation = F.when(F.col("l_suppkey") % 5 == 0, F.rpad(F.lit("too thin"), 40, " ")).otherwise("an explanation of more than thirty characters")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_linenumber") % 2 == 1).alias("buggy"), F.when(F.col("l_partkey") % 7 == 0, " ").otherwise("s").alias("summary"),
        F.array_repeat(explanation, (F.col("l_orderkey") % 4).cast("int")).alias("explanations"),
    )
    return labels.verify_reason(rows)


_REMOVED = [("f1", 100, "a.py", n) for n in range(1, 7)] + [("f2", 50, "b.py", 1)]
_BLAME = [("f1", "a.py", n, "o1" if n < 4 else "o2" if n < 6 else "o3", 10 if n < 4 else 20) for n in range(1, 7)] + [("f2", "b.py", 1, "o9", 60)]


@query(f"""
    WITH j AS (SELECT r.fix, origin, count(*) AS n_lines FROM {_values(_REMOVED)} r(fix, fix_ts, path, line) JOIN {_values(_BLAME)} b(fix, path, line, origin, origin_ts) ON r.fix = b.fix AND r.path = b.path AND r.line = b.line
               WHERE origin_ts < fix_ts GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY fix ORDER BY n_lines DESC, origin)::INT AS rank FROM j) SELECT * FROM k WHERE rank <= 3
""")
def szz_origins(spark, sf_dir):
    return labels.szz_origins(spark.createDataFrame(_REMOVED, "fix string, fix_ts long, path string, line long"), spark.createDataFrame(_BLAME, "fix string, path string, line long, origin string, origin_ts long"))


@query(f"SELECT i.fix, origin, count(*) AS n_lines FROM {_values([('f1', 'a.py', 4), ('f1', 'a.py', 6)])} i(fix, path, spot) JOIN {_values(_BLAME)} b(fix, path, line, origin, ts) ON i.fix = b.fix AND i.path = b.path AND abs(line - spot) <= 3 GROUP BY ALL")
def szz_insertion_window(spark, sf_dir):
    blame = spark.createDataFrame(_BLAME, "fix string, path string, line long, origin string, origin_ts long")
    return labels.szz_insertion_window(spark.createDataFrame([("f1", "a.py", 4), ("f1", "a.py", 6)], "fix string, path string, at long"), blame)


@query("WITH f AS (SELECT l_orderkey AS fix, count(DISTINCT l_partkey) AS fan FROM lineitem GROUP BY 1) SELECT l_partkey AS inducing, arg_min(f.fix, struct_pack(a := fan, b := f.fix)) AS fix, min(fan) AS fan FROM lineitem JOIN f ON f.fix = l_orderkey GROUP BY 1")
def bic_smallest_fan(spark, sf_dir):
    return labels.smallest_fan(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fix"), F.col("l_partkey").alias("inducing")))


# claims made up from order lines: the measured values are those of quantity and line number
_MEASURED = "SELECT concat(l_orderkey, '-', l_linenumber) AS id, CAST(CAST(l_quantity AS INT) AS {t}) AS b, CAST(l_linenumber AS {t}) AS a, l_orderkey % 4 AS k, l_partkey % 4 AS m FROM {src}"


@query(f"""
    WITH v AS ({_MEASURED.format(t='VARCHAR', src='lineitem')}),
    c AS (SELECT *, CASE k WHEN 1 THEN a WHEN 2 THEN a ELSE b END AS cb, CASE k WHEN 1 THEN b ELSE a END AS ca, CASE WHEN m IN (0, 3) THEN b ELSE a END AS x, CASE WHEN m IN (0, 3) THEN a ELSE b END AS y FROM v)
    SELECT id, CASE WHEN k < 3 AND cb = ca THEN 'says the runs differ but gives equal values' WHEN k = 3 AND cb <> ca THEN 'says the runs agree but gives unequal values' END AS contradiction,
           a <> b AND k IN (1, 2) AS swapped, a <> b AND m < 3 AND contains(a, x) AND NOT contains(b, x) AND contains(b, y) AND NOT contains(a, y) AS reversed FROM c
""")
def claim_checks(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_claim_lines")
    v, c = spark.sql(_MEASURED.format(t="STRING", src="_claim_lines")), F.col
    rows = v.withColumn("cb", F.expr("CASE k WHEN 1 THEN concat(' ', a) WHEN 2 THEN a ELSE b END")).withColumn("ca", F.expr("CASE k WHEN 1 THEN b ELSE a END"))
    said = F.expr("CASE m WHEN 0 THEN concat('It went from `', b, '` to ', a, '.') WHEN 1 THEN concat('The value was ', a, ' and is now ', b, ', ok') WHEN 2 THEN concat('changed from ', a, ' into ', b) ELSE concat(b, ' became ', a) END")
    return rows.select("id", claims.contradiction(c("k") < 3, c("cb"), c("ca")).alias("contradiction"), claims.swapped(c("cb"), c("ca"), c("b"), c("a")).alias("swapped"), claims.direction_reversed(said, c("b"), c("a")).alias("reversed"))


# diffs made up from order lines: an indented line, a comment, a label with a blank less, another value
_EDITED = (
    "concat('--- a/f', l_linenumber, '.', CASE WHEN l_orderkey % 3 = 0 THEN 'txt' ELSE 'py' END, chr(10), '+++ b/f', l_linenumber, '.', CASE WHEN l_orderkey % 3 = 0 THEN 'txt' ELSE 'py' END, chr(10), '@@ -1 +1 @@', chr(10), "
    "CASE l_partkey % 4 WHEN 0 THEN concat('-x  = ', l_suppkey, chr(10), '+    x = ', l_suppkey) WHEN 1 THEN concat('-  # old', chr(10), '+# new ', l_suppkey) "
    "WHEN 2 THEN concat('->Jatim<', chr(10), '+>Ja tim<') ELSE concat('-x = 1', chr(10), '+x = ', l_suppkey, chr(10), '+') END)"
)


@query("SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_partkey % 4 = 0 OR l_partkey % 4 = 1 AND l_orderkey % 3 <> 0 OR l_partkey % 4 = 3 AND l_suppkey = 1 AS cosmetic FROM lineitem")
def cosmetic_diffs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), diff.cosmetic_only(F.expr(_EDITED)).alias("cosmetic"))


_MARKED = "concat('+++ b/x.py', chr(10), CASE p_size % 4 WHEN 0 THEN concat('a {+', p_name, '+}') WHEN 1 THEN concat('-', p_name, chr(10), 'a [-b-]') WHEN 2 THEN concat('+', p_name) ELSE 'a [-b-] c' END)"


@query("SELECT p_partkey, p_size % 4 IN (0, 3) AS marked FROM part")
def word_diff_detected(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", diff.already_word_diff(F.expr(_MARKED)).alias("marked"))


_SUBJECT = "CASE o_orderkey % 7 WHEN 0 THEN concat('Fixes #', o_custkey) WHEN 1 THEN 'fix typo in the long readme text' WHEN 2 THEN 'Fixed' WHEN 3 THEN concat('hotfix for overflow in order ', o_orderkey) WHEN 4 THEN 'resolve JIRA-12' WHEN 5 THEN 'prefix the names of all order fields' ELSE 'corrected  formats, then patched the reader' END"


@query(f"""
    SELECT o_orderkey, len(list_filter(regexp_extract_all(s, '(?i)\\b(fix(e[sd])?|bugfix|hotfix|patch(ed)?|resolve[sd]?|correct(ed)?)\\b(\\s+(typo|lint|format|style|doc|readme|comment|test))?'),
           lambda x: NOT regexp_matches(x, '(?i)\\s(typo|lint|format|style|doc|readme|comment|test)$'))) > 0 AND (regexp_matches(s, '#\\d+|[A-Z]+-\\d+') OR length(s) > 20) AS is_fix FROM (SELECT o_orderkey, {_SUBJECT} AS s FROM orders)
""")
def fix_subjects(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.is_fix_subject(F.expr(_SUBJECT)).alias("is_fix"))


@query("""
    SELECT l_orderkey, count(*) AS n, round_even(least(0.45 + least(count(*), 20) / 20 * 0.2 + 0.15 / sqrt(count(DISTINCT l_suppkey) + 4) + CASE WHEN bool_or(l_returnflag = 'R') THEN 0.1 ELSE 0 END, 0.92), 2) AS buggy,
           round_even(least(0.5 + sqrt(least(max(l_partkey), 2000) / 2000) * 0.28, 0.78), 2) AS clean FROM lineitem GROUP BY 1
""")
def label_confidences(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("l_suppkey") + 4).alias("fan"), F.bool_or(F.col("l_returnflag") == "R").alias("issue"), F.max("l_partkey").alias("later"))
    return g.select("l_orderkey", "n", coerce.label_confidence(F.col("n"), F.col("fan"), F.col("issue")).alias("buggy"), coerce.clean_confidence(F.col("later")).alias("clean"))


@query()
def variant_indices(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.variant_index(F.col("o_orderkey"), F.col("o_custkey"), 7, "check").alias("variant"))


_DURATION = "CASE l_linenumber % 4 WHEN 0 THEN concat(l_suppkey, 'm', l_partkey, '.5s') WHEN 1 THEN concat(' ', l_partkey) WHEN 2 THEN concat(l_suppkey, 'h') ELSE concat(l_partkey, '.25s') END"


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_suppkey * 60 + l_partkey + 0.5::DOUBLE WHEN 1 THEN l_partkey::DOUBLE WHEN 2 THEN NULL ELSE l_partkey + 0.25::DOUBLE END AS seconds FROM lineitem")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", coerce.duration_seconds(F.expr(_DURATION)).alias("seconds"))


@query("SELECT doc_id, trim(regexp_extract(text, '(?s)^(.*[.!?])', 1), ' ') AS whole FROM documents")
def terminated_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.terminated(F.col("text")).alias("whole"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN user_id::VARCHAR ELSE '' END AS id FROM events")
def first_ids(spark, sf_dir):
    k = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", coerce.first_id(F.when(k == 0, F.col("event_type")).when(k == 1, ""), F.when(k < 2, F.col("user_id").cast("string"))).alias("id"))


@query("""
    WITH m AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_partkey % 5 AS b, l_suppkey % 11 AS c, l_orderkey % 13 AS d FROM lineitem), n AS (SELECT *, c - a AS x, d - b AS y, greatest(abs(a - b), 2) AS w FROM m)
    SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN a::VARCHAR ELSE concat(least(a, b), '-', greatest(a, b)) END AS band,
           CASE WHEN x = 0 AND y = 0 THEN 'no - unchanged' WHEN NOT (x > 0 AND y > 0 OR x < 0 AND y < 0) THEN 'no - seeds disagree'
                WHEN least(abs(x), abs(y)) <= w THEN concat('no - inside seed band (+-', w, ')') ELSE concat('YES (', CASE WHEN x > 0 THEN '+' ELSE '' END, x, '/', CASE WHEN y > 0 THEN '+' ELSE '' END, y, ')') END AS readable FROM n
""")
def seed_readability(spark, sf_dir):
    a, b, c, d = F.col("l_linenumber").cast("long"), F.col("l_partkey") % 5, F.col("l_suppkey") % 11, F.col("l_orderkey") % 13
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.seed_band(a, b).alias("band"), stats.readable_move(a, b, c, d).alias("readable"))


@query("SELECT lang, count(*) AS n, round(avg(v), 6) AS mean, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS median, round(avg((v > 0)::INT), 6) AS nonzero FROM (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars / (n_chars + 1000.0) END AS v FROM documents) GROUP BY lang")
def overlap_by_lang(spark, sf_dir):
    return metrics.overlap_report(table(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(score()), ["lang"])


@query("""
    WITH s AS (SELECT l_returnflag, l_orderkey, bool_or(l_discount > 0.05) FILTER (l_linenumber % 2 = 1) AS p, bool_or(l_discount > 0.05) FILTER (l_linenumber % 2 = 0) AS q FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, count(*) AS pairs, count(*) FILTER (p AND q) AS both, count(*) FILTER (NOT p AND NOT q) AS neither, count(*) FILTER (p AND NOT q) AS correct, count(*) FILTER (q AND NOT p) AS backwards FROM s WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY 1
""")
def pair_outcomes(spark, sf_dir):
    return metrics.pair_outcomes(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linenumber") % 2 == 1, F.col("l_discount") > 0.05, ["l_returnflag"])


@query("""
    WITH l AS (SELECT c_custkey, ln(1 + greatest(c_acctbal, 0)) AS a, ln(1 + c_nationkey) AS b FROM customer)
    SELECT c_custkey, round((a - avg(a) OVER ()) / (CASE WHEN stddev_pop(a) OVER () < 1e-6 THEN 1 ELSE stddev_pop(a) OVER () END), 6) AS c_acctbal, round((b - avg(b) OVER ()) / (CASE WHEN stddev_pop(b) OVER () < 1e-6 THEN 1 ELSE stddev_pop(b) OVER () END), 6) AS c_nationkey FROM l
""")
def standardised_metrics(spark, sf_dir):
    return metrics.standardise_log1p(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])


_SPEND = "SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1"


def _spend(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    return g.agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend"))


@query(f"SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0) AS spend, n_orders IS NOT NULL AS matched FROM customer LEFT JOIN ({_SPEND}) USING (c_custkey)")
def metrics_zero_filled(spark, sf_dir):
    return joins.zero_filled(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _spend(spark, sf_dir), "c_custkey")


@query(f"SELECT c_custkey, c_name, n_orders, spend FROM customer JOIN ({_SPEND}) USING (c_custkey)")
def metrics_matched_only(spark, sf_dir):
    return joins.matched_only(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _spend(spark, sf_dir), "c_custkey")


@query("SELECT a.doc_id, a.quality, a.quality * b.toxic AS quality_b FROM labels a JOIN labels b USING (doc_id) WHERE a.doc_id % 5 > 0 AND b.doc_id % 7 > 0")
def paired_results(spark, sf_dir):
    rows, error = table(spark, sf_dir, "labels"), lambda n: F.when(F.col("doc_id") % n == 0, "failed")
    return joins.paired(rows.withColumn("error", error(5)), rows.withColumn("quality", F.col("quality") * F.col("toxic")).withColumn("error", error(7)), "doc_id", "error", ["quality"])


@query("SELECT l_orderkey, avg(l_discount) FILTER (l_linenumber % 2 = 1) AS mean_a, avg(l_discount) FILTER (l_linenumber % 2 = 0) AS mean_b FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 2) = 2")
def paired_group_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", (F.col("l_linenumber") % 2).alias("arm"))
    return joins.paired_means(rows.where("arm = 1"), rows.where("arm = 0"), "l_orderkey", "l_discount")


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def ids_in_all_arms(spark, sf_dir):
    return joins.ids_of_all(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT doc_id, lang, NULL::BIGINT AS item_id FROM documents UNION ALL SELECT NULL, NULL, item_id FROM benchmark")
def union_of_parts(spark, sf_dir):
    return joins.union_parts(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "benchmark").select("item_id"))


@query("""
    WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber AS r, l_discount > 0.05 AS v FROM lineitem)
    SELECT a.r AS l_linenumber, count(*) AS n, count(*) FILTER (a.v = b.v) AS agree, count(*) FILTER (a.v AND NOT b.v) AS raised, count(*) FILTER (b.v AND NOT a.v) AS dropped
    FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND b.r = 1 AND a.r <> 1 GROUP BY 1
""")
def rendering_flips(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("v")).distinct()
    return joins.flips(rows, "l_orderkey", "l_linenumber", 1, F.col("v"))


# --- event windows and relational queries


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    out = ingest.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_counts(spark, sf_dir):
    out = ingest.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 minutes", "user_id")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC, c_custkey LIMIT 20")
def top_customers(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "customer").join(totals, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "total").orderBy(F.desc("total"), "c_custkey").limit(20)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS returned, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS empty_orders FROM orders GROUP BY 1")
def semi_anti_orders(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    rows = table(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderpriority").agg(F.count_if(F.expr("r = 1")).alias("returned"), F.count_if(F.expr("l_orderkey is null")).alias("empty_orders"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("n_nationkey") == F.col("c_nationkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


# --- answers


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 12 AS kind, o_orderpriority AS p FROM orders)
    SELECT o_orderkey, CASE WHEN kind = 6 THEN 'says "' || p || '" here' WHEN kind <> 7 THEN p END AS explanation, CASE WHEN kind NOT IN (6, 7) THEN o_orderkey END AS key,
        CASE kind WHEN 2 THEN 'trailing-comma' WHEN 3 THEN 'python-repr' WHEN 4 THEN 'truncated' WHEN 5 THEN 'truncated+trailing-comma' WHEN 6 THEN 'explanation-only' END AS repair,
        CASE WHEN kind IN (0, 1, 8, 10, 11) THEN p END AS strict_explanation, kind IN (0, 1, 8, 10, 11) AS has_keys
    FROM o
""")
def json_in_answers(spark, sf_dir):
    """Answers made of orders, each damaged in the way of its key."""
    k, p = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    whole = say('{"explanation": "', p, '", "key": ', k, "}")
    forms = [
        whole, say('First {"n": 1}, then ```json\n', whole, "\n``` done"), say('{"explanation": "', p, '", "key": ', k, ",}"), say("{'explanation': '", p, "', 'key': ", k, "}"),
        say('{"key": ', k, ', "explanation": "', p), say('{"explanation": "', p, '", "list": [', k, ',], "key": ', k), say('{"explanation": "says "', p, '" here"}'), say("no answer for ", p),
        say(whole, " and more"), say('{"n": 1} ', whole), say("[1, 2] ", whole), say(whole, "] {x}"),
    ]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int")).alias("answer"))
    got = rows.select("o_orderkey", answers.repaired_json(F.col("answer")).alias("r"), answers.extract_json(F.col("answer")).alias("s"))
    return got.select(
        "o_orderkey", F.get_json_object("r.object", "$.explanation").alias("explanation"), F.get_json_object("r.object", "$.key").cast("long").alias("key"), F.col("r.repair").alias("repair"),
        F.get_json_object("s", "$.explanation").alias("strict_explanation"), answers.has_keys(F.col("s"), ["explanation", "key"]).alias("has_keys"),
    )
