"""Further registered queries: resampling, reuse of text, process measures, structure of diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import diff, patch, verify
from skarn.operators import grading, process, ranks, resampling, reuse
from skarn.plans.catalog import _LD, _grams, _TOKENS, buggy, flagged, labelled, query, table

# --- resampling

_DRAWS = 10_000


def _drawn(seed: int) -> str:
    """The numbered blocks and the drawn places, after a table b of blocks with key g."""
    word = "('0x' || substr(m, {}, 8))::BIGINT"
    picks = " UNION ALL ".join(f"SELECT draw, 4 * j + {k} AS i, floor({word.format(8 * k + 1)} * n / 4294967296.0)::BIGINT AS place FROM md" for k in range(4))
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || g), g) - 1 AS place FROM b), size AS (SELECT count(*) AS n, ceil(count(*) / 4)::BIGINT AS words FROM b),
    md AS (SELECT draw, j, n, md5('{seed}:' || draw || ':' || j) AS m FROM size, range({_DRAWS}) r(draw), LATERAL (SELECT unnest(range(words)) AS j)),
    picks AS (SELECT draw, place FROM ({picks}), size WHERE i < n)"""


_ENDS = f"""s AS (SELECT list_sort(list(round(d, 9))) AS l FROM per_draw)
    SELECT blocks, n, round(d, 6) AS observed, round(l[{int(0.025 * _DRAWS) + 1}], 6) AS low, round(l[{int(0.975 * _DRAWS) + 1}], 6) AS high, round(len(list_filter(l, lambda z: z <= 0)) / {_DRAWS}, 6) AS p FROM s, observed"""


def _sep(m: str) -> str:
    return f"sum({m}_tp) / greatest(sum({m}_tp) + sum({m}_fn), 1) - sum({m}_fp) / greatest(sum({m}_fp) + sum({m}_tn), 1)"


@query(f"""
    WITH {_LD}, r AS (SELECT doc_id // 3 AS g, t, p AS a, n_chars < 400 AS b FROM labelled),
    b AS (SELECT g, count(*) AS n, count(*) FILTER (t AND a) AS a_tp, count(*) FILTER (t AND NOT a) AS a_fn, count(*) FILTER (NOT t AND a) AS a_fp, count(*) FILTER (NOT t AND NOT a) AS a_tn,
        count(*) FILTER (t AND b) AS b_tp, count(*) FILTER (t AND NOT b) AS b_fn, count(*) FILTER (NOT t AND b) AS b_fp, count(*) FILTER (NOT t AND NOT b) AS b_tn FROM r GROUP BY g),
    {_drawn(5)}, per_draw AS (SELECT draw, {_sep('a')} - ({_sep('b')}) AS d FROM picks JOIN numbered USING (place) GROUP BY draw),
    observed AS (SELECT count(*) AS blocks, sum(n)::BIGINT AS n, {_sep('a')} - ({_sep('b')}) AS d FROM b), {_ENDS}
""")
def separation_bootstrap_ci(spark, sf_dir):
    """Two verdicts on the labelled documents, blocks of three neighbours."""
    rows = labelled(spark, sf_dir).withColumn("g", F.floor(F.col("doc_id") / 3).cast("long"))
    return resampling.bootstrap_separation(rows, "g", buggy(), flagged(), F.col("n_chars") < 400, _DRAWS, 5)


@query(f"""
    WITH {_LD}, r AS (SELECT doc_id // 5 AS g, t::INT AS x, p::INT AS y FROM labelled), b AS (SELECT g, count(*) AS n, avg(x) AS x, avg(y) AS y FROM r GROUP BY g),
    {_drawn(11)}, per_draw AS (SELECT draw, avg(x) - avg(y) AS d FROM picks JOIN numbered USING (place) GROUP BY draw),
    observed AS (SELECT count(*) AS blocks, sum(n)::BIGINT AS n, avg(x) - avg(y) AS d FROM b), {_ENDS}
""")
def paired_bootstrap_ci(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("g", F.floor(F.col("doc_id") / 5).cast("long"))
    return resampling.bootstrap_mean_difference(rows, "g", buggy().cast("int"), flagged().cast("int"), _DRAWS, 11)


# --- reuse of text

_SIZES = f"SELECT doc_id, source, len({_TOKENS.format('text')})::INT AS n_words FROM documents"
_COVERED = "SELECT doc_id, count(DISTINCT p)::BIGINT AS covered FROM (SELECT doc_id, unnest(range(pos, pos + 6)) AS p FROM h) GROUP BY doc_id"
_LONGEST = """s AS (SELECT a, b, d, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS isle FROM pairs),
    l AS (SELECT a AS doc_id, max(k) + 5 AS longest FROM (SELECT a, count(*) AS k FROM s GROUP BY a, b, d, isle) GROUP BY a)"""
_REUSED = f"""
    g AS MATERIALIZED (SELECT x.doc_id, d.source, x.pos, hash(x.gram) AS gram FROM {_grams('documents', 'doc_id', 6)} x JOIN documents d USING (doc_id)),
    k AS (SELECT gram, min(source) AS g0, max(source) AS g1 FROM g GROUP BY gram), h AS MATERIALIZED (SELECT doc_id, source, pos, g.gram FROM g JOIN k ON g.gram = k.gram AND g0 <> g1), c AS ({_COVERED}),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.pos AS i, x.pos - y.pos AS d FROM h x JOIN h y ON x.gram = y.gram AND x.source <> y.source), {_LONGEST}, n AS ({_SIZES}),
    scored AS (SELECT doc_id, source, n_words, coalesce(covered, 0) AS covered, round(coalesce(covered / nullif(n_words, 0), 0), 6) AS coverage, coalesce(longest, 0)::BIGINT AS longest FROM n LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source; null sources are none's, so they take part in no reuse."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


@query(f"""
    WITH g AS (SELECT doc_id, pos, gram FROM {_grams('documents', 'doc_id', 6)}), q AS (SELECT item_id, pos, gram FROM {_grams('benchmark', 'item_id', 6)}), h AS (SELECT * FROM g WHERE gram IN (SELECT gram FROM q)), c AS ({_COVERED}),
    pairs AS (SELECT g.doc_id AS a, q.item_id AS b, g.pos AS i, g.pos - q.pos AS d FROM g JOIN q USING (gram)), {_LONGEST}, n AS ({_SIZES})
    SELECT doc_id, n_words, coalesce(covered, 0) AS covered, round(coalesce(covered / nullif(n_words, 0), 0), 6) AS coverage, coalesce(longest, 0)::BIGINT AS longest FROM n LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
""")
def verbatim_from_corpus(spark, sf_dir):
    return reuse.against(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 6)


@query(f"WITH {_REUSED} SELECT * FROM scored")
def self_similarity(spark, sf_dir):
    """Each document against the documents of all other sources."""
    return reuse.reuse(_documents(spark, sf_dir), "doc_id", "source", "text", 6)


@query(f"""
    WITH {_REUSED}, u AS (SELECT * FROM scored WHERE n_words >= 6), o AS (SELECT list_sort(list(coverage)) AS v FROM u)
    SELECT count(*) FILTER (n_words >= 6) AS n, count(*) FILTER (n_words < 6) AS skipped, round(avg(coverage) FILTER (n_words >= 6), 6) AS mean, (SELECT round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) FROM o) AS median,
        (SELECT v[floor(0.9 * (len(v) - 1))::INT + 1] FROM o) AS p90, max(coverage) FILTER (n_words >= 6) AS max, count(*) FILTER (n_words >= 6 AND coverage >= 0.5) AS heavy, max(longest) AS longest
    FROM scored
""")
def self_similarity_summary(spark, sf_dir):
    return reuse.summary(reuse.reuse(_documents(spark, sf_dir), "doc_id", "source", "text", 6), 6)


# --- process measures


@query("""
    WITH c AS (SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS ts, CASE WHEN o_orderkey % 3 = 0 THEN 'Fixes ' ELSE 'Adds ' END || o_orderpriority AS subject FROM orders),
    f AS (SELECT l_orderkey AS id, CASE WHEN l_partkey % 11 = 0 THEN 'readme' || l_partkey ELSE 's' || l_partkey % 5 || '/d' || l_partkey % 17 || '/p' || l_partkey END AS path, sum(l_quantity)::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted FROM lineitem GROUP BY 1, 2),
    j AS (SELECT f.*, author, ts, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS sub, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '.' END AS dir FROM f JOIN c USING (id)),
    past AS (SELECT j.id, j.path, count(h.id) AS nuc, count(DISTINCT h.author) AS ndev, coalesce(sum(h.added - h.deleted), 0) AS lt, max(h.ts) AS last FROM j LEFT JOIN j h ON h.path = j.path AND (h.ts < j.ts OR (h.ts = j.ts AND h.id < j.id)) GROUP BY ALL),
    e AS (SELECT id, sum(added + deleted) AS t, count(*) AS n, sum(CASE WHEN added + deleted > 0 THEN (added + deleted) * log2(added + deleted) ELSE 0 END) AS tl FROM j GROUP BY id),
    p AS (SELECT j.id, count(DISTINCT sub) AS ns, count(DISTINCT dir) AS nd, count(*) AS nf, sum(added)::BIGINT AS la, sum(deleted)::BIGINT AS ld, avg(lt) AS lt, avg(ndev) AS ndev, avg(nuc) AS nuc, avg(epoch(j.ts - last) / 86400) AS age FROM j JOIN past USING (id, path) GROUP BY j.id),
    x AS (SELECT c.id, count(h.id) AS exp, coalesce(sum(1 / (epoch(c.ts - h.ts) / (365.25 * 86400) + 1)), 0) AS rexp FROM c LEFT JOIN c h ON h.author = c.author AND (h.ts < c.ts OR (h.ts = c.ts AND h.id < c.id)) GROUP BY c.id),
    y AS (SELECT s.id, count(h.id) AS sexp FROM (SELECT DISTINCT id, author, ts, sub FROM j) s JOIN j h ON h.author = s.author AND h.sub = s.sub AND (h.ts < s.ts OR (h.ts = s.ts AND h.id < s.id)) GROUP BY s.id)
    SELECT c.id, (contains(lower(subject), 'fix'))::INT AS fix, coalesce(ns, 0) AS ns, coalesce(nd, 0) AS nd, coalesce(nf, 0) AS nf, coalesce(la, 0) AS la, coalesce(ld, 0) AS ld, exp, coalesce(sexp, 0) AS sexp,
        round(CASE WHEN coalesce(n, 0) < 2 OR t = 0 THEN 0 ELSE (log2(t) - tl / t) / log2(n) END, 6) AS entropy, round(coalesce(lt, 0), 6) AS lt, round(coalesce(ndev, 0), 6) AS ndev, round(coalesce(age, 0), 6) AS age, round(coalesce(nuc, 0), 6) AS nuc, round(rexp, 6) AS rexp
    FROM c LEFT JOIN p USING (id) LEFT JOIN e USING (id) JOIN x USING (id) LEFT JOIN y USING (id)
""")
def process_measures(spark, sf_dir):
    """Orders as commits, their customers as authors, parts as files."""
    commits = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Fixes ").otherwise("Adds "), F.col("o_orderpriority")).alias("subject")
    )
    k = F.col("l_partkey")
    path = F.when(k % 11 == 0, F.concat(F.lit("readme"), k)).otherwise(F.concat(F.lit("s"), k % 5, F.lit("/d"), k % 17, F.lit("/p"), k))
    # dealt by commit alone and named after they are summed, so that what is joined by commit isn't dealt again; a part has one path
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_quantity", "l_linenumber").repartition("id")
    changes = items.groupBy("id", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted")).select("id", path.alias("path"), "added", "deleted")
    return process.process_measures(commits, changes, table(spark, sf_dir, "lineitem").select(path))


# --- structure of diffs: an order is a changed file, its items are lines, in two hunks


def order_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, diff): items returned are removed lines, accepted ones added lines, others context; those of every seventh part are definitions."""
    k, key = F.col("l_linenumber"), F.col("l_orderkey")
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    text = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("def part_"), F.col("l_partkey"), F.lit("(x):"))).otherwise(F.concat(F.lit("    part = "), F.col("l_partkey")))
    rows = table(spark, sf_dir, "lineitem").select(key.alias("id"), F.when(k <= 3, 1).otherwise(2).alias("h"), k.alias("k"), F.concat(sign, text).alias("line"))
    hunks = rows.groupBy("id", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    head = F.concat(F.lit("@@ -"), F.col("h") * 10 + F.col("id") % 7, F.lit(",9 +"), F.col("h") * 10 + F.col("id") % 5, F.lit(",9 @@"), F.when(F.col("id") % 2 == 0, " class Outer:").otherwise(""))
    whole = hunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("h", F.concat(F.array(head), "lines").alias("lines")))).alias("h"))
    name = F.concat(F.lit("f"), F.col("id"), F.lit(".py"))
    top = F.array(F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name), F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name))
    return whole.select("id", F.array_join(F.concat(top, F.flatten(F.transform("h", lambda x: x["lines"]))), "\n").alias("diff"))


_LINES = """l AS (SELECT l_orderkey AS id, l_linenumber AS k, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS h, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END AS s,
        CASE WHEN l_partkey % 7 = 0 THEN 'def part_' || l_partkey || '(x):' ELSE '    part = ' || l_partkey END AS t, CASE WHEN l_partkey % 7 = 0 THEN 'part_' || l_partkey END AS def FROM lineitem),
    n AS (SELECT *, h * 10 + id % 7 + count(*) FILTER (s <> '+') OVER w AS lno, h * 10 + id % 5 + count(*) FILTER (s <> '-') OVER w AS rno, count(*) FILTER (s = ' ') OVER w AS run,
            3 + dense_rank() OVER (PARTITION BY id ORDER BY h) + r AS "offset",
            '@@ -' || (h * 10 + id % 7) || ',9 +' || (h * 10 + id % 5) || ',9 @@' || CASE WHEN id % 2 = 0 THEN ' class Outer:' ELSE '' END AS head
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, s || t) AS r FROM l) WINDOW w AS (PARTITION BY id, h ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""
    WITH {_LINES}, d AS (SELECT id, h, run, row_number() OVER (PARTITION BY id, h, run ORDER BY r) AS i, lno, t FROM n WHERE s = '-'), a AS (SELECT id, h, run, row_number() OVER (PARTITION BY id, h, run ORDER BY r) AS i, rno, t FROM n WHERE s = '+'),
    u AS (SELECT id, h, run, i, lno AS left_no, d.t AS "left", rno AS right_no, a.t AS "right", 'change' AS kind FROM d FULL JOIN a USING (id, h, run, i)
        UNION ALL SELECT id, h, run, 1000, lno, t, rno, t, 'context' FROM n WHERE s = ' ' UNION ALL SELECT DISTINCT id, h, -1, 0, NULL::BIGINT, head, NULL::BIGINT, head, 'hunk' FROM n)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY h, run, i) - 1 AS "row", left_no, "left", right_no, "right", kind FROM u
""")
def side_by_side(spark, sf_dir):
    return order_diffs(spark, sf_dir).select("id", F.posexplode(patch.side_by_side(F.col("diff"))).alias("row", "x")).select("id", F.col("row").cast("long").alias("row"), "x.*")


@query(f"""WITH {_LINES} SELECT id, 'f' || id || '.py' AS path, rno AS line, "offset" FROM n WHERE s <> '-'""")
def diff_line_index(spark, sf_dir):
    return order_diffs(spark, sf_dir).select("id", F.inline(patch.line_index(F.col("diff"))))


@query(f"""
    WITH {_LINES}, e AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY id, h ORDER BY r) AS own FROM n)
    SELECT id, "offset", 'f' || id || '.py' AS path, head AS hunk, CASE WHEN s = '-' THEN lno END AS old_no, CASE WHEN s = '+' THEN rno END AS new_no, s AS sign, t AS text, coalesce(own, CASE WHEN id % 2 = 0 THEN 'Outer' END) AS enclosing FROM e WHERE s <> ' '
""")
def changed_places(spark, sf_dir):
    return order_diffs(spark, sf_dir).select("id", F.inline(patch.changed_places(F.col("diff"))))


@query(f"""
    WITH {_LINES}, r AS (SELECT id, h, run, CASE s WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END AS side, k, CASE s WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE ' ' END || t AS x FROM n
        UNION ALL SELECT DISTINCT id, h, -1, 0, 0, '@@ -' || (h * 10 + id % 5) || ',9 +' || (h * 10 + id % 7) || ',9 @@' || CASE WHEN id % 2 = 0 THEN ' class Outer:' ELSE '' END FROM n)
    SELECT id, 'diff --git a/f' || id || '.py b/f' || id || '.py' || chr(10) || '--- a/f' || id || '.py' || chr(10) || '+++ b/f' || id || '.py' || chr(10) || string_agg(x, chr(10) ORDER BY h, run, side, k, x) AS diff FROM r GROUP BY id
""")
def reverse_hunks(spark, sf_dir):
    return order_diffs(spark, sf_dir).select("id", patch.reversed_diff(F.col("diff")).alias("diff"))


# --- prose against measurements


@query("""
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS kind, o_custkey::VARCHAR AS b, (o_custkey + 7)::VARCHAR AS a FROM orders),
    s AS (SELECT *, 'The output changed from ' || b || ' to ' || a || '.' AS good, NOT contains(b, a) AND NOT contains(a, b) AS apart,
        CASE WHEN kind IN (3, 4) THEN 'This is purely cosmetic for users.' WHEN kind = 6 THEN 'The `part_' || id || '` method was removed.' WHEN kind = 2 THEN 'The total went from ' || a || ' to ' || b || '.' END AS second FROM o)
    SELECT id, CASE WHEN kind = 0 THEN '' WHEN kind IN (4, 6) OR (kind = 2 AND NOT apart) THEN good || ' ' || second ELSE good END AS kept,
        CASE kind WHEN 0 THEN 'reports an observation that was never made (''The output changed'') with nothing measured|reports an observation that was never made (''Still prints'') with nothing measured'
            WHEN 1 THEN 'invented [''-424242'', ''99887766'']' WHEN 2 THEN CASE WHEN apart THEN 'states the change as ''' || a || ''' -> ''' || b || '''; the measurement is the reverse' ELSE '' END
            WHEN 3 THEN 'claims the change is harmless (''purely cosmetic'') with nothing measured' WHEN 5 THEN 'says ''part_' || id || ''' was removed, but no removed line in the diff mentions it' WHEN 7 THEN 'empty' ELSE '' END AS dropped
    FROM s
""")
def filtered_prose(spark, sf_dir):
    """Explanations made of orders: a sentence that holds, and one that is wrong in the way of the order's key."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 8
    before, after = F.col("o_custkey").cast("string"), (F.col("o_custkey") + 7).cast("string")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    removal, cosmetic = say("The `part_", key, "` method was removed."), F.lit("This is purely cosmetic for users.")
    second = [F.lit("Still prints the list here."), F.lit("It then prints 99887766 and -424242."), say("The total went from ", after, " to ", before, "."), cosmetic, cosmetic, removal, removal, F.lit("Too short.")]
    prose = say("The output changed from ", before, " to ", after, ". ", F.element_at(F.array(*second), (kind + 1).cast("int")))
    diff = say("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n", F.when(kind == 6, "-").otherwise("+"), "def part_", key, "(): pass\n+keep()")
    found = verify.filtered_prose(prose, before, after, diff, ~kind.isin(0, 3), kind == 0)
    return table(spark, sf_dir, "orders").select(key.alias("id"), found.alias("x")).select("id", "x.kept", F.array_join("x.dropped", "|").alias("dropped"))


# --- rank statistics


@query(f"""
    WITH {_LD}, v AS (SELECT n_chars AS x, doc_id % 13 + quality * 3 AS y FROM labelled), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM v)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r
""")
def rank_correlation(spark, sf_dir):
    return ranks.spearman(labelled(spark, sf_dir), F.col("n_chars"), F.col("doc_id") % 13 + F.col("quality") * 3)


@query(f"""
    WITH {_LD}, v AS (SELECT n_chars - (400 + doc_id % 200) AS d FROM labelled WHERE n_chars <> 400 + doc_id % 200), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM v)
    SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus FROM r
""")
def signed_rank_sums(spark, sf_dir):
    """Against made-up lengths; the probability is tested on fixtures, as SQL has no normal distribution."""
    return ranks.signed_rank(labelled(spark, sf_dir), F.col("n_chars"), 400 + F.col("doc_id") % 200).drop("p")


# --- grading


def graded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results made of orders: none or one finding, about a definition that changed, another file, or in plain words."""
    item = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.when(F.col("l_partkey") % 7 == 0, F.col("l_partkey"))).alias("part"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").join(order_diffs(spark, sf_dir), "id").join(item, "id", "left")
    kind, named = F.col("id") % 4, F.concat(F.lit("part_"), F.coalesce("part", F.lit(0)))
    said = F.when(kind == 1, F.concat(named, F.lit(" fails"))).when(kind == 2, "The value is wrong").otherwise("The part is wrong")
    category = F.when(F.col("id") % 5 < 2, "logic").when(F.col("id") % 5 == 2, "naming").otherwise("bounds")
    file = F.when(kind == 1, F.concat(F.lit("f"), F.col("id"), F.lit(".py"))).when(kind == 2, "other.py")
    finding = F.struct(category.alias("category"), file.alias("file"), said.alias("explanation"))
    return rows.select(
        "id", F.col("o_orderstatus").alias("arm"), (F.col("id") % 3 == 0).alias("buggy"), F.when(F.col("id") % 10 == 9, "timeout").alias("error"), "diff", F.when(F.col("id") % 6 == 1, F.concat(F.lit("fix "), named)).alias("fix_diff"),
        F.col("o_totalprice").alias("seconds"), F.when(kind == 0, F.slice(F.array(finding), 1, 0)).otherwise(F.array(finding)).alias("findings"),
        F.when(F.col("id") % 7 < 3, F.array(F.lit("logic"))).alias("teacher"), F.lit("post-breaks").alias("direction"),
    )


_GRADED = """c AS (SELECT l_orderkey AS id, bool_or(l_partkey % 7 = 0) AS def, bool_or(l_partkey % 7 <> 0) AS part FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
    r AS (SELECT o_orderkey AS id, o_orderstatus AS arm, o_orderkey % 3 = 0 AS t, o_orderkey % 4 AS kind, o_orderkey % 4 > 0 AS p, o_orderkey % 10 = 9 AS bad, o_totalprice AS s, coalesce(def, false) AS def, coalesce(part, false) AS part,
        CASE WHEN o_orderkey % 5 < 2 THEN 'logic' WHEN o_orderkey % 5 = 2 THEN 'naming' ELSE 'bounds' END AS cat FROM orders LEFT JOIN c ON c.id = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    u AS (SELECT *, CASE kind WHEN 1 THEN def WHEN 2 THEN false ELSE NOT def AND part END AS g, CASE WHEN id % 6 = 1 THEN CASE WHEN kind = 1 THEN 0.5 ELSE 0 END END AS f FROM r WHERE NOT bad)"""


@query(f"""
    WITH {_GRADED}, n AS (SELECT arm, count(*) AS n, round(avg((NOT bad)::INT), 6) AS valid, list_sort(list(s))[count(*) // 2 + 1] AS median_seconds FROM r GROUP BY arm),
    x AS (SELECT arm, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (p) AS n_findings,
        round(coalesce(avg(g::INT) FILTER (p), 0), 6) AS grounded, round(avg(f) FILTER (p), 6) AS fix_agreement, count(f) FILTER (p) AS n_fix, round(avg((p AND cat = 'logic')::INT) FILTER (id % 7 < 3), 6) AS category_match FROM u GROUP BY arm),
    k AS (SELECT arm, string_agg(cat || ':' || k, ',' ORDER BY k DESC, cat) AS categories FROM (SELECT arm, cat, count(*) AS k FROM u WHERE p GROUP BY ALL) GROUP BY arm),
    q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM x)
    SELECT arm, n, valid, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
        n_findings, grounded, fix_agreement, n_fix, category_match, categories, median_seconds FROM n JOIN q USING (arm) JOIN k USING (arm)
""")
def score_card(spark, sf_dir):
    return grading.score_card(graded_results(spark, sf_dir), ["arm"])


@query("""
    WITH c AS (SELECT l_orderkey AS id, bool_or((l_partkey % 7 = 0 AND l_returnflag <> 'N') OR l_partkey = 0) AS named, bool_or(l_partkey % 7 = 0) AS def, bool_or(l_partkey % 7 <> 0) AS part FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN g THEN 1 ELSE 0 END AS n_kept, CASE WHEN o_orderkey % 4 = 0 OR g THEN 'post-breaks' ELSE 'unchanged' END AS direction
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN named WHEN 2 THEN false ELSE NOT def AND part END AS g FROM orders JOIN c ON c.id = o_orderkey)
""")
def grounded_findings(spark, sf_dir):
    """What is left of each result's findings, looked for in the whole hunks."""
    rows = graded_results(spark, sf_dir)
    return rows.select("id", grading.drop_ungrounded(F.col("findings"), F.col("direction"), F.col("diff")).alias("x")).select("id", F.size("x.findings").alias("n_kept"), "x.direction")


# --- lines of diffs


@query(f"""
    WITH {_LINES}, g AS (SELECT id, count(*) FILTER (s <> ' ')::INT AS n_changed, coalesce(list_sort(list(trim(t)) FILTER (s = '-')), []) AS x, coalesce(list_sort(list(trim(t)) FILTER (s = '+')), []) AS y FROM n GROUP BY id)
    SELECT id, 'f' || id || '.py' AS files, n_changed, n_changed > 0 AND x = y AS cosmetic FROM g
""")
def changed_lines(spark, sf_dir):
    d = F.col("diff")
    return order_diffs(spark, sf_dir).select("id", F.array_join(diff.files_in_diff(d), ",").alias("files"), F.size(diff.changed_lines(d)).alias("n_changed"), diff.cosmetic_only(d).alias("cosmetic"))


@query(f"""
    WITH {_LINES}, g AS (SELECT id, count(*) FILTER (s = '+')::INT AS p, count(*) FILTER (s = '-')::INT AS m, coalesce(sum(length(t) + 1) FILTER (s = '+'), 0)::INT AS pc, coalesce(sum(length(t) + 1) FILTER (s = '-'), 0)::INT AS mc, count(*)::INT AS n_lines FROM n GROUP BY id)
    SELECT id, p AS added, m AS removed, p - m AS net, round(p / greatest(m, 1), 6) AS ratio, pc AS added_chars, mc AS removed_chars, pc - mc AS net_chars, round(pc / greatest(mc, 1), 6) AS chars_ratio, n_lines FROM g
""")
def count_features(spark, sf_dir):
    f = diff.count_features(F.col("diff"))
    whole = ("added", "removed", "net", "added_chars", "removed_chars", "net_chars", "n_lines")
    return order_diffs(spark, sf_dir).select("id", *(f[n].alias(n) for n in whole), *(F.round(f[n], 6).alias(n) for n in ("ratio", "chars_ratio")))
