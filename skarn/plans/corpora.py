"""Registered queries that draw, split and weigh the rows of a training set."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import profile
from skarn.operators import features, sampling
from skarn.operators.ranking import hash_key
from skarn.plans.catalog import _order, query, table
from skarn.streaming import ingest

_SHARE = 0.3
_RATIO = repr((1 - _SHARE) / _SHARE)


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes: defects are rarer in some languages and sizes than in others."""
    key, lang = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), lang.alias("lang"), F.floor(F.col("o_totalprice") / 60000).cast("int").alias("bin"), (F.col("o_orderstatus") == "F").alias("structured"), F.col("o_custkey").alias("project"), F.floor(F.col("o_totalprice") / 700).cast("long").alias("n_lines"),
        ((key % 5 == 0) | ((F.substring(lang, 1, 1) == "1") & (F.col("o_custkey") % 2 == 0))).alias("buggy"),
    )


_CHANGES = "ch AS (SELECT o_orderkey AS id, o_orderpriority AS lang, floor(o_totalprice / 60000)::INT AS bin, o_orderstatus = 'F' AS structured, o_custkey AS project, floor(o_totalprice / 700)::BIGINT AS n_lines, o_orderkey % 5 = 0 OR (o_orderpriority[1] = '1' AND o_custkey % 2 = 0) AS buggy FROM orders)"


def _quota_sql(rounds: int = 4) -> str:
    """The table of cells with what each gives, one table for every clip."""
    cell, steps, last = "bin, lang, structured", [], "q0"
    for j in range(rounds):
        ask = "least(neg, ceil(pos * W / P)::BIGINT)" if j == 0 else "neg - taken"
        steps.append(f"a{j}_0 AS (SELECT *, {ask} AS ask FROM {last})")
        for i, (part, quota) in enumerate([("PARTITION BY bin", "qb"), ("PARTITION BY lang", "ql"), ("PARTITION BY structured", "qs"), ("", "W")]):
            steps.append(f"a{j}_{i + 1} AS (SELECT * EXCLUDE (ask), least(ask, greatest({quota} - sum(taken) OVER ({part}) - coalesce(sum(ask) OVER ({part} ORDER BY {cell} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS ask FROM a{j}_{i})")
        steps.append(f"q{j + 1} AS (SELECT * EXCLUDE (ask, taken), taken + ask AS taken FROM a{j}_4)")
        last = f"q{j + 1}"
    return f"""{_CHANGES}, cells AS (SELECT {cell}, count(*) FILTER (buggy) AS pos, count(*) FILTER (NOT buggy) AS neg FROM ch GROUP BY ALL), t AS (SELECT sum(pos)::BIGINT AS P, round_even(sum(pos) * {_RATIO}::DOUBLE, 0)::BIGINT AS W FROM cells),
    q0 AS (SELECT *, 0 AS taken, round_even(sum(pos) OVER (PARTITION BY bin) / P * W, 0)::BIGINT AS qb, round_even(sum(pos) OVER (PARTITION BY lang) / P * W, 0)::BIGINT AS ql, floor((sum(pos) OVER (PARTITION BY structured) / P + 0.12::DOUBLE) * W)::BIGINT AS qs FROM cells, t),
    {', '.join(steps)}, given AS (SELECT {cell}, pos, neg, taken FROM {last})"""


_STRATA = ["bin", "lang", "structured"]


@query(f"WITH {_quota_sql()} SELECT bin, lang, structured, pos, neg, taken::BIGINT AS taken FROM given")
def matched_quotas(spark, sf_dir):
    cells = order_changes(spark, sf_dir).groupBy(*_STRATA).agg(F.count_if("buggy").alias("pos"), F.count_if(~F.col("buggy")).alias("neg"))
    return sampling.quotas(cells, _STRATA, {"structured": 0.12}, _SHARE)


@query(f"""
    WITH {_quota_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY bin, lang, structured ORDER BY {_order(21, 'id')}) AS r FROM ch WHERE NOT buggy)
    SELECT id, true AS positive FROM ch WHERE buggy UNION ALL SELECT id, false FROM r JOIN given USING (bin, lang, structured) WHERE r <= taken
""")
def matched_sample(spark, sf_dir):
    return sampling.matched_sample(order_changes(spark, sf_dir), F.col("buggy"), _STRATA, {"structured": 0.12}, _SHARE, 21, "id").select("id", "positive")


@query(f"""
    WITH {_CHANGES}, c AS (SELECT id, least(6, n_lines // 40) AS b FROM ch WHERE NOT buggy AND id % 9 > 1), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY {_order(22, 'id')}) AS slot FROM c), k AS (SELECT *, row_number() OVER (ORDER BY slot, b) AS k FROM r),
    d AS (SELECT id FROM ch WHERE buggy AND (lang[1] <> '1' OR id % 3 = 0))
    SELECT id, true AS positive FROM d UNION ALL SELECT id, false FROM k WHERE k <= (SELECT round_even(count(*) * {_RATIO}::DOUBLE, 0) FROM d)
""")
def restored_share(spark, sf_dir):
    """After a filter that took rows of both classes."""
    rows = order_changes(spark, sf_dir).where("case when buggy then substring(lang, 1, 1) <> '1' or id % 3 = 0 else id % 9 > 1 end")
    return sampling.restore_share(rows.withColumn("b", F.least(F.lit(6), F.floor(F.col("n_lines") / 40))), F.col("buggy"), "b", _SHARE, 22, "id").select("id", "positive")


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_order(23)}) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= (SELECT greatest(1, 60 // count(DISTINCT source)) FROM documents)")
def even_sample(spark, sf_dir):
    return sampling.even_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 60, 23, "doc_id")


@query(f"""
    WITH {_CHANGES}, k AS (SELECT project, 2 * count(*) AS k FROM ch WHERE buggy GROUP BY project), r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY {_order(24, 'id')}) AS r FROM ch WHERE NOT buggy)
    SELECT id, project FROM r JOIN k USING (project) WHERE r <= k
""")
def random_negatives(spark, sf_dir):
    return sampling.random_negatives(order_changes(spark, sf_dir), "project", F.col("buggy"), 2, 24, "id").select("id", "project")


@query(f"""
    WITH f AS (SELECT o_orderkey AS id, o_custkey % 23 AS family, o_custkey % 23 < 9 AND o_orderstatus = 'F' AS p FROM orders), g AS (SELECT family, bool_or(p) AS any_p FROM f GROUP BY family),
    n AS (SELECT greatest(1, round_even(6 * count(*) FILTER (any_p) / count(*), 0)) AS kp FROM g), o AS (SELECT family, any_p, row_number() OVER (PARTITION BY any_p ORDER BY {_order(25, 'family')}) AS i FROM g),
    h AS (SELECT family FROM o, n WHERE i <= CASE WHEN any_p THEN kp ELSE greatest(1, 6 - kp) END), rest AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {_order(25, 'id')}) AS r, count(*) OVER (PARTITION BY p) AS c FROM f WHERE family NOT IN (SELECT family FROM h))
    SELECT id, family, 'cross' AS split FROM f WHERE family IN (SELECT family FROM h) UNION ALL SELECT id, family, CASE WHEN r <= round_even(c * 0.1::DOUBLE, 0) THEN 'within' ELSE 'train' END FROM rest
""")
def family_splits(spark, sf_dir):
    family = F.col("o_custkey") % 23
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), family.alias("family"), ((family < 9) & (F.col("o_orderstatus") == "F")).alias("p"))
    return sampling.family_splits(rows, "family", F.col("p"), 6, 0.1, 25, "id").select("id", "family", "split")


@query("""
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 10 AS kind, o_orderkey % 3 AS ext, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT id, CASE ext WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE CASE WHEN kind = 7 THEN '.js' ELSE '?' END END AS lang, CASE WHEN keep THEN n END AS n_lines, CASE WHEN keep THEN r > 0 END AS structured
    FROM (SELECT *, n > 0 AND (ext < 2 OR kind = 7) AND kind NOT IN (1, 2, 3, 4, 5) AS keep FROM o)
""")
def commit_profiles(spark, sf_dir):
    """Orders as commits, their items as changed lines: returned ones are branches; each tenth kind is noise of its own sort."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 10
    line = F.when(kind == 1, "import part").when(kind == 2, "  # part").when(F.col("l_returnflag") == "R", "if part:").otherwise("part = call(part)")
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = items.groupBy("o_orderkey").agg(F.concat_ws("\n", F.collect_list(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), line))).alias("body"))
    main = F.concat(F.lit("src/a"), F.element_at(F.array(*map(F.lit, (".py", ".tsx", ".txt"))), (key % 3 + 1).cast("int")))
    more = F.when(kind == 3, F.array(F.lit("src/b.c"))).when(kind == 4, F.array(F.lit("x/README.md"))).when(kind == 5, F.array(*(F.lit(f"d{j}.go") for j in range(5)))).when(kind == 7, F.array(F.lit("b.mjs"), F.lit(".ts"))).otherwise(F.array().cast("array<string>"))
    files = F.concat(F.array(main), more)
    diff = F.concat(F.lit("--- a/src/a\n+++ b/src/a\n@@ -1 +1 @@\n context\n+\n"), F.coalesce("body", F.lit("")))
    found = table(spark, sf_dir, "orders").select("o_orderkey").join(rows, "o_orderkey", "left").select(key.alias("id"), profile.language_of(files).alias("lang"), profile.commit_profile(files, diff).alias("x"))
    return found.select("id", "lang", F.col("x.n_lines").cast("long").alias("n_lines"), "x.structured")


# --- features

_TERMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf WHERE doc_id % 5 <> 0 GROUP BY term HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 300),
    i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0)) / (1 + df)) + 1 AS idf FROM v)"""


def _learnt() -> Column:
    return F.col("doc_id") % 5 != 0


@query(f"WITH {_TERMS}, x AS (SELECT doc_id, term, idx, (1 + ln(tf)) * idf AS weight FROM tf JOIN i USING (term)) SELECT doc_id, term, idx, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def tfidf_weights(spark, sf_dir):
    """Terms of the documents; each fifth document is not learnt from."""
    return features.tfidf(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _learnt()).withColumn("idx", F.col("idx").cast("long")).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_TERMS} SELECT term, idx, df, round(idf, 6) AS idf FROM i")
def tfidf_vocabulary(spark, sf_dir):
    terms = features.vocabulary(table(spark, sf_dir, "documents").where(_learnt()).select("text"), "text")
    return terms.select("term", F.col("idx").cast("long").alias("idx"), "df", F.round("idf", 6).alias("idf"))


@query("""
    WITH m AS (SELECT l_orderkey AS id, ln(1 + sum(l_quantity)) AS la, ln(1 + sum(l_linenumber)) AS ld, ln(1 + greatest(sum(l_quantity - l_extendedprice / 1000), 0)) AS net, ln(2) AS one FROM lineitem GROUP BY 1),
    s AS (SELECT avg(la) AS mla, stddev_pop(la) AS sla, avg(ld) AS mld, stddev_pop(ld) AS sld, avg(net) AS mnet, stddev_pop(net) AS snet, avg(one) AS mone FROM m WHERE id % 5 <> 0)
    SELECT id, round((la - mla) / sla, 6) AS la, round((ld - mld) / sld, 6) AS ld, round((net - mnet) / snet, 6) AS net, round(one - mone, 6) AS one FROM m, s
""")
def standardised_measures(spark, sf_dir):
    """Measures of orders: one may be negative, one is constant."""
    names = ["la", "ld", "net", "one"]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("la"), F.sum("l_linenumber").alias("ld"), F.sum(F.col("l_quantity") - F.col("l_extendedprice") / 1000).alias("net"), F.lit(1).alias("one"))
    return features.standardised(rows, names, F.col("id") % 5 != 0).select("id", *(F.round(F.col(n) + 0.0, 6).alias(n) for n in names))


# --- streams whose state outlives a run


def _own_folder(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"


@query(f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order(26)}) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= 25")
def capped_stream(spark, sf_dir):
    """The documents as a stream of files, at most 25 of a language."""
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).select("doc_id", "lang").schema
    own = _own_folder(spark)
    stream = spark.readStream.schema(schema).parquet(f"{source}*")
    ingest.capped_sink(stream, own, "lang", 25, "doc_id", hash_key(26, "doc_id"), f"{own}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{own}/rows").select("doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('R', 'A'))")
def unsettled_orders(spark, sf_dir):
    """Orders none of whose items was returned or accepted."""
    attempts = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return ingest.unsettled(table(spark, sf_dir, "orders").select("o_orderkey"), attempts, "o_orderkey", "l_returnflag", ["R", "A"])
