"""Fuzzy line deduplication: MinHash on character shingles, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import cut, stored
from skarn.llm.linking import likely_in, link_classes, shared_buckets, with_likely

#: Characters of a shingle and least Jaccard similarity of lines' sets of them.
SHINGLE, SIMILARITY = 5, 0.8
#: Characters of the shingles that are signed (longer ones, as unlike lines share few), minima of a signature (even), minima of a band.
SIGNED, MINIMA, ROWS = 8, 14, 3
#: Signed shingles that begin with one of these characters come first in the order of hashes, so that of lines of LONG characters that have
#: MINIMA of them only these need be taken out. (About every eighth character of a text in Latin letters; other texts have none of them and take all.)
#: This order is not a random one: lines whose edits fall on shingles that begin with these characters are likelier to be lost as candidates.
LEADERS, LONG = "aiqyAIQY19", 120
#: Lines of at most FEW different signed shingles are signed by the SHINGLE characters that are verified, too, in bands of two minima; from MANY on by the longer ones.
FEW, MANY = 40, 24

#: Longs of the bits that tell of two lines whether they can be similar.
BIT_LONGS = 16
#: Shingles that one row of the count of bits takes.
AT_ONCE = 4


def shingles(line: Column, n: int = SHINGLE) -> Column:
    """A line's n-character shingles; a shorter line is its own."""
    return F.when(F.length(line) < n, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(r"(?s)(?=(.{%d}))" % n), 1))


def hashed(line: Column, n: int) -> Column:
    """64-bit hashes of a line's different n-character shingles; a shorter line is its own."""
    # four bytes a character, so that shingles are found by their place; the outer transform holds them, as the inner one would copy a column's bytes for each shingle
    of = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(b) / 4).cast("int") - n, F.lit(0))), lambda i: F.xxhash64(F.substring(b, i * 4 + 1, F.lit(n * 4))))
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-32")), of), F.lit(0)))


def _changed(line: Column, n: int, change: Callable[[Column], Column]) -> Column:
    """change of each different n-character shingle, in lines under LONG characters without a regular expression."""
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.length(line) - (n - 1), F.lit(1))), lambda i: change(F.substring(line, i, F.lit(n))))
    return F.array_distinct(F.when(F.length(line) < LONG, short).otherwise(F.transform(shingles(line, n), change)))


def plausible(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Whether the sizes and bits of two lines' sets allow the similarity: of sets that reach it, at most (1 - s) / (1 + s) of both sizes together differ."""
    most = (1 - similarity) / (1 + similarity) * (x("size") + y("size")) + 1e-6
    differ = [F.bit_count(x(f"b{j}").bitwiseXOR(y(f"b{j}"))) for j in range(BIT_LONGS)]
    # a part of the bits tells most unlike lines apart
    return (F.abs(x("size") - y("size")) <= most) & (sum(differ[:4], F.lit(0)) <= most) & (sum(differ, F.lit(0)) <= most)


def signatures(lines: DataFrame) -> DataFrame:
    """lines (line and further columns) with its signature in place of line: n_a and a0.., n_b and b0...

    a: the MINIMA least of all the line's SIGNED-character shingles in an order
    by LEADERS and hash, b: those of its SHINGLE-character ones by hash if it
    has FEW of the former; n_a and n_b: the numbers of different shingles (n_a
    may be too large for long lines, n_b is 0 without b). Never empty for a
    line that isn't. Hashes of leaders are negative, all shingles' ones are not;
    a leader is in the order twice, which changes no comparison of two lines.
    """
    line, low = F.col("line"), F.lit((1 << 31) - 1)
    leaders = F.regexp_extract_all(line, F.lit(r"(?s)(?=([%s].{%d}))" % (LEADERS, SIGNED - 1)), 1)
    hashes = lambda own, change: F.array_distinct(F.transform(own, change))
    first = lambda own: F.slice(F.sort_array(own), 1, MINIMA)
    rest = [c for c in lines.columns if c != "line"]
    led = lines.select(*rest, "line", hashes(leaders, lambda s: F.hash(s).bitwiseOR(F.lit(-(1 << 31)))).alias("led"))
    enough = (F.size("led") >= MINIMA) & (F.length(line) >= LONG)
    own = led.select(*rest, "line", "led", F.when(~enough, _changed(line, SIGNED, lambda s: F.hash(s).bitwiseAND(low))).alias("own"))
    both = own.select(
        *rest, F.coalesce(F.size("own"), F.lit(LONG)).alias("n_a"), F.when(F.col("own").isNull(), first(F.col("led"))).otherwise(first(F.concat("led", "own"))).alias("a"),
        F.when(F.size("own") <= FEW, first(_changed(line, SHINGLE, lambda s: F.hash(s)))).alias("b"),
    )
    values = lambda name: [F.get(name, F.lit(i)).alias(f"{name}{i}") for i in range(MINIMA)]
    return both.select(*rest, "n_a", F.coalesce(F.size("b"), F.lit(0)).alias("n_b"), *values("a"), *values("b"))


def band_keys(signed: DataFrame) -> DataFrame:
    """(key, node) of each band: ROWS (of the shorter shingles: two) neighbouring minima, wherever in the signature they stand."""
    long_ = [F.when((F.col("n_a") >= MANY) & (F.col("n_a") >= i + ROWS), F.xxhash64(*(f"a{i + r}" for r in range(ROWS)))) for i in range(MINIMA - ROWS + 1)]
    short = [F.when(F.col("n_b") >= i + 2, F.xxhash64(F.lit("pair"), f"b{i}", f"b{i + 1}")) for i in range(MINIMA - 1)]
    one = F.when(F.col("n_b") == 1, F.xxhash64(F.lit("one"), "b0"))
    return signed.select("node", F.explode(F.array(*long_, *short, one)).alias("key")).where("key is not null")


def bits_of(texts: DataFrame) -> DataFrame:
    """(node, size, b0..) of texts' lines: each different shingle turns one bit, so as many bits as differ between two sets, the sets differ in at least."""
    sets = texts.select("node", hashed(F.col("line"), SHINGLE).alias("set")).withColumn("size", F.size("set").cast("long"))
    # a row takes AT_ONCE shingles, which saves most of the lookups of its node
    rows = sets.select("node", "size", "set", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1, F.lit(AT_ONCE))).alias("i"))
    own = [F.get("set", F.col("i") + k) for k in range(AT_ONCE)]
    rows = rows.select("node", "size", *(F.pmod(F.shiftright(s, 6), F.lit(BIT_LONGS)).alias(f"slot{k}") for k, s in enumerate(own)), *(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int")).alias(f"bit{k}") for k, s in enumerate(own)))
    zero = F.lit(0).cast("long")
    turned = [reduce(Column.bitwiseXOR, (F.when(F.col(f"slot{k}") == j, F.col(f"bit{k}")).otherwise(zero) for k in range(AT_ONCE))) for j in range(BIT_LONGS)]
    return rows.groupBy("node").agg(F.max("size").alias("size"), *(F.coalesce(F.bit_xor(x), zero).alias(f"b{j}") for j, x in enumerate(turned)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without lines that repeat another line, exactly or nearly.

    Equal lines are one by their 128-bit hash. Each is signed by the least
    hashes of all its character shingles (see signatures); lines that share a
    band of neighbouring minima are compared (link_classes tells which) by the
    exact Jaccard similarity of the sets of their 5-character shingles; a
    shorter line is its own shingle. Linked lines form components by
    distributed union-find. Of a component's occurrences the first line in the
    document with the least id stays.

    All columns of docs come back, text without the removed lines, and with
    them n_lines and n_removed (renamed out of the way of columns of those
    names: theirs are replaced). Ids must be integers. Lines are split at
    newlines; blank ones stay and are never compared. Null texts stay null, with
    no lines; a text whose lines all go is empty. Rows that share an id are one
    document: their lines at a place stay or go together. Rows with a null id
    stay as they are. An empty table gives no rows.
    """
    line = F.col("line")
    lines = (
        docs.select(F.col(id_col).cast("long").alias("d"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
        .where("trim(line) <> '' and d is not null")
        .select("d", "at", "line", F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("h2"))
    )
    keyed = signatures(lines.drop("at"))
    # equal lines have equal signatures, so their least is that of any
    values = [c for c in keyed.columns if c not in ("d", "h", "h2")]
    packed = [F.min(F.call_function("shiftleft", F.coalesce(x, F.lit(0)).cast("long"), F.lit(32)).bitwiseOR(F.coalesce(y, F.lit(0)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(x) for x, y in zip(values[::2], values[1::2], strict=True)]
    signed = keyed.groupBy("h", "h2").agg(F.min("d").alias("first_doc"), F.count(F.lit(1)).alias("n"), *packed).withColumn("node", F.monotonically_increasing_id())
    signed = stored(signed)
    unpacked = signed.select("node", *(c for x, y in zip(values[::2], values[1::2], strict=True) for c in (F.shiftright(x, 32).alias(x), F.shiftright(F.shiftleft(x, 32), 32).alias(y))))

    members = shared_buckets(band_keys(unpacked))
    wanted = cut(signed.join(members.select("node").distinct(), "node", "left_semi").select("node", "h", "h2", F.col("first_doc").alias("d")))
    some = likely_in(lines.select("d", "h", "h2", "line"), "h", wanted.select("h"))
    texts = cut(some.join(wanted, ["h", "h2", "d"]).select("node", "line").dropDuplicates(["node"]))

    traits = cut(bits_of(texts))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("node").alias("a"), F.col("line").alias("la")), texts.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        sets = pairs.join(a, "a").join(b, "b").select("a", "b", hashed(F.col("la"), SHINGLE).alias("x"), hashed(F.col("lb"), SHINGLE).alias("y"))
        sizes = sets.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
        return cut(sizes).where(F.col("both") >= similarity * (F.col("all") - F.col("both")) - 1e-9).select("a", "b")

    classes = link_classes(members, traits, lambda x, y: plausible(x, y, similarity), verify, similarity)
    classed = signed.select("node", "h", "h2", "first_doc", "n").join(classes, "node", "left")
    winners = classed.where("comp is not null").groupBy("comp").agg(F.min("first_doc").alias("keep_doc"))
    flagged = cut(classed.where("comp is not null or n > 1").join(winners, "comp", "left").select("h", "h2", F.coalesce("comp", "node").alias("comp"), F.coalesce("keep_doc", "first_doc").alias("keep_doc")))
    repeated = likely_in(lines.select("d", "at", "h", "h2"), "h", flagged.select("h")).join(flagged, ["h", "h2"])
    places = repeated.groupBy("d").agg(F.array_sort(F.collect_set(F.struct("comp", "at", (F.col("d") == F.col("keep_doc")).alias("own")))).alias("p"))
    stays = lambda x, i: x["own"] & ((i == 0) | (F.get("p", i - 1)["comp"] != x["comp"]))
    gone = cut(places.select("d", F.transform(F.filter("p", lambda x, i: ~stays(x, i)), lambda x: x["at"]).alias("gone")).where("size(gone) > 0"))
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("d"))
    marked = with_likely(every, "d", gone.select("d"))
    touched = marked.where("likely").select("row", "d").join(gone, "d", "left").select("row", "gone")
    out = touched.unionByName(marked.where("not likely").select("row"), allowMissingColumns=True)
    out = out.withColumn("lines", F.split(F.col("row")[text_col], "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.col("lines")[i])
    text = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("row")[text_col])
    return out.select(
        *(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
    )
