"""Near-duplicate lines, by an exact set-similarity join in DataFrame functions.

A line is the set of its words; two lines match when their Jaccard similarity
reaches a threshold. A line that matches an earlier one, by (doc_id, line
number), is removed from its document. Lines of equal sets match whatever their
word order is and count as one set, placed where the first of them stands.

For the rest: the words of two matching sets of n and m words differ in at most
(n + m) * (100 - PERCENT) / (100 + PERCENT). So words are dealt by hash into one
bucket more than that, and some bucket is the same in both sets; its words and
number, hashed, are a mark that both have. How many buckets there are goes by
classes of sizes, and a set is marked for each class that the smaller set of a
match may be in. A bucket of few words is no rare mark by itself, so the other words
are dealt once more, and each of their buckets makes a mark with it: if the small
bucket is the same in both, one of those is, too.

Sets that share a mark are compared by their words, first each with the earliest set
of its mark, in a few rounds: most of a group of near copies match that one, so
pairs grow with the group and not with its square. Only sets that match none
of these meet all earlier sets of their marks.

Defined results: null text stays null; lines without words are left alone and
match nothing; rows that repeat doc_id and text are one document, their copies
lose the same lines; rows that repeat a doc_id with other texts tie where their
lines have one number, and such lines don't remove each other; a null doc_id
comes last. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm.common import read
from sparkodds.session import materialize

#: Two lines match from this similarity on, in hundredths.
PERCENT = 90

#: Sets of fewer words only match equal ones: n words match m > n of them only if
#: 100 * n >= PERCENT * (n + 1).
LEAST = math.ceil(PERCENT / (100 - PERCENT))

#: Words of a bucket that is no mark by itself, in sets of at most SPLIT buckets.
FEW, SPLIT = 2, 32

#: Columns of a bitmap of 64 bits each; a word has one bit in one of them.
MAPS = ["s0", "s1", "s2", "s3"]

#: Rounds in which sets meet one earlier set of each mark.
ROUNDS = 2

#: Bytes up to which a table that Spark has written is sent to all executors.
SENT = 64 << 20

_LAST = 2**63 - 1


def lines(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, line_no, line) of all lines with words, trimmed."""
    texts = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.split("text", "\n").alias("lines"),
    )
    each = texts.select("doc", "text_hash", F.posexplode("lines").alias("line_no", "line"))
    trimmed = F.btrim("line", F.lit(" \t\x0b\x0c\r"))
    return each.withColumn("line", trimmed).where(F.col("line") != "")


def ordered(line: Column) -> Column:
    """The line's distinct words as hashes, sorted."""
    for space in "\t\x0b\x0c\r":  # one sign can be split at without a pattern
        line = F.replace(line, F.lit(space), F.lit(" "))
    words = F.array_distinct(F.transform(F.split(line, " "), lambda word: F.xxhash64(word)))
    return F.sort_array(F.array_remove(words, F.xxhash64(F.lit(""))))


def ceil_div(n: Column, d: int) -> Column:
    return F.floor((n + (d - 1)) / d).cast("int")


def classes() -> list[tuple[int, int]]:
    """(end, buckets): sets below ``end`` words, and of no class before, whose
    match with an equal or larger set is found by so many buckets."""
    out, end = [], LEAST
    while end < 2**31:
        end = max(end + LEAST, end * 7 // 5 // LEAST * LEAST)
        out.append((end, (end - 1) * (100 - PERCENT) // PERCENT + 1))
    return out


def n_buckets(n: Column) -> Column:
    """Buckets of the class of n words."""
    (end, k), *rest = classes()
    found = F.when(n < end, k)
    for end, k in rest:
        found = found.when(n < F.lit(end), k)
    return found


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x computed once; functions of arrays compute what they hold each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def cut(words: Column, bounds: Column) -> Column:
    """Sorted words, cut before each of the sorted bounds."""

    def parts(both: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(bounds, lambda b: F.array_position(both, b).cast("int")), F.array(F.size(both) + 1))
        # A part ends before the bound that stands behind it.
        part = lambda end: lambda i: F.slice(both, F.get(end, i) + 1, F.get(end, i + 1) - F.get(end, i) - 1)
        return let(ends, lambda end: F.transform(F.sequence(F.lit(0), F.size(end) - 2), part(end)))

    return let(F.sort_array(F.concat(words, bounds)), parts)


def bound(at: Column, k: Column) -> Column:
    """Of k equal parts of all hashes the lower bound of part ``at``."""
    return (2 * at - k).cast("long") * F.floor(F.lit(_LAST) / k.cast("decimal(10,0)")).cast("long")


def dealt(words: Column, k: Column) -> Column:
    """The words in k buckets, some buckets together first, so that long lines
    don't take words times buckets."""
    wide = F.greatest(F.lit(SPLIT), F.ceil(F.sqrt(k)).cast("int"))

    def bounds(first: Column, last: Column, step: Column) -> Column:
        at = F.sequence(first, last, step)
        return F.transform(F.slice(at, F.lit(2), F.size(at)), lambda j: bound(j, k))

    groups = cut(words, bounds(F.lit(0), k - 1, wide))
    own = lambda group, g: cut(group, bounds(g * wide, F.least(g * wide + wide, k) - 1, F.lit(1)))
    return F.when(k <= SPLIT, cut(words, bounds(F.lit(0), k - 1, F.lit(1)))).otherwise(F.flatten(F.transform(groups, own)))


def marks(words: Column, k: Column) -> Column:
    """The marks of a set for k buckets."""

    def again(own: Column, j: Column) -> Column:
        # k buckets of the other words, over all hashes but the own bucket's.
        def other(s: Column) -> Column:
            at = s * (k - 1)
            return bound(at + F.when(at >= j * k, k).otherwise(0), k * k)

        others = cut(F.array_except(words, own), F.transform(F.sequence(F.lit(1), k - 1), other))
        return F.transform(others, lambda rest, s: F.xxhash64(k, j, own, s, rest))

    def of(own: Column, j: Column) -> Column:
        return F.when((F.size(own) > FEW) | (k > SPLIT), F.array(F.xxhash64(k, j, own))).otherwise(again(own, j))

    return F.flatten(F.transform(dealt(words, k), of))


def line_sets(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, line_no, set, n, marks): all lines with words; no marks for
    sets so small that only equal ones match."""
    sets = lines(docs).select("doc", "text_hash", "line_no", ordered(F.col("line")).alias("words"))
    n = F.size("words")
    sets = sets.withColumn("n", n).withColumn(
        "ks", F.when(n >= LEAST, F.array_distinct(F.array(n_buckets(ceil_div(n * PERCENT, 100)), n_buckets(n))))
    )
    found = F.flatten(F.transform("ks", lambda k: marks(F.col("words"), k)))
    return sets.select("doc", "text_hash", "line_no", F.xxhash64("words").alias("set"), "n", found.alias("marks"))


def sent_if_small(df: DataFrame) -> DataFrame:
    """A written table, sent whole to the executors if its files are small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= SENT else df


def words_of(docs: DataFrame, every: DataFrame, start: DataFrame) -> DataFrame:
    """(of, words) of sets, from the documents that they stand in first; start: of, start."""
    here = (F.col("set") == F.col("of")) & (place() == F.col("start"))
    homes = every.join(start, here).select("of", F.col("doc").alias("home"), F.col("text_hash").alias("home_hash"), "line_no")
    own = materialize(homes.groupBy("home", "home_hash").agg(F.collect_list(F.struct("line_no", "of")).alias("spots")))
    there = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("hash"), "text"
    )
    line = F.btrim(F.get("lines", F.col("spot.line_no")), F.lit(" \t\x0b\x0c\r"))
    return (
        there.join(sent_if_small(own), (F.col("doc") == F.col("home")) & (F.col("hash") == F.col("home_hash")))
        .select(F.split("text", "\n").alias("lines"), F.explode("spots").alias("spot"))
        .select(F.col("spot.of").alias("of"), ordered(line).alias("words"))
        .groupBy("of")
        .agg(F.first("words").alias("words"))
    )


def bitmaps() -> list[Column]:
    """Of ``words``, see MAPS."""
    own = "filter(words, w -> cast(w & 3 as int) = {0})"
    return [F.expr(f"aggregate({own.format(i)}, 0L, (bits, w) -> bits | shiftleft(1L, cast(shiftright(w, 2) & 63 as int)))").alias(s) for i, s in enumerate(MAPS)]


def close(other: str) -> Column:
    """Whether sizes and bitmaps let a set match that whose columns end so. Sets
    of n and m words need c common ones, 100 * c >= PERCENT * (n + m - c), and the
    bitmaps' difference is at most the words'."""
    m = f"n{other}"
    total = F.col("n") + F.col(m)
    differ = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(s + other))) for s in MAPS)
    sizes = 100 * F.least("n", m) >= PERCENT * F.greatest("n", m)
    return sizes & (differ <= total - 2 * ceil_div(total * PERCENT, 100 + PERCENT))


def matching(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(late) of the pairs (early, late) whose words match."""
    pairs = pairs.select("early", "late").distinct()
    for name in ("early", "late"):
        own = words.select(F.col("of").alias(f"of_{name}"), F.col("words").alias(f"words_{name}"))
        pairs = pairs.join(own, F.col(name) == F.col(f"of_{name}"))
    common = F.size(F.array_intersect("words_early", "words_late"))
    either = F.size("words_early") + F.size("words_late") - common
    return pairs.where(100 * common >= PERCENT * either).select("late").distinct()


def members(every: DataFrame, firsts: DataFrame) -> DataFrame:
    """(mark, set, n, place) of the marks that several sets share."""
    marked = every.where(F.col("marks").isNotNull()).select("set", F.explode("marks").alias("mark"))
    # Copies of a line shrink to one row before the shuffle.
    several = marked.groupBy("mark").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low != high")
    several = materialize(several.select(F.col("mark").alias("shared")))
    own = marked.join(sent_if_small(several), F.col("mark") == F.col("shared")).select("mark", "set").distinct()
    known = firsts.select(F.col("set").alias("of"), "n", "place")
    return own.join(known, F.col("set") == F.col("of")).select("mark", "set", "n", "place")


def late_sets(docs: DataFrame, every: DataFrame, firsts: DataFrame) -> DataFrame:
    """(late): sets that match one whose first line is earlier; every: line_sets;
    firsts: set, n, place."""
    sharing = materialize(members(every, firsts))
    start = materialize(sharing.select(F.col("set").alias("of"), F.col("place").alias("start")).distinct())
    words = materialize(words_of(docs, every, start).select("of", "words", *bitmaps()))
    sharing = materialize(sharing.join(words.select("of", *MAPS), F.col("set") == F.col("of")).drop("of"))
    early = sharing.select(F.col("mark").alias("of"), F.col("set").alias("early"), F.col("place").alias("since"), *(F.col(c).alias(f"{c}_e") for c in ("n", *MAPS)))
    meets = F.col("mark") == F.col("of")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = left.join(right, meets & (F.col("since") < F.col("place")) & close("_e"))
        return pairs.select("early", F.col("set").alias("late"))

    left, late, leads = sharing, [], None
    for _ in range(ROUNDS):
        ahead = left
        if leads is not None:
            ahead = left.join(leads, F.col("mark") == F.col("led")).where(F.col("place") > F.col("lead"))
        leads = materialize(ahead.groupBy(F.col("mark").alias("led")).agg(F.min("place").alias("lead")))
        first = materialize(early.join(leads, (F.col("of") == F.col("led")) & (F.col("since") == F.col("lead"))).drop("led", "lead"))
        late.append(materialize(matching(met(left, first), words)))
        left = materialize(left.join(late[-1], F.col("set") == F.col("late"), "left_anti"))
    late.append(matching(met(left, early), words))
    return reduce(DataFrame.union, late).distinct()


def place() -> Column:
    """A line's place in the corpus as one number, so that minima need no sorting."""
    return (F.col("doc").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")


def later_matches(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, line_no) of the lines that match an earlier one."""
    every = materialize(line_sets(docs))
    firsts = materialize(every.groupBy("set").agg(F.min(place()).alias("place"), F.max("n").alias("n")))
    late = materialize(late_sets(docs, every, firsts).withColumn("matched", F.lit(True)))
    known = firsts.join(late, F.col("set") == F.col("late"), "left").select(F.col("set").alias("of"), F.col("place").alias("start"), "matched")
    return (
        every.select("doc", "text_hash", "line_no", "set")
        .join(known, F.col("set") == F.col("of"))
        .where(F.col("matched").isNotNull() | (place() > F.col("start")))
        .select("doc", "text_hash", "line_no")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with later matches taken out of ``text``, all columns kept,
    as (row, n_lines, n_removed): ``row`` has the input's columns."""
    gone = later_matches(docs).groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    gone = materialize(gone)
    rows = docs.select(F.struct("*").alias("row"))
    key = (F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST)) == F.col("doc")) & (F.xxhash64("row.text") == F.col("text_hash"))
    split = F.split("row.text", "\n")
    kept = F.filter(split, lambda line, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return rows.join(sent_if_small(gone), key, "left").select(
        F.col("row").withField("text", text).alias("row"),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were removed, and the text that is left, as a digest."""
    return dedup(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_removed", F.md5(F.col("row.text").cast("binary")).alias("text_md5")
    )


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT doc_id, line_no, line,
         list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM l),
sets AS (
  SELECT s, len(s) AS n, min((doc_id, line_no)) AS place FROM t WHERE len(s) > 0 GROUP BY s),
late AS (
  SELECT DISTINCT b.s FROM sets a JOIN sets b
    ON a.n BETWEEN b.n * 0.9 AND b.n / 0.9 AND a.place < b.place AND a.n >= 9 AND b.n >= 9
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 90 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
marked AS (
  SELECT t.doc_id, t.line_no, t.line,
         t.s IN (SELECT s FROM late) OR (sets.place IS NOT NULL AND (t.doc_id, t.line_no) > sets.place) AS gone
  FROM t LEFT JOIN sets USING (s))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
