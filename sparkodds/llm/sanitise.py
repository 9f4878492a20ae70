"""Personal data, and the terms of the corpus that give it away.

Protected entities are mail addresses, IP addresses, card and phone numbers, found
by pattern and checked by their digits; each distinct value is an entity c. A word
t discloses c as far as seeing t makes c likely: with the corpus's places as
events, p(c) is the share of places that stand near c, p(c|t) the share of t's
places that do, PMI(c;t) = log(p(c|t) / p(c)) and IC(c) = -log(p(c)). A term whose
PMI(c;t) / IC(c) reaches 1 / ALPHA for any c is protected wherever it stands, if it
has been seen with c in SUPPORT different phrasings: near copies and passages that
repeat are one phrasing, known by the words next to c.

In the sanitised text, a protected term is generalised to its class, [NUMBER],
[WORD] or [CODE], if the class by the same measure discloses no entity, and taken
out otherwise; entities give way to their kind, [EMAIL] and so on.

Near c are the places of up to WORDS words on either side, within REACH characters
and up to the next datum of the kind. Terms are runs of letters, marks and digits,
compared in lower case. Occurrences whose surroundings overlap each count.

All of this is column expressions: matches and what lies between them give the
places, as running sums within blocks and over blocks, so that a text of many
matches costs no square of them. The patterns never go back over a run of
characters, so long texts cost in proportion.

Defined results: null and empty texts have no spans and stay as they are; spans are
in code points, ends exclusive, sorted by start and kind, kinds in the order of
KINDS; they may overlap, and where they do the sanitised text has the first one's
label. Rows that repeat are counted as often as they stand there. Columns other
than text are not read and are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm.common import read
from sparkodds.session import materialize

_LOCAL = "[A-Za-z0-9._%+-]"

#: Fixed patterns of the data looked for, written so that a run of characters is
#: entered at its start, or where the last match ended, and never given back.
KINDS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs without which a text has none of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

TERM = r"[\p{L}\p{M}\p{N}]++"

#: Words and characters on either side that are near; words that tell phrasings apart.
WORDS, REACH, PHRASE = 8, 100, 2

#: A term is protected from PMI / IC >= 1 / ALPHA on, if seen in so many phrasings.
ALPHA, SUPPORT = 1.25, 3

#: Elements of a block of running sums.
BLOCK = 256


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
        return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    """A value as it is compared."""
    if kind in ("card", "phone"):
        return F.regexp_replace(match, "[^0-9]", "")
    return F.lower(match)


def running(name: str) -> Column:
    """For each number of an array column the sum of those before it. A column, not
    an expression, since it is read once for each block."""
    values, last = F.col(name), lambda a: F.element_at(a, -1)
    summed = lambda a, start: F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))
    n = F.floor((F.size(values) + (BLOCK - 1)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), n), lambda b: F.slice(values, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
    starts = summed(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), F.lit(0))
    sums = F.zip_with(blocks, F.slice(starts, F.lit(1), n), lambda b, s: F.slice(summed(b, s), F.lit(1), F.size(b)))
    return F.when(F.size(values) > 0, F.flatten(sums)).otherwise(F.array().cast("array<int>"))


def steps(gaps: Column, matches: Column) -> Column:
    """The lengths of each match with the gap before it."""
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))


def places(name: str, matches: Column) -> Column:
    """Where matches begin, from the column of their steps."""
    ends = F.zip_with(running(name), F.col(name), lambda before, step: before + step)
    return F.zip_with(ends, matches, lambda end, m: end - F.length(m))


def _near(gap: Column, left: bool) -> Column:
    """The terms of the words next to a match that a gap ends at or begins with."""
    cut = F.right(gap, F.lit(REACH)) if left else F.left(gap, F.lit(REACH))
    words = F.regexp_extract_all(F.lower(cut), F.lit(TERM), F.lit(0))
    whole = F.length(gap) <= REACH  # else the outermost word may be cut
    n = F.size(words)
    if left:
        inner = F.slice(words, F.when(whole | (n == 0), 1).otherwise(2), n)
        return F.slice(inner, F.greatest(F.size(inner) - (WORDS - 1), F.lit(1)), F.lit(WORDS))
    return F.slice(words, F.lit(1), F.least(F.when(whole | (n == 0), n).otherwise(n - 1), F.lit(WORDS)))


def _spans(nth: int, kind: str, near: bool) -> Column:
    matches, gaps = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")

    def span(at: Column, i: Column) -> Column:
        match = F.get(matches, i)
        fields = [at.alias("start"), F.lit(nth).alias("kind"), (at + F.length(match)).alias("end"), _entity(kind, match).alias("entity")]
        if near:
            fields += [_near(F.get(gaps, i), True).alias("left"), _near(F.get(gaps, i + 1), False).alias("right")]
        return F.when(_valid(kind, match), F.struct(*fields))

    return F.array_compact(F.transform(places(f"__s_{kind}", matches), span))


def with_base(docs: DataFrame, near: bool = False) -> DataFrame:
    """The rows, as column ``row``, with ``base``: (start, kind, end, entity) of the
    data found by pattern, kind as a number; with the terms near them if asked for."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("__text"))
    none = F.array().cast("array<string>")
    for kind, pattern in KINDS.items():
        found = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
        may = F.contains("__text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("__text").isNotNull()
        rows = rows.withColumn(f"__m_{kind}", F.when(may, found).otherwise(none))
    for kind, pattern in KINDS.items():
        cut = F.when(F.size(f"__m_{kind}") > 0, F.split("__text", pattern, -1)).otherwise(none)
        rows = rows.withColumn(f"__g_{kind}", cut)
    rows = rows.withColumns({f"__s_{kind}": steps(F.col(f"__g_{kind}"), F.col(f"__m_{kind}")) for kind in KINDS})
    spans = [_spans(nth, kind, near) for nth, kind in enumerate(KINDS)]
    return rows.select("row", F.col("__text"), F.array_sort(F.concat(*spans)).alias("base"))


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, phrase, terms): for each datum the terms near it."""
    each = with_base(docs, near=True).select(F.explode("base").alias("x"))
    inner = F.array(*(F.get(F.reverse("x.left"), F.lit(i)) for i in range(PHRASE)), *(F.get("x.right", F.lit(i)) for i in range(PHRASE)))
    return each.select(
        F.concat_ws(":", F.col("x.kind").cast("string"), "x.entity").alias("entity"),
        F.xxhash64(inner).alias("phrase"),
        F.concat("x.left", "x.right").alias("terms"),
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, f) of all terms of the corpus."""
    terms = F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(TERM), F.lit(0))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("f"))


def category(term: Column) -> Column:
    """What a term is generalised to."""
    return F.when(F.rlike(term, F.lit(r"^\p{N}+$")), "NUMBER").when(F.rlike(term, F.lit(r"\p{N}")), "CODE").otherwise("WORD")


def _disclosed(pairs: DataFrame, near: DataFrame, total: int) -> DataFrame:
    """``pairs`` (entity, n, f, ...) with ``disclosure``, PMI / IC; near: entity, places."""
    of_c = near.select(F.col("entity").alias("of"), F.col("places"))
    met = pairs.join(of_c, F.col("entity") == F.col("of"))
    share_t, share_c = F.least(F.col("n") / F.col("f"), F.lit(1.0)), F.least(F.col("places") / F.lit(max(total, 1)), F.lit(1.0))
    value = F.when(share_c < 1, 1 - F.ln(share_t) / F.ln(share_c)).otherwise(0.0)
    return met.withColumn("disclosure", value).drop("of", "places")


def disclosing(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(term, disclosure, label) of the terms to protect; label: their class, or
    nothing where that would disclose too."""
    near = materialize(contexts(docs))
    places_near = near.groupBy("entity").agg(F.sum(F.size("terms")).alias("places"))
    met = near.select("entity", "phrase", F.explode("terms").alias("term"))
    by_phrase = met.groupBy("entity", "term", "phrase").agg(F.count("*").alias("n"))
    pairs = materialize(by_phrase.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("phrases")))
    counts = materialize(term_counts(docs))
    by_class = counts.groupBy(category(F.col("term")).alias("class")).agg(F.sum("f").alias("f"))
    f_of = {r["class"]: r.f for r in by_class.collect()}  # three rows
    total = sum(f_of.values())
    seen = pairs.where(F.col("phrases") >= support).join(counts, "term")
    terms = _disclosed(seen, places_near, total).where(F.col("disclosure") >= 1 / alpha)
    terms = terms.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    of_class = pairs.groupBy("entity", category(F.col("term")).alias("class")).agg(F.sum("n").alias("n")).join(by_class, "class")
    unsafe = {r["class"] for r in _disclosed(of_class, places_near, total).where(F.col("disclosure") >= 1 / alpha).select("class").distinct().collect()}
    safe = [c for c in ("NUMBER", "CODE", "WORD") if c not in unsafe]
    label = F.when(category(F.col("term")).isin(safe), category(F.col("term"))).otherwise("")
    return terms.withColumn("label", label)


def find(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, base, spans): all rows with the data found by pattern and all spans,
    (start, kind, end, label), the terms' after those of KINDS; terms: term, label."""
    word = lambda text: F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    each = texts.select(F.xxhash64("text").alias("of"), F.explode(F.array_distinct(word(F.lower("text")))).alias("term"))
    hits = materialize(each.join(terms, "term").groupBy("of").agg(F.collect_set(F.struct("term", "label")).alias("hits")))
    rows = with_base(docs).join(hits, F.xxhash64("__text") == F.col("of"), "left")
    some = F.col("hits").isNotNull()
    rows = rows.withColumn("__m", F.when(some, word(F.col("__text")))).withColumn("__g", F.when(some, F.split("__text", TERM, -1)))
    known = F.map_from_entries("hits")

    def span(at: Column, i: Column) -> Column:
        match = F.get("__m", i)
        label = F.element_at("__known", F.lower(match))
        alone = ~F.exists("base", lambda b: (b["start"] < at + F.length(match)) & (at < b["end"]))
        fields = [at.alias("start"), F.lit(len(KINDS)).alias("kind"), (at + F.length(match)).alias("end"), label.alias("label")]
        return F.when(label.isNotNull() & alone, F.struct(*fields))

    rows = rows.withColumn("__known", F.when(some, known)).withColumn("__s", steps(F.col("__g"), F.col("__m")))
    rows = rows.withColumn("__at", places("__s", F.col("__m")))
    more = F.when(some, F.array_compact(F.transform("__at", span)))
    names = F.array(*(F.lit(k.upper()) for k in KINDS))
    base = F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"], F.get(names, b["kind"]).alias("label")))
    both = F.when(some, F.array_sort(F.concat(base, more))).otherwise(base)
    return rows.select("row", "base", both.alias("spans"))


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The documents with all spans of ``text`` replaced by their labels in square
    brackets, or taken out where there is no label that doesn't disclose."""
    found = find(docs, disclosing(docs) if terms is None else terms)
    text = F.col("row.text").cast("string")

    def step(acc: Column, s: Column) -> Column:
        part = lambda upto: F.substring(text, acc["at"] + 1, upto - acc["at"])
        label = F.when(s["label"] == "", "").otherwise(F.concat(F.lit("["), s["label"], F.lit("]")))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], part(s["start"]), label).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.select(F.col("row").withField("text", F.when(F.size("spans") > 0, made).otherwise(text)).alias("row")).select("row.*")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the data of each kind, a digest of their spans, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, materialize(disclosing(docs)))
    count = lambda nth: F.size(F.filter("base", lambda b: b["kind"] == nth)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(count(nth).alias(f"n_{kind}") for nth, kind in enumerate(KINDS)),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
