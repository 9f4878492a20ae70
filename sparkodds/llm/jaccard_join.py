"""Documents linked by the Jaccard similarity of their word shingles, exactly.

Links are those of 100 * intersection >= PERCENT * union. Equal sets are one
entry, whatever number of documents has them.

1. One order of all shingles: those that many documents have come last, the rest
   by hash. Which they are is counted over all documents, in windows whose
   frequent shingles are summed.
2. Linked sets share a shingle among the first ones in that order (so many that
   the rest alone couldn't reach the similarity), and several among a few more.
   Sets that share fewer with all others together are linked with none: this is
   where the work stops growing with the square.
3. Each shared shingle names the least edited of its sets, the one that shares
   the largest part of its first shingles. Sets are compared with those, so that a
   large group of near copies becomes one component after about as many
   comparisons as it has members.
4. What is left are shared shingles between components. Their sets go into tiles,
   one for each shingle and size band: only sizes within PERCENT of each other can
   be linked, so a set meets its own band and the next. Within a tile the places
   of the shared shingle bound the overlap from above; a crowded tile is cut.
5. Hashed bitmaps of the pairs that pass bound it once more by their bit counts,
   and what is left is decided by intersecting the sorted arrays.

Arrays exist only for sets that passed the bitmaps, made again from the texts. No
pair is emitted within a component that step 3 has found, none is lost between
different ones.

Defined results: null text and text without words is an empty set, linked with
nothing; fewer than five words are one shingle; rows that repeat a doc_id are
rows of their own with equal component_id; component_id is the smallest non-null
doc_id of the component. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm import grid
from sparkodds.llm import shingles as sh
from sparkodds.llm.cells import pairs_in, whole_cells
from sparkodds.llm.common import give_back, read, spans
from sparkodds.llm.components import components
from sparkodds.session import materialize

PERCENT = 75

#: A shingle is frequent if so large a part of the documents has it, LEAST at least.
FREQUENT, LEAST = 1 / 1000, 64

#: Shingles that a task counts at once, and the count from which it reports one.
WINDOW, REPORTED = 2_000_000, 4

#: Sets that a tile may hold.
TILE = 4096

#: Places of the filter that picks documents to read again.
FILTER = 1 << 20


def least_overlap(n: int | np.ndarray) -> int | np.ndarray:
    """A linked set of n shingles shares so many of them at least."""
    return -(-n * PERCENT // 100)


def extra(n: int | np.ndarray) -> int | np.ndarray:
    """How many shingles, besides the first shared one, are looked at."""
    return n // 10


def least_shared(n: F.Column) -> F.Column:
    """Linked sets share so many of the shingles that are looked at: the smaller
    of both has PERCENT of n, and 1 + extra of those."""
    return 1 + F.floor(F.ceil(n * PERCENT / 100) / 10)


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= PERCENT * (n + m - common)


def sets_of(parts: Iterator[pd.DataFrame], late: np.ndarray | None = None) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with their texts' sets, about CHUNK bytes at a time."""
    for part in parts:
        texts = [t if isinstance(t, str) else "" for t in part["text"]]
        for piece in spans([len(t) for t in texts], sh.CHUNK):
            yield part.iloc[piece], sh.shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts[piece]], late)
        give_back()


def with_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, none, text): ids without nulls, of which pandas would make floats."""
    known = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(known, F.lit(0)).alias("doc_id"), known.isNull().alias("none"), "text")


def identities(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set, n) of all documents, and (shingle, n) of frequent ones."""
    schema = "doc_id long, set long, n int, shingles array<long>, counts array<int>"

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window: list[np.ndarray] = []
        held = 0

        def report() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(window), return_counts=True)
            some = counts >= REPORTED
            row = {"doc_id": None, "set": None, "n": None, "shingles": values[some].astype(np.int64), "counts": counts[some].astype(np.int32)}
            return frame([tuple(row.values())])

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "set", "n", "shingles", "counts"], dtype=object)
            return out.astype({"doc_id": "Int64", "set": "Int64", "n": "Int32"})

        for rows, sets in sets_of(frames):
            ids = zip(rows["doc_id"].tolist(), rows["none"].tolist(), strict=True)
            yield frame([(None if none else i, sh.set_id(s), len(s), None, None) for (i, none), s in zip(ids, sets, strict=True)])
            window += sets
            held += sum(map(len, sets))
            if held >= WINDOW:
                yield report()
                window, held = [], 0
        if window:
            yield report()

    found = materialize(with_ids(docs).mapInPandas(parts, schema))
    members = found.where(F.col("n").isNotNull()).select("doc_id", "set", "n")
    reported = found.where(F.col("n").isNull()).select(F.explode(F.arrays_zip("shingles", "counts")).alias("r"))
    return members, reported.groupBy(F.col("r.shingles").alias("shingle")).agg(F.sum("r.counts").alias("n"))


def first_shingles(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """(shingle, set, n, place): the shingles by which a set may meet others, and
    their places in its order. A set is given once for each partition that has it."""
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[int] = set()
        for _, sets in sets_of(frames, sent.value):
            some = []
            for s in sets:
                name = sh.set_id(s)
                if name is not None and name not in given:
                    given.add(name)
                    some.append((name, len(s), s[: len(s) - least_overlap(len(s)) + 1 + extra(len(s))]))
            if some:
                length = [len(x) for _, _, x in some]
                yield pd.DataFrame(
                    {
                        "shingle": np.concatenate([x for _, _, x in some]).astype(np.int64),
                        "set": np.repeat(np.array([x for x, _, _ in some], np.int64), length),
                        "n": np.repeat(np.array([x for _, x, _ in some], np.int32), length),
                        "place": np.concatenate([np.arange(x, dtype=np.int32) for x in length]),
                    }
                )

    return docs.select("text").mapInPandas(parts, "shingle long, set long, n int, place int")


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows whose shingle several sets have, once for each set. Sorted partitions
    are read as a stream; nothing is held but the row before."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: pd.DataFrame | None = None
        before_given = False
        for part in frames:
            if not len(part):
                continue
            whole = part if before is None else pd.concat([before, part], ignore_index=True)
            shingle, name = whole["shingle"].to_numpy(), whole["set"].to_numpy()
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])])
            whole, shingle = whole[new], shingle[new]
            start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            length = np.diff(np.concatenate([start, [len(shingle)]]))
            keep = np.repeat(length > 1, length)
            if before is not None and before_given:
                keep[0] = False
                keep[1 : length[0]] = True
            before_given = bool(length[-1] > 1 or (len(length) == 1 and before is not None and before_given))
            before = whole.iloc[[-1]].reset_index(drop=True)
            if keep.any():
                yield whole[keep]

    return rows.repartition("shingle").sortWithinPartitions("shingle", "set").mapInPandas(parts, rows.schema)


def read_again(docs: DataFrame, members: DataFrame, wanted: DataFrame, value: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(set, size, ``name``) of the wanted sets, from the text of one document of
    each. A filter of bounded size picks the documents on the way; what it lets
    through besides is joined away."""
    chosen = members.join(wanted.select("set"), "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    chosen = materialize(chosen)
    at = chosen.select(grid.dealt(F.col("doc_id"), FILTER).alias("at")).distinct().toPandas()["at"]
    places = np.zeros(FILTER, bool)
    places[at.dropna().to_numpy(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(places))

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.unpackbits(sent.value).astype(bool)
        for part in frames:
            hit = part["none"].to_numpy(bool) | places[grid.dealt_ids(part["doc_id"].to_numpy(np.int64), FILTER)]
            if hit.any():
                yield part[hit]

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in sets_of(picked(frames)):
            some = [i for i, s in enumerate(sets) if len(s)]
            ids = rows.iloc[some]
            yield pd.DataFrame(
                {
                    "own": ids["doc_id"].astype("Int64").where(~ids["none"].to_numpy(bool)).reset_index(drop=True),
                    "set": pd.Series([sh.set_id(sets[i]) for i in some], dtype="int64"),
                    "size": pd.Series([len(sets[i]) for i in some], dtype="int32"),
                    name: pd.Series([value(sets[i]).tobytes() for i in some], dtype=object),
                }
            )

    made = with_ids(docs).mapInPandas(parts, f"own long, set long, size int, {name} binary")
    named = chosen.select(F.col("set").alias("of"), "doc_id")
    return materialize(
        made.join(named, (F.col("set") == F.col("of")) & F.col("own").eqNullSafe(F.col("doc_id")))
        .groupBy("set")
        .agg(F.first("size").alias("size"), F.first(name).alias(name))
    )


def with_both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with size and ``name`` of both."""
    for side in ("a", "b"):
        own = of.select(F.col("set").alias(f"of_{side}"), F.col("size").alias(f"n_{side}"), F.col(name).alias(f"{name}_{side}"))
        pairs = pairs.join(own, F.col(side) == F.col(f"of_{side}")).drop(f"of_{side}")
    return pairs


def may_link(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps leave possible."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            keep = []
            for n, m, x, y in zip(part["n_a"], part["n_b"], part["signature_a"], part["signature_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                bound = sh.overlap_bound(n, sh.folded(x, words), np.array([m]), sh.folded(y, words)[None, :])[0]
                keep.append(linked(int(bound), n, m))
            yield part.loc[keep, ["a", "b"]]

    sized = with_both(pairs, signatures, "signature")
    sized = sized.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return sized.mapInPandas(parts, "a long, b long")


def verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs (a, b) that are linked, by their arrays."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            keep = []
            for x, y in zip(part["members_a"], part["members_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(linked(int((y[at] == x).sum()), len(x), len(y)))
            yield part.loc[keep, ["a", "b"]]

    return with_both(pairs, arrays, "members").mapInPandas(parts, "a long, b long")


def band(n: F.Column) -> F.Column:
    """Size bands whose members lie within PERCENT of each other."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")


CELL = ["shingle", "band", "x", "y"]


def tiles(rows: DataFrame) -> DataFrame:
    """(shingle, set, n, place, root) rows dealt into tiles.

    A set stands in the tile of its own band and asks in the one below. A crowded
    shingle is cut into pieces, and its tiles (x, y) hold two pieces each."""
    crowd = rows.groupBy(F.col("shingle").alias("of")).agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("cuts"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    apart = crowd.where(F.col("low") != F.col("high")).select("of", "cuts")
    piece = F.pmod(F.xxhash64(F.lit(3), "set"), F.col("cuts")).cast("int")
    cells = rows.join(apart, F.col("shingle") == F.col("of")).withColumn("piece", piece)
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    cells = cells.select("shingle", "set", "n", "place", "root", "piece", other)
    own = band(F.col("n"))
    bands = F.array(F.struct(own.alias("band"), F.lit(False).alias("asks")), F.struct((own - 1).alias("band"), F.lit(True).alias("asks")))
    return cells.select(
        "shingle", "set", "n", "place", "root", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"), F.inline(bands)
    )


def tile_pairs(tiled: DataFrame) -> DataFrame:
    """(a, b) of different components that sizes and places in a tile leave possible."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cell in whole_cells(frames, CELL):
            n, place, root, name = (part[x].to_numpy(np.int64) for x in ("n", "place", "root", "set"))
            asks = part["asks"].to_numpy(bool)

            def possible(i: np.ndarray, j: np.ndarray, n=n, place=place, root=root, asks=asks) -> np.ndarray:
                rest = np.minimum(n[i] - place[i], n[j] - place[j])
                ok = (root[i] != root[j]) & ~(asks[i] & asks[j])
                ok &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
                return ok & (100 * rest >= PERCENT * (n[i] + n[j] - rest))

            for i, j in pairs_in(cell, n, PERCENT, possible):
                if len(i):
                    found = pd.DataFrame({"a": np.minimum(name[i], name[j]), "b": np.maximum(name[i], name[j])})
                    yield found.drop_duplicates()

    return tiled.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(parts, "a long, b long").distinct()


def links(docs: DataFrame, members: DataFrame, late: np.ndarray) -> DataFrame:
    """(a, b) sets whose links connect all linked sets; more are left out only
    within components."""
    met = materialize(shared_only(first_shingles(docs, late)))
    looked_at = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 + F.floor(F.col("n") / 10)
    enough = met.groupBy(F.col("set").alias("of")).agg(F.count("*").alias("shared"), F.min("n").alias("n"))
    enough = enough.where(F.col("shared") >= least_shared(F.col("n"))).select("of", (F.col("shared") / looked_at).alias("part"))
    first = F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    met = materialize(met.where(first).join(enough, F.col("set") == F.col("of")).drop("of"))
    # Shingles that bring together the same sets: the first of them will do, as it
    # is the first that any two of the sets share.
    groups = met.groupBy("shingle").agg(F.count("*").alias("crowd"), F.expr("bit_xor(xxhash64(set))").alias("all"))
    one = groups.where(F.col("crowd") > 1).groupBy("crowd", "all").agg(F.min("shingle").alias("shingle"))
    met = materialize(met.join(one.select("shingle"), "shingle", "left_semi"))
    hub = met.groupBy(F.col("shingle").alias("of")).agg(F.max_by("set", "part").alias("hub"))
    met = materialize(met.join(hub, F.col("shingle") == F.col("of")).select("shingle", "set", "n", "place", "hub"))
    signatures = read_again(docs, members, met.select("set").distinct(), sh.signature, "signature")

    hubs = met.where(F.col("set") != F.col("hub")).select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct()
    hubs = materialize(may_link(hubs, signatures))
    arrays = read_again(docs, members, hubs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), lambda s: s, "members")
    found = materialize(verified(hubs, arrays))

    roots = components(found).withColumnsRenamed({"node": "of", "root": "found"})
    rooted = met.join(roots, F.col("set") == F.col("of"), "left").select("shingle", "set", "n", "place", F.coalesce("found", "set").alias("root"))
    # Pairs decided above aren't decided again.
    left = materialize(tile_pairs(tiles(materialize(rooted))).join(hubs, ["a", "b"], "left_anti"))
    more = materialize(may_link(left, signatures))
    arrays = read_again(docs, members, more.select(F.explode(F.array("a", "b")).alias("set")).distinct(), lambda s: s, "members")
    return found.union(verified(more, arrays))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    members, reported = identities(docs)
    limit = max(LEAST, int(members.count() * FREQUENT))
    # At most 1 / FREQUENT times the mean number of shingles of a document.
    late = reported.where(F.col("n") >= limit).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    found = materialize(links(docs, members, np.sort(late.astype(np.uint64))))
    sets = members.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(found).withColumnsRenamed({"node": "of"})
    classes = materialize(sets.join(roots, F.col("set") == F.col("of"), "left").select("set", "first", "n", "root"))
    whole = classes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("component"))
    linked_sets = classes.join(whole, "root").select("set", "component")
    copies = classes.where(F.col("root").isNull() & (F.col("n") > 1)).select("set", F.col("first").alias("component"))
    of = materialize(linked_sets.union(copies).withColumnRenamed("set", "of"))
    return members.join(of, F.col("set") == F.col("of"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM w),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS both_have
  FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * both_have >= 75 * (n + m - both_have)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, min(r.other)) AS component_id
FROM sets s LEFT JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""
