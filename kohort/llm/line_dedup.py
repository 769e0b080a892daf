"""Removal of repeated multi-line chunks, with content-defined borders at two widths.

Lines that aren't blank are the units; blank ones belong to the stretch around
them.  A rolling hash over each pair of neighbouring units' lines decides where
chunks end: behind every pair whose hash is smaller than those of the pairs
before and after.  A border thus depends on four neighbouring units alone, and
units inserted or lost elsewhere shift none.  Chunks of two units or more are
counted over the whole corpus by hash, and all but the first of each are later
ones: copies and long passages are settled by a few rows a document.

A short passage may hold no whole chunk, and a long one reaches beyond its
chunks.  So the pairs themselves are the chunks of the finest width: those of
the chunks that aren't later ones, and those that cross a border.  Every
repeated stretch of two units or more is found whole in this way: the first
occurrence of a pair never lies inside a later chunk, for then the chunk's
first occurrence would hold the pair earlier.

The texts of what repeats by hash are compared byte by byte (Spark groups them
by the text itself), and every occurrence but the first is removed.  (Two
texts with one 64-bit hash can at most hide the pairs of the later one from
the second step; nothing is removed by a hash.)

DataFrame operations only.  Counts combine before the shuffle, joins are split
by adaptive execution where a chunk is hot, and the documents' texts are
shuffled twice, by document: once for the bytes to compare and once for the
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import ROW_ID, let, packed, row_id, stored


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _chunks(text: Column) -> Column:
    """Array of (first, stop, n, hash, starts, keys): a chunk's lines from first to before stop, its number of
    units, its hash, the lines at which its units and the next one start, and the hashes of the pairs that
    start in it."""
    def of_lines(h, units):
        def span(start, end):
            return F.xxhash64(F.slice(h, start + 1, end - start + 1))

        def of_pairs(r):
            ends = _present(F.transform(units, lambda _, k: F.when(
                (k == F.size(units) - 1) | ((F.get(r, k - 1) < F.coalesce(F.get(r, k - 2), F.lit(2**63 - 1)))
                                            & (F.get(r, k - 1) < F.get(r, k))), k)))

            def chunk(e, last, pos):
                a = F.coalesce(F.get(e, pos - 1) + 1, F.lit(0))
                first, end, n = F.get(units, a), F.get(units, last), last - a + 1
                return F.struct(first.alias("first"), (end + 1).alias("stop"), n.alias("n"), span(first, end).alias("hash"),
                                F.slice(units, a + 1, n + 1).alias("starts"), F.slice(r, a + 1, n).alias("keys"))
            return let(ends, lambda e: F.transform(e, lambda last, pos: chunk(e, last, pos)))
        pairs = _present(F.transform(units, lambda x, k: F.when(k < F.size(units) - 1, span(x, F.get(units, k + 1)))))
        return let(pairs, of_pairs)

    def of(lines):
        units = _present(F.transform(lines, lambda x, i: F.when(F.length(F.trim(x)) > 0, i)))
        return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: let(units, lambda u: of_lines(h, u)))
    return let(F.split(text, "\n"), of)


def _candidates(docs: DataFrame) -> DataFrame:
    """(row identity, first, stop) of the chunks and pairs whose hash occurs more than once."""
    chunks = stored(docs.filter("text is not null").select(*row_id(), F.explode(_chunks(F.col("text"))).alias("c"))
                         .select(*ROW_ID, "c.*").distinct())
    at = F.struct(*ROW_ID, "first")
    # tables of their own, so that adaptive execution can split a hot hash in the joins
    often = stored(chunks.filter("n > 1").groupBy("hash").agg(F.min(at).alias("kept"), F.count("*").alias("times"))
                        .filter("times > 1").select("hash", "kept"))
    again = F.col("kept").isNotNull() & (F.col("n") > 1)
    known = stored(chunks.join(often, "hash", "left").select(
        *ROW_ID, "first", "stop", "n", "starts", "keys", again.alias("again"), (again & (at != F.col("kept"))).alias("later")))
    pairs = F.transform("keys", lambda key, k: F.when(~F.col("later") | (k == F.col("n") - 1), F.struct(
        F.get("starts", k).alias("first"), (F.get("starts", k + 1) + 1).alias("stop"), key.alias("hash"))))
    pairs = known.select(*ROW_ID, F.explode(_present(pairs)).alias("p")).select(*ROW_ID, "p.*")
    twice = stored(pairs.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash"))
    place = [*ROW_ID, "first", "stop"]
    return known.filter("again").select(*place).unionByName(pairs.join(twice, "hash").select(*place))


def repeated(docs: DataFrame) -> DataFrame:
    """(row identity, gone): for every document with stretches that repeat earlier ones, their lines as pairs
    (first, stop), from 0, stop excluded, sorted; neighbours may overlap, but neither first nor stop descends.

    Documents are ordered by doc_id (null last), then by a hash of the text;
    within a document the earlier stretch is first.
    """
    where = (_candidates(docs).groupBy(*ROW_ID)  # at most a document's chunks and pairs
             .agg(F.collect_set(F.struct("first", "stop")).alias("spans")))
    held = docs.select("text", *row_id()).join(where, ROW_ID)

    def of(lines):
        return F.transform("spans", lambda s: F.struct(
            F.array_join(F.slice(lines, s["first"] + 1, s["stop"] - s["first"]), "\n").alias("chunk"),
            s["first"].alias("first"), s["stop"].alias("stop")))
    texts = held.select(*ROW_ID, F.explode(let(F.split("text", "\n"), of)).alias("c"))
    texts = stored(texts.select("c.chunk", F.struct(*ROW_ID, "c.first").alias("at"), "c.stop"))
    # likewise a table of its own, for the join by the stretch's text
    earliest = stored(texts.groupBy("chunk").agg(F.min("at").alias("kept"), F.count("*").alias("times"))
                           .filter("times > 1").select("chunk", "kept"))
    return (texts.join(earliest, "chunk").filter("at <> kept")
            .groupBy(*[F.col(f"at.{c}").alias(c) for c in ROW_ID])
            .agg(F.array_sort(F.collect_set(F.struct("at.first", "stop"))).alias("gone")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc, new_text, n_lines, n_removed) of every row: ``doc`` is the whole row, new_text its text without
    repeated stretches, the numbers count lines.

    Lines are removed from one that isn't blank to the next such one if the
    same bytes stand, from line to line, earlier in the corpus; the first
    occurrence of a line always stays.  Lines are blank if they are empty or
    spaces.  Null texts stay null with 0 lines; an empty text is one line.
    Repeated rows (same doc_id and text) are one document and get the same
    result.  Further columns may have any name; an empty table gives no rows.
    """
    rest = packed(docs).select("doc", "text", *row_id()).join(repeated(docs), ROW_ID, "left")

    def before(i):
        return F.coalesce(F.get("gone", i - 1)["stop"], F.lit(0))

    def between(lines):
        """The lines before, between and behind the removed ones."""
        def part(i):
            end = F.coalesce(F.get("gone", i)["first"], F.size(lines))
            return F.slice(lines, before(i) + 1, F.greatest(F.lit(0), end - before(i)))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), part)), "\n")
    kept = let(F.split("text", "\n"), between)
    fresh = F.transform("gone", lambda g, i: g["stop"] - F.greatest(g["first"], before(i)))
    removed = F.aggregate(fresh, F.lit(0).cast("long"), lambda s, x: s + x)
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rest.select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("new_text"),
                       F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(removed, F.lit(0)).alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the new text and its length; documents of which lines went and nothing but blank ones is
    left go, as all they hold stands elsewhere."""
    empty = F.trim(F.replace("new_text", F.lit("\n"), F.lit(" "))) == ""
    found = deduplicated(docs).filter((F.col("n_removed") == 0) | ~empty)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
