"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers with
their places.  They are the seeds: the two words before a seed, digits blotted
out, are a lexical pattern for its kind.  Patterns and instances form a graph,
scored in turns: a pattern is worth the share of all its occurrences in the
corpus that stand before a trusted instance of its kind, and an instance that
is no seed is trusted when the patterns it follows make it likely enough.
Trusted instances raise further patterns in the next turn.  What stands behind
an accepted pattern and is trusted joins the base spans.

DataFrame and SQL functions only.  Places are code points; every rewriting of
a text before the places are taken replaces one character by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import ROW_ID, let, row_id
from kohort.session import materialize, scratch

KINDS = ("email", "ip", "card", "phone")
DOT, GAP, OPEN, SHUT = "\u0001", "\u0002", "\u0003", "\u0004"  # marks; a text's own ones count as U+0007
LABEL = "[A-Za-z0-9-]"
# A single dot between domain characters, and a single separator between digits, are marked beforehand, so that
# each pattern is a plain run of characters: no loop over groups, which would use the stack for each turn.
# A pattern may only start where the run it starts with does, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@{LABEL}++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{GAP}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

CONTEXT_WORD = 24  # a pattern's words have at most so many characters
WINDOW = 3 * CONTEXT_WORD
MIN_SEEDS = 5  # distinct trusted instances that a pattern needs
MIN_SCORE = 0.6
MIN_TRUST = 0.8
MIN_DIGITS = 4
CELLS = 2**20  # hash cells of patterns, a number each: some 16 MB
FIRST = 1024  # rows of the first part of the corpus in which patterns are counted
STEP = 16  # a further part has so many times the rows


def _marked(kind: str) -> Column:
    """The text with the kind's marks, one character for one."""
    text = F.translate("text", DOT + GAP + OPEN + SHUT, "\u0007" * 4)
    if kind == "email":
        return F.regexp_replace(text, rf"(?<={LABEL})\.(?={LABEL})", DOT)
    if kind == "card":
        return F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", GAP)
    return text


def _prefix_sums(sizes: Column) -> Column:
    """Sum of all elements before each one, in blocks, so that the work is n times its root."""
    block = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))

    def total(part):
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def of(b):
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / b).cast("int")), lambda k: total(F.slice(sizes, (k * b + 1).cast("int"), b)))
        starts = let(sums, lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))
        return let(starts, lambda t: F.transform(sizes, lambda _, i: F.get(t, F.floor(i / b).cast("int"))
                                                 + total(F.slice(sizes, (F.floor(i / b) * b + 1).cast("int"), (i % b).cast("int")))))
    return let(block, of)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        # from the right, every second digit doubles, less 9 when over 9
        luhn = let(F.reverse(digits), lambda d: F.aggregate(
            F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(
                i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
                    (2 * F.substring(d, i, F.lit(1)).cast("int")) % 10 + F.floor(F.substring(d, i, F.lit(1)).cast("int") / 5).cast("int"))))
        return F.when(F.length(digits).between(13, 19), luhn % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def _bracketed(text: Column, pattern: str, one) -> Column:
    """Array of ``one(match, start)`` over a text's matches, in order.

    Matches are bracketed in one pass and the text is split at the brackets;
    the lengths of the pieces give the places.
    """
    def spans(parts):
        # parts: the text before the first match, then match, SHUT and rest each
        sizes = F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
        each = lambda starts: F.transform(parts, lambda p, i: one(F.substring_index(p, SHUT, 1), F.get(starts, i)))
        return F.slice(let(let(sizes, _prefix_sums), each), F.lit(2), F.size(parts))
    return let(F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{SHUT}"), OPEN), spans)


def _span(kind, start: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), start.cast("int").alias("s"),
                    (start + F.length(value)).cast("int").alias("e"), value.alias("value"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,s:int,e:int,value:string>>")


def base_spans() -> Column:
    """Column of all base spans of ``text``: array of (kind, s, e, value) by kind, then start; null texts have none."""
    may = {"email": F.contains(F.col("text"), F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"),
           "card": F.col("text").rlike("[0-9][ -]?[0-9]"), "phone": F.col("text").rlike(r"\+[0-9]")}

    def found(kind):
        spans = _bracketed(_marked(kind), PATTERNS[kind], lambda match, start: _span(kind, start, F.translate(match, DOT + GAP, ". ")))
        return F.when(may[kind], F.filter(spans, lambda x: _valid(kind, x["value"]))).otherwise(_no_spans())
    return F.concat(*map(found, KINDS))


def other_spans() -> Column:
    """Column of the words of ``text`` that may identify but that no span in ``base`` touches, with null kind: those
    with MIN_DIGITS digits or an @, less the punctuation around them."""
    opening = r"[\p{Ps}\p{Pi}\"']"

    def one(word, start):
        lead = F.length(F.regexp_extract(word, f"^({opening}*+)", 1))
        inner = F.regexp_replace(F.regexp_replace(word, f"^{opening}++", ""), r"(?<!\p{P})\p{P}++$", "")
        return _span(None, start + lead, inner)
    words = _bracketed(F.translate("text", OPEN + SHUT, "\u0007" * 2), r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", one)
    shaped = F.filter(words, lambda x: F.contains(x["value"], F.lit("@"))
                      | (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= MIN_DIGITS))
    free = F.filter(shaped, lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.when(F.col("text").rlike("[0-9@]"), free).otherwise(_no_spans())


def context(start: Column) -> Column:
    """Pattern of the place ``start`` in ``text``: the two words before it, in lower case and digits as 0; null where
    there are none or one is too long."""
    first = F.greatest(start - WINDOW, F.lit(0))
    part = F.substring(F.col("text"), first + 1, start - first)
    part = F.when(first > 0, F.regexp_replace(part, r"^\S+", "")).otherwise(part)  # no word is cut
    words = F.regexp_extract(part, rf"(?:^|\s)(\S{{1,{CONTEXT_WORD}}}\s++\S{{1,{CONTEXT_WORD}}})\s++[\p{{Ps}}\"']*+$", 1)
    words = F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"\s+", " ")
    return F.when(words != "", words)


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of ``patterns`` stands in the whole corpus before any further word.

    Any number of patterns will do: the corpus's word pairs are counted in each task before the shuffle, and the
    counts joined with the patterns.  Of the pairs only those go that share a hash cell with no pattern; there are
    CELLS cells at most, which bounds what is broadcast.
    """
    cell = F.pmod(F.xxhash64("pattern"), F.lit(CELLS)).alias("cell")
    cells = patterns.select(cell).distinct()
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), "[0-9]", "0")
    pairs = let(F.split(plain, " "), lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    seen = docs.filter("text is not null").select(F.explode(pairs).alias("pattern"))
    seen = seen.select("pattern", cell).join(F.broadcast(cells), "cell", "left_semi")
    return seen.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern")


def growing_parts(docs: DataFrame) -> list[DataFrame]:
    """Parts of ``docs`` by a hash of the row, each within the next: some FIRST rows, then STEP times as many and so
    on, up to a quarter of all.  Few rows have none."""
    of, parts = docs.count() // FIRST, []
    while of > 3:
        parts.append(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(of)) == 0))
        of //= STEP
    return parts


def bootstrap(docs: DataFrame, seen: DataFrame) -> DataFrame | None:
    """(row identity, kind, s, e) of the identifiers that only contexts reveal; None if no pattern is good enough.

    ``docs`` are the rows (doc_id, text), ``seen`` has the occurrences (row identity, kind, s, e, value, pattern).
    Each turn scores the patterns that have enough trusted instances, then all
    instances from the accepted patterns; turns end when neither grow in number.
    Only such patterns are counted in the corpus, and of them only those that
    still have a chance: whatever is known to be some of a pattern's
    occurrences, a weight too small for them is too small for all.  Known are
    at first the places before instances, then the occurrences in growing
    parts of the corpus; what no part rules out is counted in all of it, once.
    Common word pairs meet enough instances by chance once the corpus is
    large, and more of them the larger it is; they are ruled out by the first
    part that holds more of them than their weight allows, so that the
    occurrences counted keep to the number of instances, not to that of such
    pairs.  No score is taken from a part.
    """
    with scratch() as keep:
        return _turns(docs, seen, keep)


def _turns(docs: DataFrame, seen: DataFrame, keep) -> DataFrame | None:
    """``bootstrap``.  Tables of one turn are kept by ``keep``; what grows from turn to turn or goes to the caller is a
    checkpoint, so that plans stay short."""
    # by value as well, so that no hot pattern lies in one task
    graph = keep(seen.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")))
    # spans of two kinds may start at one place; those of one kind, and those without a kind, never share theirs
    by_kind = graph.groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
    least = keep(by_kind.groupBy("pattern").agg((
        F.coalesce(F.max(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0))
        + F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0))).alias("least")))
    seeds = graph.filter("kind is not null").select("kind", "value", F.lit(1.0).alias("trust")).distinct()
    open_ = graph.filter("kind is null").select("pattern", "value")
    trusted, accepted, known, totals, parts = seeds, 0, 0, None, None

    def uncounted():
        possible = held.join(least, "pattern").filter(F.col("weight") / F.col("least") >= MIN_SCORE).select("pattern").distinct()
        return keep(possible if totals is None else possible.join(totals, "pattern", "left_anti"))
    while True:
        held = keep(graph.select("pattern", "value", "n").join(trusted, "value").groupBy("pattern", "kind")
                    .agg(F.sum(F.col("n") * F.col("trust")).alias("weight"), F.count_distinct("value").alias("seeds"))
                    .filter(F.col("seeds") >= MIN_SEEDS))
        new = uncounted()
        if parts is None and not new.isEmpty():
            parts = growing_parts(docs)
        for part in parts or []:
            if new.isEmpty():
                break
            least = materialize(least.join(pattern_totals(part, new), "pattern", "left")
                                .select("pattern", F.greatest("least", "total").alias("least")))
            new = uncounted()
        if not new.isEmpty():
            counted = pattern_totals(docs, new)
            totals = materialize(counted if totals is None else totals.unionByName(counted))
        if totals is None:
            return None
        scored = keep(held.join(totals, "pattern").select("pattern", "kind", (F.col("weight") / F.col("total")).alias("score"))
                      .filter(F.col("score") >= MIN_SCORE))
        # likely by any of its patterns: one less the product of what each leaves open
        left = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        likely = (open_.join(scored, "pattern").groupBy("kind", "value").agg((1 - left).alias("trust"))
                  .filter(F.col("trust") >= MIN_TRUST))
        best = F.max_by("kind", F.struct("trust", F.negative(F.ascii("kind"))))
        likely = materialize(likely.groupBy("value").agg(best.alias("kind"), F.max("trust").alias("trust"))
                             .select("kind", "value", "trust"))
        patterns, now = scored.count(), likely.count()
        if patterns <= accepted and now <= known:
            break
        trusted, accepted, known = seeds.unionByName(likely), max(patterns, accepted), max(now, known)
    if not known:
        return None
    return materialize(seen.filter("kind is null").drop("kind").join(scored.select("pattern", "kind"), "pattern")
                       .join(likely.select("kind", "value"), ["kind", "value"]).select(*ROW_ID, "kind", "s", "e").distinct())


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text).

    base: array of (kind, s, e, value) found by the base patterns; spans:
    array of (kind, s, e), those and what the contexts add.  Both by kind in
    the order of KINDS, then by place.  Null texts have none; repeated rows
    get equal results; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", *row_id()).withColumn("base", base_spans())
    seen = F.transform(F.concat("base", other_spans()), lambda x: F.struct(
        x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"),
        context(x["s"]).alias("pattern")))
    found = materialize(rows.select("doc_id", *ROW_ID, seen.alias("seen")))
    single = found.select(*ROW_ID, F.explode("seen").alias("o")).select(*ROW_ID, "o.*").filter("pattern is not null")
    more = bootstrap(docs.select("doc_id", "text"), single)
    kinds = F.array(*map(F.lit, KINDS))
    base = F.filter("seen", lambda x: x["kind"].isNotNull())
    out = found.select("doc_id", *ROW_ID, base.alias("base"))
    if more is None:
        out = out.withColumn("spans", F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    else:
        added = more.groupBy(*ROW_ID).agg(F.collect_list(F.struct("kind", "s", "e")).alias("added"))  # of one document
        out = out.join(added, ROW_ID, "left").withColumn("added", F.coalesce("added", F.array().cast(added.schema["added"].dataType)))

        def place(x):
            return F.struct(F.array_position(kinds, x["kind"]).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
        spans = F.array_sort(F.concat(F.transform("base", place), F.transform("added", place)))
        out = out.withColumn("spans", F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return out.select("doc_id", F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
                                                                       x["value"].alias("value"))).alias("base"), "spans")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what ``personal_data`` returns; the numbers count base spans."""
    def listed(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.size(F.filter("base", (lambda k: lambda x: x["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
