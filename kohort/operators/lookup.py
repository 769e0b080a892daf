"""Code -> label lookups and cell patches.

Hard-coded fixes of the source scripts become rows of small tables.  A
table built from a Python literal has a size known before the job runs, so
it is broadcast explicitly; a table read from storage is joined without a
hint and AQE broadcasts it when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.functions.nulls import rlike_or_false
from kohort.session import materialize

# A literal table up to this many rows is broadcast with an explicit hint.
LITERAL_BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_CHARS = 10_000_000  # and, where rows are read from a table, up to so many characters


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= LITERAL_BROADCAST_MAX_ROWS else df


def code_to_group(df: DataFrame, code_col: str, lookup: DataFrame, out: str,
                  default: str, key: str = "code", label: str = "label") -> DataFrame:
    """Exact-match lookup with a default label (left join)."""
    lk = lookup.select(F.col(key).alias("__code"), F.col(label).alias("__label"))
    j = df.join(lk, df[code_col] == lk["__code"], "left")
    return j.withColumn(out, F.coalesce(F.col("__label"), F.lit(default))).drop("__code", "__label")


def code_to_group_regex(c, rules: list[tuple[str, str]], default: str) -> Column:
    """First matching pattern wins; NULL text -> default."""
    expr = None
    for pattern, label in rules:
        cond = rlike_or_false(c, pattern)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


GRAM = 3  # characters


def _grams(text, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, at every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _words(text) -> Column:
    """The distinct stretches of a text without white space, and the empty one, which every text has."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(text, r"\s+")))


def _containing(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, piece): which of the distinct ``words`` contain which of the distinct ``pieces``.

    Each piece is filed under its rarest run of three characters (a shorter one
    under itself); words meet the pieces filed under their own runs by an equality
    join, keyed by a hash so that runs don't carry words, and candidates are
    verified."""
    filed = materialize(pieces.withColumn("gram", F.explode(
        F.when(F.length("piece") < GRAM, F.array("piece")).otherwise(_grams(F.col("piece"), GRAM)))))
    common = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    index = (filed.join(common, "gram").groupBy("piece").agg(F.min(F.struct("n", "gram")).alias("least"))
             .select("piece", F.col("least.gram").alias("gram")))
    sizes = sorted(r[0] for r in filed.select(F.least(F.length("piece"), F.lit(GRAM))).distinct().collect())
    runs = F.array_distinct(F.concat(F.array().cast("array<string>"),
                                     *[_grams(F.col("word"), z) if z else F.array(F.lit("")) for z in sizes]))
    words = words.withColumn("__key", F.xxhash64("word"))
    met = words.select("__key", F.explode(runs).alias("gram")).join(index, "gram").select("__key", "piece")
    return words.join(met, "__key").filter(F.contains("word", "piece")).select("word", "piece")


def _small(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a broadcast hint if its rows and the characters of ``text`` are few."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    return F.broadcast(df) if size["n"] <= LITERAL_BROADCAST_MAX_ROWS and size["chars"] <= BROADCAST_MAX_CHARS else df


def substring_rules(df: DataFrame, text_col: str, rules: DataFrame, out: str, default: str,
                    order: str = "rule_order", pattern: str = "pattern", label: str = "label") -> DataFrame:
    """``df`` with the label of the first rule whose pattern is part of the text, for any number of rules.

    ``rules`` is a table (order, pattern, label).  A text that holds a pattern
    has a word that holds the pattern's longest stretch without white space, so
    the distinct words of all texts are matched, once each (see
    :func:`_containing`), and texts meet the rules through their words.  For a
    pattern without white space that is the answer; the other patterns are
    verified in the texts where no such rule comes before them for the word.
    Texts are told apart by 128 bits of their SHA-256.  A text that no rule matches, or
    NULL, gets ``default``; NULL patterns match nothing, an empty one every
    text.  Of rules with one order the smallest (pattern, label) counts.
    """
    rule = rules.filter(F.col(pattern).isNotNull()).select(
        F.struct(F.col(order).alias("o"), F.col(pattern).alias("pattern"), F.col(label).alias("label")).alias("rule")).distinct()
    longest = F.array_max(F.transform(F.split("rule.pattern", r"\s+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("piece"))))
    # ids that rise in the order of the sorted rules, though not by one
    ranked = materialize(rule.orderBy("rule").select(
        F.monotonically_increasing_id().alias("rank"), F.col("rule.pattern").alias("pattern"), F.col("rule.label").alias("label"),
        longest["piece"].alias("piece"), (~F.col("rule.pattern").rlike(r"\s")).alias("sure")))

    text = F.col(text_col)
    texts = df.filter(text.isNotNull()).select(_digest(text).alias("__key"), text.alias("__text"))
    words = texts.select(F.explode(_words("__text")).alias("word")).distinct()
    hits = _containing(words, ranked.select("piece").distinct()).join(ranked.select("rank", "piece", "sure"), "piece")
    hits = materialize(hits.select("word", "rank", "sure"))
    known = hits.filter("sure").groupBy("word").agg(F.min("rank").alias("best"))
    unsure = materialize(hits.filter("NOT sure").join(known, "word", "left").filter("best IS NULL OR rank < best").select("word", "rank"))
    worded = texts.select("__key", F.explode(_words("__text")).alias("word"))
    first = worded.join(_small(known, "word"), "word").select("__key", F.col("best").alias("rank"))
    if not unsure.isEmpty():
        asked = worded.join(_small(unsure, "word"), "word").select("__key", "rank").distinct()
        asked = asked.join(_small(ranked.select("rank", "pattern"), "pattern"), "rank")
        held = texts.dropDuplicates(["__key"]).join(asked, "__key").filter(F.contains("__text", "pattern"))
        first = first.unionByName(held.select("__key", "rank"))
    first = first.groupBy("__key").agg(F.min("rank").alias("rank"))
    named = first.join(_small(ranked.select("rank", F.col("label").alias("__label")), "__label"), "rank").select("__key", "__label")
    j = df.withColumn("__own", _digest(text))
    j = j.join(named, j["__own"] == named["__key"], "left")
    return j.withColumn(out, F.coalesce(F.col("__label"), F.lit(default))).drop("__own", "__key", "__label")


def patch_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows = [(key, column, value_text, only_if_null)]``."""
    return literal_table(spark, rows, "key bigint, column string, value string, only_if_null boolean")


def apply_patches(df: DataFrame, key: str, patches: DataFrame, null_rules: dict | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    """Cell corrections by key.

    For each patched column: an unconditional patch replaces the value, an
    ``only_if_null`` patch fills a NULL only.  ``null_rules`` maps a column
    to a Column test; where it holds (and no patch applied) the cell
    becomes NULL.  The patch table is pivoted to one row per key (small)
    and left-joined once.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    # target columns: given, or read from the patch table (at most the
    # schema width of distinct names)
    targets = sorted(set(columns) if columns is not None else
                     set(r["column"] for r in patches.select("column").distinct().collect()))
    wide = patches.groupBy("key").agg(*[
        x for c in targets for x in (
            F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"__v_{c}"),
            F.max(F.when(F.col("column") == c, F.col("only_if_null"))).alias(f"__o_{c}"))])
    j = df.join(wide.withColumnRenamed("key", "__pkey"), F.col(key) == F.col("__pkey"), "left")
    null_rules = null_rules or {}
    new = {}
    for c in set(targets) | set(null_rules):
        cur = F.col(c)
        if c in null_rules:
            cur = F.when(F.coalesce(null_rules[c], F.lit(False)), F.lit(None).cast(types[c])).otherwise(cur)
        if c in targets:
            v = F.col(f"__v_{c}").cast(types[c])
            has = F.col("__pkey").isNotNull() & F.col(f"__v_{c}").isNotNull()
            cur = (F.when(has & F.col(f"__o_{c}"), F.coalesce(F.col(c), v))
                    .when(has, v).otherwise(cur))
        new[c] = cur
    out = j.withColumns(new)
    return out.drop("__pkey", *[x for c in targets for x in (f"__v_{c}", f"__o_{c}")])


def patch_where(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Cell corrections that depend on other cells: ``rules = [(column,
    test, value)]`` sets ``column`` to ``value`` where the test holds (a
    NULL test does not).  Tests read the row as it came; of two rules for
    one column that both hold, the later wins."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new: dict = {}
    for c, test, value in rules:
        new[c] = F.when(F.coalesce(test, F.lit(False)), F.lit(value).cast(types[c])).otherwise(new.get(c, F.col(c)))
    return df.withColumns(new)
