"""Preference pairs of conversations for training.

The longest common turn prefix of a chosen and a rejected conversation is
their prompt and is rendered once; what follows is rendered for each as a
completion, with loss on the assistants' words only.

The core result is one row for each rendered turn: a conversation may hold a
large part of the table, and no task ever gathers one.  ``paired`` joins the
turns of pairs up to a given size to one row each and leaves larger pairs as
one row for each turn.

Pairs come from a table of pairs (``preferences``), or, where a corpus has none,
from ``swapped_sides``: each conversation up to its last assistant turn, chosen
as it is and rejected with its neighbour's last assistant turn in that place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations 2k and 2k+1, where both exist."""
    ids = turns.select("conv_id").filter("conv_id is not null").distinct()
    other = ids.select((F.col("conv_id") - 1).alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    return (ids.withColumnRenamed("conv_id", "chosen_id").filter("chosen_id % 2 = 0").join(other, "chosen_id")
            .select(F.shiftright("chosen_id", 1).alias("pair_id"), "chosen_id", "rejected_id"))


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, part, turn, role, rendered, loss_start, loss_end).

    part is prompt, chosen or rejected; within each, rows are in order of
    turn (null last), then role, then text.  Turns are the same when number,
    role and text are; the prefix ends before the first number at which the
    two conversations differ.  Loss is on the characters of ``rendered`` from
    loss_start up to loss_end (0, 0: none).  Repeated rows are one turn;
    a null role or text is rendered empty; rows without conv_id belong to no
    conversation.  A mark in a text is broken up, so that no text can end its
    turn.  Pairs of equal conversations have a prompt only.  Empty tables give
    no rows.
    """
    return rendered(pair_sides(turns, pairs))


def _said(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()


def pair_sides(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, turn, role, text): the turns of both sides of each pair."""
    sides = pairs.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(
        F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("chosen")),
        F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("chosen")))).alias("side"))
    return sides.select("pair_id", "chosen_id", "rejected_id", "side.*").join(_said(turns), "conv_id").drop("conv_id")


def swapped_sides(turns: DataFrame) -> DataFrame:
    """The same columns for pairs made from single conversations.

    Conversation c is chosen up to its last assistant turn; rejected is the
    same with the last assistant turn of conversation c + 1 (even c) or c - 1
    (odd c) in that place.  pair_id and chosen_id are c, rejected_id is the
    neighbour.  Of several assistant rows with the last number the one of
    the largest text counts (null least), and the others go.  Conversations without an
    assistant turn, a neighbour or a neighbour's assistant turn make no pair;
    rows without a number are in none.
    """
    said = _said(turns).filter("conv_id is not null and turn is not null")
    # one row a conversation, combined map-side
    last = (said.filter(F.col("role") == ASSISTANT).groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.turn", "last.text"))
    own = last.select(F.col("conv_id").alias("chosen_id"), F.col("turn").alias("end"), F.col("text").alias("good"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                        F.col("text").alias("bad"))
    ends = own.join(other, "chosen_id")
    answer = F.array(F.struct(F.lit(True).alias("chosen"), F.col("good").alias("text")),
                     F.struct(F.lit(False).alias("chosen"), F.col("bad").alias("text")))
    ending = ends.select("chosen_id", "rejected_id", F.explode(answer).alias("a"), F.col("end").alias("turn"), F.lit(ASSISTANT).alias("role"))
    ahead = (said.withColumnRenamed("conv_id", "chosen_id").join(ends.select("chosen_id", "rejected_id", "end"), "chosen_id")
             .filter((F.col("turn") < F.col("end")) | ((F.col("turn") == F.col("end")) & ~F.col("role").eqNullSafe(ASSISTANT)))
             .withColumn("chosen", F.explode(F.array(F.lit(True), F.lit(False)))))
    columns = [F.col("chosen_id").alias("pair_id"), "chosen_id", "rejected_id"]
    return (ahead.select(*columns, "chosen", "turn", "role", "text")
            .unionByName(ending.select(*columns, "a.chosen", "turn", "role", "a.text")))


def rendered(sides: DataFrame) -> DataFrame:
    """``preferences`` of the turns of both sides."""
    each = (sides.groupBy("pair_id", "chosen_id", "rejected_id", "turn", "role", "text")
            .agg(F.bool_or("chosen").alias("in_chosen"), F.bool_or(~F.col("chosen")).alias("in_rejected")))
    both = F.col("in_chosen") & F.col("in_rejected")
    at = F.struct(F.col("turn").isNull(), F.coalesce("turn", F.lit(0)))
    ends = each.filter(~both).groupBy("pair_id").agg(F.min(at).alias("end"))
    placed = each.join(ends, "pair_id", "left")
    common = F.col("end").isNull() | (at < F.col("end"))
    parts = F.when(common, F.array(F.lit("prompt"))).otherwise(F.filter(F.array(
        F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected")), lambda p: p.isNotNull()))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |"))
    head = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE))
    learns = (F.col("part") != "prompt") & F.coalesce(F.col("role") == ASSISTANT, F.lit(False))
    return (placed.withColumn("part", F.explode(parts))
            .select("pair_id", "chosen_id", "rejected_id", "part", "turn", "role",
                    F.concat(head, text, F.lit(END)).alias("rendered"),
                    F.when(learns, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
                    F.when(learns, F.length(head) + F.length(text)).otherwise(0).cast("long").alias("loss_end")))


def paired(segments: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, turn, prompt, chosen, rejected, chosen_loss, rejected_loss).

    Pairs of at most ``max_chars`` rendered characters are one row, with a null
    turn.  A larger pair has one row for each of its turns, in the column of
    its part, the others being empty: in order of turn they join to the same
    texts.  Losses are ``start:end`` within the row's completion, comma-joined.
    """
    whole = ["pair_id", "chosen_id", "rejected_id"]
    sizes = segments.groupBy(*whole).agg(F.sum(F.length("rendered")).alias("size"))
    sized = segments.join(sizes.select("pair_id", (F.col("size") <= max_chars).alias("fits")), "pair_id")
    row = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "rendered", "loss_start", "loss_end")
    # the turns of a pair that fits meet in one group, of max_chars at most; those of others are groups by themselves
    alone = F.when(~F.col("fits"), F.struct("part", "turn", "role", "rendered"))
    joined = sized.withColumn("alone", alone).groupBy(*whole, "alone").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, row))).alias(f"{p}_rows") for p in ("prompt", "chosen", "rejected")])

    def text(c):
        return F.array_join(F.transform(c, lambda x: x["rendered"]), "")

    def losses(c):
        start = lambda i: F.aggregate(F.slice(c, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x["rendered"]))
        spans = F.transform(c, lambda x, i: F.when(x["loss_start"] < x["loss_end"], F.concat(
            start(i) + x["loss_start"], F.lit(":"), start(i) + x["loss_end"])))
        return F.array_join(spans, ",")
    return joined.select(*whole, F.col("alone.turn").alias("turn"),
                         *[text(f"{p}_rows").alias(p) for p in ("prompt", "chosen", "rejected")],
                         losses("chosen_rows").alias("chosen_loss"), losses("rejected_rows").alias("rejected_loss"))


ORACLE = r"""
WITH said AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, turn, text FROM said WHERE role = 'assistant'
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1),
ends AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turn AS stop, a.text AS good, b.text AS bad
         FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
sides AS (SELECT chosen_id, rejected_id, side, turn, role, text FROM said JOIN ends ON conv_id = chosen_id,
            (VALUES (true), (false)) v(side)
          WHERE turn < stop OR (turn = stop AND role IS DISTINCT FROM 'assistant')
          UNION ALL SELECT chosen_id, rejected_id, true, stop, 'assistant', good FROM ends
          UNION ALL SELECT chosen_id, rejected_id, false, stop, 'assistant', bad FROM ends),
each_turn AS (SELECT chosen_id, rejected_id, turn, role, text, bool_or(side) AS in_chosen, bool_or(NOT side) AS in_rejected
              FROM sides GROUP BY ALL),
cuts AS (SELECT chosen_id, min(turn) AS cut FROM each_turn WHERE NOT (in_chosen AND in_rejected) GROUP BY chosen_id),
placed AS (SELECT e.*, cut IS NULL OR turn < cut AS common FROM each_turn e LEFT JOIN cuts USING (chosen_id)),
parts AS (SELECT *, 'prompt' AS part FROM placed WHERE common
          UNION ALL SELECT *, 'chosen' FROM placed WHERE NOT common AND in_chosen
          UNION ALL SELECT *, 'rejected' FROM placed WHERE NOT common AND in_rejected),
bodies AS (SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') AS body FROM parts),
shown AS (SELECT *, head || body || '<|end|>' || chr(10) AS shown FROM bodies),
sized AS (SELECT *, sum(length(shown)) OVER (PARTITION BY chosen_id) <= 1048576 AS fits FROM shown),
alone AS (SELECT *, CASE WHEN NOT fits THEN turn END AS own, CASE WHEN NOT fits THEN row(part, turn, role, shown) END AS piece FROM sized),
offsets AS (SELECT *, sum(length(shown)) OVER w - length(shown) AS start, row_number() OVER w AS place FROM alone
       WINDOW w AS (PARTITION BY chosen_id, piece, part ORDER BY turn, role NULLS FIRST, shown ROWS UNBOUNDED PRECEDING)),
marks AS (SELECT *, CASE WHEN role = 'assistant' AND body <> '' THEN (start + length(head)) || ':' || (start + length(head) + length(body))
          END AS loss FROM offsets)
SELECT chosen_id AS pair_id, chosen_id, rejected_id, own AS turn,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(loss, ',' ORDER BY place) FILTER (part = 'chosen'), '') AS chosen_loss,
  coalesce(string_agg(loss, ',' ORDER BY place) FILTER (part = 'rejected'), '') AS rejected_loss
FROM marks GROUP BY chosen_id, rejected_id, own, piece
"""
