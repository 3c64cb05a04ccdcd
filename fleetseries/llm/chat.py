"""Chat formatting by perspective rotation, with DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; system turns stay system turns. The mask lists the stretches (code points of the whole
dialogue, end exclusive) that the assistant says, which are those to train on.

The rows of a conversation, ordered by turn, role and text, come in parts of PART_ROWS rows, which join by part
number; a conversation of up to PART_ROWS rows is part 0 alone. A part is bounded by rows, whatever turn numbers they
have, so a conversation of any length, and all rows that share a turn or have no conv_id, spread over many tasks:
rows are sorted by range over all tasks, and the number of a row is its place in its task plus the conversation's
rows in earlier tasks.

Cases: a null role is the speaker "unknown"; a null text is an empty turn; a null turn counts as turn 0; turns of one
number, and repeated rows, follow by role, then text; a null conv_id is a conversation of its own; a conversation
with system turns alone has no participant and no rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.llm.common import cut

PART_ROWS = 1024
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
USER, SELF = "user name=", "assistant"


def numbered(said: DataFrame, part_rows: int) -> DataFrame:
    """said with part and n, the place in the part, of each row in the order of its conversation.

    The last sort key, a number of the row, lets equal rows lie in several tasks. `earlier` is ordered over one row a
    task that holds rows of a conversation.
    """
    order = ["conv_id", "turn", "role", "text", "__row"]
    rows = cut(said.withColumn("__row", F.monotonically_increasing_id()), "chat-rows")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("__task", F.shiftright("__at", 33)).drop("__row"), "chat-sorted")  # the id's upper bits are the task
    counts = dealt.groupBy("conv_id", "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = W.partitionBy("conv_id").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("conv_id").alias("__c"), F.col("__task").alias("__k"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__offset")
    )
    placed = dealt.join(offsets, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__task") == F.col("__k"))).withColumn("__at", F.col("__at") + F.col("__offset"))
    part = F.floor(F.col("__at") / part_rows).cast("long")
    return placed.select("conv_id", "turn", "role", "text", part.alias("part"), (F.col("__at") - part * part_rows).alias("n"))


def longer_head(speaker: Column) -> Column:
    """How much longer another user's head is than the assistant's."""
    return F.length(F.concat(F.lit(USER), speaker)) - len(SELF)


def part_starts(lines: DataFrame, said: DataFrame) -> DataFrame:
    """(__c, __p, speaker, part_start): where each part begins in the whole dialogue as each speaker's side has it. A row a part and speaker, without texts."""
    speakers = said.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("role").alias("speaker")).distinct()
    totals = lines.groupBy("conv_id", "part").agg(F.sum(F.length("line")).alias("__all"))
    own = lines.groupBy(F.col("conv_id").alias("__oc"), F.col("part").alias("__op"), F.col("role").alias("__or")).agg(F.count("*").alias("__own"))
    grid = totals.join(speakers, F.col("conv_id").eqNullSafe(F.col("__c")))
    met = grid.join(own, F.col("conv_id").eqNullSafe(F.col("__oc")) & (F.col("part") == F.col("__op")) & (F.col("speaker") == F.col("__or")), "left")
    long = F.col("__all") - F.coalesce("__own", F.lit(0)) * longer_head(F.col("speaker"))
    earlier = W.partitionBy("__c", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return met.select("__c", F.col("part").alias("__p"), "speaker", F.coalesce(F.sum(long).over(earlier), F.lit(0)).cast("long").alias("part_start"))


def rotate(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, speaker, part, part_start, n_turns, text, mask): each dialogue from each participant's side.

    A dialogue's parts, one after the other, are its whole text; masks count from the start of that, so a dialogue of
    any length is rendered as one of a single part is. part_start is where a part's text begins there.
    """
    said = conversations.select(
        "conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    lines = numbered(said, part_rows)
    head = F.when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit(USER), "role"))
    others = F.concat(F.lit(START), head, F.lit("\n"), "text", F.lit(END + "\n"))
    before = W.partitionBy("conv_id", "part").orderBy("n").rowsBetween(W.unboundedPreceding, -1)  # PART_ROWS rows at most
    lines = lines.withColumn("line", others).withColumn("at", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)))
    parts = lines.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "at", "role", "text", "line"))).alias("turns"))
    starts = part_starts(lines, said)
    both = parts.join(starts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")))
    own = F.filter("turns", lambda x: x["role"] == F.col("speaker"))
    longer = longer_head(F.col("speaker"))

    def span(x, k):
        start = F.col("part_start") + x["at"] - k * longer + len(START + SELF) + 1
        return F.concat_ws(":", start, start + F.length(x["text"]) + len(END))

    mine = lambda x: F.concat(F.lit(f"{START}{SELF}\n"), x["text"], F.lit(END + "\n"))
    return both.select(
        "conv_id", "speaker", "part", "part_start",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.when(x["role"] == F.col("speaker"), mine(x)).otherwise(x["line"])), "").alias("text"),
        F.array_join(F.transform(own, span), ",").alias("mask"),
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0), coalesce(role, 'unknown'), coalesce(text, '')) - 1) // {PART_ROWS} AS part FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
r AS (
  SELECT t.conv_id, p.speaker, t.part, t.turn, t.role, t.text, row_number() OVER w AS k,
         '{START}' || CASE WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN t.role = p.speaker THEN 'assistant'
                           ELSE 'user name=' || t.role END || chr(10) AS head, t.text || '{END}' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
  WINDOW w AS (PARTITION BY t.conv_id, p.speaker, t.part ORDER BY t.turn, t.role, t.text)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY part, k
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT conv_id, speaker, part, CAST(min(pos) AS BIGINT) AS part_start, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN role = speaker THEN CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' ||
                  CAST(CAST(pos + length(head) + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""
