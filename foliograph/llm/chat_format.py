"""Chat formatting: every participant's view of a dialogue (DataFrame functions only).

For each participant of a conversation the dialogue is rendered with that
speaker as the assistant and everyone else as a named user; the system role is
nobody's view and stays as it is. The result has a row per (conversation,
speaker, turn) with the rendered segment, its place in the rendered dialogue
and whether it is trained on, so that no dialogue, however long, has to be in
one row or task. ``render_dialogues`` joins the segments of bounded ones.

A participant's view of a turn depends only on whether the participant spoke
it, and the lengths of both forms are known, so places are prefix sums: one
over all turns as "user" plus one of differences at the speaker's own turns. Both
have two levels, within a span of ``SPAN`` turn numbers and over the sums of
whole spans, so a conversation with a third of all turns is spread over tasks
and texts are shuffled once. Turns of one number stay in one span.

Defined results: a null text is empty; a null role is a participant named
``unknown``; turns with one number keep the order of role and text; repeated
rows are turns of their own; a null turn comes first; a conversation without
participants (system only) gives no rows; rows with a null conv_id are in no
conversation and go; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"
UNKNOWN = "unknown"
#: Turn numbers of a span: the unit that one task sorts, whatever the length of its conversation.
SPAN = 256


def span_bases(t: DataFrame, system_role: str) -> DataFrame:
    """A row per (conv_id, span, speaker): turns, width and own turns in the spans before it."""
    sums = t.groupBy("conv_id", "span", "name").agg(F.count(F.lit(1)).alias("rows"), F.sum("width").alias("width"))
    sums = table(sums, "spans")
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.groupBy("conv_id", "span").agg(F.sum("rows").alias("rows"), F.sum("width").alias("width"))
    spans = spans.select(
        "conv_id", "span",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("width").over(before), F.lit(0)).alias("width_before"),
    )
    spoken = sums.filter(F.col("name") != system_role).select("conv_id", "span", F.col("name").alias("speaker"), F.col("rows").alias("spoken"))
    grid = spans.join(spoken.select("conv_id", "speaker").distinct(), "conv_id").join(spoken, ["conv_id", "span", "speaker"], "left")
    own = Window.partitionBy("conv_id", "speaker").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select("conv_id", "span", "speaker", "rows_before", "width_before", F.coalesce(F.sum("spoken").over(own), F.lit(0)).alias("spoken_before"))


def rotate_perspectives(turns: DataFrame, system_role: str = SYSTEM) -> DataFrame:
    """conv_id, speaker, turn, seq, role, segment, start, end, train_start, train_end, trained."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("name"), F.coalesce("text", F.lit("")).alias("body"))
    t = t.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62)))).filter("conv_id IS NOT NULL")
    plain = F.when(F.col("name") == system_role, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), "name", F.lit("|>\n")))
    mark = "<|end|>\n"
    t = t.withColumn("plain", plain).withColumn("width", F.length("plain") + F.length("body") + len(mark))
    spans = span_bases(t, system_role)

    by = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "name", "body").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("nth", F.row_number().over(by)).withColumn("upto", F.sum("width").over(by))
    v = t.join(spans, ["conv_id", "span"])
    own = F.col("name") == F.col("speaker")
    along = Window.partitionBy("conv_id", "span", "speaker").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("spoken", F.col("spoken_before") + F.sum(own.cast("long")).over(along))
    # each own turn changes a place by the difference of its two heads
    shift = F.lit(len("<|assistant|>\n") - len("<|user name=|>\n")) - F.length("speaker")
    v = v.withColumn("end", F.col("width_before") + F.col("upto") + F.col("spoken") * shift)
    role = F.when(own, "assistant").when(F.col("name") == system_role, "system").otherwise("user")
    v = v.withColumn("role", role).withColumn("head", F.when(own, "<|assistant|>\n").otherwise(F.col("plain"))).withColumn("segment", F.concat("head", "body", F.lit(mark)))
    v = v.withColumn("start", F.col("end") - F.length("segment")).withColumn("seq", (F.col("rows_before") + F.col("nth") - 1).cast("int"))
    # the head is given, the body and the end mark are learned
    return v.select(
        "conv_id", "speaker", "turn", "seq", "role", "segment", "start", "end",
        F.when(own, F.col("start") + F.length("head")).alias("train_start"),
        F.when(own, F.col("end") - 1).alias("train_end"),
        own.alias("trained"),
    )


def render_dialogues(turns: DataFrame, system_role: str = SYSTEM) -> DataFrame:
    """conv_id, speaker, dialogue, masks: whole dialogues in one row, for conversations of bounded length."""
    v = rotate_perspectives(turns, system_role)
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment")))
    masks = F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct("train_start", "train_end"))))
    return v.groupBy("conv_id", "speaker").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("dialogue"), masks.alias("masks"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS body,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS INT) AS seq
  FROM conversations),
people AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
v AS (
  SELECT t.conv_id, speaker, turn, seq, name = speaker AS trained,
         CASE WHEN name = speaker THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN name = speaker THEN '<|assistant|>' || chr(10) WHEN name = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || name || '|>' || chr(10) END AS head, body
  FROM t JOIN people ON t.conv_id = people.conv_id),
s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM v),
e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY seq) AS BIGINT) AS "end" FROM s)
SELECT conv_id, speaker, turn, seq, role, segment, "end" - length(segment) AS start, "end",
       CASE WHEN trained THEN "end" - length(segment) + length(head) END AS train_start,
       CASE WHEN trained THEN "end" - 1 END AS train_end, trained
FROM e
"""
