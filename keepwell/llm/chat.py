"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant the whole dialogue is rendered once with that speaker as
the assistant, all others as named users, and a loss mask over what the
assistant says.  A rendered dialogue is a table: one row per message, in the
order of ``position``; the messages' renderings one after the other are the
dialogue.  So a conversation of any length is spread over tasks.

Places in a conversation come from a range partitioning of all messages:
counts inside each partition, and a running sum over the partitions that a
conversation spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.session import materialize

#: Roles that set the scene and take no part.
CONTEXT_ROLES = ("system",)
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def placed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, position): messages in the order of turn, then role, then text, nulls last."""
    keys = ["conv_id", "turn", "role", "text"]
    counted = messages.select(*keys).groupBy(*keys).agg(F.count("*").alias("copies"))
    order = [F.col(k).asc_nulls_last() for k in keys]
    # Checkpointed: the parts must not be dealt anew when an executor is lost.
    dealt = materialize(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "conv_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part", "conv_id").agg(F.sum("copies").alias("n"))
    bases = parts.select(F.col("part").alias("of_part"), F.col("conv_id").alias("of_conv"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    joined = ranked.join(bases, (F.col("part") == F.col("of_part")) & F.col("conv_id").eqNullSafe(F.col("of_conv")))
    first = F.col("base") + F.col("within")
    return joined.select(*keys, F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("position"))


def rotate(messages: DataFrame) -> DataFrame:
    """One row per perspective and message: conv_id, perspective, position, chat_role, name, rendered, loss_start, loss_end.

    ``loss_start`` and ``loss_end`` bound the characters of ``rendered`` to
    train on, end mark included: the perspective's own messages; 0, 0 in
    others.  A null role is the participant ``unknown``; a null text is empty.
    A repeated message is a message each time.  A null conv_id is a
    conversation of its own.  Messages of a context role are rendered as such
    for everyone; a conversation of nothing else has no perspective.
    """
    speaker = F.coalesce("role", F.lit(UNNAMED))
    rows = placed(messages).select("conv_id", "position", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    takes_part = ~F.col("perspective").isin(*CONTEXT_ROLES)
    people = messages.select(F.col("conv_id").alias("of"), speaker.alias("perspective")).where(takes_part).distinct()
    each = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    context = F.col("speaker").isin(*CONTEXT_ROLES)
    own = F.col("speaker") == F.col("perspective")
    chat_role = F.when(context, F.col("speaker")).when(own, "assistant").otherwise("user")
    name = F.when(~context & ~own, F.col("speaker"))
    header = F.concat(F.lit(OPEN), chat_role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    rendered = F.concat(header, F.col("text"), F.lit(CLOSE))
    return each.select(
        "conv_id",
        "perspective",
        "position",
        chat_role.alias("chat_role"),
        name.alias("name"),
        rendered.alias("rendered"),
        F.when(own, F.length(header)).otherwise(0).cast("long").alias("loss_start"),
        F.when(own, F.length(rendered) - 1).otherwise(0).cast("long").alias("loss_end"),
    )


def op7(messages: DataFrame) -> DataFrame:
    return rotate(messages)


SQL = """
WITH m AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS position
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (
  SELECT m.conv_id, perspective, position, text, speaker = perspective AS own,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS header FROM r)
SELECT conv_id, perspective, position, chat_role, name, header || text || '<|im_end|>' || chr(10) AS rendered,
  CAST(CASE WHEN own THEN length(header) ELSE 0 END AS BIGINT) AS loss_start,
  CAST(CASE WHEN own THEN length(header || text || '<|im_end|>') ELSE 0 END AS BIGINT) AS loss_end
FROM h
"""
