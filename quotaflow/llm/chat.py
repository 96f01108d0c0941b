"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, only its text is trainable. Turns after the last assistant turn (or
conversations without one) make one example with context alone, so that the
output holds every turn. Template of a turn:

    <|role|>escaped role<|text|>escaped text<|end|>

In roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``[``
becomes ``\\k``: no control string of this template, nor one like ``</s>`` or
``[INST]``, can come out of a text, and the escaping can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: The conversation that the query adds: both texts hold control strings.
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\k"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), context, target, reply, trains, whole.

    ``context + target`` is the formatted example and ``target`` the reply's
    turn; the loss covers ``reply``, the escaped text inside ``target``.
    Examples without a reply have an empty target and reply; the last example of a
    conversation is ``whole``: it holds all its turns. Turns go by number
    (null first), then role and text; repeated rows stay. A null text or role is
    empty; rows of a null conv_id form one conversation. Other columns are ignored.

    A conversation's formatted turns are one string, of which each example is a prefix cut at
    the place of its reply: a task holds a conversation once, whatever the number of
    its examples, and its examples one after the other.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("formatted", _turn(F.col("role"), F.col("text")))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.select(
        "conv_id", "formatted", (F.col("role") == "assistant").alias("trains"), F.char_length("formatted").alias("size"),
        F.char_length(escape(F.col("text"))).alias("reply_size"), F.row_number().over(order).alias("i"),
        (F.sum(F.char_length("formatted")).over(order.rowsBetween(W.unboundedPreceding, -1))).alias("start"))
    whole = placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "formatted"))), lambda x: x["formatted"]), "").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("trains"), F.struct("i", F.coalesce("start", F.lit(0)).alias("start"), "size", "reply_size", "trains")))).alias("replies"),
        F.count("*").alias("n"), F.sum("size").alias("chars"))
    rest = F.struct(F.lit(0).alias("i"), F.col("chars").alias("start"), F.lit(0).alias("size"), F.lit(0).alias("reply_size"), F.lit(False).alias("trains"))
    ends = F.coalesce(F.get("replies", F.size("replies") - 1)["i"] == F.col("n"), F.lit(False))
    cuts = F.when(ends, F.col("replies")).otherwise(F.concat("replies", F.array(rest)))
    cut = whole.select("conv_id", "text", "n", F.size(cuts).alias("examples"), F.posexplode(cuts).alias("example", "c"))
    start, size, reply = (F.col("c")[x].cast("int") for x in ("start", "size", "reply_size"))
    return cut.select(
        "conv_id", F.col("example").cast("long").alias("example"),
        F.substring("text", F.lit(1), start).alias("context"), F.substring("text", start + 1, size).alias("target"),
        F.substring("text", start + size - reply - len(END) + 1, reply).alias("reply"), F.col("c")["trains"].alias("trains"),
        (F.col("example") == F.col("examples") - 1).alias("whole"))


def read_back(examples: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted examples alone: turns parsed
    from the longest example, loss texts from every target, in order. Only that example's text
    goes into the grouping."""
    target_text = F.regexp_replace(F.split_part("target", F.lit(TEXT), F.lit(2)), r"<\|end\|>$", "")
    held = examples.select(
        "conv_id", "example", "trains", unescape(target_text).alias("loss"),
        F.when(F.col("whole"), F.concat("context", "target")).alias("whole"),
        (F.char_length("context") + F.char_length("target")).alias("chars"))
    per = held.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.when(F.col("trains"), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.get(F.collect_list("whole"), F.lit(0)).alias("whole"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    parts = F.filter(F.split("whole", r"<\|end\|>"), lambda x: x != "")

    def plain(x: Column) -> Column:
        role = F.split_part(F.substring(x, len(ROLE) + 1, 1 << 30), F.lit(TEXT), F.lit(1))
        return F.concat(unescape(role), F.lit("\n"), unescape(F.split_part(x, F.lit(TEXT), F.lit(2))), F.lit("\n"))

    return per.select(
        "conv_id", F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(parts, plain), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return read_back(prefix_target_examples(rows))


#: The digests straight from the turns; formatted_chars from the template's lengths.
ORACLE_OP6 = """
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, 23 + length(role) + length(text)
    + length(role || text) - length(replace(role || text, chr(92), ''))
    + length(role || text) - length(replace(role || text, '<', ''))
    + length(role || text) - length(replace(role || text, '[', '')) AS chars,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_in WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM numbered)
SELECT conv_id, count(*) AS n_turns,
  sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i), '')) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""
