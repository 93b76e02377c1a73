"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions.

Two conversations of a pair are compared turn by turn, by turn number: the prompt is every
turn before the first that differs (missing on one side counts), rendered once; what
follows on each side is its completion, in which only assistant turns, header excluded, are
to be learned from. The first differing turn is a minimum, so no conversation is gathered to
find it, and what is rendered is grouped by ``SPAN`` turn numbers: a conversation of any
length is rows of bounded size, in order by ``part_no``.

Defined results: turns without a conversation or a number belong to no pair and are left
out; a null role is user, a null text empty; rows that repeat a turn are one; several
different rows of one number follow each other by role and text, and differ from other sets of rows;
conversations without a partner differ at their first turn; equal conversations have
a prompt and no completion; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 64


def paired(turns: DataFrame) -> DataFrame:
    """``pair_id, side, turn, role, text``: ids 2n and 2n + 1 are a pair, the even one chosen."""
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    pair = ((F.col("conv_id") - F.pmod("conv_id", F.lit(2))) / 2).cast("long")
    return turns.select(pair.alias("pair_id"), side.alias("side"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, part, part_no, n_turns, text, learned`` of ``turns(pair_id, side, turn, role, text)``.

    ``learned``: spans ``start:end`` of ``text``, in characters, that the loss covers, joined by commas.
    """
    turns = turns.filter("pair_id IS NOT NULL AND turn IS NOT NULL").distinct()
    side = lambda s: F.when(F.col("side") == s, F.struct(F.md5("role"), F.md5("text")))
    # Sorted digests of a turn's rows, of which a turn has few, are equal on both sides or the turn differs.
    each = turns.groupBy("pair_id", "turn").agg(F.array_sort(F.collect_list(side("chosen"))).alias("a"), F.array_sort(F.collect_list(side("rejected"))).alias("b"))
    split = each.groupBy("pair_id").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("turn"))).alias("differs"))
    rows = turns.join(split, "pair_id")
    same = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    # A prompt's turns are on both sides: the chosen one's are rendered.
    rows = rows.withColumn("part", F.when(same, "prompt").otherwise(F.col("side"))).filter((F.col("part") != "prompt") | (F.col("side") == "chosen"))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    row = F.struct("turn", "role", "text", F.length(head).alias("skip"), F.concat(head, F.col("text"), F.lit("<|end|>\n")).alias("out"))
    spans = rows.groupBy("pair_id", "part", F.floor(F.col("turn") / SPAN).cast("long").alias("part_no")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    upto = F.aggregate("t", F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("s")), lambda a, x: F.struct(
        (a["n"] + F.length(x["out"])).alias("n"),
        F.when(
            (F.col("part") != "prompt") & (x["role"] == "assistant"),
            F.concat(a["s"], F.array(F.concat_ws(":", (a["n"] + x["skip"]).cast("string"), (a["n"] + F.length(x["out"])).cast("string")))),
        ).otherwise(a["s"]).alias("s"),
    ))
    return spans.select("pair_id", "part", "part_no", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["out"]), "").alias("text"), F.array_join(upto["s"], ",").alias("learned"))


def query(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return format_pairs(paired(turns))


SQL = f"""
WITH t AS (
  SELECT DISTINCT (conv_id - (conv_id % 2)) // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), d AS (
  SELECT pair_id, min(turn) FILTER (a IS DISTINCT FROM b) AS differs FROM (
    SELECT pair_id, turn, list_sort(list([role, text]) FILTER (side = 'chosen')) AS a, list_sort(list([role, text]) FILTER (side = 'rejected')) AS b FROM t GROUP BY ALL) GROUP BY 1
), r AS (
  SELECT pair_id, turn, role, text, CASE WHEN differs IS NULL OR turn < differs THEN 'prompt' ELSE side END AS part, side FROM t JOIN d USING (pair_id)
), o AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS out, turn // {SPAN} AS part_no FROM r WHERE part <> 'prompt' OR side = 'chosen'
), n AS (
  SELECT *, sum(length(out)) OVER (PARTITION BY pair_id, part, part_no ORDER BY turn, role, text)::BIGINT AS upto FROM o
)
SELECT pair_id, part, part_no, count(*) AS n_turns, string_agg(out, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg((upto - length(out) + length(role) + 5)::VARCHAR || ':' || upto::VARCHAR, ',' ORDER BY turn, role, text) FILTER (role = 'assistant' AND part <> 'prompt'), '') AS learned
FROM n GROUP BY pair_id, part, part_no
"""
