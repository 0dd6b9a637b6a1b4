"""Chat formatting: logged snapshots that are prefixes of longer conversations are dropped, the rest are rendered.

DataFrame functions only. A turn's key is a pair of 64-bit hashes of its rank, role and text; the running exclusive-or of
the keys identifies each prefix of a conversation, because a key depends on its place. Edge cases: null roles and texts count as
values of their own and render as empty; rows with a null conversation are ignored; repeated rows of a turn count once;
different rows of the same turn are ordered by role and text; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, whole): each prefix of n turns by its hash; whole marks the full conversation.

    Only hashes are shuffled, never texts.
    """
    present = F.struct(F.col("role").isNull(), F.col("text").isNull())
    t = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.xxhash64("role", "text", present).alias("x1"), F.xxhash64(F.lit(77), "text", "role", present).alias("x2")).distinct()
    w = Window.partitionBy("conv_id").orderBy("turn", "x1", "x2")
    t = t.select("conv_id", F.row_number().over(w).alias("n"), F.lead("x1").over(w).isNull().alias("whole"), "x1", "x2")
    w = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "n", "whole", F.bit_xor(F.xxhash64("n", "x1")).over(w).alias("h1"), F.bit_xor(F.xxhash64("x2", "n")).over(w).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that no longer one begins with; of equal ones the smallest id."""
    p = prefixes(turns)
    whole = p.where("whole").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = p.where("not whole").select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, keep: DataFrame) -> DataFrame:
    """One row for each kept conversation: conv_id, n_turns, n_copies, text in chat markup."""
    t = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text").join(keep, "conv_id")
    one = F.struct("turn", "role", "text")
    body = F.transform(F.array_sort(F.collect_set(one)), lambda x: F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(CLOSE + "\n")))
    return t.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(body, "").alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return render(turns, maximal(turns))


SQL = {
    "op5_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total,
             string_agg('<|im_start|>' || coalesce(role,'') || chr(10) || coalesce(text,'') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS body FROM t),
p AS (SELECT conv_id, n, total, body, md5(body) AS h FROM w),
f AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(body) AS text FROM p WHERE n = total GROUP BY n, h)
SELECT conv_id, n AS n_turns, n_copies, text FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = f.n AND p.h = f.h AND p.n < p.total)
"""
}
