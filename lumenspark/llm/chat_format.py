"""Preference formatting: one prompt from the turns two conversations share, and paired completions.

Native only. Turns of both sides of a pair meet in one aggregation; the longest common turn prefix is
rendered once, and each side's remaining turns become a completion whose mask lists the character
ranges to learn from: the assistant's words and the end mark after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

END_OF_TURN = "<|end|>"
LEARNED_ROLE = "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(END_OF_TURN + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Ranges (start, end) of the learned turns' texts and end marks in the rendered turns."""

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t["role"]))
        end = start + F.length(t["text"]) + len(END_OF_TURN)
        more = F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == LEARNED_ROLE, more).otherwise(a["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))
    return F.aggregate(turns, empty, step)["out"]


def format_preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns has a row per turn; side 0 is chosen, side 1 rejected, other sides and null pairs are left
    out. Turns order by (turn, role, text), so repeated rows are turns of their own. Null roles read
    "unknown", null texts are empty. A pair with one side only has an empty prompt and an empty other
    side. Columns besides the five are ignored; an empty table gives no pairs.
    """
    src = turns.where(F.col(pair).isNotNull() & F.col(side).isin(0, 1))
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = src.groupBy(F.col(pair).alias("pair_id")).agg(*(F.array_sort(F.collect_list(F.when(F.col(side) == i, item))).alias(n) for i, n in enumerate(("c", "r"))))
    least = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i <= least) & (F.get("c", i - 1)["role"] == F.get("r", i - 1)["role"]) & (F.get("c", i - 1)["text"] == F.get("r", i - 1)["text"]))
    ends = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)).cast("int")
    out = both.withColumn("n", F.when(ends == 0, least).otherwise(ends - 1))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    out = out.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), *(F.when(F.size(c) > F.col("n"), tail(c)).otherwise(F.slice(c, 1, 0)).alias(c) for c in ("c", "r")))
    return out.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def _ranges(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"], m["end"])), ",")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the whole table are pair k."""
    turns = read(spark, sf_dir, "conversations")
    turns = turns.select(F.expr("conv_id div 2").alias("pair_id"), F.expr("cast(conv_id % 2 as int)").alias("side"), "turn", "role", "text")
    out = format_preferences(turns)
    return out.withColumn("chosen_mask", _ranges("chosen_mask")).withColumn("rejected_mask", _ranges("rejected_mask"))


OP10_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id
), same AS (
  SELECT c.pair_id, c.pos, c.role = r.role AND c.text = r.text AS eq
  FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.side = 0 AND r.side = 1
), n AS (
  SELECT s.pair_id, coalesce((SELECT min(pos) - 1 FROM same x WHERE x.pair_id = s.pair_id AND NOT eq), least(nc, nr)) AS n FROM sizes s
), r AS (
  SELECT t.pair_id, side, pos, role, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body, length(role) + 5 AS head, length(text) + 7 AS tail
  FROM t JOIN n USING (pair_id)
), q AS (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r WHERE pos > n
), m AS (
  SELECT pair_id, side, string_agg(body, '' ORDER BY pos) AS body,
         string_agg(CAST(CAST(start + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + head + tail AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (role = 'assistant') AS mask
  FROM q GROUP BY pair_id, side
), p AS (
  SELECT pair_id, string_agg(body, '' ORDER BY pos) AS body FROM r WHERE side = 0 AND pos <= n GROUP BY pair_id
)
SELECT n.pair_id, CAST(n.n AS BIGINT) AS n_prompt_turns, coalesce(p.body, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(j.body, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(j.mask, '') AS rejected_mask
FROM n LEFT JOIN p USING (pair_id) LEFT JOIN m c ON c.pair_id = n.pair_id AND c.side = 0 LEFT JOIN m j ON j.pair_id = n.pair_id AND j.side = 1
"""

QUERIES = {"op10_preference_format": op10_preference_format}
SQL = {"op10_preference_format": OP10_SQL}
