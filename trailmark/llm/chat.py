"""Chat formatting of preferences: shared prompt, paired completions, loss masks.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns is rendered once as the prompt;
what remains of each is a completion. A completion's mask lists the stretches that a model is trained on: the text and
end mark of assistant turns. Everything is DataFrame functions on arrays of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
TURNS = "array<struct<role:string,text:string>>"
NO_ROLE = "unknown"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns (role, text) in order of turn, then role, then text; nulls first.

    A null role is `unknown`, a null text empty; rows without conv_id form one conversation. Repeated rows repeat turns.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(NO_ROLE)).alias("role"),
                   F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def contrasted(talks: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected of each conversation (conv_id, turns) with itself gone stale: from the second half of
    its assistant turns on, each gives the conversation's first assistant text again."""
    answers = F.filter("turns", lambda t: t["role"] == TRAINED)
    rows = talks.withColumn("answers", answers).withColumn(
        "places", F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("stale_from", F.get("places", F.ceil(F.size("places") / 2).cast("int")))
    stale = F.transform("turns", lambda t, i: F.when(
        (i >= F.col("stale_from")) & (t["role"] == TRAINED),
        F.struct(t["role"].alias("role"), F.get("answers", F.lit(0))["text"].alias("text"))).otherwise(t))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), stale.cast(TURNS).alias("rejected"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def written_out(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_stretches(turns: Column) -> Column:
    """(start, end) in code points of the trained text in rendered turns, end exclusive."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        head = a["at"] + F.length(t["role"]) + 5  # <|role|> and a line end
        end = head + F.length(t["text"]) + 7  # text and <|end|>
        found = F.array(F.struct(head.alias("start"), end.alias("end")))
        return F.struct((a["at"] + F.length(rendered(t))).alias("at"),
                        F.when(t["role"] == TRAINED, F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, begin, step, lambda a: a["out"])


def preferences(pairs: DataFrame) -> DataFrame:
    """One row per pair (pair_id, chosen, rejected): pair_id, n_prompt_turns, prompt, chosen, rejected (completions),
    chosen_mask, rejected_mask (arrays of start and end).

    Null conversations count as empty. Equal conversations are all prompt, with empty completions and masks.
    """
    empty = F.array().cast(TURNS)
    rows = pairs.select("pair_id", F.coalesce(F.col("chosen").cast(TURNS), empty).alias("c"), F.coalesce(F.col("rejected").cast(TURNS), empty).alias("r"))
    apart = F.array_position(F.zip_with("c", "r", lambda c, r: c.eqNullSafe(r)), False)
    rows = rows.withColumn("n", F.when(apart > 0, apart - 1).otherwise(F.size("c")).cast("int"))
    rows = rows.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"),
                       *(F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))).alias(x) for x in ("c", "r")))
    return rows.select("pair_id", F.col("n").alias("n_prompt_turns"), written_out(F.col("p")).alias("prompt"),
                       written_out(F.col("c")).alias("chosen"), written_out(F.col("r")).alias("rejected"),
                       trained_stretches(F.col("c")).alias("chosen_mask"), trained_stretches(F.col("r")).alias("rejected_mask"))


# The same for the derived pairs, relationally: a turn differs from its stale form where the rejected text differs.
PREFERENCES_SQL = """
WITH rows_ AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations),
answers AS (
  SELECT conv_id, place, text, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_ WHERE role = 'assistant'),
turns AS (
  SELECT r.conv_id, r.place, r.role, r.text AS chosen,
    CASE WHEN a.k > ceil(a.n / 2.0) THEN f.text ELSE r.text END AS rejected
  FROM rows_ r LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND a.place = r.place
  LEFT JOIN answers f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = 1),
cut AS (
  SELECT conv_id, coalesce(min(place) FILTER (WHERE chosen <> rejected) - 1, max(place)) AS n FROM turns GROUP BY conv_id),
parts AS (
  SELECT t.conv_id, t.place, t.role, c.n, t.place <= c.n AS prompt,
    '<|' || role || '|>' || chr(10) || chosen || '<|end|>' || chr(10) AS c,
    '<|' || role || '|>' || chr(10) || rejected || '<|end|>' || chr(10) AS r,
    length(chosen) AS cl, length(rejected) AS rl
  FROM turns t JOIN cut c ON c.conv_id IS NOT DISTINCT FROM t.conv_id),
placed AS (
  SELECT *, sum(CASE WHEN prompt THEN 0 ELSE length(c) END) OVER w - CASE WHEN prompt THEN 0 ELSE length(c) END AS c_at,
    sum(CASE WHEN prompt THEN 0 ELSE length(r) END) OVER w - CASE WHEN prompt THEN 0 ELSE length(r) END AS r_at
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY place))
SELECT conv_id AS pair_id, CAST(max(n) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(c, '' ORDER BY place) FILTER (WHERE prompt), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY place) FILTER (WHERE NOT prompt), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY place) FILTER (WHERE NOT prompt), '') AS rejected,
  coalesce(string_agg(CAST(c_at + length(role) + 5 AS BIGINT) || ':' || CAST(c_at + length(role) + 12 + cl AS BIGINT), ',' ORDER BY place)
    FILTER (WHERE NOT prompt AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(r_at + length(role) + 5 AS BIGINT) || ':' || CAST(r_at + length(role) + 12 + rl AS BIGINT), ',' ORDER BY place)
    FILTER (WHERE NOT prompt AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
