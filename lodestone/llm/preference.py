"""Operator 7: preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows in each conversation is
its completion, of which only the assistant's turns (with their end mark) are trained on. All of it is
built-in array expressions over one row for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _MIDDLE, _CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    """Concatenated turns: <|role|> line, text, end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(_OPEN), t["role"], F.lit(_MIDDLE), t["text"], F.lit(_CLOSE))), "")


def _spans(turns: Column) -> Column:
    """[start, end) offsets of what is trained on, within the rendered turns."""
    head = lambda t: F.length(t["role"]) + len(_OPEN) + len(_MIDDLE)
    body = lambda t: F.length(t["text"]) + len(_CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    step = lambda a, t: F.struct(
        (a["at"] + head(t) + body(t)).alias("at"),
        F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + head(t)).alias("start"), (a["at"] + head(t) + body(t)).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(turns, start, step, lambda a: a["spans"])


def _gathered(df: DataFrame, name: str) -> DataFrame:
    clean = df.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return clean.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_set("t")), lambda t: F.struct(t["role"], t["text"])).alias(name))


def pairs_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chosen and a rejected version of every conversation with an assistant turn, as tables like it.

    Chosen is the conversation up to its last assistant turn. Rejected is the same with another last reply:
    the conversation's first assistant text, which answers another question; where that is the last reply
    itself, or equals it, the text of the turn before (an echo), or the empty text if it opens.
    Rows with a null conv_id or turn are ignored, a null role or text counts as empty, repeated rows count once, and of
    different rows with the same turn that with the smaller role, then text, comes first. A conversation without an
    assistant turn has no row in either table; an empty table gives empty tables; extra columns don't matter, and texts
    of any length are kept whole.
    """
    gathered = _gathered(conversations, "turns")
    n = F.size("turns")
    last = F.array_max(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.element_at("turns", i)["role"] == "assistant", i)))
    cut = gathered.withColumn("_last", last).where("_last IS NOT NULL").withColumn("turns", F.slice("turns", 1, F.col("_last")))
    reply = F.element_at("turns", -1)["text"]
    first = F.element_at(F.filter("turns", lambda t: t["role"] == "assistant"), 1)["text"]
    echo = F.when(F.size("turns") > 1, F.try_element_at("turns", F.lit(-2))["text"]).otherwise("")
    other = F.when(first != reply, first).otherwise(echo)
    swapped = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(F.struct(F.lit("assistant").alias("role"), other.alias("text"))))
    flat = lambda c: cut.select("conv_id", F.posexplode(c).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    return flat(F.col("turns")), flat(swapped)


def formatted(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask) for every conv_id in both tables.

    Each table is (conv_id, turn, role, text). n_shared turns, equal in role and text, make the prompt;
    chosen and rejected are the rendered rest, and the masks list 'start-end' offsets into them that are
    trained on. Conversations that are equal, or of which one begins the other, leave an empty completion.
    Rows with a null conv_id or turn are ignored; a null role or text counts as empty; repeated rows count
    once, and of different rows with the same turn that with the smaller role, then text, comes first.
    Extra columns don't matter; a conv_id in one table only has no row.
    """
    both = _gathered(chosen, "c").join(_gathered(rejected, "r"), "conv_id")
    least = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: F.element_at("c", i) != F.element_at("r", i))
    shared = F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, least)
    cut = both.withColumn("n", shared).select("conv_id", F.col("n").alias("n_shared"), F.slice("c", F.lit(1), F.col("n")).alias("p"), *[F.slice(x, F.col("n") + 1, F.size(x)).alias(x) for x in ("c", "r")])
    mask = lambda x: F.array_join(F.transform(_spans(F.col(x)), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return cut.select("conv_id", "n_shared", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))


SQL = r"""
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), ranked AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM clean
), last AS (
  SELECT conv_id, max(i) AS n, min(i) AS f FROM ranked WHERE role = 'assistant' GROUP BY conv_id
), chosen AS (
  SELECT r.conv_id, i, role, text, n, f FROM ranked r JOIN last l ON r.conv_id = l.conv_id AND i <= n
), other AS (
  SELECT l.conv_id, CASE WHEN fr.text <> lr.text THEN fr.text ELSE coalesce(pr.text, '') END AS reply, lr.text AS good
  FROM last l JOIN ranked fr ON fr.conv_id = l.conv_id AND fr.i = l.f JOIN ranked lr ON lr.conv_id = l.conv_id AND lr.i = l.n
  LEFT JOIN ranked pr ON pr.conv_id = l.conv_id AND pr.i = l.n - 1
), shared AS (
  SELECT l.conv_id, CASE WHEN reply = good THEN n ELSE n - 1 END AS k, reply, good FROM last l JOIN other o ON l.conv_id = o.conv_id
), prompt AS (
  SELECT c.conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) AS prompt
  FROM chosen c JOIN shared s ON c.conv_id = s.conv_id AND c.i <= s.k GROUP BY c.conv_id
)
SELECT s.conv_id, k::INTEGER AS n_shared, coalesce(prompt, '') AS prompt,
       CASE WHEN reply = good THEN '' ELSE '<|assistant|>' || chr(10) || good || '<|end|>' || chr(10) END AS chosen,
       CASE WHEN reply = good THEN '' ELSE '<|assistant|>' || chr(10) || reply || '<|end|>' || chr(10) END AS rejected,
       CASE WHEN reply = good THEN '' ELSE '14-' || (14 + length(good) + 8)::VARCHAR END AS chosen_mask,
       CASE WHEN reply = good THEN '' ELSE '14-' || (14 + length(reply) + 8)::VARCHAR END AS rejected_mask
FROM shared s LEFT JOIN prompt p ON s.conv_id = p.conv_id
"""
