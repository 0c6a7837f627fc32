"""Assembly of instruction data: entries, messages, splits, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .generate import draw

SYSTEM = "You are a helpful assistant. Answer from the context; say NOT_IN_CONTEXT if it does not hold the answer."


def entries(symbols: DataFrame, qa: DataFrame, debug: DataFrame) -> DataFrame:
    """symbols (path, name, ..) with nested qa_pairs and debugging_tasks; those without either are left out."""
    nest = lambda df, name: df.groupBy("path", "name").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in ("path", "name")]))).alias(name))
    joined = symbols.join(nest(qa, "qa_pairs"), ["path", "name"], "left").join(nest(debug, "debugging_tasks"), ["path", "name"], "left")
    return joined.where((F.coalesce(F.size("qa_pairs"), F.lit(0)) > 0) | (F.coalesce(F.size("debugging_tasks"), F.lit(0)) > 0))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def instruct(question: Column, answer: Column, context: Column | None = None) -> Column:
    """System, user and assistant messages; the context, if any, comes before the question."""
    asked = question if context is None else F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)
    return F.array(message("system", F.lit(SYSTEM)), message("user", asked), message("assistant", answer))


def train_split(rows: DataFrame, key: str, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with split: the floor(n * ratio) groups of `key` that come first in the seeded order are train.

    Every row of a group falls on one side. Only the distinct keys are ordered.
    """
    ratio = min(1.0, max(0.0, ratio))
    keys = rows.select(key).distinct().withColumn("_h", draw(F.col(key), seed=seed))
    n = keys.count()
    # two-level ranking: counts of 256 hash ranges give each range its offset, so that no window holds all keys
    ranges = keys.withColumn("_r", F.substring("_h", 1, 2))
    sizes = {r["_r"]: r["n"] for r in ranges.groupBy("_r").agg(F.count("*").alias("n")).collect()}
    offset, at = {}, 0
    for r in sorted(sizes):
        offset[r], at = at, at + sizes[r]
    start = F.create_map(*[F.lit(x) for pair in offset.items() for x in pair]) if offset else F.lit(None)
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) + (start[F.col("_r")] if offset else 0)
    named = ranges.withColumn("split", F.when(place <= int(n * ratio), "train").otherwise("val")).select(key, "split")
    return rows.join(named, key)


def chat_text(messages: Column) -> Column:
    """Messages as one training text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")


def last_user_turn(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of each conversation's last user turn."""
    return turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", "x.turn", "x.text")


def conversation_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): turns in order as messages."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"], t["content"])).alias("messages"))


def packed(rows: DataFrame, tokens: str, order: str, by: str, size: int) -> DataFrame:
    """rows with bin: consecutive rows of a group share a bin of `size` tokens by their running total."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("bin", F.floor((F.sum(tokens).over(w) - 1) / size))


def numbered_context(results: DataFrame) -> DataFrame:
    """(query_id, context): '[i] citation' and text of the results in order of rank."""
    items = F.array_sort(F.collect_list(F.struct("rank", "citation", "text")))
    return results.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["citation"], F.lit("\n"), x["text"])), "\n\n").alias("context"))


def negatives_as_qa(negatives: DataFrame) -> DataFrame:
    return negatives.select("path", "name", F.lit("negative").alias("focus"), "question", F.lit("NOT_IN_CONTEXT").alias("answer"), F.lit(True).alias("is_negative"))


def works_cited(citations: DataFrame) -> DataFrame:
    """Distinct citation texts in order."""
    return citations.select("citation").where("citation IS NOT NULL").distinct().orderBy("citation")


def budgeted(parts: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """(by, context): parts in order while their running length stays below `most`, joined by line ends."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = parts.withColumn("_sum", F.sum(F.length(text)).over(w)).where(F.col("_sum") < most)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("context"))


FORMS = {"qa": "What follows is code. {question}", "debug": "Find what is wrong in this code. {question}", "paper": "What follows is from a paper. {question}"}


def examples(rows: DataFrame, pairs: str = "qa_pairs", form: str = "qa") -> DataFrame:
    """(path, position, messages, metadata): one example for each pair (question, answer) of an entry (path, context, pairs).

    Pairs without a question or an answer are left out; metadata names the entry, the form and the pair's place.
    """
    one = rows.select("path", "context", F.posexplode(pairs).alias("position", "p")).where("trim(p.question) <> '' AND trim(p.answer) <> ''")
    asked = F.replace(F.lit(FORMS[form]), F.lit("{question}"), F.col("p.question"))
    told = F.create_map(F.lit("path"), F.col("path").cast("string"), F.lit("form"), F.lit(form), F.lit("position"), F.col("position").cast("string"))
    return one.select("path", "position", instruct(asked, F.col("p.answer"), F.col("context")).alias("messages"), told.alias("metadata"))
