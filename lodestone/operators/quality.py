"""Transparent rubrics: parsing scores, gates, feedback, section and draft scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("groundedness", "specificity", "clarity", "usefulness", "consistency", "completeness")
WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.10, 0.05)
GATE = {"groundedness": 0.7, "specificity": 0.6, "clarity": 0.6, "usefulness": 0.5}
FLOORS = {"Background": 300, "Specific Aims": 200, "Significance": 250, "Innovation": 200, "Approach": 400, "Environment": 150, "Bibliography": 50}
OUTSIDE = ("best practice", "common practice", "recommended approach", "industry standard", "generally", "usually", "typically", "in most cases", "framework", "external library", "see documentation", "refer to manual", "documented in", "according to the documentation")
_GOOD = ("What it says rests on the context", "It goes into detail", "It reads clearly", "It teaches something")
_BAD = ("What it says doesn't rest on the context", "It stays vague", "It is hard to follow", "It teaches little")
_SUGGEST = ("Say only what the context shows", "Name details and examples from the context", "Order and word the answer more plainly", "Ask about what a learner needs")
_ADVICE = ("improve grounding in provided context", "increase specificity and detail", "improve clarity and structure", "focus on educational value")


def parsed_scores(raw: Column) -> list[Column]:
    """The six scores of a model's reply: from JSON, else from the first braces in it, else field by field, else 0."""
    schema = ", ".join(f"{f} double" for f in FIELDS)
    inner = F.regexp_extract(raw, "(\\{[^}]+\\})", 1)
    out = []
    for f in FIELDS:
        found = F.regexp_extract(raw, f'"{f}":[ \\t\\r\\n]*([0-9.]+)', 1)
        loose = F.when(found.rlike("^[0-9]+(\\.[0-9]+)?$"), found.cast("double"))
        out.append(F.coalesce(F.from_json(raw, schema)[f], F.from_json(inner, schema)[f], loose, F.lit(0.0)).alias(f))
    return out


def overall(*scores: Column) -> Column:
    """Weighted sum of the six scores at three digits, of a decimal, so that halves round up."""
    return F.round(sum((w * s for w, s in zip(WEIGHTS, scores)), F.lit(0.0)).cast("decimal(18,6)"), 3).cast("double")


def passes_gate() -> Column:
    ok = F.lit(True)
    for f, least in GATE.items():
        ok = ok & (F.col(f) >= least)
    return ok


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "acceptable").otherwise("poor")


def feedback(score: Column, cited: Column, negative: Column) -> list[Column]:
    """strengths, weaknesses, suggestions and verdict columns from the score fields; score is the overall one."""
    some = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    bare = ~cited & ~negative
    strong = [F.when(F.col(f) >= 0.8, t) for f, t in zip(FIELDS, _GOOD)] + [F.when(cited, "It cites its sources")]
    weak = [F.when(F.col(f) < 0.5, t) for f, t in zip(FIELDS, _BAD)] + [F.when(bare, "It cites nothing")]
    todo = [F.when(F.col(f) < 0.5, t) for f, t in zip(FIELDS, _SUGGEST)] + [F.when(bare, "Point to lines or snippets of the context")]
    return [some(strong).alias("strengths"), some(weak).alias("weaknesses"), some(todo).alias("suggestions"), band(score).alias("verdict")]


def coverage(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct words that the context has; 0 without words."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[\\p{L}\\p{N}_]+"), 0))
    own = words(answer)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words(context))) / F.size(own)).otherwise(0.0)


def citation_facts(citations: Column, answer: Column, context: Column) -> list[Column]:
    """has_citations, citation_count, line_references, code_snippets and code_coverage of an answer."""
    starts = lambda what: F.size(F.filter(citations, lambda c: c.startswith(what)))
    n = F.size(citations)
    return [(n > 0).alias("has_citations"), n.alias("citation_count"), starts("line").alias("line_references"), starts("code:").alias("code_snippets"), F.round(coverage(answer, context), 9).alias("code_coverage")]


def regeneration(answer: Column, negative: Column) -> list[Column]:
    """regenerate and guidance: what to improve, or, for an unexpected abstention, to ask something else."""
    parts = F.concat_ws(", ", *[F.when(F.col(f) < least, F.lit(t)) for (f, least), t in zip(GATE.items(), _ADVICE)])
    odd = (answer == "NOT_IN_CONTEXT") & ~negative
    text = F.when(odd, "The question needs outside knowledge; ask one that the context answers").when(~passes_gate(), F.concat(F.lit("Regenerate with focus on: "), parts)).otherwise("")
    return [(odd | ~passes_gate()).alias("regenerate"), text.alias("guidance")]


def running_mean(rows: DataFrame, value: str, order: list, by: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_mean", F.round(F.avg(value).over(w), 9))


def section_score(section: Column, text: Column, citations: Column) -> Column:
    """0 to 1 for a draft of a section: length, citations, and the words the section should have."""
    words = F.size(F.filter(F.split(F.trim(text), "[ \\t\\r\\n]+"), lambda w: w != ""))
    low = F.lower(text)
    floor = F.coalesce(*[F.when(section == s, F.lit(n)) for s, n in FLOORS.items()], F.lit(100))
    less = lambda test, by: F.when(test, by).otherwise(0.0)
    off = F.when(words < floor, 0.2).when(words > 1000, 0.1).otherwise(0.0)
    off = off + less((section != "Bibliography") & (citations < 2), 0.15) + less((section != "Bibliography") & (words > 500) & (citations < 5), 0.1)
    off = off + less((section == "Background") & ~low.rlike("gap|limitation"), 0.1)
    off = off + less((section == "Specific Aims") & ~low.rlike("aim 1|aim one"), 0.2) + less((section == "Specific Aims") & (F.regexp_count(low, F.lit("aim ")) < 2), 0.1)
    off = off + less((section == "Significance") & ~low.contains("impact"), 0.1) + less((section == "Innovation") & ~low.rlike("novel|innovative"), 0.1)
    off = off + less((section == "Approach") & ~low.rlike("method|protocol"), 0.1)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - off)), 6)


def section_band(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.75, "good").when(score >= 0.6, "fair").otherwise("needs work")


def external_knowledge(text: Column) -> Column:
    """Whether an answer draws on knowledge outside its context, by its phrases; an abstention never does."""
    found, low = F.lit(False), F.lower(text)
    for phrase in OUTSIDE:
        found = found | low.contains(phrase)
    return found & ~text.contains("NOT_IN_CONTEXT")


def needs_context(feedback: Column) -> Column:
    """Whether feedback on a draft asks for more than the draft's own context, by any of 13 words anywhere in it."""
    found, low = F.lit(False), F.lower(feedback)
    for word in ("add", "address", "cite", "cover", "describe", "detail", "discuss", "elaborate", "expand", "explain", "include", "more", "reference"):
        found = found | low.contains(word)
    return found


def grounded(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows whose answer isn't an abstention."""
    return rows.where(F.col(answer).isNotNull() & ~F.col(answer).contains("NOT_IN_CONTEXT"))


def five_point(section: Column, text: Column) -> Column:
    """The older rubric, 0 to 5: length, the words a section should have, and at least three sentences."""
    low, size = F.lower(text), F.length(F.trim(text))
    off = lambda test, by: F.when(test, by).otherwise(0.0)
    lost = off(size < 100, 2.0) + off(size > 2000, 0.5) + off(F.size(F.split(text, "\\. ")) < 3, 1.0)
    lost = lost + off((section == "Background") & ~low.contains("gap") & ~low.contains("problem"), 1.0)
    lost = lost + off((section == "Objectives") & ~low.rlike("\\b(aim|goal|objective)\\b"), 1.0)
    lost = lost + off((section == "Specific Aims") & ~low.rlike("aim [0-9]|aim one|aim two|aim three"), 1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), 5.0 - lost))


def five_point_band(score: Column) -> Column:
    return F.when(score >= 4.0, "ready for review").when(score >= 3.0, "minor changes").otherwise("major changes")


def evaluated(rows: DataFrame, scorer) -> DataFrame:
    """rows with the six scores that `scorer` (rows -> rows with FIELDS) gives, their overall score and whether they pass."""
    return scorer(rows).withColumn("overall", overall(*[F.col(f) for f in FIELDS])).withColumn("passes", passes_gate())
