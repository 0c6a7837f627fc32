"""Questions, negatives, bugs and chunk combinations for instruction data, all with seeded choices."""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASKS = {"simple": (2, 1), "moderate": (3, 2), "complex": (4, 3), "very_complex": (5, 3)}
FOCUS = (
    ("purpose", "What is the purpose of `{name}`?"),
    ("parameters", "What parameters does `{name}` take and what are they for?"),
    ("flow", "How does control flow through `{name}`?"),
    ("returns", "What does `{name}` return?"),
    ("edge_cases", "Which edge cases does `{name}` handle?"),
    ("general", "Explain how `{name}` works."),
)
NEGATIVES = (
    ("nonexistent_parameter", "function,method", "What does the `{fake}` parameter of `{name}` control?"),
    ("nonexistent_method", "class,struct", "How does the `{fake}` method of `{name}` work?"),
    ("external_knowledge", "function,method,class,struct", "Which library versions is `{name}` compatible with?"),
    ("performance_claim", "function,method", "How fast is `{name}` on a million records?"),
    ("usage_elsewhere", "function,method,class,struct", "Which other projects use `{name}`?"),
    ("history", "function,method,class,struct", "Who wrote `{name}` and when?"),
)
FAKES = ("timeout", "retries", "verbose", "cache_size", "encoding", "strict", "callback", "max_depth", "locale", "threads")
BUGS = (
    ("off_by_one", r"range\(([^()]+)\)", r"range(\1 + 1)", "medium"),
    ("comparison", r"<=", "<", "medium"),
    ("comparison", r">=", ">", "medium"),
    ("operator", r"(\w) \+ (\w)", r"\1 - \2", "medium"),
    ("logic", r"\band\b", "or", "hard"),
    ("logic", r"\bnot ", "", "hard"),
    ("boolean", r"\bTrue\b", "False", "easy"),
    ("null_check", r"\bis not None\b", "is None", "medium"),
    ("assignment", r"\+=", "-=", "medium"),
    ("equality", r"==", "!=", "easy"),
    ("boundary", r"\[0\]", "[1]", "easy"),
    ("return", r"return (\w+)$", "return None", "easy"),
)
SEVERITY = {"off_by_one": "medium", "comparison": "medium", "operator": "high", "logic": "high", "boolean": "high", "null_check": "high", "assignment": "high", "equality": "high", "boundary": "medium", "return": "high"}


def draw(*keys: Column, seed: int = 42) -> Column:
    """A hash that orders rows like a seeded shuffle; md5, so that any engine can follow it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def task_counts(level: Column) -> list[Column]:
    """qa and debug tasks for a tier, scaled down above 10 in total and topped up below 3."""
    qa = F.coalesce(*[F.when(level == k, F.lit(v[0])) for k, v in TASKS.items()], F.lit(2))
    debug = F.coalesce(*[F.when(level == k, F.lit(v[1])) for k, v in TASKS.items()], F.lit(1))
    total = qa + debug
    shrink = lambda n: F.when(total > 10, F.greatest(F.lit(1), F.floor(n * 10 / total))).otherwise(n)
    return [(shrink(qa) + F.when(total < 3, 3 - total).otherwise(0)).cast("int").alias("qa"), shrink(debug).cast("int").alias("debug")]


#: symbols sorted, and put bugs into, in a task
SORTED, INJECTED = 100_000, 20_000


def _dealt(symbols: DataFrame, rows: int, *by: str) -> DataFrame:
    """symbols in tasks of about `rows`, as many as there are cores at least, however small their files are."""
    n = max(math.ceil(symbols.count() / rows), symbols.sparkSession.sparkContext.defaultParallelism)
    return symbols.repartition(n, *by)


def questions(symbols: DataFrame, count: Column, seed: int = 42) -> DataFrame:
    """(path, name, focus, question): `count` seeded templates for each symbol."""
    dim = F.array(*[F.struct(F.lit(f).alias("focus"), F.lit(t).alias("template")) for f, t in FOCUS])
    all_ = _dealt(symbols.withColumn("_count", count), SORTED, "path", "name").select("path", "name", "_count", F.explode(dim).alias("d"))
    w = Window.partitionBy("path", "name").orderBy(draw(F.col("path"), F.col("name"), F.col("d.focus"), seed=seed))
    return all_.withColumn("_n", F.row_number().over(w)).where("_n <= _count").select("path", "name", "d.focus", F.replace(F.col("d.template"), F.lit("{name}"), F.col("name")).alias("question"))


def negatives(symbols: DataFrame, per_symbol: int = 1, seed: int = 42) -> DataFrame:
    """(path, name, negative_type, question, trap): questions the source can't answer, of kinds its type allows.

    A made-up name is the first in the seeded order that the symbol's parameters don't have.
    """
    dim = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(on).alias("on"), F.lit(t).alias("t")) for k, on, t in NEGATIVES])
    all_ = _dealt(symbols, SORTED, "path", "name").select("path", "name", "type", "parameters", F.explode(dim).alias("d")).where(F.array_contains(F.split("d.on", ","), F.col("type")))
    order = F.array_sort(F.transform(F.array(*[F.lit(f) for f in FAKES]), lambda f: F.struct(F.md5(F.concat(F.lit(str(seed)), F.col("name"), f)).alias("h"), f.alias("f"))))
    fake = F.try_element_at(F.filter(F.transform(order, lambda x: x["f"]), lambda f: ~F.array_contains("parameters", f)), F.lit(1))
    w = Window.partitionBy("path", "name").orderBy(draw(F.col("path"), F.col("name"), F.col("d.k"), seed=seed))
    cut = all_.withColumn("fake", fake).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_symbol)
    text = F.replace(F.replace(F.col("d.t"), F.lit("{name}"), F.col("name")), F.lit("{fake}"), F.coalesce("fake", F.lit("option")))
    return cut.select("path", "name", F.col("d.k").alias("negative_type"), text.alias("question"), F.when(F.col("d.t").contains("{fake}"), F.col("fake")).alias("trap"))


def negative_share(count: Column, share: float = 0.15) -> Column:
    return F.greatest(F.lit(1), F.floor(count * share)).cast("int")


_BUG = T.StructType([T.StructField(n, t) for n, t in (("bug_type", T.StringType()), ("buggy", T.StringType()), ("line", T.IntegerType()), ("severity", T.StringType()), ("difficulty", T.StringType()))])


def _valid(source: str, language: str) -> bool:
    if language != "python":
        return True
    try:
        ast.parse(source)
    except (SyntaxError, ValueError):
        return False
    return True


def inject(source: str, language: str, skip: frozenset[str] = frozenset()) -> tuple | None:
    """The first applicable bug, one substitution, that still parses (checked for Python only)."""
    import textwrap

    body = textwrap.dedent(source)
    for kind, pattern, new, difficulty in BUGS:
        if kind in skip:
            continue
        changed = re.sub(pattern, new, body, count=1, flags=re.M)
        if changed != body and _valid(changed, language):
            line = next(i for i, (a, b) in enumerate(zip(body.split("\n"), changed.split("\n")), 1) if a != b)
            return kind, changed, line, SEVERITY.get(kind, "medium"), difficulty
    return None


@F.pandas_udf(T.ArrayType(_BUG))
def injected(source: pd.Series, language: pd.Series, most: pd.Series) -> pd.Series:
    """Up to `most` bugs of distinct kinds, each put into the code that the one before left."""
    out = []
    for code, tongue, n in zip(source, language, most):
        found, seen = [], set()
        while code and len(found) < n and (bug := inject(code, tongue, frozenset(seen))):
            found.append(dict(zip(("bug_type", "buggy", "line", "severity", "difficulty"), bug)))
            seen.add(bug[0])
            code = bug[1]
        out.append(found)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def variable_names(source: pd.Series) -> pd.Series:
    """Assigned names of Python sources in order; by pattern where a source doesn't parse."""
    out = []
    for code in source:
        try:
            names = [n.id for n in ast.walk(ast.parse(code or "")) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        except (SyntaxError, ValueError):
            names = re.findall(r"^\s*(\w+)\s*=(?!=)", code, re.M)
        out.append(list(dict.fromkeys(names)))
    return pd.Series(out, dtype=object)


def changed_line(a: Column, b: Column) -> Column:
    """Number of the first line in which two sources differ, 0 if none does."""
    pairs = F.zip_with(F.split(a, "\n"), F.split(b, "\n"), lambda x, y: x.eqNullSafe(y))
    return F.array_position(pairs, False).cast("int")


def debug_tasks(bugs: DataFrame) -> DataFrame:
    """(path, name, bug_type, task, prompt): the tasks for each bug: find, fix, and explain for hard ones."""
    dim = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(p).alias("prompt")) for t, p in (("find", "Find the bug in `{name}`."), ("fix", "Fix the bug in `{name}`."), ("explain", "Explain why `{name}` misbehaves."))])
    tasks = bugs.select("path", "name", "bug_type", "difficulty", F.explode(dim).alias("d")).where((F.col("d.task") != "explain") | (F.col("difficulty") == "hard"))
    return tasks.select("path", "name", "bug_type", "d.task", F.replace(F.col("d.prompt"), F.lit("{name}"), F.col("name")).alias("prompt"))


def combinations(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, size, indices): seeded distinct sets of 2, 4 and 6 chunks; min(10, n/3), min(5, n/4) and min(3, n/5) draws."""
    counted = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("all"))
    plan = F.array(*[F.struct(F.lit(s).alias("size"), F.least(F.lit(most), F.floor(F.size("all") / by)).cast("int").alias("draws")) for s, most, by in ((2, 10, 3), (4, 5, 4), (6, 3, 5))])
    draws = counted.select("doc_id", "all", F.explode(plan).alias("p")).where((F.col("p.draws") > 0) & (F.size("all") >= F.col("p.size"))).select("doc_id", "all", "p.size", F.explode(F.sequence(F.lit(1), F.col("p.draws"))).alias("draw"))
    order = F.array_sort(F.transform("all", lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string"), F.col("draw").cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    return draws.select("doc_id", "size", F.array_sort(F.transform(F.slice(order, F.lit(1), F.col("size")), lambda x: x["i"])).alias("indices")).distinct()


def integration_type(sections: Column) -> Column:
    has = lambda s: F.array_contains(sections, s)
    return F.when(has("introduction") & has("conclusion"), "contextual").when(has("methods") & has("results"), "sequential").when(F.size(F.array_distinct(sections)) == F.size(sections), "synthesis").otherwise("comparison")


def difficulty(chunks: Column) -> Column:
    return F.when(chunks <= 2, "medium").when(chunks <= 4, "hard").otherwise("very_hard")


def parsed_answer(raw: Column) -> list[Column]:
    """question and answer of a 'QUESTION: .. ANSWER: ..' reply; '' where a part is missing."""
    bare = lambda c: F.regexp_replace(c, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    return [bare(F.regexp_extract(raw, "(?s)QUESTION:(.*?)ANSWER:", 1)).alias("question"), bare(F.regexp_extract(raw, "(?s)ANSWER:(.*)$", 1)).alias("answer")]


TECHNICAL = ("algorithm", "configuration", "implementation", "optimization", "performance")
OUTWARD = ("benchmark", "compare", "connect", "deployment", "equivalent", "first", "history", "integrate", "originally", "production", "require", "scale", "version", "when", "who", "why")
COMPARING = ("alternative", "better", "compare", "faster", "versus")
TRICKY = (("design_pattern", "Which design pattern does `{name}` follow?"), ("time_complexity", "What is the time complexity of `{name}`?"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def traps(question: Column, name: Column, kind: Column) -> Column:
    """What tempts to answer a negative question: array of real_name, technical, detailed, plausible_parameter, asks_for_numbers."""
    low = F.lower(question)
    parts = (
        F.when(question.contains(name), "real_name"),
        F.when(_any(low, TECHNICAL), "technical"),
        F.when(F.size(F.filter(F.split(F.trim(question), "[ \\t\\r\\n]+"), lambda w: w != "")) > 10, "detailed"),
        F.when(kind == "nonexistent_parameter", "plausible_parameter").when(kind == "performance_claim", "asks_for_numbers"),
    )
    return F.array_compact(F.array(*parts))


def cues(question: Column, kind: Column) -> Column:
    """What should lead to abstaining: array of outside_words, absent_element, outside_domain, comparison."""
    low = F.lower(question)
    parts = (
        F.when(_any(low, OUTWARD), "outside_words"),
        F.when(kind.isin("nonexistent_parameter", "nonexistent_method"), "absent_element"),
        F.when(kind == "external_knowledge", "outside_domain"),
        F.when(_any(low, COMPARING), "comparison"),
    )
    return F.array_compact(F.array(*parts))


def adversarial(symbols: DataFrame) -> DataFrame:
    """(path, name, focus, question, difficulty): two hard questions for each symbol that its source only seems to answer."""
    dim = F.array(*[F.struct(F.lit(f).alias("focus"), F.lit(t).alias("t")) for f, t in TRICKY])
    every = symbols.select("path", "name", F.explode(dim).alias("d"))
    return every.select("path", "name", "d.focus", F.replace(F.col("d.t"), F.lit("{name}"), F.col("name")).alias("question"), F.lit("hard").alias("difficulty"))


def versions(symbols: DataFrame) -> DataFrame:
    """(path, name, task, original, buggy, bug_type, line): for each symbol (path, name, source, language) with a bug to
    plant, one comparison of both versions and up to two steps, the second of which starts from the first one's bug."""
    made = _dealt(symbols, INJECTED, "path", "name", "source").select("path", "name", "source", injected(F.col("source"), F.col("language"), F.lit(2)).alias("all"))
    step = lambda i: F.struct(F.concat(F.lit("step_"), (i + 1).cast("string")).alias("task"), F.when(i == 0, F.col("source")).otherwise(F.get("all", F.lit(0))["buggy"]).alias("original"), F.get("all", i).alias("b"))
    steps = F.transform("all", lambda b, i: step(i))
    compared = F.transform(F.slice("all", 1, 1), lambda b: F.struct(F.lit("compare").alias("task"), F.col("source").alias("original"), b.alias("b")))
    tasks = made.select("path", "name", F.explode(F.concat(compared, steps)).alias("t"))
    return tasks.select("path", "name", "t.task", "t.original", "t.b.buggy", "t.b.bug_type", "t.b.line")


def task_stats(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n) for each of the columns: what was generated, by kind."""
    parts = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return parts.groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
