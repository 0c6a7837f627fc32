"""Code analytics: symbols, complexity, importance.

Finding a symbol's end needs a scan with state, so extraction is a table function over whole files
(mapInPandas); everything measured on a symbol afterwards is built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?\s*:", re.M)
_PY_CLASS = re.compile(r"^(\s*)class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:", re.M)
_R_DEF = re.compile(r"^[ \t]*([.\w][.\w]*)\s*(?:<-|=)\s*function\s*\(([^)]*)\)\s*\{", re.M)
_C_DEF = re.compile(r"^[ \t]*((?:[A-Za-z_][\w:<>,*&]*[ \t*&]+)+)([A-Za-z_~][\w:~]*)\s*\(([^;{}()]*)\)\s*(?:const\s*)?(?:override\s*)?\{", re.M)
_C_STRUCT = re.compile(r"^[ \t]*(?:typedef\s+)?struct\s+(\w+)\s*\{", re.M)
_CPP_CLASS = re.compile(r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(\w+)[^;{]*\{", re.M)
_RESERVED = frozenset("if else for while switch return do case sizeof".split())
SCHEMA = "path string, language string, name string, type string, start_line int, end_line int, source string, parameters array<string>, parent string, is_private boolean"


def _block_end(lines: list[str], first: int, indent: int) -> int:
    """Last line of an indented block: the end lies before the first non-blank line at or left of the indent."""
    last = first
    for i in range(first + 1, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            last = i
    return last


def _brace_end(source: str, opening: int) -> int:
    depth = 0
    for i in range(opening, len(source)):
        if source[i] == "{":
            depth += 1
        elif source[i] == "}":
            depth -= 1
            if not depth:
                return i
    return len(source) - 1


def _names(parameters: str, language: str) -> list[str]:
    out = []
    for p in parameters.split(","):
        p = p.split("=")[0].strip()
        if language == "python":
            p = p.split(":")[0].strip().lstrip("*")
            if p in ("", "self", "cls", "/"):
                continue
        elif language in ("c", "cpp"):
            p = (re.findall(r"\w+", p) or [""])[-1]
            if p == "void":
                continue
        if p:
            out.append(p)
    return out


def symbols_of(path: str, source: str, language: str) -> list[tuple]:
    """Symbols of one file in source order; unbalanced braces end at the end of the file."""
    found: list[tuple] = []
    line_of = lambda at: source.count("\n", 0, at) + 1
    if language == "python":
        lines = source.split("\n")
        classes = []
        for m in _PY_CLASS.finditer(source):
            indent, first = len(m[1].lstrip("\n")), line_of(m.start(2)) - 1
            last = _block_end(lines, first, indent)
            classes.append((first, last, m[2]))
            found.append((path, language, m[2], "class", first + 1, last + 1, "\n".join(lines[first : last + 1]), [], None, m[2].startswith("_")))
        for m in _PY_DEF.finditer(source):
            indent, first = len(m[1].lstrip("\n")), line_of(m.start(2)) - 1
            last = _block_end(lines, first, indent)
            parent = next((c for a, b, c in reversed(classes) if a < first <= b), None)
            found.append((path, language, m[2], "function", first + 1, last + 1, "\n".join(lines[first : last + 1]), _names(m[3], language), parent, m[2].startswith("_")))
    elif language == "r":
        for m in _R_DEF.finditer(source):
            end = _brace_end(source, m.end() - 1)
            found.append((path, language, m[1], "function", line_of(m.start(1)), line_of(end), source[m.start(1) : end + 1], _names(m[2], language), None, m[1].startswith(".")))
    elif language in ("c", "cpp"):
        classes = []
        for kind, pattern in (("struct", _C_STRUCT), ("class", _CPP_CLASS)) if language == "cpp" else (("struct", _C_STRUCT),):
            for m in pattern.finditer(source):
                end = _brace_end(source, m.end() - 1)
                classes.append((m.start(), end, m[1]))
                found.append((path, language, m[1], kind, line_of(m.start(1)), line_of(end), source[m.start() : end + 1].lstrip(), [], None, False))
        for m in _C_DEF.finditer(source):
            first_word = m[1].split()[0]
            if m[2] in _RESERVED or first_word in _RESERVED:
                continue
            end = _brace_end(source, m.end() - 1)
            parent = next((c for a, b, c in reversed(classes) if a < m.start() < b), None)
            found.append((path, language, m[2], "method" if parent and language == "cpp" else "function", line_of(m.start(2)), line_of(end), source[m.start() : end + 1].lstrip(), _names(m[3], language), parent, m[2].startswith("_")))
    return sorted(found, key=lambda s: (s[4], s[5], s[2]))


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, source, language); other languages and null sources have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            rows = [s for path, source, language in zip(f["path"], f["source"], f["language"]) if source for s in symbols_of(path, source, language)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "source", "language").mapInPandas(run, SCHEMA)


def metrics(source: Column) -> dict[str, Column]:
    """conditionals, loops, depth, lines, tokens, comment_lines and complexity of a source text."""
    count = lambda *words: sum((F.regexp_count(source, F.lit(f"(?i)\\b{w}\\b")) for w in words), F.lit(0))
    conditionals, loops = count("if", "else", "elif", "else[ \\t\\r\\n]+if", "switch", "case"), count("for", "while", "do", "repeat")
    braces = F.regexp_extract_all(source, F.lit("[{}]"), 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, b: Column) -> Column:
        now = F.greatest(F.lit(0), a["now"] + F.when(b == "{", 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    depth = F.aggregate(braces, start, step, lambda a: a["most"])
    lines = F.filter(F.transform(F.split(source, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    comments = F.size(F.filter(lines, lambda x: x.rlike("^(#|//|/\\*|\\*)")))
    tokens = F.size(F.filter(F.split(source, "[ \\t\\r\\n]+"), lambda x: x != ""))
    n = F.size(lines)
    return {
        "conditionals": conditionals,
        "loops": loops,
        "depth": depth,
        "lines": n,
        "tokens": tokens,
        "comment_density": F.round(F.when(n > 0, comments / n).otherwise(0.0), 6),
        "complexity": F.round(2.0 * conditionals + 2.0 * loops + 3.0 * depth + 0.1 * n, 6),
    }


def tier(complexity: Column) -> Column:
    return F.when(complexity < 10, "simple").when(complexity < 25, "moderate").when(complexity < 50, "complex").otherwise("very_complex")


def token_range(tokens: Column) -> Column:
    return F.when(tokens < 100, "0-99").when(tokens < 200, "100-199").when(tokens < 300, "200-299").when(tokens < 400, "300-399").otherwise("400+")


def importance(docstring_length: Column, comments: Column, calls: Column) -> Column:
    """Score of a symbol with columns type, is_private, complexity, parameters, lines, language, name."""
    kind = F.when(F.col("type") == "class", 10.0).when(F.col("type") == "struct", 9.0).when(F.col("type") == "function", 8.0).when(F.col("type") == "method", 6.0).otherwise(5.0)
    level = tier(F.col("complexity"))
    by_tier = F.when(level == "simple", 1.0).when(level == "moderate", 4.0).when(level == "complex", 3.0).otherwise(2.0)
    size = F.when(F.col("lines").between(10, 30), 2.0).when(F.col("lines").between(5, 50), 1.0).otherwise(0.0)
    tongue = F.when(F.col("language") == "python", 1.0).when(F.col("language") == "r", 1.2).otherwise(1.1)
    doc = F.when(docstring_length > 0, 3 + F.least(docstring_length / 100, F.lit(2.0))).otherwise(0.0)
    return F.round(kind + F.when(F.col("is_private"), 0).otherwise(5) + doc + 0.5 * comments + by_tier + F.least(0.5 * F.size("parameters"), F.lit(3.0)) + F.least(0.1 * calls, F.lit(2.0)) + size + tongue - F.when(F.col("name").rlike("^(__|_\\.)"), 2).otherwise(0), 6)


def top_symbols(rows: DataFrame, n: int = 30) -> DataFrame:
    """Rows of each path: the n best by score where there are more, else all; `place` is the order kept."""
    best = Window.partitionBy("path").orderBy(F.desc("score"), "start_line", "name")
    natural = Window.partitionBy("path").orderBy("start_line", "name")
    many = F.count("*").over(Window.partitionBy("path")) > n
    return rows.withColumn("place", F.when(many, F.row_number().over(best)).otherwise(F.row_number().over(natural))).where(F.col("place") <= n)


def worth_keeping(languages: tuple[str, ...] = ("python", "r", "c", "cpp"), lines: int = 3, tokens: int = 30) -> Column:
    return F.col("language").isin(*languages) & ~F.col("is_private") & (F.col("lines") >= lines) & (F.col("tokens") >= tokens)


def method_names(source: Column) -> Column:
    """Names of the methods in a class source, without double underscores."""
    return F.filter(F.regexp_extract_all(source, F.lit("def[ \\t]+([A-Za-z_0-9]+)"), 1), lambda n: ~n.startswith("__"))


def histograms(rows: DataFrame) -> DataFrame:
    """(kind, value, n) by type, language, tier and token range in one pass of grouping sets."""
    view = rows.select("type", "language", tier(F.col("complexity")).alias("tier"), token_range(F.col("tokens")).alias("tokens"))
    counted = view.groupingSets([["type"], ["language"], ["tier"], ["tokens"]], "type", "language", "tier", "tokens").agg(F.count("*").alias("n"))
    kinds = ("type", "language", "tier", "tokens")
    return counted.select(F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds]).alias("kind"), F.coalesce(*kinds).alias("value"), "n")
