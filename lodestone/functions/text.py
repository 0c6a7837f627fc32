"""Column expressions over text: cleaning, counting, classification, headings, sentences.

All but letter_counts() are built-in expressions, so they stay inside generated code. Patterns avoid look-around and
shorthand classes whose meaning differs between regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as vx

BLANKS = "[ \\t\\r\\n]+"
MARK = "\u0001"


def clean(text: Column) -> Column:
    """White space collapsed, [PAGE n] markers removed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), "\\[PAGE [0-9]+\\]", ""))


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded down: the contract where no tokenizer model is at hand."""
    return F.floor(F.length(text) / 4).cast("int")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}]", ""))


def ascii_ratio(text: Column) -> Column:
    """Share of ASCII characters; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", "")) / F.length(text)).otherwise(0.0)


def passes_chunk_filter(text: Column, low: int = 30, high: int = 600, ratio: float = 0.7, least_letters: int = 20) -> Column:
    return token_count(text).between(low, high) & (ascii_ratio(text) >= ratio) & (letters(text) >= least_letters)


def sentences(text: Column) -> Column:
    """Split after '.', '!' or '?' and the white space that follows."""
    return F.split(F.regexp_replace(text, "([.!?])" + BLANKS, "$1" + MARK), MARK)


def terms(text: Column) -> Column:
    """Lower-case words of at least two letters, the tokens of lexical search."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}{2,}"), 0)


def title(text: Column) -> Column:
    """The first of ten lines that looks like a title, without symbols; null if none does."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda x: F.trim(x))
    low = lambda x: F.lower(x)
    fits = lambda x: (
        (F.length(x) > 10)
        & (F.length(x) < 200)
        & ~x.startswith("#")
        & ~low(x).startswith("abstract")
        & ~low(x).startswith("introduction")
        & ~x.rlike("^[0-9]+\\.")
        & x.rlike("[A-Z].*[a-z]")
    )
    return F.trim(F.regexp_replace(F.try_element_at(F.filter(lines, fits), F.lit(1)), "[^\\p{L}0-9_ \\-:.]", ""))


def plain_title(text: Column) -> Column:
    """The first line of more than 10 and fewer than 200 characters."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 10) & (F.length(x) < 200)), F.lit(1))


def authors(text: Column) -> Column:
    """Names split at ';', ',', ' and ', '&' and line ends; single characters are dropped."""
    return F.filter(F.transform(F.split(text, ";|,| and |&|\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def document_class(text: Column) -> Column:
    """grant, paper, report or document, by the first group of words that occurs anywhere."""
    low = F.lower(text)
    return (
        F.when(low.rlike("grant|proposal|funding|nih|nsf"), "grant")
        .when(low.rlike("abstract|introduction|methodology|results|conclusion"), "paper")
        .when(low.rlike("report|progress|quarterly|annual"), "report")
        .otherwise("document")
    )


def section_type(text: Column) -> Column:
    """Section of a paper by the words among its first 100 characters."""
    head, out = F.substring(F.lower(text), 1, 100), F
    for word, name in (("abstract", "abstract"), ("introduction", "introduction"), ("method", "methods"), ("result", "results"), ("conclusion", "conclusion")):
        out = out.when(head.contains(word), name)
    return out.otherwise("unknown")


def citation(source: Column, section: Column, page: Column) -> Column:
    """source | Section: s | Page p, without the parts that are null."""
    return F.concat_ws(" | ", source, F.concat(F.lit("Section: "), section), F.concat(F.lit("Page "), page.cast("string")))


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


HEADING = "(?i)^([0-9]+\\.?[ \\t]+[a-z]|[a-z][a-z \\t]{2,}$|[a-z][a-z]+([ \\t]+[a-z][a-z]+)*$|.*(introduction|conclusion|abstract|references|methodology|results|discussion))"


def is_heading(line: Column, before: Column, after: Column) -> Column:
    """Whether a trimmed line looks like a heading; before and after are its trimmed neighbours, null at the ends."""
    alone = (F.coalesce(before, F.lit("")) == "") & (F.coalesce(after, F.lit("")) == "") & (F.length(line) < 100)
    return F.length(line).between(3, 200) & (line.rlike(HEADING) | alone)


def heading_level(line: Column) -> Column:
    low = F.lower(line)
    shouted = (F.upper(line) == line) & (low != line)
    return F.when(line.rlike("^[0-9]+\\."), 1).when(low.rlike("abstract|introduction|conclusion|references") | shouted, 1).otherwise(2)


def normalised(text: Column) -> Column:
    """Lower case, punctuation out, spaces squeezed: the key of lexical dedup."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}0-9_ \\t\\r\\n]", ""), BLANKS, " "))


def human_size(n: Column) -> Column:
    """Bytes with one decimal in the largest unit below 1024."""
    unit = lambda power, name: F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(" " + name))
    return F.when(n < 1024, unit(0, "B")).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).when(n < 1024**4, unit(3, "GB")).otherwise(unit(4, "TB"))


DOC_TYPES = {
    "code": ("c", "cpp", "go", "java", "js", "py", "r", "ts"),
    "notebook": ("ipynb",),
    "paper": ("pdf", "tex"),
    "slides": ("key", "ppt", "pptx"),
    "protocol": ("md", "rst", "txt"),
    "web": ("htm", "html"),
}
LANGUAGES = {"python": ("py",), "r": ("r",), "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "h++", "hpp")}
#: kinds of boundary at which a type's texts may be cut
BOUNDARIES = {
    "code": ("class", "function", "method"),
    "default": ("paragraph", "sentence"),
    "notebook": ("cell", "markdown_section"),
    "paper": ("paragraph", "section", "subsection"),
    "protocol": ("numbered_list", "section", "step"),
    "slides": ("bullet_group", "slide"),
    "web": ("article", "paragraph", "section"),
}
#: target, least and most tokens by document type; slides have no target
STRATEGIES = {"code": (275, 100, 400), "notebook": (300, 50, 500), "paper": (425, 200, 600), "slides": (None, 20, 800), "protocol": (400, 150, 550), "web": (350, 100, 500), "default": (400, 150, 600)}


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, without query or fragment; '' if it has none.

    A host is no path segment, and a name that only starts with a dot has no extension.
    """
    plain = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.lower(F.regexp_extract(plain, "[^/.][^/]*\\.([A-Za-z0-9+]+)$", 1))


def _by_extension(path: Column, kinds: dict, default: str) -> Column:
    out, ext = F, extension(path)
    for name, extensions in kinds.items():
        out = out.when(ext.isin(*extensions), name)
    return out.otherwise(default)


def document_type(path: Column) -> Column:
    return _by_extension(path, DOC_TYPES, "default")


def may_cut(kind: Column, boundary: Column) -> Column:
    """Whether texts of a document type may be cut at a boundary of this kind."""
    return F.coalesce(*[F.when(kind == k, boundary.isin(*v)) for k, v in BOUNDARIES.items()], F.lit(False))


def language(path: Column) -> Column:
    return _by_extension(path, LANGUAGES, "unknown")


def document_id(path: Column) -> Column:
    """File stem, an underscore and the first eight digits of the path's md5."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.md5(path), 1, 8))


def chunk_estimate(tokens: Column, kind: Column) -> Column:
    """Expected chunks of a text of a type: tokens over nine tenths of the target, or over half the maximum."""
    target = F.coalesce(*[F.when(kind == k, F.lit(v[0])) for k, v in STRATEGIES.items() if v[0]])
    most = F.coalesce(*[F.when(kind == k, F.lit(v[2])) for k, v in STRATEGIES.items()])
    return F.greatest(F.lit(1), F.floor(F.when(target.isNotNull(), tokens / (target * 0.9)).otherwise(tokens / (most * 0.5)))).cast("int")


def mla(source: Column) -> Column:
    """A works-cited entry: 'Author. Title. Year.' of 'Author. Title (Year)', a file's name in quotes, else the source and a stop."""
    before, year = F.trim(F.substring_index(source, "(", 1)), F.trim(F.substring_index(F.element_at(F.split(source, "\\("), 2), ")", 1))
    author, title = F.trim(F.substring_index(before, ".", 1)), F.trim(F.regexp_replace(before, "^[^.]*\\.", ""))
    dated = F.when(before.contains("."), F.concat(author, F.lit(". "), title, F.lit(". "), year, F.lit("."))).otherwise(F.concat(before, F.lit(". "), year, F.lit(".")))
    name = F.replace(F.replace(F.replace(source, F.lit(".pdf"), F.lit("")), F.lit(".txt"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.when(source.contains("(") & source.contains(")"), dated).when(source.rlike("\\.(pdf|txt)$"), F.concat(F.lit('"'), name, F.lit('." Document.'))).otherwise(F.concat(source, F.lit(".")))


def filled(template: Column, **values: Column) -> Column:
    """template with each {name} replaced; a null value becomes ''."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def letter_counts(text: Column) -> Column:
    """How often each of a to z occurs: the smallest encoder that any engine can follow."""
    return vx.counted_letters(F.lower(text))
