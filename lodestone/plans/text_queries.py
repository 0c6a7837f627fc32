"""Queries over documents and pages: text functions, structure, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking
from .registry import query, table

TOK = "(length(text) // 4)::INTEGER"
ASCII = r"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END"
ALPHA = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
PASSES = rf"({TOK} BETWEEN 30 AND 600 AND {ASCII} >= 0.7 AND {ALPHA} >= 20)"
SENTS = r"string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))"
CLEAN = r"trim(regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '\[PAGE [0-9]+\]', '', 'g'))"
TRIMMED = r"trim(regexp_replace({0}, '^[ \t\r]+|[ \t\r]+$', '', 'g'))"
HEADING = r"regexp_matches(line, '(?i)^([0-9]+\.?[ \t]+[a-z]|[a-z][a-z \t]{2,}$|[a-z][a-z]+([ \t]+[a-z][a-z]+)*$|.*(introduction|conclusion|abstract|references|methodology|results|discussion))')"
LINES = f"lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, {TRIMMED.format('unnest(string_split(text, chr(10)))')} AS line FROM documents)"
NEAR = "near AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
IS_HEADING = f"(length(line) BETWEEN 3 AND 200 AND ({HEADING} OR (coalesce(before, '') = '' AND coalesce(after, '') = '' AND length(line) < 100)))"
LEVEL = r"CASE WHEN regexp_matches({0}, '^[0-9]+\.') THEN 1 WHEN regexp_matches(lower({0}), 'abstract|introduction|conclusion|references') OR (upper({0}) = {0} AND lower({0}) <> {0}) THEN 1 ELSE 2 END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {TOK} AS tokens FROM documents WHERE {PASSES}")
def chunk_filter(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).where(tx.passes_chunk_filter(t)).select("doc_id", tx.token_count(t).alias("tokens"))


@query(f"SELECT source, count(*) AS n, count_if({PASSES}) AS kept, round(count_if({PASSES})::DOUBLE / count(*), 9) AS rate FROM documents GROUP BY source")
def chunk_filter_stats(spark, sf_dir):
    ok = tx.passes_chunk_filter(F.col("text"))
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.round(F.try_divide(F.count_if(ok), F.count("*")), 9).alias("rate"))


@query(f"SELECT lang, count(*) AS n, sum(len({SENTS}))::BIGINT AS sentences, max(len({SENTS}))::INTEGER AS most FROM documents GROUP BY lang")
def sentence_split_stats(spark, sf_dir):
    n = F.size(tx.sentences(F.col("text")))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("sentences"), F.max(n).alias("most"))


@query(f"SELECT source, sum({TOK})::BIGINT AS total, round(avg({TOK}), 6) AS mean, min({TOK}) AS least, max({TOK}) AS most FROM documents GROUP BY source")
def token_count_stats(spark, sf_dir):
    n = tx.token_count(F.col("text"))
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


_TITLE = r"""SELECT doc_id, trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: trim(x)),
  lambda x: length(x) > 10 AND length(x) < 200 AND NOT starts_with(x, '#') AND NOT starts_with(lower(x), 'abstract') AND NOT starts_with(lower(x), 'introduction')
  AND NOT regexp_matches(x, '^[0-9]+\.') AND regexp_matches(x, '[A-Z].*[a-z]'))[1], '[^\p{L}0-9_ \-:.]', '', 'g')) AS title,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10 AND length(x) < 200)[1] AS plain FROM documents"""


@query(_TITLE)
def title_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.title(F.col("text")).alias("title"), tx.plain_title(F.col("text")).alias("plain"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'grant|proposal|funding|nih|nsf') THEN 'grant' WHEN regexp_matches(lower(text), 'abstract|introduction|methodology|results|conclusion') THEN 'paper'
  WHEN regexp_matches(lower(text), 'report|progress|quarterly|annual') THEN 'report' ELSE 'document' END AS class,
  CASE WHEN contains(lower(text)[1:100], 'abstract') THEN 'abstract' WHEN contains(lower(text)[1:100], 'introduction') THEN 'introduction' WHEN contains(lower(text)[1:100], 'method') THEN 'methods'
  WHEN contains(lower(text)[1:100], 'result') THEN 'results' WHEN contains(lower(text)[1:100], 'conclusion') THEN 'conclusion' ELSE 'unknown' END AS section FROM documents""")
def doc_class(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.document_class(F.col("text")).alias("class"), tx.section_type(F.col("text")).alias("section"))


@query(f"WITH {LINES}, {NEAR} SELECT doc_id, pos::INTEGER AS pos, line, {LEVEL.format('line')} AS level FROM near WHERE {IS_HEADING}")
def heading_detect(spark, sf_dir):
    return chunking.headings(_docs(spark, sf_dir))


@query(f"""WITH {LINES}, {NEAR}, marked AS (SELECT *, {IS_HEADING} AND NOT regexp_matches(line, '^\\[PAGE [0-9]+\\]$') AS head FROM near),
  numbered AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM marked)
  SELECT doc_id, section_no::BIGINT AS section_no, max(CASE WHEN head THEN line END) AS title, min(pos)::INTEGER AS start_line, max(pos)::INTEGER AS end_line,
  coalesce(string_agg(CASE WHEN NOT head AND line <> '' AND NOT regexp_matches(line, '^\\[PAGE [0-9]+\\]$') THEN line END, chr(10) ORDER BY pos), '') AS content,
  CASE WHEN max(CASE WHEN head THEN line END) IS NOT NULL THEN {LEVEL.format('max(CASE WHEN head THEN line END)')} END AS level FROM numbered GROUP BY doc_id, section_no""")
def section_assign(spark, sf_dir):
    return chunking.sections(_docs(spark, sf_dir))


@query(f"""WITH {LINES}, {NEAR}, h AS (SELECT doc_id, pos, line, {LEVEL.format('line')} AS level FROM near WHERE {IS_HEADING})
  SELECT a.doc_id, a.pos::INTEGER AS pos, CASE WHEN a.level = 1 THEN a.line ELSE coalesce((SELECT max_by(b.line, b.pos) FROM h b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level = 1) || ' > ', '') || a.line END AS path FROM h a""")
def heading_hierarchy(spark, sf_dir):
    return chunking.hierarchy(chunking.headings(_docs(spark, sf_dir))).select("doc_id", "pos", F.array_join("path", " > ").alias("path"))


@query()
def chunk_pack_rag(spark, sf_dir):
    return chunking.rag_chunks(_docs(spark, sf_dir))


@query()
def chunk_pack_paper(spark, sf_dir):
    return chunking.paper_chunks(_docs(spark, sf_dir))


@query()
def chunk_pack_paragraph(spark, sf_dir):
    return chunking.paragraph_chunks(_docs(spark, sf_dir))


@query()
def splitting_stats(spark, sf_dir):
    c = chunking.rag_chunks(_docs(spark, sf_dir))
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg("token_count"), 6).alias("mean"), F.min("token_count").alias("least"), F.max("token_count").alias("most"))


_SENT_ROWS = f"s AS (SELECT doc_id, generate_subscripts({SENTS}, 1) - 1 AS pos, unnest({SENTS}) AS sentence FROM documents)"


@query(f"WITH {_SENT_ROWS} SELECT doc_id, pos::INTEGER AS pos, lag(sentence) OVER w [1:150] AS prev, lead(sentence) OVER w [1:150] AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)".replace("lag(sentence) OVER w [1:150]", "substr(lag(sentence) OVER w, 1, 150)").replace("lead(sentence) OVER w [1:150]", "substr(lead(sentence) OVER w, 1, 150)"))
def preview_lag_lead(spark, sf_dir):
    from pyspark.sql import Window

    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return s.select("doc_id", "pos", F.substring(F.lag("sentence").over(w), 1, 150).alias("prev"), F.substring(F.lead("sentence").over(w), 1, 150).alias("next"))


@query(f"WITH {_SENT_ROWS} SELECT doc_id, pos // 4 AS window_no, min(pos)::INTEGER AS first_index FROM s GROUP BY ALL HAVING count(*) = 4")
def window_pack(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("chunk_index", "sentence"))
    return chunking.windows(s, 4).select("doc_id", "window_no", F.element_at("indices", 1).alias("first_index"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\n[ \t\r\n]*\n'), lambda p: regexp_matches(lower(p), 'method|result|impact|license')), chr(10) || chr(10)) AS relevant FROM documents")
def paragraph_keyword_filter(spark, sf_dir):
    hit = F.filter(F.split("text", "\n[ \\t\\r\\n]*\n"), lambda p: F.lower(p).rlike("method|result|impact|license"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(hit, "\n\n").alias("relevant"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}0-9_ \t\r\n]', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS norm, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS excerpt FROM documents")
def normalise_excerpt(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalised(F.col("text")).alias("norm"), tx.excerpt(F.col("text"), 200).alias("excerpt"))


@query("SELECT doc_id, concat_ws(' | ', source, 'Section: ' || CASE WHEN lang <> 'en' THEN lang END, 'Page ' || CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7)::VARCHAR END) AS citation FROM documents")
def citation_format(spark, sf_dir):
    section = F.when(F.col("lang") != "en", F.col("lang"))
    page = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7)
    return _docs(spark, sf_dir).select("doc_id", tx.citation(F.col("source"), section, page).alias("citation"))


_EXT = r"coalesce(lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[^/.][^/]*\.([A-Za-z0-9+]+)$', 1)), '')"
_KINDS = "CASE WHEN ext IN ('py', 'r', 'c', 'cpp', 'java', 'js', 'ts', 'go') THEN 'code' WHEN ext = 'ipynb' THEN 'notebook' WHEN ext IN ('pdf', 'tex') THEN 'paper' WHEN ext IN ('pptx', 'ppt', 'key') THEN 'slides' WHEN ext IN ('txt', 'md', 'rst') THEN 'protocol' WHEN ext IN ('html', 'htm') THEN 'web' ELSE 'default' END"
#: each page's name under one of twenty endings
_NAMED = "(SELECT page_id, 'https://site.org/' || page_id || ['.py', '.R', '.c', '.cpp', '.java', '.js', '.ts', '.go', '.ipynb', '.pdf', '.tex', '.pptx', '.ppt', '.key', '.txt', '.md?x=1', '.rst#top', '.html', '.h++', ''][page_id % 20 + 1] AS url FROM pages)"
ENDINGS = (".py", ".R", ".c", ".cpp", ".java", ".js", ".ts", ".go", ".ipynb", ".pdf", ".tex", ".pptx", ".ppt", ".key", ".txt", ".md?x=1", ".rst#top", ".html", ".h++", "")


@query(f"SELECT page_id, ext, {_KINDS} AS doc_type FROM (SELECT page_id, {_EXT} AS ext FROM pages)")
def extension_scan_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.extension(F.col("url")).alias("ext"), tx.document_type(F.col("url")).alias("doc_type"))


@query(f"""SELECT page_id, ext, {_KINDS} AS doc_type, CASE WHEN ext = 'py' THEN 'python' WHEN ext = 'r' THEN 'r' WHEN ext IN ('c', 'h') THEN 'c' WHEN ext IN ('cpp', 'cxx', 'cc', 'hpp', 'h++') THEN 'cpp' ELSE 'unknown' END AS language,
  CASE {_KINDS} WHEN 'code' THEN 100 WHEN 'notebook' THEN 50 WHEN 'paper' THEN 200 WHEN 'slides' THEN 20 WHEN 'protocol' THEN 150 WHEN 'web' THEN 100 ELSE 150 END AS least, CASE {_KINDS} WHEN 'code' THEN 400 WHEN 'notebook' THEN 500 WHEN 'paper' THEN 600 WHEN 'slides' THEN 800 WHEN 'protocol' THEN 550 WHEN 'web' THEN 500 ELSE 600 END AS most,
  {_KINDS} IN ('paper', 'protocol', 'web') AS cuts_at_section FROM (SELECT page_id, {_EXT} AS ext FROM {_NAMED})""")
def path_types(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % 20 + 1).cast("int"))
    path = F.concat(F.lit("https://site.org/"), F.col("page_id").cast("string"), ending)
    kind = tx.document_type(F.col("path"))
    limits = F.create_map(*[x for k, v in tx.STRATEGIES.items() for x in (F.lit(k), F.array(F.lit(v[1]), F.lit(v[2])))])
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("doc_type", kind)
    return rows.select("page_id", tx.extension(F.col("path")).alias("ext"), "doc_type", tx.language(F.col("path")).alias("language"), limits[F.col("doc_type")][0].alias("least"), limits[F.col("doc_type")][1].alias("most"), tx.may_cut(F.col("doc_type"), F.lit("section")).alias("cuts_at_section"))


@query("SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') || '_' || md5(url)[1:8] AS doc_id FROM pages")
def path_document_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.document_id(F.col("url")).alias("doc_id"))


@query(f"SELECT doc_id, greatest(1, floor({TOK} / (400 * 0.9)))::INTEGER AS estimate FROM documents")
def chunk_estimates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.chunk_estimate(tx.token_count(F.col("text")), F.lit("default")).alias("estimate"))


@query(f"SELECT doc_id, CASE WHEN len(string_split(text, '. ')) > 3 THEN array_to_string(string_split(text, '. ')[1:3], '. ') || '.' ELSE text[1:500] END AS summary FROM documents")
def extractive_summary(spark, sf_dir):
    parts = F.split("text", "\\. ")
    return _docs(spark, sf_dir).select("doc_id", F.when(F.size(parts) > 3, F.concat(F.array_join(F.slice(parts, 1, 3), ". "), F.lit("."))).otherwise(F.substring("text", 1, 500)).alias("summary"))


@query("SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN printf('%.1f', n_chars::DOUBLE) || ' B' ELSE printf('%.1f', round(n_chars / 1024.0::DOUBLE, 1)) || ' KB' END AS size FROM documents")
def size_format(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "n_chars", tx.human_size(F.col("n_chars")).alias("size"))
