"""Queries over stand-ins for projects, drafts, jobs and searches: catalog state, search end to end, negatives, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assemble, catalog, chunking, evidence, generate, quality, retrieval
from .data_queries import _symbols
from .registry import query, table
from .search_queries import _OVER, _WORDS, BM25


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _log(spark, sf_dir) -> DataFrame:
    """Events as updates of their users' projects; each sets some fields."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("project_id"), "ts", "event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Title "), F.col("event_id").cast("string"))).alias("title"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 7 == 0, F.round("value", 3)).alias("budget"))


@query("""WITH l AS (SELECT user_id AS project_id, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'Title ' || event_id END AS title, CASE WHEN event_id % 3 = 0 THEN event_type END AS status, CASE WHEN event_id % 7 = 0 THEN round(value, 3) END AS budget FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, event_id) AS r FROM l)
  SELECT project_id, arg_max(title, r) FILTER (WHERE title IS NOT NULL) AS title, arg_max(status, r) FILTER (WHERE status IS NOT NULL) AS status, arg_max(budget, r) FILTER (WHERE budget IS NOT NULL) AS budget, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS updated_at FROM n GROUP BY project_id""")
def project_state(spark, sf_dir):
    s = catalog.project_state(_log(spark, sf_dir), "project_id", ("title", "status", "budget"), "ts", "event_id")
    return s.select("project_id", "title", "status", "budget", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("created_at", "updated_at")])


@query("SELECT source AS project_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919) % 1000003 DESC, doc_id)::INTEGER AS place FROM documents")
def project_documents(spark, sf_dir):
    d = _documents(spark, sf_dir).select(F.col("source").alias("project_id"), "doc_id", (F.col("doc_id") * 7919 % 1000003).alias("uploaded_at"))
    return catalog.numbered(d, ["project_id"], F.desc("uploaded_at"), F.asc("doc_id")).select("project_id", "doc_id", F.col("place").cast("int").alias("place"))


@query("SELECT user_id AS draft_id, event_id AS feedback_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS place FROM events WHERE event_type <> 'view'")
def draft_feedback(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("draft_id"), F.col("event_id").alias("feedback_id"), "ts")
    return catalog.numbered(e, ["draft_id"], F.asc("ts"), F.asc("feedback_id")).select("draft_id", "feedback_id", F.col("place").cast("int").alias("place"))


@query("SELECT user_id AS project_id, count(*) AS n, sum(event_id % 500)::BIGINT AS tokens, round(avg(value), 6) AS mean_seconds, epoch_us(max(ts)) AS last_at FROM events GROUP BY 1")
def generation_telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), (F.col("event_id") % 500).alias("tokens"), F.col("value").alias("seconds"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return catalog.generation_report(e, "project_id")


@query("""SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_model, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_acctbal > 0 AS has_rag FROM customer""")
def project_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    held = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("rag_completed"))
    return catalog.availability(p, held("F"), held("O")).select("id", "has_model", "has_rag")


@query("""WITH v AS (SELECT user_id AS project_id, event_type AS section, 'text ' || event_id AS content, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS cited, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY user_id, event_type) AS last FROM events)
  SELECT project_id, count(*) AS n_sections, string_agg(section || '=' || content || '#' || version || '#' || cited, '; ' ORDER BY section) AS drafts FROM v WHERE version = last GROUP BY project_id""")
def section_drafts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("section"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("content"), F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.lit("ref")))).alias("citations"), "ts", "event_id")
    d = catalog.numbered(e, ["project_id", "section"], F.asc("ts"), F.asc("event_id")).withColumnRenamed("place", "version")
    told = F.transform(F.array_sort(F.map_entries("drafts")), lambda x: F.concat(x["key"], F.lit("="), x["value"]["content"], F.lit("#"), x["value"]["version"].cast("string"), F.lit("#"), F.size(x["value"]["citations"]).cast("string")))
    return catalog.drafts_by_section(d).select("project_id", F.size(F.map_keys("drafts")).cast("long").alias("n_sections"), F.array_join(told, "; ").alias("drafts"))


_TYPE = "CASE event_id % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'data_generation' ELSE 'training' END"
_STATUS = "CASE (event_id // 3) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END"


@query(f"""WITH j AS (SELECT user_id AS project_id, event_id, ts, {_TYPE} AS t, {_STATUS} AS s FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY project_id, t ORDER BY ts DESC, event_id DESC) AS r FROM j),
  g AS (SELECT project_id, coalesce(bool_or(t = 'rag' AND s = 'completed' AND event_id % 5 = 0), false) AS rag_completed, coalesce(bool_or(t = 'data_generation' AND s = 'completed' AND event_id % 5 = 0), false) AS data_generation_completed, coalesce(bool_or(t = 'training' AND s = 'completed' AND event_id % 5 = 0), false) AS training_completed,
    count_if(s IN ('pending', 'running')) AS active, max(CASE WHEN t = 'rag' AND r = 1 THEN s END) AS last_rag, max(CASE WHEN t = 'data_generation' AND r = 1 THEN s END) AS last_data_generation, max(CASE WHEN t = 'training' AND r = 1 THEN s END) AS last_training FROM n GROUP BY project_id)
  SELECT *, data_generation_completed AS can_training, training_completed AS can_chat, rag_completed AND training_completed AS can_grant, concat_ws(',', CASE WHEN NOT rag_completed THEN 'rag' END, CASE WHEN NOT training_completed THEN 'training' END) AS missing_grant FROM g""")
def project_status(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(p) for p in catalog.PIPELINES]), (F.col("event_id") % 3 + 1).cast("int"))
    state = F.element_at(F.array(*[F.lit(s) for s in catalog.STATES]), (F.floor(F.col("event_id") / 3) % 4 + 1).cast("int"))
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("job_id"), kind.alias("job_type"), state.alias("status"), F.col("ts").alias("created_at"))
    projects = catalog.marked_complete(jobs.select("project_id").distinct().withColumns({f"{p}_completed": F.lit(False) for p in catalog.PIPELINES}), jobs.where("status = 'completed' AND job_id % 5 = 0").select("project_id", F.col("job_type").alias("pipeline")))
    return catalog.project_status(projects, jobs).drop("missing_training", "missing_chat").withColumn("missing_grant", F.array_join("missing_grant", ","))


@query("SELECT n_nationkey AS project_id, count(s_suppkey) > 0 AS \"exists\", coalesce(sum(s_suppkey % 4), 0) > 0 AS has_index, count(s_suppkey) AS document_count, coalesce(sum(s_suppkey % 4), 0)::BIGINT AS chunk_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def corpus_status(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("project_id"), (F.col("s_suppkey") % 4).alias("chunks"))
    return catalog.corpus_status(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id")), docs, "project_id")


@query("SELECT n_nationkey, concat_ws(',', CASE WHEN n_nationkey % 2 = 1 THEN 'chunks' END, CASE WHEN n_nationkey % 3 > 0 THEN 'postings' END, CASE WHEN n_nationkey % 5 > 0 THEN 'stats' END) AS missing FROM nation")
def index_missing(spark, sf_dir):
    k = F.col("n_nationkey")
    present = F.array_compact(F.array(F.when(k % 2 == 0, "chunks"), F.when(k % 3 == 0, "postings"), F.when(k % 5 == 0, "stats"), F.lit("notes")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(catalog.missing_files(present), ",").alias("missing"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '. On ' || lang || '. ' || (1990 + doc_id % 30) || '.' WHEN 1 THEN 'On ' || lang || '. ' || (1990 + doc_id % 30) || '.' WHEN 2 THEN '"' || source || ' ' || lang || '." Document.' ELSE source || '.' END AS entry FROM documents""")
def mla_citations(spark, sf_dir):
    d, year = F.col("doc_id"), (F.col("doc_id") % 30 + 1990).cast("string")
    given = F.when(d % 4 == 0, F.concat("source", F.lit(". On "), "lang", F.lit(" ("), year, F.lit(")"))).when(d % 4 == 1, F.concat(F.lit("On "), "lang", F.lit(" ("), year, F.lit(")"))).when(d % 4 == 2, F.concat("source", F.lit("_"), "lang", F.lit(".pdf"))).otherwise(F.col("source"))
    return _documents(spark, sf_dir).select("doc_id", given.alias("given")).select("doc_id", tx.mla(F.col("given")).alias("entry"))


@query(r"""WITH x AS (SELECT doc_id, lower(text) AS low, length(trim(text)) AS n, len(string_split(text, '. ')) AS s, CASE doc_id % 3 WHEN 0 THEN 'Background' WHEN 1 THEN 'Objectives' ELSE 'Specific Aims' END AS section FROM documents),
  y AS (SELECT doc_id, 5.0 - CASE WHEN n < 100 THEN 2.0 ELSE 0 END - CASE WHEN n > 2000 THEN 0.5 ELSE 0 END - CASE WHEN s < 3 THEN 1.0 ELSE 0 END - CASE WHEN section = 'Background' AND NOT contains(low, 'gap') AND NOT contains(low, 'problem') THEN 1.0
   WHEN section = 'Objectives' AND NOT regexp_matches(low, '\b(aim|goal|objective)\b') THEN 1.0 WHEN section = 'Specific Aims' AND NOT regexp_matches(low, 'aim [0-9]|aim one|aim two|aim three') THEN 1.0 ELSE 0 END AS score FROM x)
  SELECT doc_id, score::DOUBLE AS score, CASE WHEN score >= 4 THEN 'ready for review' WHEN score >= 3 THEN 'minor changes' ELSE 'major changes' END AS band FROM y""")
def five_point_rubric(spark, sf_dir):
    section = F.when(F.col("doc_id") % 3 == 0, "Background").when(F.col("doc_id") % 3 == 1, "Objectives").otherwise("Specific Aims")
    s = _documents(spark, sf_dir).select("doc_id", quality.five_point(section, F.col("text")).alias("score"))
    return s.withColumn("band", quality.five_point_band(F.col("score")))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'add|include|more|explain|expand|detail|elaborate|cite|reference|discuss|describe|cover|address') AS needs_context FROM conversations WHERE text IS NOT NULL AND NOT contains(text, 'NOT_IN_CONTEXT')")
def feedback_needs(spark, sf_dir):
    return quality.grounded(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", quality.needs_context(F.col("text")).alias("needs_context"))


@query("""SELECT doc_id FROM (SELECT doc_id, (doc_id * 31 % 100) / 100.0 AS q, doc_id % 400 AS age, lang, source FROM documents) WHERE q >= 0.4 AND age <= 365 AND lang IN ('en', 'de') AND source NOT IN ('src0', 'src3')""")
def chunk_config_filter(spark, sf_dir):
    age = F.make_interval(days=(F.col("doc_id") % 400).cast("int"))
    now = F.lit("2026-01-01").cast("timestamp")
    c = _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") * 31 % 100 / 100).alias("quality"), (now - age).alias("updated_at"), F.col("lang").alias("doc_type"), F.col("source").alias("section"))
    return retrieval.filtered(c, 0.4, now, 365, ("en", "de"), ("src0", "src3")).select("doc_id")


@query("SELECT doc_id, text, concat_ws(' | ', source, 'Section: ' || CASE WHEN doc_id % 2 = 0 THEN lang END, 'Page ' || CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7)::VARCHAR END) AS citation, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'N/A' END AS section, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7)::VARCHAR ELSE 'N/A' END AS page FROM documents")
def result_shape(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("section", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("page", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7))
    return retrieval.result_shape(d, "doc_id")


_LETTERS = "[" + ", ".join(f"len(regexp_extract_all(lower({{0}}), '{c}'))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS text, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) - 1 AS pos FROM documents),
  c AS (SELECT doc_id, pos, regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM p), v AS (SELECT *, {_LETTERS.format("text")} AS v FROM c WHERE text <> ''),
  q AS (SELECT item_id AS query_id, {_LETTERS.format("text")} AS q FROM benchmark),
  s AS (SELECT query_id, doc_id, pos, round(coalesce(CASE WHEN list_sum(v) > 0 AND list_sum(q) > 0 THEN list_cosine_similarity(v, q) ELSE 0 END, 0), 9) AS score FROM v, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM s) SELECT query_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def paragraph_search(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.paragraph_hits(d, q, tx.letter_counts).select("query_id", "score", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {BM25}, c AS (SELECT query_id, id, b.text AS q, d.text AS t FROM bm_top JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id WHERE rank <= 10),
  s AS (SELECT query_id, id, round(coalesce(list_cosine_similarity({_LETTERS.format("q")}, {_LETTERS.format("t")}), 0), 9) AS score FROM c)
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s""")
def bi_encoder_rerank(spark, sf_dir):
    d = _documents(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    top = retrieval.bm25(d, q, 10).select("query_id", "id")
    c = retrieval.with_rows(d.select(F.col("doc_id").alias("id"), "text"), top).join(q, "query_id")
    return retrieval.bi_rerank(c, tx.letter_counts).select("query_id", "id", "score", F.col("rank").cast("int").alias("rank"))


def _chunks(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("section"))


@query()
def search(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieval.search(_chunks(spark, sf_dir), q, retrieval.configured("research"))
    return found.select("query_id", "id", "score", "rank", "k", "added_terms", "citation", "section", "page", F.size("spans").alias("n_spans"))


@query("SELECT count(*) AS searches, round(avg(value), 6) AS mean_seconds, round(avg(event_id % 9), 6) AS mean_words, round(avg(CASE WHEN event_id % 4 > 0 THEN event_id % 4 END), 6) AS mean_added_terms, count_if(event_id % 5 = 0) AS raised, round(sum(event_id % 3)::DOUBLE / (sum(event_id % 3) + sum(event_id % 2)), 6) AS hit_rate FROM events")
def search_stats(spark, sf_dir):
    e = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.col("value").alias("seconds"), (e % 9).alias("words"), (e % 4).alias("added_terms"), (e % 5 == 0).alias("raised"), (e % 3).alias("hits"), (e % 2).alias("misses"))
    return retrieval.search_stats(log)


_OUT = "|".join(generate.OUTWARD)
_NEG_SQL = " UNION ALL ".join(f"SELECT '{k}' AS k, '{t}' AS t" for k, _, t in generate.NEGATIVES)


@query(f"""WITH dim AS ({_NEG_SQL}), s AS (SELECT 'f' || p_partkey AS name, k, replace(replace(t, '{{name}}', 'f' || p_partkey), '{{fake}}', 'timeout') AS question FROM part, dim)
  SELECT name, k AS negative_type, concat_ws(',', 'real_name', CASE WHEN regexp_matches(lower(question), 'algorithm|configuration|implementation|optimization|performance') THEN 'technical' END, CASE WHEN len(string_split(question, ' ')) > 10 THEN 'detailed' END,
    CASE k WHEN 'nonexistent_parameter' THEN 'plausible_parameter' WHEN 'performance_claim' THEN 'asks_for_numbers' END) AS traps,
   concat_ws(',', CASE WHEN regexp_matches(lower(question), '{_OUT}') THEN 'outside_words' END, CASE WHEN k IN ('nonexistent_parameter', 'nonexistent_method') THEN 'absent_element' END, CASE WHEN k = 'external_knowledge' THEN 'outside_domain' END, CASE WHEN regexp_matches(lower(question), 'alternative|better|compare|faster|versus') THEN 'comparison' END) AS cues FROM s""")
def negative_traps(spark, sf_dir):
    dim = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, _, t in generate.NEGATIVES])
    s = _symbols(spark, sf_dir).select("name", F.explode(dim).alias("d")).select("name", "d.k", tx.filled(F.col("d.t"), name=F.col("name"), fake=F.lit("timeout")).alias("question"))
    joined = lambda c: F.array_join(c, ",")
    return s.select("name", F.col("k").alias("negative_type"), joined(generate.traps(F.col("question"), F.col("name"), F.col("k"))).alias("traps"), joined(generate.cues(F.col("question"), F.col("k"))).alias("cues"))


@query("SELECT 'src/' || (p_partkey % 50) AS path, 'f' || p_partkey AS name, focus, replace(t, '{name}', 'f' || p_partkey) AS question, 'hard' AS difficulty FROM part, (" + " UNION ALL ".join(f"SELECT '{f}' AS focus, '{t}' AS t" for f, t in generate.TRICKY) + ")")
def adversarial_questions(spark, sf_dir):
    return generate.adversarial(_symbols(spark, sf_dir))


@query("""SELECT 'type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'tier', (event_id % 4)::VARCHAR, count(*) FROM events GROUP BY ALL""")
def generation_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (F.col("event_id") % 4).alias("tier"))
    return generate.task_stats(e, "type", "tier")


@query("""WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, text, t2 FROM x WHERE role = 'user' AND r2 = 'assistant')
  SELECT conv_id AS path, position::INTEGER AS position, 'Context:' || chr(10) || 'conversation ' || conv_id || chr(10) || chr(10) || 'Question: Find what is wrong in this code. ' || text AS asked, t2 AS answered, 'debug' AS form FROM p WHERE trim(text) <> '' AND trim(t2) <> ''""")
def instruct_examples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    near = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ts") - 1)), lambda i: (F.get("ts", i - 1)["role"] == "user") & (F.get("ts", i)["role"] == "assistant")), lambda i: F.struct(F.get("ts", i - 1)["text"].alias("question"), F.get("ts", i)["text"].alias("answer")))
    entries = turns.select(F.col("conv_id").alias("path"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("context"), near.alias("qa_pairs"))
    made = assemble.examples(entries, form="debug")
    return made.select("path", "position", F.col("messages")[1]["content"].alias("asked"), F.col("messages")[2]["content"].alias("answered"), F.col("metadata")["form"].alias("form"))


@query(r"""WITH x AS (SELECT conv_id, turn, role, text AS context, lead(role) OVER w AS r2, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(answer), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(context), '[\p{L}\p{N}_]+')) AS c FROM x WHERE role = 'user' AND r2 = 'assistant')
  SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, c))::DOUBLE / len(a) ELSE 0 END, 9) AS code_coverage, 2 AS citation_count, 1 AS line_references, 1 AS code_snippets FROM w""")
def answer_coverage(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("r2", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).where("role = 'user' AND r2 = 'assistant'")
    facts = quality.citation_facts(F.array(F.lit("line 3"), F.lit("code: x")), F.col("answer"), F.col("text"))
    return pairs.select("conv_id", "turn", *facts).drop("has_citations")


@query()
def section_chunks(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.lit("txt").alias("doc_type"), "text")
    return chunking.section_chunks(d).select("doc_id", "section_no", "title", F.array_join("path", " > ").alias("path"), F.col("chunk_index").cast("int").alias("chunk_index"), "text", "token_count")


@query()
def debug_versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    source = F.format_string("def f%d(a, b):\n    total = %d\n    for i in range(a):\n        if i <= b and total == i:\n            total += i\n    return total\n", "p_partkey", "p_size")
    return generate.versions(p.select(F.lit("src").alias("path"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), source.alias("source"), F.lit("python").alias("language")))


@query(rf"""WITH v AS (SELECT item_id AS claim_id, text AS claim, CASE WHEN item_id % 2 = 0 THEN 'numeric' ELSE 'relationship' END AS kind FROM benchmark),
  o AS (SELECT claim_id, kind, doc_id AS id, {_OVER.format(a=_WORDS.format("claim"), b=_WORDS.format("d.text"))} AS w FROM v, documents d), s AS (SELECT *, round(CASE kind WHEN 'numeric' THEN 0.4 * w + 0.3 * w ELSE 0.35 * w + 0.45 * w END, 9) AS sure FROM o),
  r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY sure DESC, id) AS rank FROM s WHERE w >= 0.3 OR sure >= 0.6)
  SELECT c.item_id AS claim_id, coalesce(max(sure) >= 0.6, false) AS is_verified, coalesce(max(sure), 0.0) AS best, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank), '') AS citations, CASE WHEN max(sure) IS NULL THEN 'none' ELSE 'lexical' END AS method FROM benchmark c LEFT JOIN r ON r.claim_id = c.item_id AND rank <= 3 GROUP BY c.item_id""")
def claim_verify_by_kind(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"), F.when(F.col("item_id") % 2 == 0, "numeric").otherwise("relationship").alias("kind"))
    return evidence.verified_everywhere(claims, _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


@query("SELECT doc_id, 'For ' || lang || ' and ' || coalesce(source, '') || ': ' || n_chars AS prompt FROM documents")
def section_prompts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.filled(F.lit("For {lang} and {source}: {size}"), lang=F.col("lang"), source=F.col("source"), size=F.col("n_chars").cast("string")).alias("prompt"))
