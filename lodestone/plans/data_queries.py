"""Queries over labels, conversations, events, pages and orders: quality, code, generation, assembly, catalog, relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assemble, catalog, code, generate, quality
from .registry import query, table


def _scores(spark, sf_dir) -> DataFrame:
    """Six scores for each labelled document, derived from its numbers."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    one = lambda m: F.round((F.col("doc_id") * m % 101) / 100, 2)
    return d.select("doc_id", "text", "quality", "toxic", "source", *[one(m).alias(f) for f, m in zip(quality.FIELDS, (7, 11, 13, 17, 19, 23))])


_SCORES = "sc AS (SELECT doc_id, text, quality, toxic, source, " + ", ".join(f"round((doc_id * {m} % 101)::DOUBLE / 100, 2) AS {f}" for f, m in zip(quality.FIELDS, (7, 11, 13, 17, 19, 23))) + " FROM labels JOIN documents USING (doc_id))"
_ALL = " + ".join(f"{w} * {f}" for f, w in zip(quality.FIELDS, quality.WEIGHTS))
_GATE = "groundedness >= 0.7 AND specificity >= 0.6 AND clarity >= 0.6 AND usefulness >= 0.5"


@query(f"WITH {_SCORES} SELECT doc_id, round(({_ALL})::DECIMAL(18,6), 3)::DOUBLE AS overall FROM sc WHERE {_GATE}")
def quality_gate(spark, sf_dir):
    return _scores(spark, sf_dir).where(quality.passes_gate()).select("doc_id", quality.overall(*[F.col(f) for f in quality.FIELDS]).alias("overall"))


@query(f"""WITH {_SCORES}, j AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{{"groundedness": ' || groundedness || ', "specificity": ' || specificity || '}}' WHEN 1 THEN 'Scores: {{"groundedness": ' || groundedness || '}} done' ELSE 'say "groundedness": ' || groundedness || ' and "specificity": ' || specificity END AS raw FROM sc)
  SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(raw, '"groundedness":[ \\t\\r\\n]*([0-9.]+)', 1), '') AS DOUBLE), 0.0) AS groundedness, coalesce(TRY_CAST(nullif(regexp_extract(raw, '"specificity":[ \\t\\r\\n]*([0-9.]+)', 1), '') AS DOUBLE), 0.0) AS specificity FROM j""")
def score_parse(spark, sf_dir):
    s = _scores(spark, sf_dir)
    g, p = F.col("groundedness").cast("string"), F.col("specificity").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"groundedness": '), g, F.lit(', "specificity": '), p, F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('Scores: {"groundedness": '), g, F.lit("} done"))).otherwise(F.concat(F.lit('say "groundedness": '), g, F.lit(' and "specificity": '), p))
    parsed = quality.parsed_scores(F.col("raw"))
    return s.select("doc_id", raw.alias("raw")).select("doc_id", *parsed[:2])


@query(f"""WITH {_SCORES} SELECT doc_id, (text = 'NOT_IN_CONTEXT' AND toxic = 0) OR NOT ({_GATE}) AS regenerate,
  CASE WHEN text = 'NOT_IN_CONTEXT' AND toxic = 0 THEN 'The question needs outside knowledge; ask one that the context answers' WHEN NOT ({_GATE}) THEN 'Regenerate with focus on: ' || concat_ws(', ', CASE WHEN groundedness < 0.7 THEN 'improve grounding in provided context' END,
  CASE WHEN specificity < 0.6 THEN 'increase specificity and detail' END, CASE WHEN clarity < 0.6 THEN 'improve clarity and structure' END, CASE WHEN usefulness < 0.5 THEN 'focus on educational value' END) ELSE '' END AS guidance,
  CASE WHEN o >= 0.8 THEN 'excellent' WHEN o >= 0.6 THEN 'good' WHEN o >= 0.4 THEN 'acceptable' ELSE 'poor' END AS verdict,
  concat_ws('; ', CASE WHEN groundedness < 0.5 THEN 'Say only what the context shows' END, CASE WHEN specificity < 0.5 THEN 'Name details and examples from the context' END, CASE WHEN clarity < 0.5 THEN 'Order and word the answer more plainly' END,
  CASE WHEN usefulness < 0.5 THEN 'Ask about what a learner needs' END, CASE WHEN quality <> 1 AND toxic <> 1 THEN 'Point to lines or snippets of the context' END) AS suggestions,
  ((groundedness < 0.5)::INTEGER + (specificity < 0.5)::INTEGER + (clarity < 0.5)::INTEGER + (usefulness < 0.5)::INTEGER + (quality <> 1 AND toxic <> 1)::INTEGER)::INTEGER AS n_weaknesses,
  ((groundedness >= 0.8)::INTEGER + (specificity >= 0.8)::INTEGER + (clarity >= 0.8)::INTEGER + (usefulness >= 0.8)::INTEGER + (quality = 1)::INTEGER)::INTEGER AS n_strengths FROM (SELECT *, round(({_ALL})::DECIMAL(18,6), 3)::DOUBLE AS o FROM sc)""")
def quality_feedback(spark, sf_dir):
    s = _scores(spark, sf_dir)
    told = quality.feedback(quality.overall(*[F.col(f) for f in quality.FIELDS]), F.col("quality") == 1, F.col("toxic") == 1)
    done = s.select("doc_id", *quality.regeneration(F.col("text"), F.col("toxic") == 1), *told)
    return done.select("doc_id", "regenerate", "guidance", "verdict", F.concat_ws("; ", "suggestions").alias("suggestions"), F.size("weaknesses").alias("n_weaknesses"), F.size("strengths").alias("n_strengths"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events")
def running_quality(spark, sf_dir):
    r = quality.running_mean(table(spark, sf_dir, "events"), "value", [F.col("ts"), F.col("event_id")], [F.col("user_id")])
    return r.select("event_id", F.round("running_mean", 6).alias("running_mean"))


_SECTION = "CASE doc_id % 4 WHEN 0 THEN 'Background' WHEN 1 THEN 'Specific Aims' WHEN 2 THEN 'Approach' ELSE 'Bibliography' END"


@query(rf"""WITH x AS (SELECT doc_id, {_SECTION} AS s, lower(text) AS low, (doc_id % 7)::INTEGER AS c, len(list_filter(regexp_split_to_array(trim(text), '[ \t\r\n]+'), lambda w: w <> '')) AS n FROM documents),
  y AS (SELECT doc_id, CASE WHEN n < CASE s WHEN 'Background' THEN 300 WHEN 'Specific Aims' THEN 200 WHEN 'Approach' THEN 400 ELSE 50 END THEN 0.2::DOUBLE WHEN n > 1000 THEN 0.1 ELSE 0 END
   + CASE WHEN s <> 'Bibliography' AND c < 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN s <> 'Bibliography' AND n > 500 AND c < 5 THEN 0.1::DOUBLE ELSE 0 END
   + CASE WHEN s = 'Background' AND NOT regexp_matches(low, 'gap|limitation') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN s = 'Specific Aims' AND NOT regexp_matches(low, 'aim 1|aim one') THEN 0.2::DOUBLE ELSE 0 END
   + CASE WHEN s = 'Specific Aims' AND len(regexp_extract_all(low, 'aim ')) < 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN s = 'Approach' AND NOT regexp_matches(low, 'method|protocol') THEN 0.1::DOUBLE ELSE 0 END AS off FROM x)
  SELECT doc_id, round(greatest(0.0, least(1.0, 1.0 - off)), 6) AS score, CASE WHEN round(greatest(0.0, least(1.0, 1.0 - off)), 6) >= 0.9 THEN 'excellent' WHEN round(greatest(0.0, least(1.0, 1.0 - off)), 6) >= 0.75 THEN 'good' WHEN round(greatest(0.0, least(1.0, 1.0 - off)), 6) >= 0.6 THEN 'fair' ELSE 'needs work' END AS band FROM y""")
def section_rubric(spark, sf_dir):
    section = F.when(F.col("doc_id") % 4 == 0, "Background").when(F.col("doc_id") % 4 == 1, "Specific Aims").when(F.col("doc_id") % 4 == 2, "Approach").otherwise("Bibliography")
    s = table(spark, sf_dir, "documents").select("doc_id", quality.section_score(section, F.col("text"), F.col("doc_id") % 7).alias("score"))
    return s.withColumn("band", quality.section_band(F.col("score")))


_COUNT = "len(regexp_extract_all(html, '(?i)\\b{0}\\b'))"


@query(f"""WITH x AS (SELECT page_id, {" + ".join(_COUNT.format(w) for w in ("if", "else", "elif", "else[ \\t\\r\\n]+if", "switch", "case"))} AS conditionals, {" + ".join(_COUNT.format(w) for w in ("for", "while", "do", "repeat"))} AS loops,
  len(list_filter(string_split(html, chr(10)), lambda l: trim(l) <> '')) AS lines, len(list_filter(regexp_split_to_array(html, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS tokens FROM (SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', '', 'g') AS html FROM pages))
  SELECT page_id, conditionals::INTEGER AS conditionals, loops::INTEGER AS loops, lines::INTEGER AS lines, tokens::INTEGER AS tokens FROM x""")
def complexity_metrics(spark, sf_dir):
    m = code.metrics(F.regexp_replace("html", "[^\\x00-\\x7F]", ""))
    return table(spark, sf_dir, "pages").select("page_id", *[m[k].cast("int").alias(k) for k in ("conditionals", "loops", "lines", "tokens")])


@query("""SELECT CASE WHEN l_quantity < 10 THEN 'simple' WHEN l_quantity < 25 THEN 'moderate' WHEN l_quantity < 50 THEN 'complex' ELSE 'very_complex' END AS tier, count(*) AS n FROM lineitem GROUP BY 1""")
def complexity_tier(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(code.tier(F.col("l_quantity")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT path, event_id, place FROM (SELECT user_id AS path, event_id, (CASE WHEN count(*) OVER (PARTITION BY user_id) > 30 THEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, epoch_us(ts), event_id) ELSE row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) END)::INTEGER AS place FROM events) WHERE place <= 30")
def importance_topn(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("value").alias("score"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_line"), F.col("event_id").alias("name"), "event_id")
    return code.top_symbols(e).select("path", "event_id", F.col("place").cast("int").alias("place"))


@query("""SELECT kind, value, count(*) AS n FROM (SELECT 'type' AS kind, event_type AS value FROM events UNION ALL SELECT 'user', user_id::VARCHAR FROM events) GROUP BY ALL""")
def grouping_histograms(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("u"))
    g = e.groupingSets([["event_type"], ["u"]], "event_type", "u").agg(F.count("*").alias("n"))
    return g.select(F.when(F.col("event_type").isNotNull(), "type").otherwise("user").alias("kind"), F.coalesce("event_type", "u").alias("value"), "n")


def _symbols(spark, sf_dir) -> DataFrame:
    """Parts as stand-ins for code symbols."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "function").otherwise("method")
    return p.select(F.concat(F.lit("src/"), (F.col("p_partkey") % 50).cast("string")).alias("path"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("type"), F.array(F.lit("timeout"), F.lit("strict")).alias("parameters"), F.col("p_partkey").alias("k"))


_TEMPLATES = " UNION ALL ".join(f"SELECT '{f}' AS focus, '{t}' AS template" for f, t in generate.FOCUS)


@query(f"""WITH dim AS ({_TEMPLATES}), s AS (SELECT 'src/' || (p_partkey % 50) AS path, 'f' || p_partkey AS name FROM part),
  x AS (SELECT path, name, focus, replace(template, '{{name}}', name) AS question, row_number() OVER (PARTITION BY path, name ORDER BY md5('42|' || path || '|' || name || '|' || focus)) AS n FROM s, dim) SELECT path, name, focus, question FROM x WHERE n <= 3""")
def template_questions(spark, sf_dir):
    return generate.questions(_symbols(spark, sf_dir), F.lit(3))


_NEG = " UNION ALL ".join(f"SELECT '{k}' AS k, '{on}' AS applies, '{t}' AS t" for k, on, t in generate.NEGATIVES)


@query(f"""WITH dim AS ({_NEG}), fakes AS (SELECT unnest([{", ".join(repr(f) for f in generate.FAKES)}]) AS f), s AS (SELECT 'src/' || (p_partkey % 50) AS path, 'f' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS type FROM part),
  fk AS (SELECT path, name, min_by(f, md5('42' || name || f)) AS fake FROM s, fakes WHERE f NOT IN ('timeout', 'strict') GROUP BY ALL),
  x AS (SELECT s.path, s.name, k, t, fake, row_number() OVER (PARTITION BY s.path, s.name ORDER BY md5('42|' || s.path || '|' || s.name || '|' || k)) AS n FROM s JOIN fk USING (path, name), dim WHERE list_contains(string_split(applies, ','), type))
  SELECT path, name, k AS negative_type, replace(replace(t, '{{name}}', name), '{{fake}}', fake) AS question, CASE WHEN contains(t, '{{fake}}') THEN fake END AS trap FROM x WHERE n <= 1""")
def negative_questions(spark, sf_dir):
    return generate.negatives(_symbols(spark, sf_dir))


@query("""SELECT tier, CASE WHEN qa + debug > 10 THEN greatest(1, qa * 10 // (qa + debug)) ELSE qa END::INTEGER AS qa, debug::INTEGER AS debug FROM (VALUES ('simple', 2, 1), ('moderate', 3, 2), ('complex', 4, 3), ('very_complex', 5, 3)) AS t(tier, qa, debug)
  JOIN (SELECT DISTINCT CASE WHEN l_quantity < 10 THEN 'simple' WHEN l_quantity < 25 THEN 'moderate' WHEN l_quantity < 50 THEN 'complex' ELSE 'very_complex' END AS tier FROM lineitem) USING (tier)""")
def task_distribution(spark, sf_dir):
    tiers = table(spark, sf_dir, "lineitem").select(code.tier(F.col("l_quantity")).alias("tier")).distinct()
    return tiers.select("tier", *generate.task_counts(F.col("tier")))


@query()
def chunk_combinations(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("chunk_index", "s"))
    return generate.combinations(s)


_RENDER = "string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn)"


@query(f"SELECT conv_id, {_RENDER} AS text FROM conversations GROUP BY conv_id")
def chat_prompt(spark, sf_dir):
    return assemble.conversation_messages(table(spark, sf_dir, "conversations")).select("conv_id", assemble.chat_text(F.col("messages")).alias("text"))


@query("SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark, sf_dir):
    return assemble.last_user_turn(table(spark, sf_dir, "conversations"))


@query(f"""WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, '<|system|>' || chr(10) || '{assemble.SYSTEM}' || chr(10) || '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) || t2 || chr(10) AS text FROM x WHERE role = 'user' AND r2 = 'assistant'""")
def instruct_format(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).where("role = 'user' AND r2 = 'assistant'")
    return pairs.select("conv_id", "turn", assemble.chat_text(assemble.instruct(F.col("text"), F.col("t2"))).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM conversations JOIN (SELECT conv_id, row_number() OVER (ORDER BY md5('42|' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id)")
def train_val_split(spark, sf_dir):
    return assemble.train_split(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", "split")


@query("SELECT conv_id, turn, ((sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1) // 200)::BIGINT AS bin FROM conversations WHERE length(text) >= 4")
def token_packing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.length("text") >= 4).withColumn("n", tx.token_count(F.col("text")))
    return assemble.packed(c, "n", "turn", "conv_id", 200).select("conv_id", "turn", "bin")


@query("SELECT DISTINCT concat_ws(' | ', source, 'Section: ' || lang) AS citation FROM documents")
def works_cited(spark, sf_dir):
    return assemble.works_cited(table(spark, sf_dir, "documents").select(tx.citation(F.col("source"), F.col("lang"), F.lit(None)).alias("citation")))


@query("WITH x AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM x WHERE s < 1500 GROUP BY conv_id")
def context_budget(spark, sf_dir):
    return assemble.budgeted(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1500)


def _drafts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("section"), F.row_number().over(w).alias("version"), F.lag("event_id").over(w).alias("parent_id"), F.col("props").alias("content"), "ts")


_DRAFTS = "dr AS (SELECT event_id AS id, user_id AS project_id, event_type AS section, row_number() OVER w AS version, lag(event_id) OVER w AS parent_id, props AS content, ts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"


@query(f"WITH {_DRAFTS} SELECT project_id, section, id, version::INTEGER AS version FROM dr QUALIFY row_number() OVER (PARTITION BY project_id, section ORDER BY version DESC) = 1")
def latest_per_key(spark, sf_dir):
    return catalog.latest(_drafts(spark, sf_dir), ["project_id", "section"], F.desc("version")).select("project_id", "section", "id", "version")


@query(f"WITH {_DRAFTS} SELECT project_id, section, (max(version) + 1)::INTEGER AS next_version FROM dr GROUP BY ALL")
def version_next(spark, sf_dir):
    return catalog.next_versions(_drafts(spark, sf_dir), ["project_id", "section"])


@query(f"WITH {_DRAFTS} SELECT id, version = max(version) OVER (PARTITION BY project_id, section) AS is_current FROM dr")
def current_flag(spark, sf_dir):
    return catalog.with_current_flag(_drafts(spark, sf_dir), ["project_id", "section"]).select("id", "is_current")


@query("SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id".replace("max_by(event_type, (ts, event_id))", "arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000000 + event_id)"))
def job_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    return catalog.job_status(e)


_STATE = "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END"


@query(f"""WITH x AS (SELECT user_id AS job_id, event_id AS seq, {_STATE} AS status, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT job_id, seq, status, before FROM x WHERE before IS NOT NULL AND before <> status AND NOT ((before = 'pending' AND status IN ('running', 'failed')) OR (before = 'running' AND status IN ('completed', 'failed')))""")
def job_transitions(spark, sf_dir):
    state = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "completed").otherwise("failed")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", state.alias("status"))
    return catalog.invalid_moves(e).select("job_id", "seq", "status", "before")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_id % 4 IN (0, 1) GROUP BY 1")
def active_jobs(spark, sf_dir):
    state = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "completed").otherwise("failed")
    return catalog.active_jobs(table(spark, sf_dir, "events").withColumn("status", state)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_DRAFTS}, p AS (SELECT DISTINCT user_id AS project_id FROM events), s AS (SELECT DISTINCT event_type AS section FROM events), l AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY project_id, section ORDER BY version DESC) = 1)
  SELECT project_id, section, coalesce(version, 0)::INTEGER AS version, coalesce(len(string_split(content, ' ')), 0)::INTEGER AS words FROM p CROSS JOIN s LEFT JOIN l USING (project_id, section)""")
def project_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    all_ = e.select(F.col("user_id").alias("project_id")).distinct().crossJoin(e.select(F.col("event_type").alias("section")).distinct())
    return catalog.progress(all_, _drafts(spark, sf_dir))


@query("SELECT user_id, CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND user_id % 2 = 0 THEN 'archived' WHEN user_id % 2 = 0 THEN 'active' ELSE 'draft' END AS status FROM events GROUP BY user_id")
def stale_archive(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = e.agg(F.max("ts").alias("now"))
    p = e.groupBy("user_id").agg(F.max("ts").alias("updated_at")).withColumn("status", F.when(F.col("user_id") % 2 == 0, "active").otherwise("draft"))
    return catalog.stale(p.crossJoin(F.broadcast(cut)), F.col("now") - F.expr("INTERVAL 1 DAY")).select("user_id", "status")  # one row


@query(f"""WITH {_DRAFTS}, l AS (SELECT * FROM dr WHERE project_id % 5 <> 1 QUALIFY row_number() OVER (PARTITION BY project_id, section ORDER BY version DESC) = 1), n AS (SELECT * FROM dr WHERE project_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY project_id, section ORDER BY version) = 1)
  SELECT project_id, section, coalesce(n.content, l.content) AS content, CASE WHEN n.content IS NOT NULL THEN coalesce(l.version, 0) + 1 ELSE l.version END::INTEGER AS version FROM l FULL JOIN n USING (project_id, section)""")
def draft_upsert(spark, sf_dir):
    d, keys = _drafts(spark, sf_dir), ["project_id", "section"]
    return catalog.upserted(catalog.latest(d.where("project_id % 5 <> 1"), keys, F.desc("version")), catalog.latest(d.where("project_id % 3 = 0"), keys, F.asc("version")), keys)


@query(f"WITH RECURSIVE {_DRAFTS}, up AS (SELECT id, parent_id AS ancestor, 1 AS distance FROM dr WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, dr.parent_id, distance + 1 FROM up JOIN dr ON dr.id = up.ancestor WHERE dr.parent_id IS NOT NULL) SELECT id, ancestor, distance::INTEGER AS distance FROM up")
def lineage(spark, sf_dir):
    return catalog.lineage(_drafts(spark, sf_dir).select("id", "parent_id"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def recent_history(spark, sf_dir):
    return catalog.recent(table(spark, sf_dir, "events"), "user_id", 50, "ts", "event_id").select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT n_name, count(c_custkey) AS customers, count(DISTINCT c_custkey % 10) AS kinds FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def parent_children(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.countDistinct(F.col("c_custkey") % 10).alias("kinds"))


@query("SELECT user_id, round(min(value), 6) AS least, round(arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + event_id), 6) AS last FROM events GROUP BY user_id")
def loss_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("last"))


@query("SELECT id, name, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || n || regexp_extract(name, '(\\.[^.]*)$', 1) END AS stored FROM (SELECT page_id AS id, lang || '.html' AS name, row_number() OVER (PARTITION BY lang ORDER BY page_id) - 1 AS n FROM (SELECT page_id, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages))")
def name_collisions(spark, sf_dir):
    from ..sources.files import collision_free

    names = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("seq"), F.concat(F.regexp_extract("url", "/(en|fr|de|es)/", 1), F.lit(".html")).alias("name"))
    return collision_free(names).select("id", "name", "stored")


@query()
def user_sessions(spark, sf_dir):
    from ..streaming.incremental import sessions

    return sessions(table(spark, sf_dir, "events"))
