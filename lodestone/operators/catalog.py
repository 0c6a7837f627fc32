"""Projects, versioned drafts, jobs and logs as append-only tables with latest-by-key views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved

STATES = ("pending", "running", "completed", "failed")
MOVES = {"pending": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by the order columns given (as descending expressions)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_versions(drafts: DataFrame, keys: list[str]) -> DataFrame:
    return drafts.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("next_version"))


def with_current_flag(drafts: DataFrame, keys: list[str]) -> DataFrame:
    return drafts.withColumn("is_current", F.col("version") == F.max("version").over(Window.partitionBy(*keys)))


def upserted(drafts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content, version): current drafts after edits (keys, content); an edit takes the next version."""
    old = drafts.select(*keys, F.col("content").alias("_old"), F.col("version").alias("_v"))
    both = old.join(edits.select(*keys, F.col("content").alias("_new")), keys, "full")
    edited = F.col("_new").isNotNull()
    return both.select(*keys, F.coalesce("_new", "_old").alias("content"), F.when(edited, F.coalesce("_v", F.lit(0)) + 1).otherwise(F.col("_v")).cast("int").alias("version"))


def progress(sections: DataFrame, drafts: DataFrame) -> DataFrame:
    """Every section with its latest draft's version and words, zero where it has none."""
    newest = latest(drafts, ["project_id", "section"], F.desc("version")).select("project_id", "section", "version", F.size(F.split("content", " ")).alias("words"))
    return sections.join(newest, ["project_id", "section"], "left").select("project_id", "section", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("words", F.lit(0)).alias("words"))


def stale(projects: DataFrame, cutoff: Column) -> DataFrame:
    """projects with status archived for active ones not updated since the cutoff."""
    return projects.withColumn("status", F.when((F.col("updated_at") < cutoff) & (F.col("status") == "active"), "archived").otherwise(F.col("status")))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "running"))


def missing_steps(required: Column, done: Column) -> Column:
    return F.array_sort(F.array_except(required, done))


def invalid_moves(events: DataFrame) -> DataFrame:
    """Rows (job_id, ts, seq, status, before) whose status may not follow the one before."""
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    moved = events.withColumn("before", F.lag("status").over(w))
    allowed = F.lit(False)
    for state, to in MOVES.items():
        if to:
            allowed = allowed | ((F.col("before") == state) & F.col("status").isin(*to))
    return moved.where(F.col("before").isNotNull() & ~allowed & (F.col("before") != F.col("status")))


def job_status(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("n_events"))


def lineage(drafts: DataFrame) -> DataFrame:
    """(id, ancestor, distance): every draft with all its ancestors over parent_id, by pointer doubling.

    Each join doubles the distance reached, until one finds nothing; rounds are checkpointed. Parents that
    form a cycle have no end and raise a ValueError.
    """
    reach = saved(drafts.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")))
    span = 1
    while True:
        onward = reach.select(F.col("id").alias("_via"), F.col("ancestor").alias("_far"), F.col("distance").alias("_d"))
        longer = saved(reach.where(F.col("distance") == span).join(onward, F.col("ancestor") == F.col("_via")).select("id", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance")))
        if longer.isEmpty():
            return reach
        reach = reach.unionByName(longer)
        if not reach.where("id = ancestor").isEmpty():
            raise ValueError("parent_id has a cycle")
        span *= 2


LOG_STEP, LOG_EPOCH, LOG_LOSS = "Step ([0-9]+)/([0-9]+)", "[Ee]poch[ :]+([0-9.]+)", "'?loss'?[ :=]+([0-9]+\\.?[0-9]*)"


def log_metrics(lines: DataFrame) -> DataFrame:
    """(path, step, steps, progress, epoch, min_loss, last_loss, last_losses, failed) from log lines (path, line_no, line).

    Progress is that of the last step line, at most 95 before the log says it completed.
    """
    f = lines.select("path", "line_no", "line", F.regexp_extract("line", LOG_STEP, 1).alias("a"), F.regexp_extract("line", LOG_STEP, 2).alias("b"), F.regexp_extract("line", LOG_EPOCH, 1).alias("e"), F.regexp_extract("line", LOG_LOSS, 1).alias("l"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("double"))
    at = F.when(F.col("a") != "", F.col("line_no"))
    losses = F.array_sort(F.collect_list(F.when(F.col("l") != "", F.struct("line_no", number("l").alias("v")))))
    done = F.max(F.col("line").rlike("(?i)training complete|completed successfully").cast("int")) == 1
    g = f.groupBy("path").agg(F.max_by(number("a"), at).alias("step"), F.max_by(number("b"), at).alias("steps"), F.max_by(number("e"), F.when(F.col("e") != "", F.col("line_no"))).alias("epoch"), F.transform(losses, lambda x: x["v"]).alias("ls"), done.alias("done"), (F.max(F.col("line").rlike("Traceback|ERROR|Error:").cast("int")) == 1).alias("failed"))
    share = F.when(F.col("done"), 100.0).when(F.col("steps") > 0, F.least(F.lit(95.0), 100.0 * F.col("step") / F.col("steps"))).otherwise(0.0)
    return g.select("path", F.col("step").cast("int"), F.col("steps").cast("int"), F.round(share, 6).alias("progress"), "epoch", F.array_min("ls").alias("min_loss"), F.try_element_at("ls", F.lit(-1)).alias("last_loss"), F.slice("ls", F.greatest(F.lit(1), F.size("ls") - 19), F.lit(20)).alias("last_losses"), "failed")


def recent(rows: DataFrame, by: str, n: int, order: str, tie: str) -> DataFrame:
    """The latest n rows of each group, for reading in ascending order."""
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


NEEDS = {"training": ("data_generation",), "chat": ("training",), "grant": ("rag", "training")}
PIPELINES = ("rag", "data_generation", "training")


def project_state(log: DataFrame, key: str, fields: tuple[str, ...], *order: str) -> DataFrame:
    """(key, fields.., created_at, updated_at) of an append-only log of creations and updates.

    Each field has the value of the last row that sets it (isn't null) by the order columns, of which the
    first is the time; a field that no row sets is null.
    """
    at = F.struct(*order)
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return log.groupBy(key).agg(*last, F.min(order[0]).alias("created_at"), F.max(order[0]).alias("updated_at"))


def numbered(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """rows with `place` from 1 in each group: a project's documents newest first, a draft's feedback oldest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def generation_report(log: DataFrame, by: str) -> DataFrame:
    """(by, n, tokens, mean_seconds, last_at) of a generation log (by, tokens, seconds, at)."""
    return log.groupBy(by).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.max("at").alias("last_at"))


def availability(projects: DataFrame, models: DataFrame, indexes: DataFrame, key: str = "id") -> DataFrame:
    """projects (key, rag_completed, ..) with has_model and has_rag; an index counts once its pipeline is completed."""
    held = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = projects.join(held(models, "_model"), key, "left").join(held(indexes, "_index"), key, "left")
    ready = F.col("_index").isNotNull() & F.coalesce("rag_completed", F.lit(False))
    return both.withColumn("has_model", F.col("_model").isNotNull()).withColumn("has_rag", ready).drop("_model", "_index")


def drafts_by_section(drafts: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, drafts): a map of each section's current draft as (content, citations, version); citations are a JSON list, [] without."""
    cited = F.coalesce(F.from_json("citations", "array<string>"), F.expr("cast(array() as array<string>)"))
    now = drafts.groupBy(key, "section").agg(F.max_by(F.struct("content", cited.alias("citations"), "version"), "version").alias("draft"))
    return now.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "draft")))).alias("drafts"))


def marked_complete(projects: DataFrame, done: DataFrame, key: str = "project_id") -> DataFrame:
    """projects with <pipeline>_completed true where done (key, pipeline) has a row for it; unknown pipelines raise an error."""
    known = done.select(key, F.when(F.col("pipeline").isin(*PIPELINES), F.col("pipeline")).otherwise(F.raise_error(F.concat(F.lit("unknown pipeline "), F.col("pipeline")))).alias("pipeline"))
    flags = known.groupBy(key).agg(*[F.max(F.col("pipeline") == p).alias(f"_{p}") for p in PIPELINES])
    joined = projects.join(flags, key, "left")
    return joined.select(*[c for c in projects.columns if c not in {f"{p}_completed" for p in PIPELINES}], *[(F.coalesce(f"{p}_completed", F.lit(False)) | F.coalesce(f"_{p}", F.lit(False))).alias(f"{p}_completed") for p in PIPELINES])


def project_status(projects: DataFrame, jobs: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, <pipeline>_completed.., active, last_<pipeline>.., can_<step>.., missing_<step>..) for every project.

    jobs is (key, job_id, job_type, status, created_at); active counts those pending or running, last_<pipeline> is the
    status of the type's newest job, and a step may be entered when all that it needs is completed.
    """
    own = jobs.groupBy(key).agg(F.count_if(F.col("status").isin("pending", "running")).alias("active"), *[F.max_by("status", F.when(F.col("job_type") == p, F.struct("created_at", "job_id"))).alias(f"last_{p}") for p in PIPELINES])
    done = F.array_compact(F.array(*[F.when(F.col(f"{p}_completed"), F.lit(p)) for p in PIPELINES]))
    steps = {s: missing_steps(F.array(*[F.lit(n) for n in needs]), done) for s, needs in NEEDS.items()}
    joined = projects.join(own, key, "left")
    return joined.select(key, *[f"{p}_completed" for p in PIPELINES], F.coalesce("active", F.lit(0)).alias("active"), *[f"last_{p}" for p in PIPELINES], *[(F.size(m) == 0).alias(f"can_{s}") for s, m in steps.items()], *[m.alias(f"missing_{s}") for s, m in steps.items()])


def job_by_task(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The latest state (job_id, task_id, status, progress, created_at) of the jobs of tasks (task_id)."""
    return latest(jobs.join(tasks.select("task_id").distinct(), "task_id", "left_semi"), ["task_id"], F.desc("created_at"), F.desc("job_id"))


def corpus_status(projects: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, exists, has_index, document_count, chunk_count) from documents (key, chunks) of projects' indexes."""
    counted = documents.groupBy(key).agg(F.count("*").alias("document_count"), F.sum("chunks").alias("chunk_count"))
    joined = projects.select(key).join(counted, key, "left")
    return joined.select(key, F.col("document_count").isNotNull().alias("exists"), (F.coalesce("chunk_count", F.lit(0)) > 0).alias("has_index"), F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def missing_files(present: Column, required: tuple[str, ...] = ("chunks", "postings", "stats")) -> Column:
    """The files of an index that aren't among those present."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)
