"""What is run for a project and what keeps it from running, as joins of tests, exercises, files and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Jobs at once at most, seconds that a job costs besides its own time limit.
MAX_PARALLEL, JOB_OVERHEAD = 8, 2.0


def file_blockers(exercises: DataFrame, file_map: DataFrame, modules: DataFrame) -> DataFrame:
    """Why code of a file can't run: exercises(subject_id, file), file_map(project_id, subject_id, file, found),
    modules(project_id, path, ok) to (project_id, file, blocker): the check id of a missing or unreadable file."""
    files = exercises.select("subject_id", "file").distinct()
    projects = file_map.select("project_id", "subject_id").distinct()
    rows = projects.join(files, "subject_id").join(file_map, ["project_id", "subject_id", "file"], "left").join(modules.select("project_id", F.col("path").alias("found"), "ok"), ["project_id", "found"], "left")
    blocker = F.when(F.col("found").isNull(), F.concat(F.lit("structure:file:"), "file")).when(F.endswith("file", F.lit(".py")) & ~F.coalesce("ok", F.lit(False)), F.concat(F.lit("syntax:"), "file"))
    return rows.select("project_id", "file", blocker.alias("blocker")).where("blocker is not null")


def primary_exercises(exercises: DataFrame) -> DataFrame:
    """Of each file, the first exercise of kind functions, one without bonus before all others."""
    first = Window.partitionBy("subject_id", "file").orderBy("bonus", "pos")
    return exercises.where("kind = 'functions'").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def runnable_exercises(exercises: DataFrame, file_map: DataFrame, blockers: DataFrame) -> DataFrame:
    """The primary exercise of each file that a project can run: (project_id, subject_id, file, exercise_id, module_path)."""
    rows = file_map.where("found is not null").join(primary_exercises(exercises), ["subject_id", "file"]).join(blockers, ["project_id", "file"], "left_anti")
    return rows.select("project_id", "subject_id", "file", "exercise_id", F.col("found").alias("module_path"))


def plan_tests(tests: DataFrame, exercises: DataFrame, file_map: DataFrame, blockers: DataFrame, functions: DataFrame) -> DataFrame:
    """What becomes of each test: tests(project_id, subject_id, test_id, exercise_id, function, pos), where a test without
    function is a script; functions(project_id, path, function) are those that modules define.

    Returns (project_id, test_id, exercise_id, kind, outcome, blocked_by, module_path), also an import job for each primary
    exercise that can run. outcome: unknown_exercise, blocked, run, or repeated. What is blocked never takes an id: of the rest
    of one id the first runs, imports before functions before scripts, then by pos."""
    imports = runnable_exercises(exercises, file_map, blockers).select("project_id", F.concat(F.lit("import:"), "exercise_id").alias("test_id"), "exercise_id", F.lit("import").alias("kind"), F.lit(0).alias("stage"), "module_path")
    known = exercises.select("subject_id", "exercise_id", "file").withColumn("known", F.lit(True))
    rows = tests.join(known, ["subject_id", "exercise_id"], "left").join(file_map.select("project_id", "subject_id", "file", F.col("found").alias("module_path")), ["project_id", "subject_id", "file"], "left").join(blockers, ["project_id", "file"], "left")
    defined = functions.select("project_id", F.col("path").alias("module_path"), "function").distinct().withColumn("defined", F.lit(True))
    rows = rows.join(defined, ["project_id", "module_path", "function"], "left")
    is_script = F.col("function").isNull()
    absent = F.when(F.col("module_path").isNull(), F.concat(F.lit("structure:file:"), "file")).when(~is_script & F.col("defined").isNull(), F.concat(F.lit("function:"), "exercise_id", F.lit(":"), "function"))
    blocked = F.when(F.col("known").isNotNull(), F.coalesce("blocker", absent))
    rows = rows.select("project_id", "test_id", "exercise_id", F.when(is_script, "script").otherwise("function").alias("kind"), F.when(is_script, 2).otherwise(1).alias("stage"), "module_path", "pos", "known", blocked.alias("blocked_by"))
    every = rows.unionByName(imports.withColumn("known", F.lit(True)), allowMissingColumns=True).withColumn("open", F.col("known").isNotNull() & F.col("blocked_by").isNull())
    first = Window.partitionBy("project_id", "test_id", "open").orderBy("stage", "pos", "exercise_id")
    outcome = F.when(F.col("known").isNull(), "unknown_exercise").when(~F.col("open"), "blocked").when(F.row_number().over(first) == 1, "run").otherwise("repeated")
    return every.select("project_id", "test_id", "exercise_id", "kind", outcome.alias("outcome"), "blocked_by", F.when(F.col("open"), F.col("module_path")).alias("module_path"))


def repeated_ids(rows: DataFrame, *keys: str) -> DataFrame:
    """Ids that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Each planned job of (run_id, job_id) with its result; a harness error where none came back."""
    rows = jobs.join(results.select("run_id", "job_id", "status", "duration_ms"), ["run_id", "job_id"], "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("harness_error"))).withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0.0)))


def time_budgets(jobs: DataFrame, parallel: int = 4, slack: float = 5.0) -> DataFrame:
    """Seconds for all jobs(run_id, timeout) of a run on some workers: their cost shared out, the dearest, and a slack."""
    cost = F.col("timeout") + JOB_OVERHEAD
    workers = F.greatest(F.lit(1), F.least(F.lit(parallel), F.lit(MAX_PARALLEL), F.count("*")))
    return jobs.groupBy("run_id").agg((F.sum(cost) / workers + F.max(cost) + slack).alias("seconds"), workers.cast("int").alias("workers"))
