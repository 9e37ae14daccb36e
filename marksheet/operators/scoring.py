"""From check rows to readiness, breakdowns and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet import schema
from marksheet.functions import scores as S


def dedupe_checks(checks: DataFrame) -> DataFrame:
    """One row for each (run_id, check_id): the worst status, of equals the last emitted; position of the first emitted."""
    own = Window.partitionBy("run_id", "check_id")
    ranked = checks.withColumn("pick", F.row_number().over(own.orderBy(S.rank_of(F.col("status"), schema.STATUS_DEDUPE).desc(), F.desc("emit_seq")))).withColumn("position", F.min("emit_seq").over(own))
    return ranked.where("pick = 1").drop("pick")


def filled(sentence: str, *values: Column) -> Column:
    """A sentence with values in place of {}."""
    parts = sentence.split("{}")
    return F.concat(*[x for pair in zip(map(F.lit, parts), [*[v.cast("string") for v in values], F.lit("")], strict=True) for x in pair])


def with_mandatory(checks: DataFrame) -> DataFrame:
    return checks.withColumn("counted", S.is_mandatory(F.col("mandatory"), F.col("bonus"), F.col("status")))


def readiness(checks: DataFrame) -> DataFrame:
    """One row a run: mandatory checks passed, their number, percent (0 without any), verdict and its message; counts by
    status and severity."""
    failing = F.col("status").isin(*schema.FAILING)
    rows = with_mandatory(checks).groupBy("run_id").agg(
        F.count_if("counted").alias("total"),
        F.count_if(F.col("counted") & F.col("status").isin(*schema.PASSED)).alias("passed"),
        F.count_if(F.col("counted") & failing).alias("failures"),
        F.coalesce(F.bool_or(F.col("counted") & failing & (F.col("severity") == "critical")), F.lit(False)).alias("critical"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in schema.STATUS_REPORT],
        *[F.count_if(failing & (F.col("severity") == s)).alias(f"failing_{s}") for s in schema.SEVERITY],
    )
    verdict = F.when((F.col("total") > 0) & (F.col("failures") == 0), "ready").otherwise("not_ready")
    remaining = F.concat(filled(schema.REMAINING, F.col("failures")), F.when(F.col("critical"), schema.CRITICAL_FIRST).otherwise(""))
    message = F.when(F.col("total") == 0, schema.NO_REQUIREMENT).when(F.col("failures") == 0, schema.READY).otherwise(remaining)
    return rows.withColumn("readiness", F.coalesce(S.percent(F.col("passed"), F.col("total")), F.lit(0.0))).withColumn("verdict", verdict).withColumn("message", message)


def category_scores(checks: DataFrame) -> DataFrame:
    """Scored categories with a mandatory check; warnings count all checks of the category."""
    rows = with_mandatory(checks).where(F.col("category").isin(*schema.SCORED_CATEGORIES)).groupBy("run_id", "category").agg(
        F.count_if(F.col("counted") & F.col("status").isin(*schema.PASSED)).alias("passed"),
        F.count_if("counted").alias("total"),
        F.count_if(F.col("counted") & F.col("status").isin(*schema.FAILING)).alias("failed"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
    )
    return rows.where("total > 0").withColumn("score", S.percent(F.col("passed"), F.col("total"))).withColumn("place", S.rank_of(F.col("category"), schema.SCORED_CATEGORIES))


def locate_checks(checks: DataFrame, paths: DataFrame, exercises: DataFrame) -> DataFrame:
    """Adds located_file and located_exercise. The exercise is the check's if it is one of exercises(exercise_id, file,
    ...); the file is what the check id ends in, the check's file or its exercise's file, the first that is among
    paths(path), else the check's file."""
    ends = F.coalesce(*[F.when(F.startswith("check_id", F.lit(p)), F.substr("check_id", F.lit(len(p) + 1))) for p in schema.PATH_PREFIXES])
    known = paths.select("path").distinct()
    own = exercises.groupBy("exercise_id").agg(F.min("file").alias("own_file"))
    rows = checks.withColumn("ends", ends).join(known.withColumnRenamed("path", "by_id"), F.col("ends") == F.col("by_id"), "left")
    rows = rows.join(known.withColumnRenamed("path", "by_file"), F.col("file") == F.col("by_file"), "left").join(own.withColumnRenamed("exercise_id", "located_exercise"), F.col("exercise_id") == F.col("located_exercise"), "left")
    return rows.withColumn("located_file", F.coalesce("by_id", "by_file", "own_file", "file")).drop("ends", "by_id", "by_file", "own_file")


def missing_files(located: DataFrame) -> DataFrame:
    """(run_id, file) of which a structure check says that it is missing."""
    says = (F.col("category") == "structure") & F.col("diagnosis").isin(*schema.MISSING_FILE) & (F.col("status") != "pass")
    return located.where(says & F.col("located_file").isNotNull() & (F.col("located_file") != "")).select("run_id", F.col("located_file").alias("file")).distinct()


def in_progress(optional: Column) -> Column:
    """Checks that make up a progress ratio; optional: the exercise or file is neither required nor bonus."""
    return F.col("status").isin(*schema.PROGRESS) & (F.col("category") != schema.HEURISTIC_CATEGORY) & (F.col("mandatory") | F.col("bonus") | optional)


def exercise_membership(located: DataFrame, exercises: DataFrame) -> DataFrame:
    """Checks of each exercise: by its id, or, where no exercise is known, by its file (then of every exercise of the file).
    Columns of exercises begin with of_."""
    dim = exercises.select(*[F.col(c).alias(f"of_{c}") for c in exercises.columns])
    # One join of both kinds, so that the checks are read and deduped once.
    keyed = dim.select("*", F.lit(False).alias("by_file"), F.col("of_exercise_id").alias("of_key")).unionByName(dim.select("*", F.lit(True).alias("by_file"), F.col("of_file").alias("of_key")))
    own = (F.coalesce("located_exercise", "located_file") == F.col("of_key")) & (F.col("located_exercise").isNull() == F.col("by_file"))
    return located.join(keyed, own).drop("by_file", "of_key")


def exercise_scores(located: DataFrame, exercises: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each exercise of each run's subject: exercises(subject_id, exercise_id, file, required, bonus, functions),
    runs(run_id, subject_id), checks of locate_checks()."""
    rows = exercise_membership(located, exercises.drop("subject_id"))
    optional = ~F.col("of_required") & ~F.col("of_bonus")
    status, counted = F.col("status"), in_progress(optional)
    gone = F.col("diagnosis").isin(*schema.MISSING_FUNCTION) & status.isin(*schema.PROGRESS_FAILING)
    named = F.coalesce("function", F.lit("")) != ""
    stats = rows.groupBy("run_id", F.col("of_exercise_id").alias("exercise_id")).agg(
        F.count_if(counted & status.isin(*schema.PASSED)).alias("passed"),
        F.count_if(counted).alias("total"),
        F.count_if(S.is_issue(status)).alias("issues"),
        F.max(counted & status.isin(*schema.PROGRESS_FAILING)).alias("failing"),
        F.max(status == "warning").alias("warned"),
        F.max(counted & status.isin(*schema.PASSED) & F.col("category").isin(*schema.BEHAVIOUR_CATEGORIES)).alias("behaves"),
        F.max(gone & ~named & (F.col("diagnosis") == "bonus_not_implemented")).alias("not_there"),
        F.collect_set(F.when(gone & named & F.array_contains("of_functions", F.col("function")), F.col("function"))).alias("gone"),
    )
    every = runs.select("run_id", "subject_id").join(exercises, "subject_id").drop("subject_id")
    lost = missing_files(located).withColumn("file_missing", F.lit(True))
    rows = every.join(stats, ["run_id", "exercise_id"], "left").join(lost, ["run_id", "file"], "left").fillna({"passed": 0, "total": 0, "issues": 0})
    true = lambda c: F.coalesce(c, F.lit(False))
    absent = true("file_missing") | true("not_there") | (F.size("functions") > 0) & (F.size(F.array_except("functions", F.coalesce("gone", F.expr("cast(array() as array<string>)")))) == 0)
    state = (
        F.when(F.col("bonus") & absent, "not_implemented")
        .when(true("file_missing"), "missing")
        .when(F.col("total") == 0, "warning")
        .when(~true("failing"), F.when(true("warned"), "warning").otherwise("pass"))
        .when(true("behaves"), "partial")
        .otherwise("fail")
    )
    return rows.select("run_id", "exercise_id", "file", "required", "bonus", "passed", "total", S.percent(F.col("passed"), F.col("total")).alias("score"), "issues", state.alias("state"))


def bonus_completion(scores: DataFrame) -> DataFrame:
    """exercise_scores() to each run's share of bonus exercises that are complete; null without any."""
    complete = F.col("bonus") & (F.col("total") > 0) & F.col("state").isin("pass", "warning")
    rows = scores.groupBy("run_id").agg(F.count_if(complete).alias("bonus_passed"), F.count_if("bonus").alias("bonus_total"))
    return rows.withColumn("bonus_completion", S.percent(F.col("bonus_passed"), F.col("bonus_total")))


def expected_files(structure: DataFrame, exercises: DataFrame) -> DataFrame:
    """What a subject asks for: structure(subject_id, path, kind, required, bonus, pos) before the files of
    exercises(subject_id, file, required, bonus, pos); the first entry of a path counts."""
    own = exercises.select("subject_id", F.col("file").alias("path"), F.lit("file").alias("kind"), "required", "bonus", "pos", F.lit(1).alias("origin"))
    rows = structure.select("subject_id", "path", "kind", "required", "bonus", "pos", F.lit(0).alias("origin")).unionByName(own)
    first = F.row_number().over(Window.partitionBy("subject_id", "path").orderBy("origin", "pos"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth", "origin")


def file_scores(located: DataFrame, files: DataFrame, exercises: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each expected file of each run's subject, with the worst severity of its issues and its exercises."""
    wanted = files.where("kind = 'file'").select("subject_id", F.col("path").alias("file"), "required", "bonus")
    mine = located.select("run_id", "status", "severity", "category", "mandatory", "bonus", F.col("located_file").alias("file")).join(wanted.select("file", "required", F.col("bonus").alias("file_bonus")).distinct(), "file")
    mine = mine.withColumn("counted", in_progress(~F.col("required") & ~F.col("file_bonus")))
    issue = S.is_issue(F.col("status"))
    stats = mine.groupBy("run_id", "file").agg(
        F.count_if(F.col("counted") & F.col("status").isin(*schema.PASSED)).alias("passed"), F.count_if("counted").alias("total"), F.count_if(issue).alias("issues"), F.min(F.when(issue, S.severity_rank(F.col("severity")))).alias("worst_rank"),
    )
    serves = exercises.groupBy("subject_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "exercise_id"))), lambda e: e["exercise_id"]), ",").alias("exercise_ids"))
    rows = runs.select("run_id", "subject_id").join(wanted, "subject_id").join(serves, ["subject_id", "file"], "left").join(stats, ["run_id", "file"], "left")
    rows = rows.join(missing_files(located).withColumn("lost", F.lit(True)), ["run_id", "file"], "left").fillna({"passed": 0, "total": 0, "issues": 0, "exercise_ids": ""})
    names = F.array(*map(F.lit, schema.SEVERITY))
    worst = F.when(F.col("worst_rank") < len(schema.SEVERITY), names[F.col("worst_rank")])
    return rows.select("run_id", "file", "exercise_ids", F.col("lost").isNull().alias("present"), "passed", "total", S.percent(F.col("passed"), F.col("total")).alias("score"), "issues", worst.alias("worst"))


def under_tested(checks: DataFrame, functions: DataFrame, runs: DataFrame, least: int = schema.MIN_TESTS_PER_FUNCTION) -> DataFrame:
    """functions(subject_id, exercise_id, function, required, bonus, pos) of required exercises that fewer than `least`
    explicit or derived tests of a run aim at, tests without an exercise added; also those that no check names at all."""
    raw = F.coalesce("test_id", F.when(F.startswith("check_id", F.lit("test:")), F.substr("check_id", F.lit(6))))
    target = F.when(F.coalesce("function", F.lit("")) != "", F.col("function")).when(F.contains(raw, F.lit("#")), F.substring_index(raw, "#", 1))
    tests = checks.where(F.col("category").isin("explicit_tests", "derived_tests")).select("run_id", "exercise_id", target.alias("function")).where("function <> ''").groupBy("run_id", "exercise_id", "function").agg(F.count("*").alias("n"))
    wanted = runs.select("run_id", "subject_id").join(functions.where("required and not bonus"), "subject_id").select("run_id", "exercise_id", "function", "pos")
    loose = tests.where("exercise_id is null").select("run_id", "function", F.col("n").alias("loose"))
    rows = wanted.join(tests, ["run_id", "exercise_id", "function"], "left").join(loose, ["run_id", "function"], "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("loose", F.lit(0))
    return rows.select("run_id", "exercise_id", "function", "pos", total.alias("tests")).where(F.col("tests") < least)


def confidence(checks: DataFrame, functions: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, level, reasons) of each run of runs(run_id, subject_id, reviewed, ai_items, notes, sandbox_mode): high, and
    the lowest level of what lowers it; reasons in a fixed order, the last of them only a note."""
    counted = with_mandatory(checks).groupBy("run_id").agg(
        F.count_if("counted").alias("mandatory"),
        F.count_if(F.col("category").isin("explicit_tests", "output") & F.startswith("check_id", F.lit("test:"))).alias("explicit"),
        F.count_if((F.col("category") == schema.HEURISTIC_CATEGORY) & (F.col("status") == "warning")).alias("heuristic"),
    )
    weak = under_tested(checks, functions, runs).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "function"))), lambda f: f["function"]).alias("weak"))
    rows = runs.join(counted, "run_id", "left").join(weak, "run_id", "left").fillna({"mandatory": 0, "explicit": 0, "heuristic": 0})
    n_weak = F.coalesce(F.size("weak"), F.lit(0))
    lowers = [
        (F.col("mandatory") == 0, 0, F.lit(schema.NOTHING_VERIFIED)),
        (F.col("explicit") == 0, 0, F.lit(schema.NO_EXPLICIT_TEST)),
        ((F.col("ai_items") > 0) & ~F.col("reviewed"), 1, filled(schema.AI_NOT_REVIEWED, F.col("ai_items"))),
        (n_weak > 0, 1, filled(schema.UNDER_TESTED, n_weak, F.array_join("weak", ", "))),
        (F.col("heuristic") > 0, 1, filled(schema.HEURISTIC_WARNINGS, F.col("heuristic"))),
        (F.col("notes") > 0, 1, filled(schema.PARSER_NOTES, F.col("notes"))),
        (F.col("sandbox_mode") == "local", 2, F.lit(schema.LOCAL_SANDBOX)),
    ]
    level = F.least(*[F.when(c, n).otherwise(2) for c, n, _ in lowers])
    reasons = F.array_compact(F.array(*[F.when(c, text) for c, _, text in lowers]))
    return rows.select("run_id", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1).alias("level"), F.array_join(reasons, "\n").alias("reasons"))


def check_order() -> list[Column]:
    """Worst first: status, severity, mandatory ones, then the order of emission."""
    return [S.report_rank(F.col("status")), S.severity_rank(F.col("severity")), F.desc("mandatory"), F.col("emit_seq")]


def top_issues(checks: DataFrame, n: int = 5) -> DataFrame:
    """Of each run: mandatory failures first, then by severity, then check_order()."""
    failure = F.col("mandatory") & ~F.col("bonus") & F.col("status").isin(*schema.FAILING)
    order = Window.partitionBy("run_id").orderBy(F.when(failure, 0).otherwise(1), S.severity_rank(F.col("severity")), *check_order())
    return checks.where(S.is_issue(F.col("status"))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def search_issues(checks: DataFrame, query: str, statuses: list[str], severity: str | None = None, provenance: str | None = None) -> DataFrame:
    """Faceted filter: buckets of status_filter(), a severity, a provenance; every word of the query must occur in what
    is said about a check, in any case."""
    hay = F.lower(F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "message", "check_id", "file", "location_file", "function", "exercise_id", "diagnosis")]))
    out = checks.where(S.status_filter(F.col("status")).isin(*statuses))
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    if provenance is not None:
        out = out.where(F.col("provenance") == provenance)
    for word in query.lower().split():
        out = out.where(F.contains(hay, F.lit(word)))
    return out
