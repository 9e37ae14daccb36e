"""Merging what a second parser found in a subject into a first parser's spec: what the first has always wins.

A spec is three tables:

exercises(spec_id, pos, exercise_id, file_path, kind, side_effects, script, constraints): script is struct<prompts, required_outputs> of
arrays, or null; constraints of any type, null where there are none;
functions(spec_id, exercise_pos, pos, name, rules array<string>, reference): names differ within an exercise;
tests(spec_id, exercise_pos, function, pos, test_id, call): function is null for tests of the script; call is compared as a whole.

pos is unique in its spec or exercise. Null lists count as empty, a null file_path matches no other. A spec that only base has stays
as it is; one that only the other has goes through the same rules, so its later exercises may join earlier ones. Which exercise takes
which depends on what earlier ones took, so exercises of one file of one spec are folded in order inside an aggregate over a short
array; all else is joins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.sources.tables import written

NO_PLACES = "cast(array() as array<struct<side:int,pos:bigint>>)"
TAKEN = "cast(array() as array<struct<pos:bigint,into:struct<side:int,pos:bigint>>>)"


class Spec(NamedTuple):
    exercises: DataFrame
    functions: DataFrame
    tests: DataFrame


def free_numbers(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """wanted(spec_id, prefix, pos, ...) with test_id: prefix and the least number from 1 that neither used(spec_id, test_id) nor an
    earlier row of wanted has. A prefix doesn't end in a digit. Numbers with leading zeros are never given, so never in the way.

    Below the i-th used number u are u - i free ones, so the k-th free number is k plus how many used ones have u - i < k.
    """
    parts = used.select("spec_id", F.regexp_extract("test_id", r"(?s)\A(.*\D|)([1-9][0-9]{0,17})\z", 1).alias("prefix"), F.regexp_extract("test_id", r"(?s)\A(.*\D|)([1-9][0-9]{0,17})\z", 2).alias("u"))
    parts = parts.where("u <> ''").select("spec_id", "prefix", F.col("u").cast("long").alias("u")).distinct()
    by = Window.partitionBy("spec_id", "prefix")
    gaps = parts.select("spec_id", "prefix", (F.col("u") - F.row_number().over(by.orderBy("u"))).alias("at"), F.lit(True).alias("is_used"))
    asked = wanted.withColumn("at", F.row_number().over(by.orderBy("pos")).cast("long")).withColumn("is_used", F.lit(False))
    both = asked.unionByName(gaps, allowMissingColumns=True)
    passed = F.count(F.when(F.col("is_used"), 1)).over(by.orderBy("at", "is_used").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("passed", passed).where(~F.col("is_used")).withColumn("test_id", F.concat("prefix", (F.col("at") + F.col("passed")).cast("string"))).drop("at", "is_used", "passed")


def _place(side: int, pos: str) -> Column:
    return F.struct(F.lit(side).alias("side"), F.col(pos).cast("long").alias("pos"))


def _names(base: Spec, other: Spec) -> DataFrame:
    """Each name of either spec: whether base has it, and the first exercise of other that does."""
    had = base.functions.select("spec_id", "name").distinct().withColumn("in_base", F.lit(True))
    first = other.functions.groupBy("spec_id", "name").agg(F.min("exercise_pos").alias("first"))
    return first.join(had, ["spec_id", "name"], "left").withColumn("in_base", F.coalesce("in_base", F.lit(False)))


def match_exercises(base: Spec, other: Spec) -> DataFrame:
    """(spec_id, exercise_pos, side, pos): where each exercise of other goes. side 0 is an exercise of base, 1 one of other that was
    added; an exercise at its own place is added itself.

    In order, an exercise goes to the first untaken one of its file with a function in common; else to the only untaken one of its file,
    if none of its functions is defined anywhere so far; else it is added. Added ones may be taken by later ones, each once.
    """
    names = _names(base, other)
    mentioned = other.functions.select("spec_id", "exercise_pos", "name").join(names, ["spec_id", "name"])
    files = lambda s, side: s.exercises.select("spec_id", F.col("file_path").alias("at_file"), F.col("pos").alias("exercise_pos"), _place(side, "pos").alias("place"))
    held = base.functions.select("spec_id", "exercise_pos", "name").join(files(base, 0), ["spec_id", "exercise_pos"]).select("spec_id", "name", "at_file", "place")
    owned = names.where(~F.col("in_base")).select("spec_id", "name", F.col("first").alias("exercise_pos")).join(files(other, 1), ["spec_id", "exercise_pos"]).select("spec_id", "name", "at_file", "place")
    own = other.exercises.select("spec_id", F.col("pos").alias("exercise_pos"), F.col("file_path").alias("at_file"))
    shared = mentioned.join(own, ["spec_id", "exercise_pos"]).join(held.unionByName(owned), ["spec_id", "name", "at_file"]).groupBy("spec_id", "exercise_pos").agg(F.sort_array(F.collect_set("place")).alias("shared"))
    known = mentioned.groupBy("spec_id", "exercise_pos").agg(F.max(F.col("in_base") | (F.col("first") < F.col("exercise_pos"))).alias("known"))
    turns = own.join(known, ["spec_id", "exercise_pos"], "left").join(shared, ["spec_id", "exercise_pos"], "left")
    turn = F.struct(F.col("exercise_pos").cast("long").alias("pos"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("shared", F.expr(NO_PLACES)).alias("shared"))
    queues = turns.where("at_file IS NOT NULL").groupBy("spec_id", "at_file").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    there = files(base, 0).where("at_file IS NOT NULL").groupBy("spec_id", "at_file").agg(F.sort_array(F.collect_list("place")).alias("untaken"))

    def take(state: Column, t: Column) -> Column:
        left = state["untaken"]
        into = F.coalesce(F.get(F.array_intersect(t["shared"], left), F.lit(0)), F.when((F.size(left) == 1) & ~t["known"], F.get(left, F.lit(0))))
        itself = F.struct(F.lit(1).alias("side"), t["pos"].alias("pos"))
        after = F.when(into.isNull(), F.concat(left, F.array(itself))).otherwise(F.array_except(left, F.array(into)))
        return F.struct(after.alias("untaken"), F.concat(state["out"], F.array(F.struct(t["pos"].alias("pos"), F.coalesce(into, itself).alias("into")))).alias("out"))

    start = F.struct(F.coalesce("untaken", F.expr(NO_PLACES)).alias("untaken"), F.expr(TAKEN).alias("out"))
    folded = queues.join(there, ["spec_id", "at_file"], "left").select("spec_id", F.explode(F.aggregate("turns", start, take)["out"]).alias("o"))
    placed = folded.select("spec_id", F.col("o.pos").alias("exercise_pos"), "o.into.side", "o.into.pos")
    nowhere = own.where("at_file IS NULL").select("spec_id", F.col("exercise_pos").cast("long").alias("exercise_pos"), F.lit(1).alias("side"), F.col("exercise_pos").cast("long").alias("pos"))
    return placed.unionByName(nowhere)


def _added_ids(base: Spec, other: Spec, goes: DataFrame) -> DataFrame:
    """Ids of added exercises: their own, or with the least suffix from _2 that no exercise of the spec has so far."""
    added = goes.where(_itself()).select("spec_id", "pos").join(other.exercises.select("spec_id", "pos", "exercise_id"), ["spec_id", "pos"])
    asked = added.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("pos", "exercise_id"))).alias("asked"))
    used = base.exercises.groupBy("spec_id").agg(F.collect_list("exercise_id").alias("used"))

    def name(state: Column, a: Column) -> Column:
        suffixed = F.transform(F.sequence(F.lit(2), F.size(state["used"]) + 2), lambda n: F.concat(a["exercise_id"], F.lit("_"), n.cast("string")))
        free = F.when(~F.array_contains(state["used"], a["exercise_id"]), a["exercise_id"]).otherwise(F.get(F.array_except(suffixed, state["used"]), F.lit(0)))
        return F.struct(F.concat(state["used"], F.array(free)).alias("used"), F.concat(state["out"], F.array(F.struct(a["pos"].alias("pos"), free.alias("new_id")))).alias("out"))

    start = F.struct(F.coalesce("used", F.expr("cast(array() as array<string>)")).alias("used"), F.expr("cast(array() as array<struct<pos:bigint,new_id:string>>)").alias("out"))
    return asked.join(used, "spec_id", "left").select("spec_id", F.inline(F.aggregate("asked", start, name)["out"]))


def _itself() -> Column:
    return (F.col("side") == 1) & (F.col("pos") == F.col("exercise_pos"))


def _some(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0)) > 0


def merge_specs(base: Spec, other: Spec) -> Spec:
    """The merged spec: base's exercises, then the added ones, told apart by (side, pos), with added where they came from other.

    Exercises: an id that is taken gets a suffix; kind 'file' becomes 'functions' or 'script' with the first of these; prompts and
    required outputs of a script fill empty lists. Functions: a name that is defined elsewhere is dropped; rules and reference fill
    gaps. Tests: new functions bring all theirs, known ones those whose call is new (the first of equals), scripts theirs if there were
    none; each gets a free id. Functions and tests name their exercise by (side, exercise_pos).

    Where exercises go and what becomes of functions is written, as many of the joins below read it.
    """
    goes = written(match_exercises(base, other), "merge-goes")
    names = _names(base, other)
    ids = _added_ids(base, other, goes)
    # What becomes of each function of other.
    there = base.functions.select("spec_id", F.lit(0).alias("side"), F.col("exercise_pos").cast("long").alias("pos"), "name", F.lit(True).alias("in_place"))
    claims = other.functions.select("spec_id", "exercise_pos", "name", F.col("pos").alias("function_pos"), "rules", "reference").join(goes, ["spec_id", "exercise_pos"]).join(names, ["spec_id", "name"]).join(there, ["spec_id", "side", "pos", "name"], "left")
    is_held = F.coalesce("in_place", F.lit(False)) | ((F.col("side") == 1) & ~F.col("in_base") & (F.col("first") == F.col("pos")) & (F.col("exercise_pos") != F.col("pos")))
    is_new = ~F.col("in_base") & (F.col("first") == F.col("exercise_pos"))
    claims = claims.withColumn("fate", F.when(is_held, "held").when(is_new, "new")).where("fate IS NOT NULL").select("spec_id", "exercise_pos", "side", "pos", "name", "function_pos", "rules", "reference", "fate")
    claims = written(claims, "merge-claims")
    # Functions: base's and new ones, their gaps filled by held ones.
    whole = base.functions.select("spec_id", F.lit(0).alias("side"), F.col("exercise_pos").cast("long").alias("pos"), "name", F.lit(False).alias("added"), F.col("exercise_pos").cast("long").alias("from_pos"), F.col("pos").alias("function_pos"), "rules", "reference")
    new = claims.where("fate = 'new'").select("spec_id", "side", "pos", "name", F.lit(True).alias("added"), F.col("exercise_pos").cast("long").alias("from_pos"), "function_pos", "rules", "reference")
    fill = claims.where("fate = 'held'").select("spec_id", "side", "pos", "name", F.col("rules").alias("more_rules"), F.col("reference").alias("more_reference"))
    functions = whole.unionByName(new).join(fill, ["spec_id", "side", "pos", "name"], "left")
    functions = functions.withColumn("rules", F.when(_some("rules"), F.col("rules")).otherwise(F.coalesce("more_rules", "rules"))).withColumn("reference", F.coalesce("reference", "more_reference"))
    order = Window.partitionBy("spec_id", "side", "pos").orderBy("added", "from_pos", "function_pos")
    functions = functions.select("spec_id", "side", F.col("pos").alias("exercise_pos"), F.row_number().over(order).alias("pos"), "name", "rules", "reference", "added")
    # Exercises: base's and added ones, then what each took.
    kept = new.where((F.col("side") == 1) & (F.col("from_pos") == F.col("pos"))).groupBy("spec_id", "pos").agg(F.lit(True).alias("has_kept"))
    own = other.exercises.join(ids, ["spec_id", "pos"]).join(kept, ["spec_id", "pos"], "left")
    kind = F.when((F.col("kind") == "functions") & F.col("has_kept").isNull(), F.when(F.col("script").isNotNull(), "script").otherwise("file")).otherwise(F.col("kind"))
    columns = ["spec_id", "side", "pos", "exercise_id", "file_path", "kind", "side_effects", "script", "constraints", "added"]
    first = base.exercises.withColumn("side", F.lit(0)).withColumn("added", F.lit(False)).withColumn("pos", F.col("pos").cast("long")).select(*columns)
    late = own.withColumn("exercise_id", F.col("new_id")).withColumn("kind", kind).withColumn("side", F.lit(1)).withColumn("added", F.lit(True)).withColumn("pos", F.col("pos").cast("long")).select(*columns)
    stand = first.unionByName(late)
    gained = new.where((F.col("side") == 0) | (F.col("from_pos") != F.col("pos"))).groupBy("spec_id", "side", "pos").agg(F.lit(True).alias("gained"))
    taken = goes.where(~_itself()).join(other.exercises.select("spec_id", F.col("pos").alias("exercise_pos"), F.col("script").alias("more"), F.col("constraints").alias("more_constraints")), ["spec_id", "exercise_pos"]).select("spec_id", "side", "pos", "more", "more_constraints")
    stand = stand.join(gained, ["spec_id", "side", "pos"], "left").join(taken, ["spec_id", "side", "pos"], "left")
    becomes = F.when(F.col("kind") != "file", F.lit(None)).when(F.col("gained"), "functions").when(F.col("script").isNull() & F.col("more").isNotNull(), "script")
    pick = lambda c: F.when(_some(f"script.{c}"), F.col(f"script.{c}")).otherwise(F.coalesce(f"more.{c}", f"script.{c}")).alias(c)
    script = F.when(F.col("script").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("script")).otherwise(F.struct(pick("prompts"), pick("required_outputs")))
    exercises = stand.select("spec_id", "side", "pos", "exercise_id", "file_path", F.coalesce(becomes, F.col("kind")).alias("kind"), F.coalesce(becomes == "script", F.col("side_effects")).alias("side_effects"), script.alias("script"), F.coalesce("constraints", "more_constraints").alias("constraints"), "added")
    # Tests.
    had = base.tests.select("spec_id", F.lit(0).alias("side"), F.col("exercise_pos").cast("long").alias("pos"), F.col("function").alias("name"), F.col("pos").alias("test_pos"), "test_id", "call")
    offered = other.tests.select("spec_id", "exercise_pos", F.col("function").alias("name"), F.col("pos").alias("test_pos"), "call")
    of_functions = offered.join(claims.select("spec_id", "exercise_pos", "name", "side", "pos", "fate"), ["spec_id", "exercise_pos", "name"])
    brought = of_functions.where("fate = 'new'").drop("fate")
    known = had.where("name IS NOT NULL").select("spec_id", "side", "pos", "name", "call").unionByName(brought.select("spec_id", "side", "pos", "name", "call")).distinct()
    unique = F.row_number().over(Window.partitionBy("spec_id", "side", "pos", "name", "call").orderBy("test_pos"))
    extra = of_functions.where("fate = 'held'").drop("fate").withColumn("turn", unique).where("turn = 1").drop("turn").join(known, ["spec_id", "side", "pos", "name", "call"], "left_anti")
    scripts = other.exercises.where("script IS NOT NULL").select("spec_id", F.col("pos").alias("exercise_pos"))
    of_scripts = offered.where("name IS NULL").join(scripts, ["spec_id", "exercise_pos"]).join(goes, ["spec_id", "exercise_pos"])
    own_scripts = of_scripts.where(_itself())
    tested = had.where("name IS NULL").select("spec_id", "side", "pos").unionByName(own_scripts.select("spec_id", "side", "pos")).distinct()
    of_scripts = own_scripts.unionByName(of_scripts.where(~_itself()).join(tested, ["spec_id", "side", "pos"], "left_anti"))
    more = brought.unionByName(extra, allowMissingColumns=True).unionByName(of_scripts, allowMissingColumns=True)
    named = base.exercises.select("spec_id", F.lit(0).alias("side"), F.col("pos").cast("long").alias("pos"), "exercise_id").unionByName(ids.select("spec_id", F.lit(1).alias("side"), "pos", F.col("new_id").alias("exercise_id")))
    more = more.join(named, ["spec_id", "side", "pos"]).withColumn("prefix", F.when(F.col("name").isNull(), F.concat("exercise_id", F.lit("#session"))).otherwise(F.concat("name", F.lit("#ex"))))
    claimed = more.withColumnRenamed("pos", "into_pos").withColumn("pos", F.struct("exercise_pos", "test_pos"))
    numbered = free_numbers(claimed, base.tests.select("spec_id", "test_id")).select("spec_id", "side", F.col("into_pos").alias("pos"), "name", "exercise_pos", "test_pos", "test_id", "call", F.lit(True).alias("added"))
    every = had.withColumn("added", F.lit(False)).withColumn("exercise_pos", F.col("pos")).unionByName(numbered)
    order = Window.partitionBy("spec_id", "side", "pos", "name").orderBy("added", "exercise_pos", "test_pos")
    tests = every.withColumn("place", F.row_number().over(order)).select("spec_id", "side", F.col("pos").alias("exercise_pos"), F.col("name").alias("function"), F.col("place").alias("pos"), "test_id", "call", "added")
    return Spec(exercises, functions, tests)


def merged_files(base: DataFrame, other: DataFrame) -> DataFrame:
    """(spec_id, pos, path, ..., added): base's entries in order, then other's whose path base lacks, the first of a path."""
    absent = other.join(base.select("spec_id", "path").distinct(), ["spec_id", "path"], "left_anti")
    once = absent.withColumn("turn", F.row_number().over(Window.partitionBy("spec_id", "path").orderBy("pos"))).where("turn = 1").drop("turn")
    return base.withColumn("added", F.lit(False)).unionByName(once.withColumn("added", F.lit(True)))


def merged_globals(base: DataFrame, other: DataFrame) -> DataFrame:
    """(spec_id, allowed_builtins, allowed_imports, forbidden_builtins, forbidden_imports, forbidden_methods), one row a spec: lists of
    what is allowed stand unless null, lists of what is forbidden are followed by what the other adds."""
    allowed, forbidden = ["allowed_builtins", "allowed_imports"], ["forbidden_builtins", "forbidden_imports", "forbidden_methods"]
    both = base.select("spec_id", *allowed, *forbidden).join(other.select("spec_id", *[F.col(c).alias("more_" + c) for c in allowed + forbidden]), "spec_id", "full")
    nothing = F.expr("cast(array() as array<string>)")
    had = lambda c: F.coalesce(c, nothing)
    joined = [F.concat(had(c), F.array_except(had("more_" + c), had(c))).alias(c) for c in forbidden]
    return both.select("spec_id", *[F.coalesce(c, "more_" + c).alias(c) for c in allowed], *joined)
