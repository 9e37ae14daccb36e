"""Names that were nearly written: the candidate most like a name, if it is like enough.

Likeness is difflib's ratio of the lower-cased names, twice the matched characters over all characters. Pairs are found by an
equality join on the lengths that can still reach the cutoff; then the characters that both have, order aside, bound the
ratio from above; what is left is compared exactly. Both bounds only ever drop pairs below the cutoff.

A name that differs in case alone is alike in full. Of candidates that are as like, the one greatest in lower case counts, and
of those that differ in case alone, the first. Null names and candidates take no part.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Least likeness of functions, and of files.
FUNCTION_CUTOFF, FILE_CUTOFF = 0.8, 0.75


def _bound(shared: Column, a: Column, b: Column) -> Column:
    """The ratio if so many characters match; two empty names are alike."""
    return F.when(F.length(a) + F.length(b) > 0, 2.0 * shared / (F.length(a) + F.length(b))).otherwise(1.0)


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters both have, order aside."""
    often = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(often(a, c), often(b, c)))


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """difflib's ratio of a candidate and a name, a pair at a time; the name's table is kept while it stays the same."""
    matcher = difflib.SequenceMatcher(None, "", "")
    for candidates, names in pairs:
        out = []
        for candidate, name in zip(candidates, names, strict=True):
            if name != matcher.b:
                matcher.set_seq2(name)
            matcher.set_seq1(candidate)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def candidate_pairs(names: DataFrame, candidates: DataFrame, cutoff: float) -> DataFrame:
    """names(group_id, name) and candidates(group_id, candidate, pos) to the pairs that both bounds let through, in lower case:
    (group_id, name, low, other, candidate)."""
    low = lambda c: F.lower(F.col(c))
    known = candidates.where("candidate is not null").groupBy("group_id", low("candidate").alias("other")).agg(F.min_by("candidate", "pos").alias("candidate"))
    asked = names.where("name is not null").select("group_id", "name", low("name").alias("low")).distinct()
    n = F.length("low")
    # One more on either side, for the rounding of the quotient; the bound itself is tested as it is defined.
    sizes = F.sequence(F.greatest(F.floor(n * cutoff / (2 - cutoff)) - 1, F.lit(0)), F.ceil(n * (2 - cutoff) / cutoff) + 1)
    rows = asked.select("*", F.explode(sizes).alias("size")).join(known.withColumn("size", F.length("other").cast("long")), ["group_id", "size"])
    a, b = F.col("low"), F.col("other")
    near = (_bound(F.least(F.length(a), F.length(b)), a, b) >= cutoff) & (_bound(shared_characters(a, b), a, b) >= cutoff)
    return rows.where(near).drop("size")


def near_misses(names: DataFrame, candidates: DataFrame, cutoff: float = FUNCTION_CUTOFF) -> DataFrame:
    """Each name of names(group_id, name) that has a likely candidate: (group_id, name, candidate, likeness)."""
    pairs = candidate_pairs(names, candidates, cutoff).withColumn("likeness", F.when(F.col("low") == F.col("other"), 1.0).otherwise(_ratio("other", "low")))
    best = pairs.where(F.col("likeness") >= cutoff).groupBy("group_id", "name").agg(F.max(F.struct("likeness", "other", "candidate")).alias("best"))
    return best.select("group_id", "name", "best.candidate", "best.likeness")


def similar_files(requirements: DataFrame, tree: DataFrame) -> DataFrame:
    """Of requirements(project_id, path, kind), those for which tree(project_id, path, kind) has a file of a similar name and, if the
    name has one, the same ending: (project_id, path, kind, similar, likeness). Of paths of one name the smallest counts."""
    base = F.substring_index("path", "/", -1)
    ending = F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1))
    keys = F.filter(F.array(F.lit("*"), F.concat(F.lit("."), ending)), lambda k: k.isNotNull())
    group = lambda key: F.struct("project_id", "kind", key.alias("ending")).alias("group_id")
    wanted = requirements.select("path", F.coalesce(F.concat(F.lit("."), ending), F.lit("*")).alias("key"), "project_id", "kind", base.alias("name"))
    have = tree.select("project_id", "kind", "path", base.alias("base"), F.explode(keys).alias("key"))
    have = have.groupBy("project_id", "kind", "key", F.lower("base").alias("low")).agg(F.min("path").alias("path"))
    found = near_misses(wanted.select(group(F.col("key")), "name"), have.select(group(F.col("key")), F.substring_index("path", "/", -1).alias("candidate"), F.col("path").alias("pos")), FILE_CUTOFF)
    found = found.select("group_id.*", "name", F.lower("candidate").alias("low"), "likeness").withColumnRenamed("ending", "key")
    named = wanted.join(found, ["project_id", "kind", "key", "name"]).join(have.withColumnRenamed("path", "similar"), ["project_id", "kind", "key", "low"])
    return named.select("project_id", "path", "kind", "similar", "likeness")
