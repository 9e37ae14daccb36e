"""Fill-in-the-middle transformation: texts cut at unit boundaries and put in another order.

A unit grammar is translated to a regular expression of zero width: a boundary stands where a character of one class has
one of another class before it. Spark's split at it keeps every piece as it is, so the pieces joined are the text. The
empty text has no boundary and no piece; it is treated apart.

The cuts and the form of a document depend on its id and the seed alone, so an attempt that is repeated, or a run on
another cluster, gives the same output. A row is worked on for itself: nothing is shuffled, and what is held is a few
copies of one text.

Defined results: a null text counts as empty; a null doc_id is hashed as no digits; rows that repeat an id are cut by the
same numbers; a text that holds a mark stays plain, as the output could not be read back; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of those so many put the suffix first.
FIM_RATE, SPM_RATE = 50, 80

_SPACE = r"\x20\x09-\x0D"


class Grammar(NamedTuple):
    """Units of a text: what one looks like, and the pairs of classes (before, after) that a boundary stands between."""

    unit: str
    boundaries: tuple[tuple[str, str], ...]


#: A unit's pattern, matched again and again from the left, gives the pieces between the boundaries.
GRAMMARS = {
    "character": Grammar(r"[\s\S]", ((r"[\s\S]", r"[\s\S]"),)),
    "token": Grammar(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+", ((f"[^{_SPACE}]", f"[{_SPACE}]"),)),
    "run": Grammar(rf"[{_SPACE}]+|[^{_SPACE}]+", ((f"[^{_SPACE}]", f"[{_SPACE}]"), (f"[{_SPACE}]", f"[^{_SPACE}]"))),
    "line": Grammar(r"[^\n]*\n|[^\n]+", ((r"\n", r"[\s\S]"),)),
    "sentence": Grammar(rf"[{_SPACE}]*(?:(?![.!?][{_SPACE}])[\s\S])*(?:[.!?](?=[{_SPACE}])|(?=\Z))", ((r"[.!?]", f"[{_SPACE}]"),)),
}


def boundary(grammar: Grammar) -> str:
    """A pattern of zero width that matches at the grammar's boundaries."""
    return "|".join(f"(?<={before})(?={after})" for before, after in grammar.boundaries)


def units(text: Column, grammar: Grammar) -> Column:
    """The pieces of a text that isn't null; none if it is empty."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, boundary(grammar), -1))


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th of eight 32-bit numbers for an id, from 0."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, grammar: str = "token", seed: int = 42, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n, form, prefix_chars, middle_chars, output, text).

    n: units of the text; form: plain, psm (prefix, suffix, middle) or spm (suffix first); the numbers of code points of
    prefix and middle are null where the form is plain."""
    # Each step's columns are used more than once by the next, so the optimiser keeps the steps apart and works each out once.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", units(F.col("text"), GRAMMARS[grammar]).alias("pieces"), *[draw(F.col("doc_id"), seed, k).alias(f"h{k + 1}") for k in range(4)])
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= fim_rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("*", F.size("pieces").cast("long").alias("n"), form.alias("form"))
    one, other = ((F.col(h) % (F.col("n") + 1)).cast("int") for h in ("h1", "h2"))
    rows = rows.select("*", F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    part = lambda start, n: F.when(F.col("form") != "plain", F.array_join(F.slice("pieces", start + 1, n), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b - a).alias("middle"), part(b, F.col("n").cast("int") - b).alias("suffix"))
    p, s, m = (F.concat(F.lit(mark), F.col(name)) for mark, name in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"), "text")


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was written and its form. A mark can't arise where a piece and a mark meet."""
    after = lambda mark: F.substr(output, F.locate(mark, output) + F.lit(3))
    prefix = F.when(form == "psm", F.substring_index(after(PREFIX), SUFFIX, 1)).otherwise(F.substring_index(after(PREFIX), MIDDLE, 1))
    suffix = F.when(form == "psm", F.substring_index(after(SUFFIX), MIDDLE, 1)).otherwise(F.substring_index(after(SUFFIX), PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))


def digests(transformed: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of transform's rows."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
