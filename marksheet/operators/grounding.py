"""Whether what a spec claims stands in its subject's text, and on which line.

Texts are compared without white space and with one form of quotes, arrows, dashes and ellipses. Signs are put into that
form first; then a phrase becomes a pattern that lets white space stand between any of its characters, and the pattern is
matched against the text itself, so a place found is a place of the text and no table of offsets is needed. Patterns that
are bounded neither begin nor end inside a word or a number, so 15 isn't found in 273.15.

All of it are column expressions: a subject's text is joined to its items by id and never collected.

A null text has no phrase; an empty phrase is found nowhere; items of a subject without text are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of what is found, found in part and not found; characters within which the value of a pair
#: follows, and within which a word for "otherwise" comes before.
GROUNDED, PARTIAL, UNGROUNDED, PAIR_WINDOW, OTHERWISE_WINDOW = 0.9, 0.8, 0.6, 400, 60
#: Words for "otherwise".
OTHERWISE_WORDS = ("otherwise", "else", "sinon", "default", "défaut", "autrement", "other")
#: Signs of one form; what is dropped besides white space.
QUOTES, ARROWS, DASHES, DROPPED = "'\"‘’‚‛“”„‟«»′″", "→⟶⇒➜➔⟹", "−–", "`\u200b\u200c\u200d\ufeff"
#: Entities that phrases are read with.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

_SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}"
_GAP, _SIGN = f"[{_SPACE}{DROPPED}]", f"[^{_SPACE}{DROPPED}]"
_WORD = r"[\p{L}\p{N}_]"


def one_form(text: Column) -> Column:
    """The text with signs in one form; white space stays, so lines do."""
    out = F.replace(text, F.lit("=>"), F.lit("->"))
    out = F.translate(out, QUOTES + DASHES, "'" * len(QUOTES) + "-" * len(DASHES))
    return F.replace(F.regexp_replace(out, f"[{ARROWS}]", "->"), F.lit("…"), F.lit("..."))


def compact(phrase: Column) -> Column:
    """A phrase in one form, with entities read and without white space."""
    for name, sign in ENTITIES:
        phrase = F.replace(phrase, F.lit(name), F.lit(sign))
    return F.regexp_replace(one_form(phrase), f"{_GAP}+", "")


def phrase_pattern(phrase: Column, bounded: bool = True) -> Column:
    """A pattern that finds the phrase in a text of one form; null for an empty one."""
    c = compact(phrase)
    body = F.regexp_replace(F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1"), r"(\\?+[\s\S])(?=[\s\S])", "$1" + _GAP.replace("\\", "\\\\") + "*")
    if bounded:
        head, tail = F.regexp_extract(c, r"\A[\s\S]", 0), F.regexp_extract(c, r"[\s\S]\z", 0)
        before = F.concat(F.when(head.rlike(_WORD), rf"(?<!{_WORD})").otherwise(""), F.when(head.rlike(r"\p{Nd}"), r"(?<!\p{Nd}\.)").otherwise(""))
        after = F.concat(F.when(tail.rlike(_WORD), rf"(?!{_WORD})").otherwise(""), F.when(tail.rlike(r"\p{Nd}"), r"(?!\.\p{Nd})").otherwise(""))
        body = F.concat(before, body, after)
    return F.when(c != "", body)


def _up_to(n: Column) -> Column:
    """A pattern of n characters at most, as few as will do."""
    return F.concat(F.lit(f"(?:{_SIGN}{_GAP}*){{0,"), F.greatest(n, F.lit(0)).cast("string"), F.lit("}?"))


def pair_pattern(anchor: Column, value: Column) -> Column:
    """The anchor where the value follows within PAIR_WINDOW characters of its beginning."""
    room = F.lit(PAIR_WINDOW) + 2 * F.length(value) - F.length(compact(value))
    return F.concat(F.lit("(?="), phrase_pattern(anchor), F.lit(")"), _up_to(room), phrase_pattern(value))


def otherwise_pattern(value: Column) -> Column:
    """A word for otherwise, in any case, with the value after it; the value is what comes last."""
    spaced = lambda w: f"{_GAP}*".join(w)
    words = [F.concat(F.lit(f"(?iu:{spaced(w)}){_GAP}*"), _up_to(F.lit(OTHERWISE_WINDOW - len(w)))) for w in OTHERWISE_WORDS if w != "otherwise"]  # "other" begins it
    either = words[0]
    for w in words[1:]:
        either = F.concat(either, F.lit("|"), w)
    return F.concat(F.lit("(?:"), either, F.lit(")(?="), phrase_pattern(value), F.lit(")"))


def place(text: Column, pattern: Column) -> Column:
    """Where the pattern is first found, from 1; null where it isn't."""
    at = F.regexp_instr(text, pattern)
    return F.when(at > 0, at)


def place_of_sequence(text: Column, phrases: Column) -> Column:
    """Where the first of some phrases begins, if all stand in the text in that order; blank ones are left out.

    Each is looked for from one character after the last one's beginning; the first place of each leaves most room."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(True).alias("ok"))

    def step(s: Column, phrase: Column) -> Column:
        rest = F.substr(text, s["at"] + 1)
        at = F.coalesce(place(rest, phrase_pattern(phrase, bounded=False)), F.lit(0))
        at = F.when(s["ok"] & (at > 0), s["at"] + at).otherwise(0)
        return F.struct(at.alias("at"), F.when(s["first"] > 0, s["first"]).otherwise(at).alias("first"), (at > 0).alias("ok"))

    said = F.filter(phrases, lambda p: F.regexp_replace(p, f"[{_SPACE}]+", "") != "")
    got = F.aggregate(said, start, step)
    return F.when(got["ok"] & (F.size(said) > 0), got["first"])


def needs_grounding(provenance: Column, line: Column) -> Column:
    """What an extraction claims: found by a model, or said to be explicit without a line."""
    return F.coalesce((provenance == "ai_extracted") | ((provenance == "explicit") & line.isNull()), F.lit(False))


def ground_items(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """items(subject_id, item_id, kind, phrases array<string>, provenance, line, confidence) of subjects(subject_id, text).

    kind: first (the phrases are tried in order; a later one counts as a part), pair (an anchor and its value), otherwise (a
    value after a word for otherwise), sequence (all phrases in order). Adds checked, place (in the text of one form),
    found_line and found_phrase (from 0), and what becomes of provenance, confidence and line; items that need no grounding
    keep theirs."""
    rows = items.join(subjects.select("subject_id", one_form(F.col("text")).alias("whole")), "subject_id", "left")
    text, phrases = F.col("whole"), F.col("phrases")
    at = lambda n: F.try_element_at(phrases, F.lit(n))
    tried = F.transform(phrases, lambda p: place(text, phrase_pattern(p)))
    nth = F.array_position(F.transform(tried, lambda p: p.isNotNull()), True)
    after_word = otherwise_pattern(at(1))
    # The value stands right after what the pattern takes.
    lead = F.call_function("regexp_extract", text, F.concat(F.lit(r"\A[\s\S]*?"), after_word), F.lit(0))
    found = (
        F.when(F.col("kind") == "first", F.when(nth > 0, F.try_element_at(tried, nth.cast("int"))))
        .when(F.col("kind") == "pair", place(text, pair_pattern(at(1), at(2))))
        .when(F.col("kind") == "otherwise", F.when(place(text, after_word).isNotNull(), F.length(lead) + 1))
        .when(F.col("kind") == "sequence", place_of_sequence(text, phrases))
    )
    checked = needs_grounding(F.col("provenance"), F.col("line"))
    rows = rows.withColumn("checked", checked).withColumn("place", F.when(F.col("checked"), found)).withColumn("found_phrase", F.when(F.col("place").isNotNull(), F.when(F.col("kind") == "first", nth - 1).otherwise(0)).cast("int"))
    begin = F.substring(text, F.lit(1), F.col("place") - 1)
    rows = rows.withColumn("found_line", F.length(begin) - F.length(F.replace(begin, F.lit("\n"), F.lit(""))) + 1)
    here, some = F.col("place").isNotNull(), F.when(F.col("found_phrase") == 0, GROUNDED).otherwise(PARTIAL)
    return rows.select(
        *[c for c in items.columns if c not in ("provenance", "confidence", "line")], "checked", "place", "found_phrase", "found_line",
        F.when(~F.col("checked"), F.col("provenance")).when(here, "explicit").otherwise("ai_extracted").alias("provenance"),
        F.when(~F.col("checked"), F.col("confidence")).when(here, some).otherwise(F.least("confidence", F.lit(UNGROUNDED))).alias("confidence"),
        F.when(F.col("checked") & here, F.col("found_line")).otherwise(F.col("line")).alias("line"),
    )
