"""Grounding against a search by loops over the text without white space."""

import html
import random

import pytest
from marksheet.operators import grounding as G
from pyspark.sql import functions as F


class Plain:
    """Each character that counts, with where it came from."""

    def __init__(self, text):
        self.text, self.chars = text, []
        for i, c in enumerate(text.replace("=>", "->")):
            self.chars += [(x, i) for x in self.signs(c)]
        self.line = "".join(c for c, _ in self.chars)

    @staticmethod
    def signs(c):
        if c.isspace() or c in G.DROPPED:
            return ""
        return "'" if c in G.QUOTES else "->" if c in G.ARROWS else "-" if c in G.DASHES else "..." if c == "…" else c

    @classmethod
    def short(cls, phrase):
        return "".join(cls.signs(c) for c in html.unescape(phrase).replace("=>", "->"))

    def whole(self, at, n):
        a, b = self.chars[at][1], self.chars[at + n - 1][1] + 1
        before, after = self.text[max(0, a - 2) : a], self.text[b : b + 2]
        word = lambda c: c.isalnum() or c == "_"
        head, tail = self.line[at], self.line[at + n - 1]
        cuts = (word(head) and before and word(before[-1])) or (head.isdigit() and len(before) == 2 and before[0].isdigit() and before[1] == ".")
        return not (cuts or (word(tail) and after and word(after[0])) or (tail.isdigit() and len(after) == 2 and after[0] == "." and after[1].isdigit()))

    def all(self, phrase, bounded=True, start=0, end=None):
        n = self.short(phrase)
        end = len(self.line) if end is None else min(end, len(self.line))
        return [p for p in range(start, end - len(n) + 1) if self.line[p : p + len(n)] == n and (not bounded or self.whole(p, len(n)))] if n else []

    def find(self, kind, phrases):
        """The line of the hit and which phrase it was."""
        hit = None
        if kind == "first":
            hit = next(((p, k) for k, n in enumerate(phrases) for p in self.all(n)[:1]), None)
        elif kind == "pair":
            a, v = phrases
            hit = next(((p, 0) for p in self.all(a) if self.all(v, True, p, p + G.PAIR_WINDOW + 2 * len(v))), None)
        elif kind == "otherwise":
            hit = next(((p, 0) for p in self.all(phrases[0]) if any(w in self.line[max(0, p - 60) : p].lower() for w in G.OTHERWISE_WORDS)), None)
        else:
            phrases = [p for p in phrases if p.strip()]
            for start in self.all(phrases[0], False) if phrases else ():
                at = start
                for n in phrases[1:]:
                    later = self.all(n, False, at + 1)
                    if not later:
                        break
                    at = later[0]
                else:
                    hit = (start, 0)
                    break
        return (self.text[: self.chars[hit[0]][1]].count("\n") + 1, hit[1]) if hit else None


ITEM = "subject_id int, item_id int, kind string, phrases array<string>, provenance string, line int, confidence double"


def found(spark, texts, items):
    rows = spark.createDataFrame([(s, k, kind, phrases, "ai_extracted", None, 0.7) for k, (s, kind, phrases) in enumerate(items)], ITEM)
    got = G.ground_items(rows, spark.createDataFrame(list(enumerate(texts)), "subject_id int, text string")).collect()
    return {r.item_id: None if r.place is None else (r.found_line, r.found_phrase) for r in got}


TEXT = 'Write def is_safe( temp ) .\nIt returns "Too hot" when temp > 273.15 → True,\notherwise it returns ‘ok’.\nUse abs( 1,2 ) => 3 … and exec_all.\nEnter a number:  \nThen: Bye 15.'


@pytest.mark.parametrize(("kind", "phrases", "want"), [
    ("first", ["def is_safe("], (1, 0)), ("first", ["is_saf"], None), ("first", ["nowhere", "exec_all"], (4, 1)), ("first", ["273"], None), ("first", ["15"], (6, 0)), ("first", ["273.15"], (2, 0)), ("first", ["abs(1, 2) -&gt; 3 ..."], (4, 0)),
    ("first", ["'Too  hot'"], (2, 0)), ("first", [""], None), ("first", ["exec"], None), ("pair", ["temp > 273.15", "True"], (2, 0)), ("pair", ["temp", '"ok"'], (1, 0)), ("pair", ["Bye", "True"], None), ("pair", ["temp", "temp"], (1, 0)),
    ("otherwise", ["'ok'"], (3, 0)), ("otherwise", ["True"], None), ("otherwise", ["3"], (4, 0)), ("sequence", ["Enter a number:", " ", "Bye"], (5, 0)), ("sequence", ["Bye", "Enter"], None), ("sequence", [" "], None), ("sequence", ["e", "e", "e"], (1, 0)),
])
def test_phrases(spark, kind, phrases, want):
    assert Plain(TEXT).find(kind, phrases) == want
    assert found(spark, [TEXT], [(0, kind, phrases)])[0] == want


def test_random_texts(spark):
    rng = random.Random(6)
    bits = ["else", "a", "b1", "1", ".", "2", " ", " ", "\n", "'", "“", "→", "->", "=>", "…", "(", ")", "x_y", "-", "–", "é", "​", "`", "\\", "[", "+", "Other", " ", "$", "日"]
    say = lambda n: "".join(rng.choice(bits) for _ in range(n))
    texts = [say(rng.choice([0, 5, 40, 300])) for _ in range(30)] + [f"a {'x ' * n}b1" for n in (398, 399, 400, 401, 402, 410)] + [f"else {'x ' * n}b1" for n in (54, 55, 56, 57, 58)] + [None]
    items = [(i, "pair", ["a", "b1"]) for i in range(30, 36)] + [(i, "otherwise", ["b1"]) for i in range(36, 41)] + [(41, "first", ["a"]), (77, "first", ["a"])]
    for _ in range(700):
        s = rng.randrange(30)
        cut = lambda s=s: texts[s][(a := rng.randrange(max(1, len(texts[s])))) : a + rng.randint(1, 5)] if rng.random() < 0.8 else say(2)
        kind = rng.choice(["first", "pair", "otherwise", "sequence"])
        items.append((s, kind, [cut() for _ in range({"first": 2, "pair": 2, "otherwise": 1}.get(kind, 3))]))
    got = found(spark, texts, items)
    for k, (s, kind, phrases) in enumerate(items):
        want = Plain(texts[s]).find(kind, phrases) if s < 41 and texts[s] else None
        assert got[k] == want, (kind, phrases, texts[s])
    assert sum(x is not None for x in got.values()) > 200


def test_what_becomes_of_items(spark):
    rows = [(0, 0, "first", ["Bye"], "ai_extracted", None, 0.7), (0, 1, "first", ["nope", "Bye"], "explicit", None, 1.0), (0, 2, "first", ["nope"], "explicit", None, 1.0), (0, 3, "first", ["nope"], "explicit", 4, 1.0), (0, 4, "first", ["nope"], "user", None, 0.3), (0, 5, "first", ["nope"], "ai_extracted", None, 0.2)]
    got = G.ground_items(spark.createDataFrame(rows, ITEM), spark.createDataFrame([(0, TEXT)], "subject_id int, text string")).collect()
    assert {r.item_id: (r.checked, r.provenance, r.confidence, r.line) for r in got} == {
        0: (True, "explicit", 0.9, 6), 1: (True, "explicit", 0.8, 6), 2: (True, "ai_extracted", 0.6, None), 3: (False, "explicit", 1.0, 4), 4: (False, "user", 0.3, None), 5: (True, "ai_extracted", 0.2, None),
    }
    assert spark.range(1).select(G.compact(F.lit(" a &lt;b&gt; “c” ⇒ d "))).first()[0] == "a<b>'c'->d"
