"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, all else is lower-cased; windows of WINDOW such tokens of the
benchmark are hash-joined with those of the documents, and so are windows of the plain tokens (lower-cased, nothing
replaced). Windows of a document and an item that lie on one diagonal belong together. Templates count if half of
their tokens at least are literal and the values in their slots map consistently (each value of the item to one value
in the document), so a re-parameterised question is found and an accidental template isn't. Equal plain windows always
count: they find copies that are mostly numbers, and those whose first word or case reads as a name elsewhere.

A hit needs enough of the item in one neighbourhood of the document (diagonals that differ by little, as words put in or
left out give), see needed: short items whole or nearly so, as a common phrase can be most of them. What plain windows
alone don't reach also needs MIN_LITERAL different literal tokens.

Defined results: null and empty texts and items match nothing; an item with fewer tokens than a window is matched
whole from MIN_TOKENS tokens on; rows are told apart by id and text, so a doc_id or item_id that is null or repeated is
matched like any other, each of its texts for itself; equal hits are given once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .textbuf import RUN_BYTES, Run, Words, mix, runs, word_hashes, words

WINDOW, MIN_TOKENS, MIN_COVER = 6, 3, 0.4
#: Of short items, this share up to so many tokens has to be covered, and always more than one window or the whole item.
SHORT_COVER, SHORT_TOKENS, MIN_LITERAL = 0.8, 12, 4
#: Diagonals that differ by so many tokens, or by this share of the item if that is more, are one neighbourhood.
NEAR, NEAR_SHARE = 8, 0.25
#: Up to so many window hashes of the benchmark (8 bytes each) go to every task; beyond, all windows are shuffled.
MAX_BROADCAST = 4_000_000

#: Numbers in words, and units, which count after a number; English, French, German and Spanish. Words that are
#: common as something else (articles, "in", "on") are left out but for units, which stand after numbers alone.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille millions milliard milliards demi "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones"
).split()
UNIT_WORDS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years hz khz mhz ghz w kw kwh v volts amps j joule joules cal kcal pa kpa bar "
    "dollar dollars cent cents euro euros usd eur gbp percent percentage degree degrees kmh mph bytes kb mb gb tb "
    "mètre mètres kilomètre kilomètres gramme grammes kilo kilos tonne tonnes seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés "
    "meter metern kilometer kilometern gramm kilogramm tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad prozent "
    "metro metros kilómetro kilómetros gramo gramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados dólar dólares"
).split()
NUM, NAME, UNIT = np.uint64(0x1111111111111111), np.uint64(0x2222222222222222), np.uint64(0x3333333333333333)

_DIGIT, _UPPER, _LETTER, _STOP, _TRIM = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = _UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP[list(b".!?:;\"|*")] = True
_TRIM[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _hashes_of(strings: list[str]) -> np.ndarray:
    data = " ".join(strings).encode()
    buf, offs = np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64)
    return np.sort(word_hashes(buf, words(buf, offs)))


class Lexicon:
    """The words that count as numbers, and as units after a number, in small letters."""

    def __init__(self, numbers: Iterable[str] = NUMBER_WORDS, units: Iterable[str] = UNIT_WORDS) -> None:
        self.numbers, self.units = _hashes_of(sorted(set(numbers))), _hashes_of(sorted(set(units)))


LEXICON = Lexicon()


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h if len(known) else np.zeros(len(h), bool)


def canonical(run: Run, lexicon: Lexicon = LEXICON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with placeholders, hashes of the words as they stand, and each text's first token."""
    data, w = run.data, words(run.data, run.offsets)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(run.offsets), np.int64)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(6):
        start += (start < end) & _TRIM[data[np.minimum(start, len(data) - 1)]]
        end -= (start < end) & _TRIM[data[np.maximum(end - 1, 0)]]
    kept = start < end
    # A name: a capital, then not a capital, where no sentence or line begins.
    last = np.append(True, _STOP[data[w.end[:-1] - 1]])
    newline = np.append(np.int32(0), np.cumsum(data == 10, dtype=np.int32))
    begins = last | np.append(True, newline[w.start[1:]] > newline[w.end[:-1]]) | np.append(True, w.doc[1:] != w.doc[:-1])
    first, second = data[np.minimum(start, len(data) - 1)], data[np.minimum(start + 1, len(data) - 1)]
    accent = (first == 0xC3) & (second >= 0x80) & (second < 0x9F)
    third = np.where(accent, data[np.minimum(start + 2, len(data) - 1)], second)
    longer = end - start > 1 + accent
    is_name = (_UPPER[first] | accent) & longer & ~_UPPER[third] & ~((third == 0xC3) & accent) & ~begins
    digits = np.append(np.int32(0), np.cumsum(_DIGIT[data], dtype=np.int32))
    is_number = _DIGIT[first] | (digits[end] - digits[start] > 0) & ~_LETTER[first]
    start, end = start[kept], end[kept]
    core = Words(start, end, w.doc[kept], np.searchsorted(start, run.offsets, "left"))
    masked = data.copy()  # what was trimmed counts as a gap, so that words are hashed without it
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    masked[np.cumsum(inside[:-1], dtype=np.int8) == 0] = 32
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1
    masked[capital] += 0x20  # accented Latin capitals count as small letters, as A-Z do
    plain = word_hashes(masked, core)
    is_number = is_number[kept] | _among(plain, lexicon.numbers)
    after = np.append(False, is_number[:-1]) & np.append(False, core.doc[1:] == core.doc[:-1])
    is_unit = after & ~is_number & _among(plain, lexicon.units)
    token = np.where(is_number, NUM, np.where(is_unit, UNIT, np.where(is_name[kept], NAME, plain)))
    return token, plain, core.first


WINDOWS = "h long, exact boolean, pos int, tokens array<long>, plain array<long>"


def _windows(batches: Iterable[pa.RecordBatch], key: list[str], sizes: list[int], wanted: np.ndarray | None, per_item: bool, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """A row for each window (of items: of one size that fits; of documents: of each size) that is wanted, as a template and as it stands."""
    for run in runs(batches, "text", RUN_BYTES // 2):
        token, plain, first = canonical(run, lexicon)
        literal = ~((token == NUM) | (token == NAME) | (token == UNIT))
        lit = np.append(0, np.cumsum(literal))
        n = np.diff(first)
        for size in sizes:
            if len(token) < size:
                continue
            total = len(token) - size + 1
            doc = np.searchsorted(first, np.arange(total), "right") - 1
            whole = np.arange(total) + size <= first[doc + 1]
            if per_item:
                whole &= np.minimum(n[doc], WINDOW) == size
            for exact, source in ((False, token), (True, plain)):
                rolled = np.full(total, size + 1000 * exact, np.uint64)
                for j in range(size):
                    rolled = mix(rolled * np.uint64(3) + source[j : j + total])
                fine = whole if exact else whole & ((lit[size:] - lit[:-size]) * 2 >= size)
                if wanted is not None:
                    fine = fine & _among(rolled, wanted)
                at = np.flatnonzero(fine)
                for k in range(0, len(at), 20_000):
                    part = at[k : k + 20_000]
                    grid = part[:, None] + np.arange(size)
                    lists = lambda x, n=len(part): pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(x.ravel().view(np.int64)))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [*(run.rows.column(c).take(pa.array(doc[part])) for c in range(len(key))), pa.array(rolled[part].view(np.int64)), pa.array(np.full(len(part), exact)), pa.array((part - first[doc[part]]).astype(np.int32)), lists(token[grid]), lists(plain[grid]), pa.array(n[doc[part]].astype(np.int32))],
                        names=[*key, "h", "exact", "pos", "tokens", "plain", "n"],
                    )


def needed(n: Column, min_cover: float) -> Column:
    """Tokens of an item of n that have to be covered; never less for a longer item."""
    return F.greatest(F.ceil(n * F.lit(min_cover)), F.least(F.ceil(n * F.lit(SHORT_COVER)), F.lit(SHORT_TOKENS)), F.least(n, F.lit(WINDOW + 1)))


#: What tells rows apart: the id, which may be null or repeated, and two hashes of the text.
DOC, ITEM = (["doc_id", "doc_a", "doc_b"], ["item_id", "item_a", "item_b"])


def _keyed(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(key[0], F.xxhash64("text").alias(key[1]), F.xxhash64(F.lit(7), F.col("text")).alias(key[2]), "text")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER, lexicon: Lexicon = LEXICON) -> DataFrame:
    """Like find_contaminated, with the columns DOC and ITEM: a row for each pair of a document's and an item's text."""
    sizes = list(range(MIN_TOKENS, WINDOW + 1))
    schema = f"{WINDOWS}, n int"
    kinds = lambda key: "".join(f"{k} long, " for k in key)
    items = materialise(_keyed(benchmark, ITEM).mapInArrow(lambda b: _windows(b, ITEM, sizes, None, True, lexicon), kinds(ITEM) + schema), "benchmark-windows")
    present = [r.size for r in items.select(F.size("tokens").alias("size")).distinct().collect()]
    hashes = items.select("h").distinct()
    wanted = None
    if hashes.count() <= MAX_BROADCAST:
        wanted = np.sort(np.array([r.h for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
    found = _keyed(docs, DOC).mapInArrow(lambda b: _windows(b, DOC, sorted(present), wanted, False, lexicon), kinds(DOC) + schema)
    a, b = found.drop("n").alias("a"), items.alias("b")
    same = (F.col("a.exact") == F.col("b.exact")) & F.when(F.col("b.exact"), F.col("a.plain") == F.col("b.plain")).otherwise(F.col("a.tokens") == F.col("b.tokens"))
    placeholders = [int(x.view(np.int64)) for x in (NUM, NAME, UNIT)]
    slots = F.filter(F.transform(F.sequence(F.lit(1), F.size("b.tokens")), lambda i: F.struct(F.element_at("b.tokens", i).alias("t"), F.element_at("b.plain", i).alias("was"), F.element_at("a.plain", i).alias("now"))), lambda s: s["t"].isin(*placeholders))
    # What stands at each place that a window covers; null for the slots of a template.
    literal = F.when(F.col("b.exact"), F.col("b.plain")).otherwise(F.transform("b.tokens", lambda t: F.when(~t.isin(*placeholders), t)))
    span = F.transform(literal, lambda t, i: F.struct((F.col("b.pos") + i).alias("place"), t.alias("literal")))
    hit = a.join(b, (F.col("a.h") == F.col("b.h")) & same).select(*[f"a.{k}" for k in DOC], *[f"b.{k}" for k in ITEM], "b.n", "b.exact", (F.col("a.pos") - F.col("b.pos")).alias("diagonal"), span.alias("span"), F.transform(slots, lambda s: F.struct(s["was"], s["now"])).alias("slots"))
    # A diagonal of a pair has at most as many rows of a kind as the item has windows.
    one = hit.groupBy(*DOC, *ITEM, "n", "diagonal", "exact").agg(F.collect_set("span").alias("spans"), F.collect_set("slots").alias("slots"))
    pairs = F.array_distinct(F.flatten("slots"))
    consistent = F.size(F.array_distinct(F.transform(pairs, lambda s: s["was"]))) == F.size(pairs)
    reworded = ~F.col("exact") & F.exists(pairs, lambda s: s["was"] != s["now"])
    # Parts of an item on near diagonals count together: each diagonal is in two overlapping neighbourhoods of twice NEAR,
    # so any two that differ by NEAR at most share one.
    near = F.greatest(F.lit(NEAR), F.floor(F.col("n") * F.lit(NEAR_SHARE)))
    area = F.floor(F.col("diagonal") / (near + 1))
    placed = one.where(F.col("exact") | consistent).select(*DOC, *ITEM, "n", "exact", reworded.alias("reworded"), F.explode(F.array(area - 1, area)).alias("area"), F.array_distinct(F.flatten("spans")).alias("span"))
    placed = placed.select("*", F.explode("span").alias("at"))
    cover = placed.groupBy(*DOC, *ITEM, "n", "area").agg(
        F.size(F.collect_set("at.place")).alias("covered"), F.size(F.collect_set(F.when(F.col("exact"), F.col("at.place")))).alias("as_is"), F.size(F.collect_set("at.literal")).alias("literals"), F.max("reworded").alias("reworded")
    )
    need = needed(F.col("n"), min_cover)
    enough = cover.where((F.col("covered") >= need) & ((F.col("as_is") >= need) | (F.col("literals") >= MIN_LITERAL)))
    best = enough.groupBy(*DOC, *ITEM, "n").agg(F.max(F.struct("covered", (~F.col("reworded")).alias("same"))).alias("best"))
    return best.select(*DOC, *ITEM, F.col("best.covered").cast("int").alias("covered"), F.col("n").alias("item_tokens"), (~F.col("best.same")).alias("reworded"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER, lexicon: Lexicon = LEXICON) -> DataFrame:
    """docs(doc_id, text, ...) and benchmark(item_id, text, ...) to pairs (doc_id, item_id, covered, item_tokens, reworded).

    covered: tokens of the item in windows that match in the best neighbourhood; reworded: some slot of a template that counts has another value."""
    return contaminated_rows(docs, benchmark, min_cover, lexicon).select("doc_id", "item_id", "covered", "item_tokens", "reworded").distinct()
