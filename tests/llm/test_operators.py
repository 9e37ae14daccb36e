"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from gold_pages import GOLD
from pyspark.sql import functions as F

from marksheet.llm import bpe_replay, chat_format, decontaminate, language_id, main_text, permutation_index, quality_fm, shingle_join, token_table, warc_archive
from marksheet.llm.textbuf import runs

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, n int, h long, sig string"
LONG = " ".join(f"word{i % 977}x" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "One two.", "a  b\n c", "don't STOP  now ", "日本語 😀 é", "same text here now ok", "same text here now ok", LONG, "x" * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, 1, 2, "s") for i, t in enumerate(TEXTS)] + [(3, "One two.", None, 1, 2, "s")]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_token_table(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    table = token_table.write_token_table(docs, JSON, P.PATTERN)
    got = sorted(token_table.read_token_table(table).collect(), key=lambda r: (r.doc_id, r.start))
    at = 0
    for r in got:
        ids = [*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(TEXTS) + 1
    for row in table.manifest.collect():
        shard = token_table.open_shard(row.path)
        keys = [token_table.doc_id_of(k) for k, _ in shard.scan()]
        assert keys == sorted(keys) and all(len(shard.lookup(k)) == keys.count(k) for k in keys)
        assert shard.lookup(10**15) == [] and shard.lookup(-4) == []
    assert token_table.read_token_table(token_table.write_token_table(none, JSON, P.PATTERN)).count() == 0


def test_strings_of_added_tokens_are_read_as_the_library_does():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(JSON), token_table.PieceEncoder(JSON, P.PATTERN)
    end = "<|endoftext|>"
    texts = [end, f"a  {end} b", f"x{end}{end}y\n {end}", "<|endoftext", "plain  words 12ab d'accord's \x00\x7f é́ ǅ", "", "abc def", " "]
    texts += ["z" * (token_table.MEMO_CHARS + 5) + " " + "z" * (token_table.MEMO_CHARS + 5)]
    assert t.encode(end, add_special_tokens=False).ids == [50256]
    for _ in range(2):  # learned, then remembered
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_shard_with_null_negative_and_wide(tmp_path):
    fs = pafs.LocalFileSystem()
    path = str(tmp_path / "x.sst")
    with fs.open_output_stream(path) as sink:
        w = token_table.ShardWriter(sink)
        for d in (None, -5, 0, 7, 7, 2**40):
            w.add(token_table.key_of(d), np.array([70_000 if d == 7 else 1, 2], np.uint32))
        with pytest.raises(ValueError):
            w.add(token_table.key_of(3), np.zeros(0, np.uint32))
        w.close()
    s = token_table.Shard(fs.open_input_file(path))
    assert [token_table.doc_id_of(k) for k, _ in s.scan()] == [None, -5, 0, 7, 7, 2**40]
    assert [x.tolist() for x in s.lookup(7)] == [[70_000, 2]] * 2 and len(s.lookup(None)) == 1


def test_bpe_replay(spark, docs, none):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_replay.load_ranks(RANKS), special_tokens={})
    out = bpe_replay.encode_documents(docs, RANKS, P.PATTERN)
    for r in out.collect():
        text = TEXTS[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe_replay.decode_documents(out, RANKS).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe_replay.encode_documents(none, RANKS, P.PATTERN).count() == 0
    rng = random.Random(1)
    own = bpe_replay.codec(RANKS, P.PATTERN)
    odd = ["".join(rng.choice("ab'sé1²。!\n\t \x1c") for _ in range(120)) for _ in range(400)] + ["a" * 999, "abab" * 99]
    assert list(own.encode(odd)) == [enc.encode_ordinary(t) for t in odd]


@pytest.mark.parametrize("kept", [3, bpe_replay.MEMO_PIECES])
def test_known_words_are_not_replayed(monkeypatch, kept):
    """Words were replayed again with each mark beside them, and common ones whenever the memo was full."""
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_replay.load_ranks(RANKS), special_tokens={})
    own = bpe_replay.Codec(bpe_replay.load_ranks(RANKS), P.PATTERN)
    replayed, encode = [], own.replay.encode
    monkeypatch.setattr(own.replay, "encode", lambda words: replayed.extend(words) or encode(words))
    monkeypatch.setattr(bpe_replay, "MEMO_PIECES", kept)
    rng = random.Random(2)
    for k in range(40):
        texts = [f"the zebra{rng.choice(['', '.', ', '])} {rng.choice('abc')}{k}x the\n the {'y' * 70}{k}" for _ in range(3)]
        assert list(own.encode(texts)) == [enc.encode_ordinary(t) for t in texts]
    assert replayed.count(b" the") == 1 and replayed.count(b" " + b"y" * 70) == 40
    assert kept == 3 or replayed.count(b" zebra") == 1


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ids_do_not_depend_on_blocks(spark, docs):
    one, two = (bpe_replay.encode_documents(docs, RANKS, P.PATTERN, block_bytes=b).orderBy("doc_id").collect() for b in (40, bpe_replay.BLOCK_BYTES))
    assert one == two


@pytest.mark.parametrize("block", [1024, 8])
def test_shingle_join(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    passage = " ".join(f"common{i}" for i in range(50))
    for k in range(120):  # chains of edited copies, equal sets in other case, and a passage that many share
        base = " ".join(f"w{k % 3}_{i}" for i in range(70)).split() if k < 60 else " ".join(f"v{k}_{i}" for i in range(60)).split() + passage.split()
        for _ in range(rng.randint(0, 4) if k < 60 else 0):
            base[rng.randrange(len(base))] = f"e{rng.randrange(9)}"
        rows.append((100 + k, " ".join(base).upper() if k % 5 == 0 else " ".join(base)))
    df = spark.createDataFrame([(d, t, None, 1, 2, "s") for d, t in rows], DOC).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(df, shingle_join.Rule(words=4, percent=85)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("rule", [shingle_join.Rule(4, 85), shingle_join.Rule()])
def test_shingle_join_with_ids_that_repeat(spark, rule, monkeypatch):
    """A doc_id with two texts stands for the set of smaller hash alone; brute force over what was kept."""
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    base = [" ".join(f"a{i}" for i in range(57)), " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(90))]
    rows = [(5, base[0]), (5, base[1]), (15, base[0]), (20, base[0] + " more")]
    for d in range(30, 75):
        words = base[rng.randrange(3)].split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = f"e{rng.randrange(5)}"
        rows.append((d - rng.randrange(3), " ".join(words)))
    got = {r.doc_id: r for r in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rule).collect()}
    assert set(got) == {d for d, _ in rows}
    sets = {}
    for d, t in rows:
        w = t.split()
        sets.setdefault(d, []).append({tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)})
    # Which of an id's sets counts is told by its size where they differ, else by who shares its class.
    kept = {d: next(s for s in x if len(s) == got[d].n_shingles and (len(x) == 1 or len({len(y) for y in x}) > 1 or all(y == s for y in x) or got[d].class_id == d or s in sets[got[d].class_id])) for d, x in sets.items()}
    sure = {d for d, x in sets.items() if len({len(y) for y in x}) == len({frozenset(y) for y in x})}
    for a in sure:
        for b in sure:
            o = len(kept[a] & kept[b])
            if a < b and 100 * o >= rule.percent * len(kept[a] | kept[b]):
                assert got[a].component_id == got[b].component_id, (a, b)
    assert got[15].component_id == got[20].component_id


def test_shingle_join_of_nothing(spark, none):
    assert shingle_join.near_duplicates(none).count() == 0


def test_chat_events_fold(spark):
    e = [("message", "user", "hi"), ("message", "assistant", "a"), ("delta", "assistant", "b"), ("regenerate", "assistant", "c"), ("delta", "assistant", "d"), ("message", "user", "x"), ("edit", "assistant", "E"), ("edit", "user", "y"), ("delta", "tool: one", None), (None, None, None)]
    df = spark.createDataFrame([(1, i, k, r, t) for i, (k, r, t) in enumerate(e)], "conv_id long, seq long, kind string, role string, text string")
    got = [(r.role, r.text) for r in chat_format.fold_events(df).orderBy("turn").collect()]
    assert got == [("user", "hi"), ("assistant", "E"), ("user", "y"), ("tool: one", ""), ("user", "")]
    back = chat_format.read_back(chat_format.render(chat_format.fold_events(df))).first()
    assert [(t.role, t.text) for t in back.turns] == got and back.loss == "E"


def test_chat_fold_of_random_logs(spark):
    """Against a plain loop over each log."""
    rng = random.Random(6)
    rows = [(c, i, rng.choice(chat_format.KINDS), rng.choice(["user", "assistant", "tool"]), rng.choice("abc") + str(i)) for c in range(60) for i in range(rng.randint(1, 25))]
    want = {}
    for c, _, kind, role, text in rows:
        done = want.setdefault(c, [])
        mine = [m for m in done if m[0] == role]
        if kind == "delta" and done and done[-1][0] == role:
            done[-1][1] += text
        elif kind == "edit" and mine:
            mine[-1][1] = text
        elif kind == "regenerate" and done and done[-1][0] == role:
            done[-1][1] = text
        else:
            done.append([role, text])
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string").repartition(5)
    got = {}
    for r in chat_format.fold_events(df).orderBy("conv_id", "turn").collect():
        assert r.turn == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append([r.role, r.text])
    assert got == want


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", " </turn>\n### user: x", "\\", "####", "", None, "a: b\n", "</turn>", "\\</turn>\\\\", "$1 🟢"]
    df = spark.createDataFrame([(c, i, ["user", "assistant", "a b"][(i + (c or 0)) % 3], t, 5) for c in (1, None) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string, at int")
    for r in chat_format.read_back(chat_format.format_conversations(df)).collect():
        assert [t.text for t in r.turns] == [t or "" for t in texts]
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_decontaminate(spark, none):
    item = "A train leaves Boston at 60 km per hour and meets another from Denver after 3 hours. How far did the first train travel in total?"
    other = "A train leaves Madrid at 85 km per hour and meets another from Lisbon after 7 hours. How far did the first train travel in total?"
    loose = "A train leaves Madrid at 85 km per hour and meets another from Madrid after 7 hours."
    clean = " ".join(f"plain{i}" for i in range(300))
    rows = [(1, clean + ". " + item + " " + clean), (2, "intro. " + other), (3, clean), (4, None), (5, ""), (6, item.upper()), (7, item), (7, item)]
    df = spark.createDataFrame([(d, t, None, 1, 2, "s") for d, t in rows], DOC)
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "tiny"), (4, "Élan vital émis par óscar ñandú hier soir")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.find_contaminated(df, bench).collect()}
    assert got == {(1, 0): False, (2, 0): True, (6, 0): False, (7, 0): False}
    assert decontaminate.find_contaminated(none, bench).count() == 0 and decontaminate.find_contaminated(df, bench.limit(0)).count() == 0
    capital = spark.createDataFrame([(9, "x ÉLAN VITAL ÉMIS PAR ÓSCAR ÑANDÚ HIER SOIR y", None, 1, 2, "s")], DOC)
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(capital, bench).collect()] == [(9, 4)]
    # The same name twice in the item, two names in the document: the slots don't agree.
    twice = spark.createDataFrame([(0, "they saw Boston and then left Boston by boat again quickly")], "item_id long, text string")
    odd = spark.createDataFrame([(1, "they saw Madrid and then left Lisbon by boat again quickly", None, 1, 2, "s"), (2, "they saw Madrid and then left Madrid by boat again quickly", None, 1, 2, "s")], DOC)
    assert [r.doc_id for r in decontaminate.find_contaminated(odd, twice).collect()] == [2]
    assert loose


def contaminated(spark, texts, items):
    docs = spark.createDataFrame([(d, t, None, 1, 2, "s") for d, t in enumerate(texts)], DOC)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_contaminated(docs, bench).collect()}


def test_decontaminate_finds_exact_copies(spark):
    items = ["Solve 3x + 5 = 20", "12 * 7 + 3 = ?", "Who wrote the book", "Sort these: 5 9 2 8 1 7 3 6 4 12 15 11 and 20 18 16 14 please", "In Paris Anna Maria Lopez met Juan Carlos Reyes near Rio Grande"]
    texts = ["Please solve 3x + 5 = 20 now", "He had 12 * 7 + 3 = ? on paper", "then he asked Who wrote the book and left", "So: " + items[3] + " Thanks", items[4].upper(), items[2].lower(), items[4], "Solve 9x + 4 = 20, 12 * 8 + 3"]
    got = contaminated(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 2), (6, 4)} and not any(r.reworded for r in got.values())
    assert all(r.covered == r.item_tokens for r in got.values())


def test_decontaminate_leaves_clean_documents(spark):
    a, b = "at the end of the day we", "it goes without saying that they"
    items = ["Which of the following is true about X?", f"{a} {' '.join(f'item{i}' for i in range(16))} {b}", "What is 7?", "The river Elbe is 20 km long"]
    filler = " ".join(f"plain{i}" for i in range(4000))
    copy = items[1].replace("item4 ", "").replace("item9 ", "item9 put in here ")
    texts = ["Tell me which of the following is true and why.", f"{a} {filler} {b}", "so what is 5 then", "they say The river Oder is 30 km wide", copy, f"{filler} {copy}", "Now which of the following is true about X? Well.", items[3]]
    got = contaminated(spark, texts, items)
    assert set(got) == {(4, 1), (5, 1), (6, 0), (7, 3)} and got[6, 0].covered == 8
    # Copies are found at each place relative to where neighbourhoods begin.
    moved = contaminated(spark, [" ".join(["pad"] * i + [copy]) for i in range(40)], items)
    assert set(moved) == {(i, 1) for i in range(40)} and len({r.covered for r in moved.values()}) == 1


def plain_cover(doc, item):
    """(covered, reworded) of the best neighbourhood by loops over every diagonal and window; None if not contaminated."""
    (dt, dp), (it, ip) = doc, item
    d, n = len(dt), len(it)
    size, slots = min(n, decontaminate.WINDOW), {int(x) for x in (decontaminate.NUM, decontaminate.NAME, decontaminate.UNIT)}
    if n < decontaminate.MIN_TOKENS:
        return None
    near, areas = max(decontaminate.NEAR, int(n * decontaminate.NEAR_SHARE)), {}
    for diagonal in range(-n, d):
        starts = [p for p in range(n - size + 1) if 0 <= p + diagonal <= d - size]
        exact = [p for p in starts if dp[p + diagonal :][:size] == ip[p:][:size]]
        alike = [p for p in starts if dt[p + diagonal :][:size] == it[p:][:size] and 2 * sum(t not in slots for t in it[p:][:size]) >= size]
        values = {(ip[q], dp[q + diagonal]) for p in alike for q in range(p, p + size) if it[q] in slots}
        if len({was for was, _ in values}) < len(values):
            alike = []
        for area in {diagonal // (near + 1) - 1, diagonal // (near + 1)} if exact or alike else ():
            covered, as_is, literal, other = areas.setdefault(area, (set(), set(), set(), []))
            for p in exact:
                as_is.update(range(p, p + size))
                literal.update(ip[p:][:size])
            covered.update(q for p in exact + alike for q in range(p, p + size))
            literal.update(it[q] for p in alike for q in range(p, p + size) if it[q] not in slots)
            other.append(bool(alike) and any(was != now for was, now in values))
    need = max(math.ceil(n * decontaminate.MIN_COVER), min(math.ceil(n * decontaminate.SHORT_COVER), decontaminate.SHORT_TOKENS), min(n, decontaminate.WINDOW + 1))
    best = [(len(c), not any(o)) for c, a, lit, o in areas.values() if len(c) >= need and (len(a) >= need or len(lit) >= decontaminate.MIN_LITERAL)]
    return (max(best)[0], not max(best)[1]) if best else None


def test_decontaminate_is_the_plain_search(spark):
    rng = random.Random(4)
    vocabulary = ["the", "train", "leaves", "at", "60", "km", "85", "Boston", "Madrid", "per", "hour.", "How", "far", "seven", "kg", "and", "ride", "x+1", "(12)"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(1, 24)) for _ in range(25)] + [["In", "Oslo", "5", "kg", "of", "fish", "cost", "90", "euros", "today"]]
    texts = []
    for _ in range(120):
        text = say(rng.randint(0, 12))
        for _ in range(rng.randint(0, 2)):
            copy = [rng.choice(vocabulary) if rng.random() < 0.06 else w for w in rng.choice(items) if rng.random() > 0.04]
            text += copy + say(rng.randint(0, 30))
        texts.append(" ".join(text))
    texts += ["In Rome 7 kg of fish cost 30 euros today", "", None, " ".join(items[3]).upper()]
    found = {k: (r.covered, r.reworded) for k, r in contaminated(spark, texts, [" ".join(i) for i in items]).items()}

    def tokens(strings):
        (run,) = runs([pa.RecordBatch.from_pydict({"text": pa.array(strings, pa.string())})], "text")
        token, plain, first = decontaminate.canonical(run)
        return [(token[a:b].tolist(), plain[a:b].tolist()) for a, b in itertools.pairwise(first.tolist())]

    told = {(d, i): got for d, doc in enumerate(tokens(texts)) for i, item in enumerate(tokens([" ".join(i) for i in items])) if (got := plain_cover(doc, item))}
    assert found == told and len(found) > 60 and {r for _, r in found.values()} == {True, False}


def test_decontaminate_tells_rows_of_one_id_apart(spark):
    item = "A shop sells 12 crates of plums at 5 dollars each and 7 crates of pears at 9 dollars. How much does it earn in all today?"
    one, two = item.replace("12", "40").replace("5", "8"), item.replace("12", "31").replace("9", "6")
    other = "Le train de Lyon part avec douze wagons et trente passagers vers la mer ce soir"
    clean = "nothing of the kind stands in this text at all"
    bench = spark.createDataFrame([(1, item), (1, other), (None, "Ein Bauer hat zwanzig Hühner und kauft noch sieben Gänse dazu auf dem Markt")], "item_id long, text string")
    alone = {}
    for text in (one, two, other.replace("douze", "seize"), "Ein Bauer hat neunzig Hühner und kauft noch vier Gänse dazu auf dem Markt", clean):
        got = decontaminate.find_contaminated(spark.createDataFrame([(5, text)], "doc_id long, text string"), bench).collect()
        alone[text] = {(r.item_id, r.covered, r.item_tokens, r.reworded) for r in got}
    assert [len(x) for x in alone.values()] == [1, 1, 1, 1, 0] and all(r for x in alone.values() for _, _, _, r in x)
    for ids in ([1] * 6, [None] * 6, [1, 2, 1, None, None, 1]):
        docs = spark.createDataFrame(list(zip(ids, [*alone, one], strict=True)), "doc_id long, text string")
        want = {(d, *hit) for d, t in zip(ids, [*alone, one], strict=True) for hit in alone[t]}
        got = [tuple(r) for r in decontaminate.find_contaminated(docs, bench).collect()]
        assert set(got) == want and len(got) == len(want)
    # A lexicon of one's own: words of another language count as numbers.
    item, text = "um barco leva oitenta caixas para o porto velho da cidade", "um barco leva noventa caixas para o porto velho da cidade"
    pair = (spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    told = [[(r.covered, r.reworded) for r in decontaminate.find_contaminated(*pair, lexicon=x).collect()] for x in (decontaminate.LEXICON, decontaminate.Lexicon(["oitenta", "noventa"]))]
    assert told == [[], [(11, True)]]


def test_permutation_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[10:60] = x[10]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0], 1), (904, [None] * 16, 1), (None, [1.0] * 16, 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in permutation_index.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(400), -np.round(s, 9))) if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for v, score in got[q].values())
        hits += len(set(order) & {v for v, _ in got[q].values()})
    assert hits / 400 >= 0.9 and [got[20][k][0] for k in range(1, 21)] == [*range(10, 20), *range(21, 31)]
    assert permutation_index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation_index.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()[0].vec_id == 1


def test_permutation_index_ranks_few_of_many(spark):
    """Large enough for the cut to leave most vectors out; recall against brute force, scores to the last bits."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24)).astype(np.float32) * rng.uniform(0.5, 2, size=(4000, 1)).astype(np.float32)
    place = permutation_index.RERANK[0] * len(x) ** permutation_index.RERANK[1]
    assert place < 0.3 * len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = permutation_index.search(df, F.col("vec_id") % 100 == 0).toPandas()
    hits, exact = 0, x.astype(float)
    for q, rows in got.groupby("query_id"):
        s = exact @ exact[q]
        hits += len(set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]) & set(rows.vec_id))
        assert sorted(rows["rank"]) == list(range(1, 21)) and np.allclose(s[rows.vec_id], rows.score, rtol=1e-12, atol=1e-12)
        assert rows.sort_values("rank").score.is_monotonic_decreasing
    assert got.query_id.nunique() == 40 and hits / 800 >= 0.9


def test_footrule():
    rng = np.random.default_rng(2)
    perms = np.array([rng.permutation(40)[:12] for _ in range(50)]).astype(np.uint16)
    rule = permutation_index.Footrule(40, 12)
    for q in perms[:5]:
        rule.ask(q)
        at = [{int(p): k for k, p in enumerate(row)} for row in perms]
        own = {int(p): k for k, p in enumerate(q)}
        distance = np.array([sum(abs(a.get(p, 12) - own.get(p, 12)) for p in range(40)) for a in at])
        assert set(distance + 2 * rule.near(rule.cells(perms))) == {12 * 13}


def test_language_id(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.detect_languages(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in language_id.detect_languages(docs).collect()} == {("und", 0.0)}
    out = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit_on(real)).collect()}
    assert [out[i] for i in (0, 1, 2)] == ["und"] * 3 and out[6] != "und" and len(out) == len(TEXTS)
    assert language_id.detect_languages(none).count() == 0
    code = language_id.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 3


def plain_language(model, text):
    """(language, score) from n-gram counts by loops and each codeword's loss on its own."""
    b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode()]
    b = [c + 32 if k and b[k - 1] == 0xC3 and 0x80 <= c < 0x9F else c for k, c in enumerate(b)]
    x = np.zeros(language_id.BUCKETS)
    for k in range(len(b) - 1):
        x[(b[k] * 257 + b[k + 1]) * 2654435761 % 2**32 >> 20] += 1
    for k in range(len(b) - 2):
        x[(b[k] * 257 + b[k + 1] + b[k + 2] * 66049 + 77) * 2246822519 % 2**32 >> 20] += 1
    x = np.sqrt(x / max(1, x.sum()))
    loss = {}
    for lang, word in zip(model.langs, model.code, strict=True):
        bits = [math.log1p(math.exp(-s * max(-8, min(8, float(x @ model.w[:-1, j]) + float(model.w[-1, j]))))) for j, s in enumerate(word.tolist())]
        loss[lang] = sum(w * bit for w, bit in zip(model.weight.tolist(), bits, strict=True)) / float(model.weight.sum())
    lang = min(loss, key=loss.get)
    return lang, 1 / sum(math.exp(-4 * (v - loss[lang])) for v in loss.values())


def test_languages_are_the_nearest_codewords(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit_on(real)
    texts = [r.text for r in real.orderBy("doc_id").limit(60).collect()] + ["ÀÉÎ straße", "a", "ab cd", "日本 語"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.identify(df, model).collect():
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_languages_of_the_sample(spark):
    rows = [(i, f"word{i} text{i}", f"l{i % 70:02d}") for i in range(2100)] + [(5000 + i, "more of it", "l69") for i in range(40)] + [(5000, "a first", "l69"), (None, "zz", "none"), (9, None, "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_id.fit_on(d, 3) for d in (df, df.repartition(7)))
    assert one.langs == [f"l{k:02d}" for k in range(70)] == two.langs and np.array_equal(one.w, two.w)
    # Many rows of one id are one document of its language; bounds on all documents and bytes leave one of each language.
    many = spark.createDataFrame([(0, f"abc def {i}", "x") for i in range(3000)] + [(i, f"ghi jkl {'mno ' * 50}", "y") for i in range(8, 40)], "doc_id long, text string, lang string")
    assert language_id.fit_on(many, in_all=2).langs == language_id.fit_on(many, in_bytes=1).langs == ["x", "y"]


def test_codewords_of_many_languages():
    for n in (8, 70, 700):
        code = language_id.codewords(n)
        apart = code.shape[1] - code @ code.T
        assert code.shape == (n, int(np.ceil(10 * np.log2(n)))) and (apart + 1000 * np.eye(n)).min() / 2 >= code.shape[1] * 0.12
        assert (np.abs(code.sum(0)) < n).all()


def test_quality_fm(spark, docs, none):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_fm.score_documents(real, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    empty = labels.limit(0)
    assert {r.score for r in quality_fm.score_documents(docs, empty).collect()} == {0.5}
    out = quality_fm.score(docs, quality_fm.fit_on(real, labels)).collect()
    assert len(out) == len(TEXTS) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert quality_fm.score_documents(none, labels).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality_fm.fit(["good words here " * 5, "BAD!! BAD!!"], [1, 0], epochs=1)
    x, v = rng.normal(size=30), rng.normal(size=(30, 8))
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(30) for j in range(i))
    assert abs(0.5 * (((x @ v) ** 2) - (x**2 @ v**2)).sum() - pairs) < 1e-9 and model is not None


def test_scores_are_those_of_all_pairs():
    """The model's scores against the sum over all pairs of features, one by one."""
    import pyarrow as pa

    from marksheet.llm.textbuf import runs

    texts = ["good words stand here and there " * 3, "BAD!! bad bad 123", "", "one", "words here"]
    model = quality_fm.fit(texts, [1, 0, 0, 1, 1], epochs=3)
    run = next(runs([pa.RecordBatch.from_pydict({"text": texts})], "text"))
    stats, bucket, first = quality_fm.statistics(run)
    got = model.scores(run)
    for k in range(len(texts)):
        count = np.bincount(bucket[first[k] : first[k + 1]], minlength=quality_fm.BUCKETS).astype(float)
        x = np.append(count / max(1e-9, np.sqrt(count @ count)), np.clip((stats[k] - model.mean) / model.scale, -5, 5))
        on = np.flatnonzero(x)
        z = model.bias + x @ model.w + sum(model.v[i] @ model.v[j] * x[i] * x[j] for n, i in enumerate(on) for j in on[:n])
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_warc(spark):
    big = "é<p>" + "z" * 90_000
    rows = [(1, "u", big, 0), (2, "u\r\nx", big, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (7, "u", "y" * 100, 0), (8, "u", "y" * 100, 0), (5, "u", "short", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc_archive.read_warc(warc_archive.write_warc(pages.repartition(3)), keep_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = (dict((p, h) for p, _, h, _ in rows)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert (r.record_type, r.refers_to) == {2: ("revisit", 1), 8: ("revisit", 7)}.get(r.page_id, ("response", None))
        assert r.payload == (None if r.page_id in (2, 8) else bytearray(html))
    assert warc_archive.read_warc(warc_archive.write_warc(pages.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, "u", "q" * 200), (9, "u", "q" * 200), (None, None, None), (12, "u", "q" * 200)], "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_archive.read_warc(warc_archive.write_warc(odd)).collect()}
    assert got == {(None, 200, "response", None), (None, 0, "response", None), (9, 200, "response", None), (12, 200, "revisit", 9)}
    with pytest.raises(ValueError):
        warc_archive.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_main_text(spark):
    cases = {
        1: ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Big title here</h1><p>One &amp; two&nbsp;three<br>four.<p>Second <b>bold</b> text of some length.</article><footer>&copy; me</footer><script>var a='<p>no</p>'</script>", "Big title here\n\nOne & two three four.\n\nSecond bold text of some length."),
        2: (None, ""), 3: ("", ""), 4: ("<div class=ad>buy now</div>", ""),
    }
    deep = "<div>" * 3000 + "<p>Some text in the middle of it all, which is long.</p>" + "</div>" * 2999
    rows = [(k, "u", h, 1) for k, (h, _) in cases.items()] + [(1, "u", cases[1][0], 1), (9, None, deep, 1), (10, "u", "<p <p>> </x><a href='unclosed>" + "<" * 500, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = main_text.extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        if r.page_id in cases:
            assert r.text == cases[r.page_id][1]
    assert main_text.extract_main_text(df.limit(0)).count() == 0


def test_main_text_on_made_pages():
    rng = random.Random(123)
    model = main_text.default_model()
    wrong = total = 0
    for _ in range(100):
        source, truth = main_text.labelled_page(rng)
        page = main_text.parse(source)
        prob, _, _ = main_text.Forest([page]).marginals(model.w, model.pair)
        leaves = [k for k, t in enumerate(page.text) if t is not None]
        assert len(leaves) == len(truth)
        wrong += sum((prob[k] >= 0.5) != t for k, t in zip(leaves, truth, strict=True))
        total += len(truth)
    assert wrong / total < 0.03


@pytest.mark.parametrize("name", GOLD)
def test_main_text_of_hand_written_pages(name):
    source, blocks = GOLD[name]
    assert main_text.default_model().texts([main_text.parse(source)]) == ["\n\n".join(blocks)]


def test_elements_are_content_if_some_text_below_is():
    page = main_text.parse("<article><p>a</p><aside>b b b b</aside></article><div>c</div>")
    labels = dict(zip(((t or page.tag[k]) for k, t in enumerate(page.text)), main_text.node_labels(page, [True, False, False]).tolist(), strict=True))
    assert labels == {"html": 1, "article": 1, "p": 1, "a": 1, "aside": 0, "b b b b": 0, "div": 0, "c": 0}


def test_features_see_whole_blocks():
    filler, notice = "lorem ipsum dolor sit amet consetetur " * 8, "We use cookies, read the cookie policy. Copyright 2024 12345 Example, all rights reserved. "
    model, seen = main_text.default_model(), []
    for text in (notice + filler, filler + notice, filler * 2):
        page = main_text.parse(f"<html><body><div>{text}end.</div><p>More.</p></body></html>")
        forest = main_text.Forest([page])
        leaf = next(k for k, t in enumerate(page.text) if t is not None)
        last = forest.rows == leaf
        seen.append((dict(zip((forest.cols[last] - main_text.N_NODE).tolist(), forest.vals[last].tolist(), strict=True)), forest.marginals(model.w, model.pair)[0][leaf]))
    (early, p_early), (late, p_late), (plain, p_plain) = seen
    assert early == late and p_early == p_late < p_plain
    assert early[-6] == 0.5 and early[-2] > 0 == plain[-6] == plain[-2]
    long = main_text.Forest([main_text.parse(f"<p>{'word ' * 4000} a cookie was baked.</p><p>more</p>")])
    assert 0 < long.vals[long.cols == main_text.N_NODE - 6][0] < 0.01


def test_marginals_are_exact():
    page = main_text.parse("<div><p>a</p><ul class=nav><li>b<li>c</ul></div>")
    forest = main_text.Forest([page])
    rng = np.random.default_rng(1)
    w, pair = rng.normal(size=main_text.N_NODE), rng.normal(size=(main_text.N_EDGE, 2, 2))
    prob, _, _ = forest.marginals(w, pair)
    score, sums, z = forest.node_scores(w), np.zeros(forest.n), 0.0
    for state in range(2**forest.n):
        y = [(state >> k) & 1 for k in range(forest.n)]
        p = np.exp(sum(score[k] * y[k] for k in range(forest.n)) + sum(pair[forest.edge[k], y[forest.parent[k]], y[k]] for k in range(1, forest.n)))
        z += p
        sums += p * np.array(y)
    assert np.allclose(sums / z, prob)
