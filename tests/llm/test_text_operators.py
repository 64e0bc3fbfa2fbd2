"""The text operators against brute force and on odd input: nulls, empty and long texts, ties, repeated rows, no rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import chat, html_text, language, near_dedup, packing, pii, quality_classifier, warc
from seriesloom.llm import components as components_module
from seriesloom.llm.components import components
from seriesloom.llm.decontaminate import contamination
from seriesloom.llm.near_dedup import near_components
from seriesloom.llm.quality_rules import quality
from seriesloom.llm.tables import stored
from seriesloom.llm.token_ids import TokenIds

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string, pii int, key string"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("t", "s", "n", "ro", "vel")]


def docs_of(spark, rows):
    """(doc_id, text) rows with the usual and some clashing columns."""
    full = [(i, t, "en", "src0", len(t or ""), "q", 1, "k") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def some_texts(seed: int, n: int) -> list[tuple[int, str]]:
    """Random texts, exact and near copies of some, and the odd ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(VOCABULARY, k=rng.choice((1, 2, 5, 12, 30, 80)))))
    return list(enumerate(texts))


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "ONE"), (906, "a b"), (906, "a b"), (None, "a b"), (907, "w " * 20000)]


# -- quality rules -----------------------------------------------------------------------------------------------------
def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_measures(spark):
    rows = [*some_texts(3, 60), *ODD[:-1], (50, "x y\nx y\n \nz"), (51, "a b c d e " * 3), (52, "é ü ## 日本 🙂 " * 4)]
    got = quality(docs_of(spark, rows)).select("doc_id", "text", "quality.*", "key").collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_long_text(spark):
    assert quality(docs_of(spark, ODD[-1:])).first()["quality"]["n_repeat_words"] == 20000


# -- near duplicates ---------------------------------------------------------------------------------------------------
def brute_components(rows, width, percent):
    """(set size, component) of each row by comparing all rows, whatever their ids."""
    lower = bytes(range(256)).lower()
    sets = []
    for _, t in rows:
        words = (t or "").encode().translate(lower).split()
        k = min(width, len(words))
        sets.append({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    for n, i in enumerate(known):
        for j in known[n + 1 :]:
            same = rows[i][0] == rows[j][0] and sets[i] == sets[j]
            if same or sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in known:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return [(len(s), least[find(i)] if rows[i][0] is not None else None) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_near_components(spark, seed, width, monkeypatch):
    """Against all pairs of rows, where ids repeat with other texts; tokens count as frequent early."""
    monkeypatch.setattr(near_dedup, "HOT", 3)
    rng = random.Random(seed)
    base = " ".join(f"t{i}" for i in range(12))
    rows = [*some_texts(seed, 120), *ODD, (2005, base), (2005, "another text of this very id"), (2007, base), (2008, base + " more")]
    rows += [(rng.randrange(40), t) for _, t in some_texts(seed + 9, 30)]
    got = near_components(docs_of(spark, rows), width=width)
    got = sorted((str(r["doc_id"]), r["text_key"], r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got.collect())
    keys = [r[0] for r in docs_of(spark, rows).select(F.xxhash64("text")).collect()]
    want = brute_components(rows, width, 80)
    assert got == sorted(
        (str(i), k, n, str(c), i is None or i == c) for (i, _), k, (n, c) in zip(rows, keys, want, strict=True)
    )
    if width == 2:
        assert ("2008", 2005) in {(g[0], int(g[3])) for g in got if g[0] == "2008"}


def test_near_components_of_a_drifting_group(spark):
    """Copies of copies: neighbours are alike, ends are not, so stars alone do not connect them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[(7 * i) % 60] = f"n{i}"
        words[(7 * i + 31) % 60] = f"m{i}"
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_components(docs_of(spark, rows)).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, brute_components(rows, 2, 80), strict=True)}


def test_plans_of_components_stay_small(spark, monkeypatch):
    """Each star reads its edges a few times; a plan of two stars in one read them 24 times, which fills a driver."""
    reads = []

    def counted(frame, purpose):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        reads.append(sum("Relation [" in line for line in plan.splitlines()))
        return stored(frame, purpose)

    monkeypatch.setattr(components_module, "stored", counted)
    edges = spark.createDataFrame([(5, 3), (3, 4), (4, 9), (7, 8), (8, 7), (6, 6), (9, 1)], "a long, b long")
    got = {tuple(r) for r in components(edges).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (5, 1), (9, 1), (7, 7), (8, 7)}
    assert 1 <= max(reads) <= 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(71)} | {100: 100, 101: 100}


# -- decontamination ---------------------------------------------------------------------------------------------------
def brute_hits(text, items, window):
    def words_of(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]

    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=k))) for i, k in enumerate((25, 12, 10, 9, 3, 14))]
    items += [(70, items[0][1].upper()), (71, ""), (72, None), (None, "solo quiz"), (8, "kat-Kat, kat kat kat kat")]
    texts = some_texts(8, 60)
    for i in range(40):
        words = rng.choices(VOCABULARY, k=40)
        part = rng.choice(items)[1] or ""
        texts.append((200 + i, " ".join(words[:20]) + " " + part + "! " + part + " " + " ".join(words[20:])))
    texts += [*ODD, (300, "Solo, QUIZ"), (301, "kat " * 30), (301, "kat " * 30)]
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    got = contamination(docs_of(spark, texts), bench).collect()
    want = sorted((i if i is not None else -1, *brute_hits(t, items, 10)) for i, t in texts)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


# -- personal data -----------------------------------------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PRIVATE = [
    "mail a.b+c@d-e.org, x@y@z.de a@b.c_d@e.f ...@x.y",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.255 and 99999999999.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 4111111111111111 0000 0000 0000 00",
    "call +1 (319) 555-5132 or +12 or + 1 22 or +1.2.3.4.5.6.7.8.9.0 () +1 234",
    "é🙂 x@y.zz 🙂 +49 170 1234567",
    "+1 (319) 555-5132x@y.com 10.0.0.1",
    "a" * 30000 + "@" + "b." * 3000 + "c " + "1" * 30000 + " " + "1." * 20000,
    None,
    "",
]


def test_pii_base_spans(spark):
    rows = list(enumerate(PRIVATE)) + [(3, PRIVATE[3])]
    docs = docs_of(spark, rows)
    got = pii.spans(docs, pii.Model(0.0, (), (float("inf"),) * 4)).select("doc_id", "text", "pii.*", "key").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r["base"]] == brute_spans(r["text"]) == [tuple(s) for s in r["all"]]


def test_pii_model_and_redaction(spark):
    good = [f"write to +1 (319) 555-{n:04d} today" for n in range(400)]
    near = [f"write to 1 (319) 556-{n:04d} today" for n in range(12)]
    other = [f"see 12 34 56 {n:04d} of volume" for n in range(200)]
    docs = docs_of(spark, list(enumerate([*good, *near, *other, None])))
    model = pii.fit(docs)
    rows = pii.spans(docs, model).select("text", "pii.*", pii.redacted(F.col("text"), F.col("pii.all")).alias("red")).collect()
    by = {r["text"]: r for r in rows}
    assert by[good[3]]["red"] == "write to <PHONE> today"
    assert by[near[3]]["red"] == "write to <PHONE> today" and not by[near[3]]["base"]
    assert by[other[3]]["red"] == other[3]
    assert by[None]["red"] is None
    scores = {model.score({f: 0 for f in pii.RANGES} | {"kind": 3, "digits": d}) for d in range(6)}
    assert all(np.isfinite(s) for s in scores)


def test_pii_candidates_are_found_once(spark, monkeypatch):
    plans = []

    def seen(frame, purpose):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return stored(frame, purpose)

    monkeypatch.setattr(pii, "stored", seen)
    pii.fit(docs_of(spark, [(1, "ask a@b.org or 10.0.0.1"), (2, ""), (3, None)]))
    assert any("regexp_extract_all" in p for p in plans)
    assert not any("Filter" in line and "regexp_extract_all" in line for p in plans for line in p.splitlines())


@pytest.mark.parametrize("missed", [100, 800])
def test_pii_finds_what_the_base_rules_often_miss(spark, missed):
    good = [f"write to +1 (319) 555-{n:04d} today" for n in range(400)]
    good += [f"write to someone{n}@site.org today" for n in range(400)]
    near = [f"write to 1 (319) 556-{n:04d} today" for n in range(missed)]
    veiled = [f"write to ann{n} [at] site [dot] org today" for n in range(missed)]
    other = [f"see 12 34 56 {n:04d} of volume" for n in range(200)] + [f"see number {10**12 + n} there" for n in range(200)]
    docs = docs_of(spark, list(enumerate([*good, *near, *veiled, *other])))
    rows = pii.spans(docs, pii.fit(docs)).select("text", pii.redacted(F.col("text"), F.col("pii.all")).alias("red")).collect()
    red = {r["text"]: r["red"] for r in rows}
    assert {red[t] for t in near} == {"write to <PHONE> today"}
    assert {red[t] for t in veiled} == {"write to <EMAIL> today"}
    assert all(red[t] == t for t in other)


# -- chats -------------------------------------------------------------------------------------------------------------
EVENT = "conv_id long, seq long, kind string, target long, role string, text string, extra int"


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "|x", None, "", "a\nb<|", "<\\\\|\\", "🙂"]
    rows = [(c, i, "message", None, ("user", "assistant", None, "a\n<|b", "é x")[(i + (c or 0)) % 5], t, 1) for c in (1, 2, None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0]]
    got = {
        r["conv_id"]: r
        for r in chat.format_chats(spark.createDataFrame(rows, EVENT))
        .select("conv_id", chat.read_back(F.col("formatted")).alias("turns"))
        .collect()
    }
    losses = {r["conv_id"]: r["loss"] for r in chat.under_mask(chat.format_chats(spark.createDataFrame(rows, EVENT))).collect()}
    for c in (1, 2, None):
        own = sorted(((r[1], r[4] or "", r[5] or "") for r in rows if r[0] == c))
        assert [tuple(t) for t in got[c]["turns"]] == [x[1:] for x in own]
        assert losses[c] == [t for _, role, t in own if role == "assistant"]


def test_chat_masks_hold_the_positions(spark):
    rows = [(1, i, "message", None, ("assistant", "user")[i % 2], "<|" * (i % 5) + "🙂x" * i, 0) for i in range(60)]
    r = chat.format_chats(spark.createDataFrame(rows, EVENT)).first()
    own = [t[5].replace("<|", "<\\|") for t in rows if t[4] == "assistant"]
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == own


def test_chat_streams_fold_to_their_messages(spark):
    """Deltas, drafts generated anew and late edits come to what was meant."""
    rng = random.Random(4)
    rows = [(c, i, rng.choice(("user", "assistant", None)), "".join(rng.choices("ab é🙂<|\n", k=rng.choice((0, 1, 2, 30))))) for c in (1, 2, None) for i in range(60)]
    rows += [rows[0], rows[0], (3, 0, "assistant", None)]
    log = chat.streamed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] == len(rows)
    got = sorted((str(r["conv_id"]), r["number"], r["role"], r["text"]) for r in chat.fold(log).collect())
    want = []
    for c in (1, 2, 3, None):
        own = sorted((t, r or "", x or "") for d, t, r, x in rows if d == c)
        want += [(str(c), n, r, x) for n, (_, r, x) in enumerate(own)]
    assert got == sorted(want)


def test_chat_of_many_turns(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("say "), F.col("id")).alias("text")
    )
    r = chat.under_mask(stored(chat.format_chats(chat.streamed(rows)), "chats")).first()
    assert r["loss"] == [f"say {i}" for i in range(n)]


def test_chat_folds_events(spark):
    rows = [
        (1, 1, "message", None, "user", "hi", 0),
        (1, 2, "message", None, "assistant", "he", 0),
        (1, 3, "delta", None, None, "llo", 0),
        (1, 4, "regenerate", 1, None, "", 0),
        (1, 5, "delta", 1, None, "good ", 0),
        (1, 6, "delta", 1, None, "day", 0),
        (1, 7, "edit", 0, None, "hello", 0),
        (1, 8, "delta", 9, None, "nowhere", 0),
        (1, 9, None, None, None, "unknown", 0),
        (2, 1, "delta", None, None, "before any message", 0),
    ]
    got = chat.fold(spark.createDataFrame(rows, EVENT)).orderBy("number").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(1, "user", "hello"), (1, "assistant", "good day")]


# -- language ----------------------------------------------------------------------------------------------------------
def test_language(spark):
    syllables = {"aa": ["the", "ing", "and", "on"], "bb": ["ção", "nh", "que", "ão"], "cc": ["sch", "ung", "ver", "ß"]}
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(30)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    model = language.fit(spark.createDataFrame([*rows[:90], (1000, None, "aa"), (1001, "x", None)], "doc_id long, text string, lang string"))
    odd = [(2000, None, "aa"), (2001, "", None), (2002, "12 34!", "bb"), (2003, rows[0][1] * 200, None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame([*rows[90:], *odd], "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in rows[90:]]) > 0.95
    assert [got[2000 + i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


LABELLED = "doc_id long, text string, lang string"


def words_of_language(rng, letters: str, n: int) -> str:
    """Many distinct words of one language's letters, which all languages mix with common ones."""
    return " ".join("".join(rng.choices(letters + "aeiou", k=rng.randint(2, 9))) for _ in range(n))


def test_language_of_long_texts_of_many_words(spark):
    rng = random.Random(8)
    letters = {"aa": "bcdfghtt", "bb": "cdfghkll", "cc": "dfghmnrs"}
    rows = [(i, words_of_language(rng, letters[k], 60), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    model = language.fit(spark.createDataFrame(rows, LABELLED))
    long = [(1000 + i, words_of_language(rng, letters[k], 160_000), k) for i, k in enumerate(letters)]
    long.append((1010, long[0][1][:300_000] + long[1][1], "bb"))  # nearly all of it is bb, the first third is not
    assert all(len(r[1]) > 900_000 for r in long)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(long, LABELLED), model).collect()}
    assert got == {i: k for i, _, k in long}
    text = long[0][1][:5001]
    parts = language.pieces(text)
    assert len(parts) == 3 and max(map(len, parts)) < language.PIECE
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    assert set().union(*map(grams, parts)) == grams(text)


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    own = {f"l{i:02d}": [chr(0x4E00 + 8 * i + j) for j in range(8)] for i in range(70)}
    rows = [(100 * i + n, "".join(rng.choices(own[k], k=200)), k) for i, k in enumerate(own) for n in range(7 if i < 64 else 5)]
    model = language.fit(spark.createDataFrame([r for r in rows if r[0] % 100], LABELLED))
    new = [r for r in rows if not r[0] % 100]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(new, LABELLED), model).collect()}
    assert got == {i: k for i, _, k in new}


# -- quality classifier ------------------------------------------------------------------------------------------------
def test_quality_classifier(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        good = i % 3 > 0
        words = rng.choices(VOCABULARY, k=40) if good else [w.upper() + "!!" for w in rng.choices(VOCABULARY, k=40)]
        source = "clean" if good and rng.random() < 0.9 else rng.choice(("clean", "mixed"))
        rows.append((i, " ".join(words), "en", source, 200))
    frame = spark.createDataFrame([*rows, (9000, None, None, None, None), (0, *rows[0][1:])], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)] + [(5, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(frame, quality_classifier.fit(frame, labels)).collect()}
    assert len(got) == 601
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in range(1, 600, 2)]) > 0.95
    twice = quality_classifier.score(frame, quality_classifier.fit(frame, labels, ("quality", "toxic")))
    assert twice.columns == ["doc_id", "score", "score_toxic"] and twice.where("score_toxic > 0.01").count() == 0
    none = quality_classifier.fit(frame, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(frame.limit(3), none).collect()} == {0.5}


def test_many_copies_of_one_id_bring_few_rows(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2).alias("text"))
    rows = rows.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(6).cast("long")})
    other = spark.createDataFrame([(i, f"word w{i}", "en", "s", 7) for i in range(2, 60)], rows.schema)
    labels = spark.createDataFrame([(1, 1)] * 3000 + [(i, i % 2) for i in range(2, 60)], "doc_id long, quality int")
    model = quality_classifier.fit(rows.unionByName(other), labels)
    assert quality_classifier.score(rows, model).select("score").distinct().count() <= 2


def test_telling_words_by_counting(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(VOCABULARY, k=8)) + (" scum" if i % 4 == 0 else "") + (" nice" if i % 3 else ""), int(i % 4 == 0), i % 3 and 1) for i in range(400)]
    frame = spark.createDataFrame([*rows, (None, None, 1)], "text string, toxic int, good int")
    want = set()
    for head in (1, 2):
        ones, zeros = ([set((r[0]).split()) for r in rows if r[head] == c] for c in (1, 0))
        ones = ones + [set()] * (head == 2)  # the row without a text
        for w in {x for r in rows for x in r[0].split()}:
            n1, n0 = sum(w in x for x in ones), sum(w in x for x in zeros)
            p = (n0 + n1 + 1) / (len(ones) + len(zeros) + 2)
            z = abs(n1 / len(ones) - n0 / len(zeros)) / math.sqrt(p * (1 - p) * (1 / len(ones) + 1 / len(zeros)))
            if n0 + n1 >= 5 and z >= 5:
                want.add(w.encode())
    got = quality_classifier.telling_words(frame, ("toxic", "good"))
    assert set(got) == want and {b"scum", b"nice"} <= want


def test_the_surest_rows_of_all_are_handed_over(spark):
    """Against sorting all rows, with copies of the surest one in every task."""
    views = quality_classifier.Views({})
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, views.width)).astype(np.float16)
    weights = [0.3 * rng.normal(size=n + 1) for n in (views.text, quality_classifier.META)]
    rows = [(r.tobytes(),) for r in x] + [(x[0].tobytes(),)] * 200
    free = spark.createDataFrame(rows, "x binary").repartition(7).withColumn("key", F.xxhash64("x"))
    trainer = quality_classifier.Trainer(x[:40].astype(np.float32), np.r_[np.ones(30), np.zeros(10)], views.columns)
    got = quality_classifier._handed_over(free, {"h": weights}, {"h": trainer}, 40, views)
    for view, cols in enumerate(views.columns):
        logit = quality_classifier._logit(x[:, cols].astype(np.float32), weights[view])
        want = {(x[i].tobytes(), 0) for i in np.argsort(logit)[:10]} | {(x[i].tobytes(), 1) for i in np.argsort(-logit)[:30]}
        assert set(got["h", view]) == want and len(got["h", view]) == 40


# -- html --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="post comments-open"><p>one</p></article>', "one"),
        ('<div class="page has-sidebar"><article><p>two</p></article><div class="sidebar">x</div></div>', "two"),
        ('<div class="sidebar"><p>lead</p><article><p>three</p></article></div>', "lead\n\nthree"),
        ('<article><p>real <span class="ad">buy now</span> news</p></article>', "real news"),
        ('<article><p>real <span class="ad">buy now</span></p></article>', "real"),
        ("<form><main><p>four</p></main><p>after</p></form>", "four\n\nafter"),
        ('<article><p>a</p></article><div class="related-posts"><article><p>card</p></article></div>', "a"),
        ('<article><p>a</p></article><section id="comments"><article class="comment-body"><p>me</p></article></section>', "a"),
        ("<aside><article><p>card</p></article></aside><main><p>b</p></main>", "b"),
        ('<div class="site-footer">f</div><div class="cookie-notice">c</div><article>d</article>', "d"),
        ("<article><header><h1>t</h1></header><p>e</p></article>", "t\n\ne"),
        ('<article><p>f <span hidden>g</span>h <b class="sharing">i</b>j</p></article>', "f h j"),
    ],
)
def test_html_places(page, text):
    assert "\n\n".join(t for place, t in html_text.blocks(page) if place != "aside") == text


class Reader(HTMLParser):
    """Another parser: the text of the one article, by blocks, without inline adverts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.off, self.parts = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.off += tag == "aside" or (tag == "span" and ("class", "ad") in attrs)
        if tag in ("p", "h1", "li", "div", "article"):
            self.parts.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "div", "article"):
            self.parts.append("")
        self.depth -= tag == "article"
        self.off -= tag == "aside" or tag == "span"

    def handle_data(self, data):
        if self.depth and not self.off:
            self.parts[-1] += data


@pytest.mark.parametrize("seed", range(6))
def test_html_against_another_parser(seed):
    rng = random.Random(seed)

    def words(n=4):
        return " ".join(rng.choices([*VOCABULARY, "&amp;", "&eacute;", "&#128578;", "  ", "\n"], k=n))

    def inner(depth=2):
        kinds = [f"<p>{words()}<b>{words(2)}</b>{words(1)}</p>", f"<h1>{words()}</h1>", f"<ul><li>{words()}</li><li>{words()}</li></ul>"]
        kinds += [f"<p>{words()} <span class='ad'>{words()}</span> {words()}</p>", f"<aside><p>{words()}</p></aside>"]
        return rng.choice([*kinds, f"<div class='has-menu'>{inner(depth - 1)}{inner(depth - 1)}</div>" if depth else kinds[0]])

    page = f"<body><nav>{words()}</nav><div class='wide-page'><article>{''.join(inner() for _ in range(12))}</article></div><footer>{words()}</footer></body>"
    other = Reader()
    other.feed(page)
    want = [" ".join(x.split()) for x in other.parts]
    assert [t for place, t in html_text.blocks(page) if place == "body"] == [x for x in want if x]


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li>menu one two</ul></nav><header>top of site</header><div class='cookie-notice'>we use cookies</div>"
    "<article><h1>T &amp; {0}</h1><p><b>First&nbsp;para {0}<br>line<p>Second   para\n{0}.<aside>see also</aside>"
    "<form>name <input></form><div class=ad>buy</div></article><section id='comments'><p>I agree</p></section>"
    "<footer>&copy; 2020</footer></body></html>"
)


def test_html_main_text(spark):
    bare = "<p>{0} {0}a {0}b</p><div>this very same sentence stands on every page of the host</div>"
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"n{i}")) for i in range(5)]
    rows += [(10 + i, f"http://g.example/{i}", bare.format(f"n{i}")) for i in range(4)]
    rows += [(20, None, None), (21, "", ""), (22, "::bad", "<p>a<!-- x"), (23, "http://k/", "<article>" + "word " * 30000 + "<script>x"), rows[0]]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, places int, host string")
    got = [(r["page_id"], r["text"]) for r in html_text.main_text(table, chunk=3).collect()]
    want = [(i, f"T & n{i}\n\nFirst para n{i} line\n\nSecond para n{i}.") for i in (0, 0, 1, 2, 3, 4)]
    by = sorted(got)
    assert [x for x in by if x[0] < 10] == want
    assert dict(by)[20] == dict(by)[21] == "" and dict(by)[22] == "a" and dict(by)[23] == ("word " * 30000).strip()
    whole = dict((r["page_id"], r["text"]) for r in html_text.main_text(table).collect())
    assert [whole[10 + i] for i in range(4)] == [f"n{i} n{i}a n{i}b" for i in range(4)]


PAGES = "page_id long, url string, html string"


def test_html_repeats_count_over_a_large_host(spark):
    """More pages than a chunk takes: a passage on two of them goes as it does on a small host."""
    n = 2 * html_text.CHUNK + 8
    own = [f"n{i} n{i}a n{i}b" for i in range(n)]
    every = "<div>this very same sentence stands on every page of the host</div>"
    twice = {p: f"<p>passage {p} k{p} l{p} m{p} o{p} p{p} q{p} r{p}</p>" for p in range(20)}  # on pages 2p and 100 + p
    article = "<article>passage 0 k0 l0 m0 o0 p0 q0 r0</article>"  # stays, as it is named an article
    rows = []
    for i in range(n):
        parts = [p for p, at in enumerate(zip(range(0, 40, 2), range(100, 120))) if i in at]
        rows.append((i, f"http://h.example/{i}", f"<p>{own[i]}</p>" + "".join(twice[p] for p in parts) + every + (article if i == 300 else "")))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: own[i] + ("\n\npassage 0 k0 l0 m0 o0 p0 q0 r0" if i == 300 else "") for i in range(n)}
    some = spark.createDataFrame(rows[:130], PAGES)
    whole = {r["page_id"]: r["text"] for r in html_text.main_text(some).collect()}
    assert {r["page_id"]: r["text"] for r in html_text.main_text(some, chunk=7).collect()} == whole


@pytest.mark.parametrize("url", [None, "no host", "http://my_blog.example.com/a", "http://h.example/a b|c", "http://[bad/"])
def test_html_hosts_of_odd_urls_are_split(spark, url):
    rows = [(i, url, f"<p>n{i} n{i}a</p>this very same sentence stands on every page here") for i in range(60)]
    parsed = spark.createDataFrame(rows, PAGES).mapInArrow(html_text._parse, html_text._BLOCKS)
    large, small, plain = html_text.by_size(parsed, 10)
    chunks = [r["count"] for r in large.groupBy("host", "chunk").count().collect()]
    assert sum(chunks) == 60 and len(chunks) > 3 and max(chunks) < 30
    assert small.count() == plain.count() == 0
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES), chunk=10).collect()}
    assert got == {i: f"n{i} n{i}a" for i in range(60)}


@pytest.mark.parametrize("seed", range(5))
def test_repeated_substrings(seed):
    rng = random.Random(seed)
    pages, tokens = [], []
    for p in range(6):
        own = [rng.randrange(3) for _ in range(rng.randrange(0, 40))]
        tokens += own
        pages += [p] * len(own)
    length = 8
    at = [i for i in range(len(tokens) - length + 1) if pages[i] == pages[i + length - 1]]
    seen: dict = {}
    for i in at:
        seen.setdefault(tuple(tokens[i : i + length]), set()).add(pages[i])
    want = np.zeros(len(tokens), bool)
    for i in at:
        if len(seen[tuple(tokens[i : i + length])]) > 1:
            want[i : i + length] = True
    assert (html_text.repeated(pages, np.array(tokens), length) == want).all()


# -- packing -----------------------------------------------------------------------------------------------------------
def test_token_ids_are_the_tokenizers():
    encode = TokenIds(packing.tokenizer_file())
    odd = ["", "a", "  a b", "a\n\nb", "a\tb c.d,e", "x<|endoftext|> y", "don't we'll 'tis", "a. b, c!? 12 34a", "a b", "naïve, Straße. 日本語", "éa b́.", "🙂 ok. 🙂", "a\rb", "²x. ½, b²", "a\x1cb c", "ß.\nß,", " ", "\n", ".", ",.", "a,.", "A.B."]
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert encode(odd) == want and encode(odd) == want


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice((5, 20, 50))) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in lengths}
    fill: dict[int, list[tuple[int, int]]] = {}
    for length, first, last, low, each, offset in packing.plan(counts, 50):
        for i in range(first, last):
            fill.setdefault(low + (i - first) // each, []).append((offset + (i - first) % each * length, length))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 50
    assert sorted(50 - sum(n for _, n in p) for p in fill.values()) == best_fit(lengths, 50)


def test_pack(spark):
    rows = [*some_texts(9, 40), *ODD[:-1], (800, "kat lon " * 3000)]
    packed = packing.pack(docs_of(spark, rows), keep_ids=True)
    got = packed.collect()
    encode = TokenIds(packing.tokenizer_file())
    want = sorted((i is None, i or 0, np.frombuffer(encode([t or ""])[0] + bytes(4), "<u4").tolist()) for i, t in rows)
    by: dict = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for i, _ in [x for x in rows if [r[0] for r in rows].count(x[0]) == 1]:
        ids = [x for p in sorted(by[i]) for x in p[2]]
        assert (i is None, i or 0, ids) in want
        assert [p[1] for p in sorted(by[i])] == np.cumsum([0] + [len(p[2]) for p in sorted(by[i])])[:-1].tolist()
    assert sum(r["length"] for r in got) == sum(len(w[2]) for w in want)
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(r["length"] for r in got) and all(len(r["ids"]) <= 2048 for r in joined)


# -- fixity ------------------------------------------------------------------------------------------------------------
def test_audit(spark):
    rng = random.Random(1)
    rows, place = [], {}
    for f in ("a", "b", None):
        at = 0
        for _ in range(200):
            record = rng.randbytes(rng.randrange(0, 400))
            rows.append((f, at, bytearray(record), 1))
            place[f, at] = len(rows) - 1
            at += len(record) + 1
    kind = "file string, offset long, record binary, node int"
    other = [list(r) for r in rows if rng.random() > 0.01]
    bad = {(r[0], r[1]): "missing" for r in rows} | {(r[0], r[1]): None for r in other}
    for r in other:
        if rng.random() < 0.01:
            r[2] = bytearray(b"?") + r[2]
            bad[r[0], r[1]] = "changed"
    other.append(["a", 10**6, bytearray(b"new"), 1])
    other.append(["c", 0, None, 1])
    bad |= {("a", 10**6): "extra", ("c", 0): "extra"}
    first, second = spark.createDataFrame([*rows, rows[0]], kind), spark.createDataFrame(other, kind)
    got = {(r["file"], r["offset"]): r["status"] for r in warc.audit(first, second, width=1000, fanout=4).collect()}
    assert got == {k: v for k, v in bad.items() if v}
    assert warc.audit(first, first).count() == 0
    assert warc.audit(first, first.limit(0)).count() == len(rows)


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://x/", "é"), (None, None, "")], "id long, url string, html string")
    got = [r[0] for r in pages.select(warc.response_record(F.col("id"), F.col("url"), F.col("html"))).collect()]
    assert got[0].endswith("Content-Length: 2\r\n\r\né\r\n\r\n") and "Content-Length: 0" in got[1]


# -- no rows, and the pipeline -----------------------------------------------------------------------------------------
def test_empty_tables(spark):
    docs = docs_of(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    events = spark.createDataFrame([], EVENT)
    assert quality(docs).count() == 0
    assert near_components(docs).count() == 0
    assert contamination(docs, bench).count() == 0
    assert contamination(docs_of(spark, [(1, "a")]), bench).first()["n_hit"] == 0
    assert pii.spans(docs, pii.fit(docs)).count() == 0
    assert chat.format_chats(events).count() == 0
    assert language.identify(docs, language.fit(docs.select("doc_id", "text", "lang"))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.score(docs, quality_classifier.fit(docs, labels)).count() == 0
    assert html_text.main_text(pages).count() == 0
    assert packing.pack(docs).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    bench = " ".join(rng.choices(VOCABULARY, k=30))

    def clean(n=60):
        return " ".join(w for _ in range(n // 3) for w in (*rng.choices(VOCABULARY, k=2), "the"))

    base = clean(90)
    rows = [(1, base), (2, base), (3, base + " kat"), (33, clean(75)), (33, clean(75)), (4, clean() + " " + bench), (5, "too short"), (6, "## " * 200)]
    rows += [(7, clean() + " write to x.y@example.org now"), (8, None), (9, " ".join(f"w{i} the" for i in range(4500))), (None, clean()), (None, clean() + " " + bench)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs_of(spark, rows).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        left.append({r["doc_id"] for r in docs.collect()})
    assert left == [{1, 2, 3, 4, 7, 9, 33, None}, {1, 4, 7, 9, 33, None}, {1, 7, 9, 33, None}, {1, 7, 9, 33, None}]
    assert docs.where(F.col("text").contains(bench)).count() == 0 and docs.count() == 6
    seven = docs.where("doc_id = 7").first()
    assert "<EMAIL>" in seven["text"] and "example" not in seven["text"] and seven["n_chars"] == len(seven["text"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {1, 7, 9, 33, None}
