"""Ranked search, collocations and toxicity against brute force, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import collocations, lexical, toxicity

LONG = " ".join(f"word{k % 700} is number {k % 90}" for k in range(60_000))
SCHEMA = "doc_id long, text string, lang string, raw int, n int, rank int, score string, seq string, word string"


def with_odd(rows):
    """``(id, text, lang)`` rows with clashing columns."""
    return [(i, t, lang, 0, 1, 2, "s", "q", "w") for i, t, lang in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "The quick brown fox", "en"),
        (1, "The quick brown fox", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \t\n.!?", "fr"),
        (None, "quick quick fox", "en"),
        (None, None, None),
        (5, LONG, "en"),
        (6, "QUICK Été fox-quick", None),
        (7, "fox", "und"),
    ]
    return spark.createDataFrame(with_odd(rows), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- ranked search ----------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked_by_hand(items, docs, top):
    """``(item, rank, doc, score)`` from the formula, every document for every item."""
    held = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 25 + (75 * c.total() * n_docs) // n_terms
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in terms.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def searched(spark, items, docs, **options):
    found = lexical.ranked_search(
        spark.createDataFrame(items, "item_id long, text string"), docs.repartition(3), **options
    )
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "quick fox quick"), (2, "word7 NUMBER 12 is"), (3, None), (4, "unheard"), (None, "été"), (1, "brown"), (5, "the")]


def test_search_on_odd_rows(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = ranked_by_hand(ITEMS, docs, 10)
    assert searched(spark, ITEMS, odd) == expected
    assert searched(spark, ITEMS, odd, block_bytes=10) == expected
    assert searched(spark, ITEMS, empty) == []
    assert searched(spark, [], odd) == []


@pytest.mark.parametrize("short_share", [1, 8, 10**9])
def test_shards_find_the_best(monkeypatch, short_share):
    """Any mix of accumulators and walked lists, with many ties and skipped windows."""
    monkeypatch.setattr(lexical, "WINDOW", 64)
    monkeypatch.setattr(lexical, "SHORT_SHARE", short_share)
    rng = np.random.default_rng(3)
    docs, terms = 1500, 40
    held = rng.random((docs, terms)) < rng.random(terms) ** 3
    of, term = np.nonzero(held)
    values = rng.integers(1, 6, len(of)) * np.where(of < 200, 5, 1)
    order = rng.permutation(len(of))
    order = order[np.argsort(of[order], kind="stable")]
    shard = lexical.Shard(docs, of[order], term[order], values[order])
    dense = np.zeros((docs, terms), np.int64)
    dense[of, term] = values
    for _ in range(40):
        item = {int(t): int(w) for t, w in zip(rng.choice(terms, 9, replace=False), rng.integers(0, 9, 9))}
        total = sum(w * dense[:, t] for t, w in item.items())
        best = np.lexsort((np.arange(docs), -total))[:10]
        best = best[total[best] > 0]
        found = lexical.search_shard(shard, item, 10, 0)
        assert found[0].tolist() == best.tolist()
        assert found[1].tolist() == total[best].tolist()
        floor = int(total[best[4]]) if len(best) > 4 else 1
        kept = lexical.search_shard(shard, item, 10, floor)
        assert kept[0].tolist() == [d for d in best.tolist() if total[d] >= floor]


def test_search_in_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in (rng.random(rng.integers(1, 60)) ** 3 * 80).astype(int)) for _ in range(600)]
    docs = [(i // 2, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 90, 12))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert searched(spark, items, df, top=7) == ranked_by_hand(items, docs, 7)


# --- collocations -----------------------------------------------------------------------


def phrases_by_hand(rows, min_count, longest, top):
    totals, counts = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    often = {k: a for k, a in counts.items() if a >= min_count}
    out = {}
    for (lang, ws), a in often.items():
        if len(ws) < 2:
            continue
        inside = any(
            lg == lang and len(longer) > len(ws) and f >= a and any(longer[i : i + len(ws)] == ws for i in range(len(longer)))
            for (lg, longer), f in often.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = often[lang, ws[:k]], often[lang, ws[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted(
        (lang, r + 1, p.decode(), -a, left, right, totals[lang], -s)
        for lang, best in out.items()
        for r, (s, a, p, left, right) in enumerate(sorted(best)[:top])
    )


def mined(df, **options):
    found = collocations.collocations(df, **options)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def chatter():
    rng = np.random.default_rng(9)
    phrases = ["new york city", "a b a b a", "the the the", "São Paulo", "x\ty", "once upon a time there"]
    rows = []
    for k in range(300):
        words = [f"w{int(x)}" for x in rng.random(12) ** 2 * 15]
        words.insert(int(rng.integers(0, 12)), phrases[k % len(phrases)])
        rows.append((k, (" " if k % 3 else ". ").join(words), ["en", "fr", None, "und"][k % 4]))
    return rows


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_collocations(spark, chatter, odd, held):
    rows = chatter + [(r["doc_id"], r["text"], r["lang"]) for r in odd.filter("doc_id is null or doc_id <> 5").collect()]
    df = spark.createDataFrame(with_odd(rows), SCHEMA).repartition(3)
    expected = phrases_by_hand([r[1:] for r in rows], 5, 5, 40)
    assert len({r[0] for r in expected}) == 3 and max(len(r[2].split()) for r in expected) == 5
    assert mined(df, min_count=5, top=40, held_numbers=held) == expected


def test_collocations_of_odd_tables(spark, odd, empty):
    assert mined(empty) == []
    assert mined(odd.filter("doc_id in (2, 3, 4)")) == []
    text = LONG.translate(LOWER)
    assert mined(odd, min_count=150, top=25) == phrases_by_hand([(text, "en")] + [
        (r["text"], r["lang"]) for r in odd.filter("doc_id is null or doc_id <> 5").collect()
    ], 150, 5, 25)


def test_tiles_count_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(collocations, "DENSE_TILES", 3)
    rng = np.random.default_rng(4)
    counts = collocations.TileCounts(tile=8, buffer=2_000, held=900)
    expected, got = Counter(), Counter()
    for _ in range(30):
        a = (rng.random(700) ** 4 * 200).astype(np.int64) + 1
        b = (rng.random(700) ** 2 * 90).astype(np.int64) + 1
        pairs = a << 32 | b
        expected.update(pairs.tolist())
        for part in counts.add(pairs):
            for p, n in zip(*(x.tolist() for x in part)):
                got[p] += n
    assert len(counts.names) == 3
    for part in counts.rest():
        for p, n in zip(*(x.tolist() for x in part)):
            got[p] += n
    assert got == expected


def test_compact_keeps_runs():
    numbers = np.array([0, 0, 5, 0, 1, 2, 0, 0, 0, 3, 3, 3, 0, 4], np.int32)
    assert collocations.compact(numbers).tolist() == [1, 2, 0, 3, 3, 3, 0]
    assert collocations.compact(np.array([1, 2])).tolist() == [1, 2]
    assert collocations.compact(np.array([7])).tolist() == []


def test_sequences_are_cut_in_gaps_alone():
    rng = np.random.default_rng(5)
    numbers = np.where(rng.random(40_000) < 0.04, 0, rng.integers(1, 900, 40_000)).astype(np.int32)
    numbers[20_000:22_000] = 7
    chunks = list(collocations._packed(numbers[at : at + 777] for at in range(0, len(numbers), 777)))
    rows = [np.frombuffer(r.as_py(), np.int32) for chunk in chunks for r in chunk["seq"]]
    assert all(r[-1] == 0 for r in rows)
    assert sorted(len(r) for r in rows)[-2] < collocations.ROW_NUMBERS + 300 and max(map(len, rows)) >= 2_000
    whole = collocations.compact(np.append(numbers, np.int32(0)))
    assert np.concatenate(rows).tolist() == whole.tolist()
    assert np.concatenate(list(collocations._sequences(iter(chunks)))).tolist() == whole.tolist()


def test_collocations_hold_one_block_of_numbers(spark, chatter, monkeypatch):
    """Tables beyond what a task may hold are read in blocks, and never joined by row."""
    rows = chatter[:150]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    parts, packed = [], collocations._pairs_packed
    monkeypatch.setattr(collocations, "_pairs_packed", lambda part: parts.append(len(part)) or packed(part))
    assert mined(df, min_count=3, longest=3, top=50, held_numbers=100) == phrases_by_hand([r[1:] for r in rows], 3, 3, 50)
    assert len(parts) > 1 and max(parts) == 100


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**12, 10**13, 10**12 + 1, 10**12 + 3)], "n long, a long, l long, r long")
    score = row.select(collocations._score(F.col("n"), F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert score == 1000 * 10**25 // ((10**12 + 1) * (10**12 + 3))


# --- toxicity ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, folded",
    [
        (None, " "),
        ("", " "),
        ("$$$ 123 !", " "),
        ("You IDIOT!", " you idiot "),
        ("1d10t cl0wn tr@sh", " idiot clown trash "),
        ("іdіоt", " idiot "),
        ("ＩＤＩＯＴ", " idiot "),
        ("ïd​i­öt", " idiot "),
        ("trash### idiot$$$ “moron”", " trash idiot moron "),
        ("in 2024 at 7", " in at "),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_longest_entry_counts_and_exceptions_void():
    lexicon = toxicity.Lexicon({" trash": 2.0, " trashy ": 5.0, " idiot ": 4.0}, [" trashcan ", " idiot savant "])
    assert lexicon.found(" trash trashy trashcan idiot savant idiot ") == {0: (6, 2.0), 6: (8, 5.0), 35: (7, 4.0)}
    naive = {" a": 1.0, " ab": 2.0, " abc ": 3.0}
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(300)]
    folded = " " + " ".join(words) + " "
    found = sum(w for _, w in toxicity.Lexicon(naive).found(folded).values())
    by_hand = 0.0
    for word in words:
        fits = [p for p in naive if f" {word} ".startswith(p)]
        by_hand += naive[max(fits, key=len)] if fits else 0.0
    assert found == by_hand


@pytest.fixture(scope="module")
def judged():
    """Documents of plain words, one in five with insults, some of them disguised."""
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("lm", "rn", "st", "nd")]
    bad = ["blockhead", "numbskull", "dimwit", "clod"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, rng.integers(20, 90)))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        elif i % 23 == 0:
            words.insert(3, "sweet clod earth")
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_a_lexicon(spark, judged, odd, empty):
    rows, labels = judged
    docs = spark.createDataFrame(with_odd(rows), SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1), (0, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert {" blockhead ", " dimwit "} <= set(model.lexicon.weights)
    assert {" clod ", " sweet clod ", " clod earth "} <= {*model.lexicon.weights, *model.lexicon.exceptions}
    truth = dict(labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held)
    disguised = model.scores(["balm dand fern " * 6 + "d1mw1t Ьlосkhеаd", "balm dand fern " * 7])
    assert disguised[0] >= 0.7 > disguised[1]
    # Labels of the held-out fold teach nothing.
    turned = [(i, 1 - t if r["held_out"] else t) for (i, t), r in zip(labels, sorted(got, key=lambda r: r["doc_id"]))]
    again = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert again.lexicon.weights == model.lexicon.weights and np.allclose(again.curve, model.curve)
    # The model depends on the rows, not on their order; repeated rows teach once.
    twice = toxicity.fit(docs.union(docs.filter("doc_id < 40")).repartition(5), known)
    assert twice.lexicon.weights == model.lexicon.weights and np.allclose(twice.curve, model.curve)
    told = {(r["doc_id"], r["score"]) for r in toxicity.scores(odd, model).collect()}
    assert len([x for x in told if x[0] == 1]) == 1
    assert {i for i, _ in told} == {1, 2, 3, 4, 5, 6, 7, None}
    assert toxicity.scores(empty, model).count() == 0


def test_toxicity_without_labels(spark, odd):
    one_kind = spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(odd, one_kind) is None
    assert toxicity.fit(odd, one_kind.limit(0)) is None
    rows = toxicity.scores(odd, None).collect()
    assert len(rows) == 10 and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
