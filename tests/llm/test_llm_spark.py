"""The operators on Spark: defined results for odd rows, and brute force on small tables."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import bpe, chat, langid, mixing, pii, repetition, simhash, token_counts, topk, warc
from tabloom.llm.matches import matches

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long,"
    " fingerprint string, spans string, rank int, tokens long"
)
LONG = " ".join(f"word{k} is number {k}" for k in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog near river bank today " * 1
    filler = " ".join(f"tok{k}" for k in range(60))
    rows = [
        (1, base + filler, "en", "src0"),
        (1, base + filler, "en", "src0"),
        (2, base + filler + " end", "en", None),
        (3, None, None, "src1"),
        (4, "", "fr", "src1"),
        (5, " \n\t", None, "src2"),
        (None, "mail a.b@c.de and +44 20 7946 0958 now", "de", "src3"),
        (None, None, None, None),
        (6, LONG, "en", "src0"),
        (7, "x", "xx", "other"),
    ]
    full = [(i, t, lg, s, len(t or ""), 0, "f", "s", 1, 2) for i, t, lg, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = {int(i): [float(np.float32(x)) for x in rng.normal(size=6).round(1)] for i in range(0, 240)}
    rows = [(i, v, 0) for i, v in vectors.items()] + [
        (500, None, 0), (550, [1.0, float("nan")], 0), (600, [None, 1.0], 0), (650, [float("inf")], 0), (None, [1.0], 0), (700, [], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(7)
    valid, terms, weights = topk.sparse(F.col("embedding"))
    good = df.filter(valid).select(F.col("vec_id").alias("id"), terms.alias("terms"), weights.alias("weights"))
    got = topk.search(good.filter("id % 50 = 0"), good, 5, block_rows=32).collect()
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors.items()} | {700: np.zeros(6, int)}
    want = []
    for q in (0, 50, 100, 150, 200, 700):
        order = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)
    # Repeated candidate rows fill ranks of their own; repeated query rows are one query.
    twice = good.filter("id in (0, 3)").union(good.filter("id in (0, 3)"))
    got = topk.search(twice.filter("id = 0"), twice, 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got)] == [(1, 3), (2, 3)]
    assert topk.search(good.limit(0), good.limit(0), 5).count() == 0


def chat_digest(turns):
    said = [(r or "", t or "") for r, t in turns]
    learned = "".join(t for r, t in said if r == "assistant")
    return (
        len(said),
        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
        len(learned),
        hashlib.sha256(learned.encode()).hexdigest(),
    )


def test_chat_folds_events(spark):
    events = [
        (1, 0, 0, "open", "user", "hi </s>"),
        (1, 0, 3, "edit", "user", "hello <s>"),
        (1, 1, 4, "open", "assistant", ""),
        (1, 1, 5, "delta", None, "wrong"),
        (1, 1, 6, "regenerate", None, ""),
        (1, 1, 7, "delta", None, "good "),
        (1, 1, 8, "delta", None, "<\\/s> day"),
        (2, 5, 0, None, None, None),
        (None, 1, 0, "open", "assistant", "é" * 1200),
        (None, 2, 0, "delta", "assistant", "late"),
    ]
    log = spark.createDataFrame(events, "conv_id long, no int, seq int, kind string, role string, text string").repartition(3)
    parts = chat.formatted(log, ["no"])
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(parts).collect()}
    assert got == {
        1: chat_digest([("user", "hello <s>"), ("assistant", "good <\\/s> day")]),
        2: chat_digest([("", "")]),
        None: chat_digest([("assistant", "é" * 1200), ("assistant", "late")]),
    }
    assert chat.read_back(chat.formatted(log.limit(0), ["no"])).count() == 0


def test_derived_log_edits_and_regenerates(spark):
    """Drafts of all kinds fold back to the table; columns that clash do not matter."""
    rows = [
        (c, t, ["user", "assistant", None][t % 3], None if (c, t) == (3, 1) else f"said {c} {t} </s> " * (t * 7), 1, "x")
        for c in range(40)
        for t in range(8)
    ]
    rows += [rows[9], (None, 0, "assistant", "é" * 900, 1, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, seq int, kind string")
    log = chat.log_of_turns(table.repartition(5))
    kinds = {(r["kind"], r["role"] == "assistant"): r["count"] for r in log.groupBy("kind", "role").count().collect()}
    assert min(kinds[k] for k in [("edit", True), ("edit", False), ("regenerate", True), ("delta", True), ("open", False)]) > 5
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.formatted(log, chat.MESSAGE_ORDER)).collect()}
    by_conv = {}
    for c, t, role, text, *_ in rows:
        by_conv.setdefault(c, []).append((t, role or "", text or ""))
    assert got == {c: chat_digest([(role, text) for _, role, text in sorted(said)]) for c, said in by_conv.items()}
    empty = spark.createDataFrame([], table.schema)
    assert chat.log_of_turns(empty).count() == 0


def test_chat_long_conversation_in_parts(spark, monkeypatch):
    turns = [(1, k, ["user", "assistant", "system"][k % 3], f"t{k} " * (k % 50)) for k in range(2000)]
    turns += [(1, 7, "user", "same"), (1, 7, "user", "same"), (2, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    monkeypatch.setattr(chat, "PART_CHARS", 500)
    parts = chat.formatted(chat.log_of_turns(df), chat.MESSAGE_ORDER)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(parts).collect()}
    rows = [t for t in turns if t[0] == 1]
    rows.sort(key=lambda t: (t[1], t[2]))
    # The assistant's turn 7 precedes the two user rows of the same number by role.
    assert got[1] == chat_digest([(t[2], t[3]) for t in rows])
    assert got[2] == chat_digest([("", "")])
    assert parts.filter("conv_id = 1").count() > 10


def test_token_counts(spark, odd, empty):
    docs = odd.select("doc_id", "text", "tokens", F.coalesce("text", F.lit("")).alias("txt"))
    docs = matches(docs, "txt", "runs", r"[0-9]{2,}+|\x20{2,}+", None)
    edits = F.expr("transform(runs, r -> struct(r.start as start, r.end as end, '0' as new))")
    docs = docs.select("text", edits.alias("edits"))
    counted = token_counts.edited_counts(F.col("text"), F.col("edits"), BYTES, public_tokenizers.PATTERN)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    for r in docs.select("text", F.size("edits"), counted.alias("c")).collect():
        assert r["c"]["n_tokens"] == size(r["text"])
        assert r["c"]["n_tokens_edited"] == size(re.sub("[0-9]{2,}| {2,}", "0", r["text"] or ""))
    none = token_counts.edited_counts(F.col("text"), F.expr("cast(null as array<struct<start:int,end:int,new:string>>)"), BYTES, public_tokenizers.PATTERN)
    assert all(r[0]["n_encoded"] == 0 for r in odd.select(none).collect())
    assert empty.select(none).count() == 0


def test_near_duplicates(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(3) == 1 and 4 not in ids and 5 not in ids
    assert simhash.keep_one_each(empty).count() == 0


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 40])
def test_near_duplicates_against_brute_force(spark, tile_rows):
    import random

    rnd = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(40):
        first = [rnd.choice(words) for _ in range(rnd.randint(1, 150))]
        texts.append(" ".join(first))
        for _ in range(rnd.randint(0, 6)):
            other = list(first)
            other[rnd.randrange(len(other))] = rnd.choice(words)
            texts.append(" ".join(other))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df, tile_rows=tile_rows).collect()}
    fps = simhash.fingerprints([t.encode() for t in texts], 3)
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == f"{int(fps[i]):016x}"
        assert got[i]["component_id"] == label[i]
    kept = sorted(r["doc_id"] for r in simhash.keep_one_each(df, tile_rows=tile_rows).collect())
    assert kept == sorted(set(label))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (5, 5)], "node long, root long")
    roots = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
    assert {roots[k] for k in range(1, 301)} == {0} and roots[901] == 900 and 0 not in roots


def test_mixing(spark, odd, empty):
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"prose": 1.0}}
    rows = [
        (k, "some words of text here", "x" if k % 4 else "y", "a" if k % 10 else "b") for k in range(20_000)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.report(df, targets, budget=0.1).collect()
    total = sum(r["n_tokens"] for r in out)
    assert abs(total - 0.1 * 5 * 20_000) < 0.1 * 0.1 * 5 * 20_000
    for column in ("source", "lang"):
        for value in targets[column]:
            share = sum(r["n_tokens"] for r in out if r[column] == value) / total
            assert abs(share - 0.5) < 0.03
    again = mixing.report(df.repartition(5), targets, budget=0.1)
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in out}
    kept = mixing.sampled(odd)
    assert kept.columns == odd.columns and kept.count() <= 10
    assert mixing.report(odd, budget=1.0).count() == 10
    assert mixing.sampled(empty).count() == 0 and mixing.report(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.fit(odd, {k: {str(v): 1.0 for v in range(2000)} for k in ("lang", "source")})


def test_mixing_reaches_targets_of_the_query(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.report(docs).cache()
    total = docs.agg(F.sum(mixing.tokens("text"))).first()[0]
    assert abs(rows.agg(F.sum("n_tokens")).first()[0] / total - mixing.BUDGET) < 0.02
    for r in mixing.reached(rows).collect():
        assert abs(r["share"] - mixing.TARGETS[r["dimension"]][r["value"]]) < 0.012, r
    counts = lambda df: {tuple(r) for r in df.groupBy("doc_id").count().collect()}
    assert counts(mixing.sampled(docs)) == counts(rows)
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 3)
    assert sorted(mixing.report(docs).collect()) == sorted(rows.collect())


def test_redaction_keeps_contact_topic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    contact = docs.filter(mixing.topic("text") == "contact")
    assert contact.count() > 10
    clean = pii.redacted(contact, n_chars=None)
    assert clean.filter(mixing.topic("text") != "contact").count() == 0
    assert clean.filter("contains(text, '[EMAIL]') and not contains(text, '@')").count() > 0
    with pytest.warns(UserWarning, match="without tokens.*topic contact"):
        mixing.plan([("src0", "en", "prose", 9)], mixing.TARGETS)


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    got = langid.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got.count() > 100 and right > 0.97
    # Labels, sources and ids of the predicted rows have no influence.
    blind = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("q").alias("lang"))
    same = langid.predictions(blind, model).select((F.col("doc_id") - 7).alias("doc_id"), F.col("lang_pred").alias("p"))
    assert langid.predictions(docs, model).join(same, "doc_id").filter("lang_pred <> p").count() == 0
    rows = langid.predictions(odd, langid.fit(odd)).collect()
    assert len(rows) == 10
    for r in rows:
        assert 0 <= r["score"] <= 1
    assert sorted(r["lang_pred"] for r in rows).count("und") == 4
    assert langid.fit(empty) is None and langid.predictions(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predictions(odd, None).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word(spark):
    """Ninety languages, and the weights of their classifiers recomputed from the texts."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:02}": ["".join(rng.choice(letters, 4)) for _ in range(12)] for k in range(90)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 90:02}"], 30)), f"l{i % 90:02}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 90 and model.code.shape == (90, 65)
    got = langid.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    counts = np.zeros((90, langid.BUCKETS))
    learned = {r[0] for r in docs.filter(langid.fold("doc_id") != 0).select("doc_id").collect()}
    for i, text, lang in rows:
        if i in learned:
            for bucket, _ in langid._grams_by_text([text.encode()]):
                counts[int(lang[1:])] += np.bincount(bucket, minlength=langid.BUCKETS)
    rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * langid.BUCKETS)
    for bit in (0, 30, 64):
        on = model.code[:, bit] > 0
        expected = np.log(rate[on].mean(axis=0)) - np.log(rate[~on].mean(axis=0))
        np.testing.assert_allclose(model.weights[:, bit], expected, rtol=1e-4, atol=1e-5)


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "un deux trois", "fr") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predictions(docs, langid.fit(docs)).collect()} == {("fr", 1.0)}


def test_quality(spark, odd, empty):
    rows = repetition.with_verdict(odd, out="quality").select("doc_id", "text", "quality.*").collect()
    assert len(rows) == 10
    for r in rows:
        words = (r["text"] or "").split()
        assert r["n_words"] == len(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    kept = repetition.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 6]
    filler = " ".join(f"w{k}" for k in range(400))
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"{filler} {passage} x {passage}", f"{passage} x {passage} {' '.join(f'v{k}' for k in range(60))}", f"{filler} {filler[:600]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    # A short passage twice is kept; one that covers half, and one of many words, are not.
    assert [r["doc_id"] for r in repetition.keep_good(df).collect()] == [0]
    assert repetition.keep_good(empty).count() == 0


def test_bpe(spark, odd, empty):
    library = Tokenizer.from_file(WORDS)
    coded = odd.select("text", bpe.encode(F.col("text"), WORDS).alias("ids"))
    for r in coded.select("text", "ids", bpe.decode(F.col("ids"), WORDS).alias("back")).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["back"] == library.decode(ids, skip_special_tokens=False)
    texts = [r["text"] for r in odd.collect()]
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(tuple(r)[1:] for r in bpe.token_digests(odd, WORDS).collect()) == sorted(want)
    assert bpe.token_digests(empty, WORDS).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark, odd, empty):
    import random

    rnd = random.Random(13)
    texts = [
        "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 01.002.3.0004", "4111 1111 1111 1111", "4111111111111111 5",
        "..a@b.c..d@e.f@g.h", "é +44 20 7946 0958 ü a.b@c.d-e.fr", "5" * 3000, "1 " * 9000, "a" * 30_000, "+1" + "2" * 3000, None, "",
        " ".join(f"u{i}@x.yz 1.2.3.{i % 300}" for i in range(1500)),
    ]
    texts += ["".join(rnd.choice("a1.2@+- 4()\né") for _ in range(rnd.randint(0, 100))) for _ in range(200)]
    texts += ["".join(rnd.choice("0123456789  -") for _ in range(rnd.randint(10, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = pii.span_digests(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    assert pii.span_digests(odd).count() == 10 and pii.span_digests(empty).count() == 0
    clean = pii.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == 10
    texts = {r["text"]: r["n_chars"] for r in clean.collect()}
    assert texts["mail [EMAIL] and [PHONE] now"] == len("mail [EMAIL] and [PHONE] now")
    assert pii.redacted(empty).count() == 0


def test_pii_finds_unseen(spark):
    rows = [(i, f"lorem ipsum please call us at +1 (555) {i}-1234 today ok") for i in range(100, 130)]
    rows += [(i, f"dolor sit call us at 555-{i}-9876 soon") for i in range(200, 205)]
    rows += [(i, f"page number {i} of the book 12345678") for i in range(300, 320)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.span_digests(df).collect()}
    assert all(got[i]["spans"] == "phone:21:33" and got[i]["n_phone"] == 0 for i in range(200, 205))
    assert all(got[i]["spans"] == "" for i in range(300, 320))
    plan = pii.span_digests(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pii_finds_unseen_beside_numbers_and_base_spans(spark):
    rows = [(i, f"lorem ipsum please call us at +1 (555) {i}-1234 today ok") for i in range(100, 130)]
    rows += [(i, f"the contact jane{i}@x{i}.com +1 (555) {i}-4321 holds") for i in range(130, 160)]
    tails = {
        200: ("dolor call us at ", "555-123-4567", " 10 x2"), 201: ("dolor call us at ", "555-123-4567", " 4013"),
        202: ("sit call us at ", "(555) 123-4567", " soon"), 203: ("call us at bob@y.org ", "555-123-4567", " soon"),
        204: ("the contact bob@y.org ", "555-123-4567", " holds"), 205: ("call us at ", "555 123 4567", " 12"),
    }
    rows += [(i, "".join(parts)) for i, parts in tails.items()]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (left, phone, _) in tails.items():
        assert got[i][-1] == f"phone:{len(left)}:{len(left) + len(phone)}", (i, got[i])
        assert len(got[i]) == 1 + ("@" in left)


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [
        (1, "http://a/", big, 9), (2, None, big, 9), (2, None, big, 9), (3, "u", "small", 9), (4, "u", "small", 9),
        (5, "u", None, 9), (6, "u", "", 9), (None, "u", big, 9), (7, "http://x y\r\n", big + "x", 9),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    index = warc.write(df, str(tmp_path / "w"), frame_bytes=2000, bundle_bytes=3000)
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(index).collect())
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        again = html == big and i != 2
        want.append((str(i) if i else "null", "revisit" if again else "response", "2" if again else None, len(body), hashlib.sha1(body).hexdigest()))
    assert got == sorted(want, key=lambda r: r[:2] + (r[2] or "",) + r[3:]) or got == sorted(want)
    (head, block), = warc.fetch(index, ["7"])
    assert block.endswith((big + "x").encode()) and head["WARC-Target-URI"] == "http://x%20y%0D%0A"
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_with_a_hot_payload(spark, tmp_path):
    """A third of the pages share one payload; reading takes several tasks."""
    rows = [(i, "u", "<hot>" * 300 if i % 3 == 0 else f"<p>{i}</p>" * 150) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    index = warc.write(df, str(tmp_path / "w"), frame_bytes=20_000, bundle_bytes=60_000)
    found = warc.read(index)
    assert found.rdd.getNumPartitions() == 8
    assert found.groupBy(F.spark_partition_id()).count().count() > 1
    got = {int(r["record_id"]): (r["record_type"], r["refers_to"]) for r in found.collect()}
    assert got == {i: ("revisit", "897") if i % 3 == 0 and i != 897 else ("response", None) for i in range(900)}


def test_pipeline_stages(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, empty):
            assert stage(spark, docs, "").columns == docs.columns, name
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "pii", "source_mixing", "bpe"]


def test_pipeline_against_single_steps(spark):
    folder = "/root/testdata/sf0.001"
    got = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    rows = repetition.measure([t.encode() for t in docs["text"]])
    m = {f: rows[:, k] for k, f in enumerate(repetition.FIELDS)}
    good = (m["n_words"] >= 50) & (2 * m["n_repeat_words"] <= m["n_words"]) & (100 * m["covered_words"] <= 30 * m["n_words"]) & (m["longest_repeat"] <= 60)
    docs = docs[good].sort_values("doc_id")
    fps = simhash.fingerprints([t.encode() for t in docs["text"]], 3)
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.array([label[np.bitwise_count(fps ^ f) <= 3].min() for f in fps])
        if (new == label).all():
            break
        label = new
    docs = docs[label == np.arange(len(fps))]
    marks = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

    def redact(text):
        out, at = [], 0
        for s, e, k in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in base_spans(text)):
            if s >= at:
                out += [text[at:s], marks[k]]
                at = e
            at = max(at, e)
        return "".join(out) + text[at:]

    docs["text"] = docs["text"].map(redact)
    library = Tokenizer.from_file(WORDS)
    sampled = mixing.sampled(spark.createDataFrame(docs)).toPandas()
    want = set()
    for i, t in zip(sampled["doc_id"], sampled["text"]):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want


HELPERS = [
    "__quality", "__measures", "__fingerprint", "__fp", "__keep_id", "__keep_fp", "__row", "__id", "__key", "__own",
    "__spans", "__new", "__cell", "__n", "__p", "__weight", "__index", "fp", "root", "key", "found", "kind", "rows",
    "copies", "best", "base", "quality", "a.b", "doc id", "c0", "c1",
]


@pytest.mark.parametrize(
    "stage", [repetition.keep_good, simhash.keep_one_each, pii.redacted, mixing.sampled], ids=lambda f: f.__name__
)
def test_columns_named_like_helpers_pass_through(spark, stage):
    prose = " ".join(f"word{k}" for k in range(80))
    rows = [(k, f"{prose} {k} a{k}@b.org" if k % 3 else prose, "en", "src1", 9) for k in range(30)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string, n_chars int")
    wide = docs.select(*[F.lit(c).alias(c) for c in HELPERS], "*")
    out = stage(wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert got and all(tuple(r)[: len(HELPERS)] == tuple(HELPERS) for r in got)
    assert sorted(tuple(r)[len(HELPERS) :] for r in got) == sorted(map(tuple, stage(docs).collect()))


def test_pii_finds_secrets_by_their_words(spark):
    import random

    rnd = random.Random(3)
    value = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    fill = lambda: "".join(rnd.choice("bcdfghklm") for _ in range(6))
    rows = [(i, f'{fill()} token = "{value()}" {fill()}') for i in range(60)]
    rows += [(i, f'{fill()} token = "{value().upper()}"!! {fill()}') for i in range(60, 64)]
    # Long words elsewhere, short numbers after the same word: neither is a secret.
    rows += [(i, f"{fill()} {value()} {fill()} token 12 {fill()} {value().upper()}") for i in range(64, 67)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(df).collect()}
    assert all(got[i] == "secret:16:56" for i in range(64)) and not any(got[i] for i in range(64, 67))
    text = {r["doc_id"]: r["text"] for r in pii.redacted(df, n_chars=None).collect()}
    assert all('token = "[SECRET]"' in text[i] for i in range(64)) and text[64] == rows[64][1]


def test_pii_pattern_scores_against_brute_force(spark):
    """The same rounds over dictionaries."""
    import math
    import random

    rnd = random.Random(5)
    strings = [f"+1555000{n}" for n in range(30)] + [f"555-010{n}" for n in range(10)] + [f"x{n}" for n in range(20)]
    rows = []
    for _ in range(600):
        n = rnd.randrange(60)
        place = rnd.choice([0, 1, 1] if n < 30 else [1, 2] if n < 40 else [2, 2, 2, 1])
        pattern = rnd.choice([["L|call", "2|please call"], ["L|ring", "1|ring|at", "L|call"], ["R|pages", "2|see the"]][place])
        rows.append((strings[n], [k == "phone" and n < 30 for k in pii.ALL_KINDS], [pattern]))
    spots = spark.createDataFrame(rows, "found string, known array<boolean>, patterns array<string>")
    got = {r["pattern"]: r for r in pii.pattern_scores(spots, 3, 0.6, 5).collect()}
    edges = {(f, p) for f, _, ps in rows for p in ps}
    at = pii.ALL_KINDS.index("phone")
    seed = {f: float(known[at]) for f, known, _ in rows}
    fits = {f: 7 <= len(re.sub("[^0-9]", "", f)) <= 15 and bool(re.fullmatch("[0-9 ()./+-]+", f)) for f in seed}
    score = dict(seed)
    for _ in range(3):
        hits, wrong = {}, {}
        for f, p in edges:
            hits[p] = hits.get(p, 0) + score[f]
            wrong[p] = wrong.get(p, 0) + (0.5 if fits[f] else 1.0) * (1 - score[f])
        conf = {p: hits[p] / (hits[p] + wrong[p] + 0.25) for p in hits}
        strong = {p for p in hits if conf[p] >= 0.6 and hits[p] >= (20 if p[:2] in ("L|", "R|") else 5)}
        doubt = {}
        for f, p in edges:
            if p in strong and fits[f]:
                doubt[f] = doubt.get(f, 0.0) + math.log(1 - min(conf[p], 0.99))
        score = {f: max(s, 1 - math.exp(doubt.get(f, 0.0))) for f, s in seed.items()}
    assert strong and set(got) == set(hits) and any(0 < s < 1 for s in score.values())
    for p, r in got.items():
        assert math.isclose(r["conf_phone"], conf[p], abs_tol=1e-9) and math.isclose(r["hits_phone"], hits[p], abs_tol=1e-9)


def test_pii_many_spans_in_a_text(spark):
    """Walks over spans go in blocks: a text of thousands gives what its parts give."""
    parts = [f"user{i}@mail{i % 7}.example.com" if i % 3 else f"10.0.{i % 256}.{i % 200}" for i in range(10_000)]
    text = " é ".join(parts)
    want = base_spans(text)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.span_digests(df).collect()[0]
    assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and r["spans"] == ",".join(want)
    clean = pii.redacted(df, n_chars=None).collect()[0]["text"]
    assert clean == " é ".join("[EMAIL]" if i % 3 else "[IP]" for i in range(10_000))


def test_mixing_draws_rows_of_one_id_apart(spark):
    rows = [(None if k % 3 else 7, f"some words of text {k}", "x", "a") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"x": 1.0}}
    out = mixing.report(df, targets, budget=0.25)
    assert abs(out.count() - 1500) < 150 and out.filter("doc_id is null").count() > 800
    assert mixing.sampled(df, targets, budget=0.25).count() == out.count()


def test_mixing_report_against_brute_force(spark):
    """Cells, raked weights and copies of the query's rows, recomputed one by one."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def topic(text):
        count = lambda signs: sum(text.count(s) for s in signs)
        if "@" in text or re.search(r"\+[0-9]", text) or any(m in text for m in pii.MARKS):
            return "contact"
        if count("{};=") and count("{};=") * mixing.CODE_EVERY >= len(text):
            return "code"
        return "list" if count("|*#") and count("|*#") * mixing.LIST_EVERY >= len(text) else "prose"

    cells, sums = {}, {}
    hashed = docs.select("*", mixing.draw([F.col("doc_id"), F.xxhash64("text")]).alias("u")).collect()
    for r in hashed:
        text = r["text"] or ""
        cell = tuple(v if v in mixing.TARGETS[d] else "rest" for d, v in zip(mixing.TARGETS, (r["source"], r["lang"], topic(text))))
        n = len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", text))
        cells[r["doc_id"]] = (cell, n, r["u"])
        sums[cell] = sums.get(cell, 0) + n
    total = sum(sums.values())
    weight = {c: n / total for c, n in sums.items()}
    for _ in range(3000):
        for axis, shares in enumerate(mixing.TARGETS.values()):
            have = {}
            for c, w in weight.items():
                have[c[axis]] = have.get(c[axis], 0) + w
            rest = sum(n for c, n in sums.items() if c[axis] == "rest") / total
            there = {v: g for v, g in shares.items() if have.get(v)}
            goal = {v: g / sum(there.values()) * (1 - rest) for v, g in there.items()} | {"rest": rest}
            weight = {c: w * goal[c[axis]] / have[c[axis]] if have[c[axis]] else w for c, w in weight.items()}
    got = {}
    for r in mixing.report(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert (r["source"], r["lang"], r["topic"]) == cells[r["doc_id"]][0] and r["n_tokens"] == cells[r["doc_id"]][1]
    for key, (cell, _, u) in cells.items():
        p = mixing.BUDGET * (weight[cell] * total / sums[cell] if sums[cell] else 1)
        if abs(u - p % 1) > 1e-6:
            assert got.get(key, 0) == int(p) + (u < p % 1), (key, cell, p)
