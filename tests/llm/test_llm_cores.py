"""The operators' cores against brute force, without Spark."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tabloom.llm import bpe, chat, langid, mixing, repetition, simhash, token_counts, topk, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "",
    "a",
    "Hello  World's it's 123 <|startoftext|> ok<|endoftext|>x é ß",
    "ΟΔΟΣ Σ Σα",
    "é ẞ Ǆ \U0001d400 ՘ İ",
    "\x85 \x1c   tab\tline\n",
    "ab" * 700,
    "z" * 257,
    "1234 's't're'",
    "汉字 かな 한글 🙂🙂",
    "  ",
]


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(WORDS)


def random_text(rnd, n):
    return "".join(rnd.choice("abcdeé 'st.,!  \n12İΣ") for _ in range(n))


def test_bpe_equals_library(coder):
    library = Tokenizer.from_file(WORDS)
    rnd = random.Random(5)
    texts = TEXTS + [random_text(rnd, rnd.randint(0, 80)) for _ in range(300)]
    for text, packed in zip(texts, coder.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert coder.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_bpe_forms_agree(coder):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aehinorst") for _ in range(rnd.randint(1, 60))).encode() for _ in range(200)]
    assert [coder.merge_alone(w) for w in words] == [coder.merge_together([w])[0] for w in words]
    assert coder.merge_together(words[:50]) == [coder.merge_alone(w) for w in words[:50]]


def test_bpe_forgets_and_learns_again(coder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    fresh = bpe.Bpe(WORDS)
    texts = ["one two three four five six", "six seven eight one", "one two"]
    assert fresh.encode(texts) == coder.encode(texts)
    assert [fresh.encode([t])[0] for t in texts] == coder.encode(texts)


def brute_repeats(words):
    n = len(words)

    def cover(size):
        count = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return {p for i in range(n - size + 1) if count[tuple(words[i : i + size])] > 1 for p in range(i, i + size)}

    longest = 0
    for size in range(2, n):
        if max(Counter(tuple(words[i : i + size]) for i in range(n - size + 1)).values()) < 2:
            break
        longest = size
    return len(cover(3)), len(cover(10)), longest


def test_repetition_against_brute_force():
    rnd = random.Random(7)
    texts = [
        b" ".join(rnd.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rnd.randint(0, 120))) for _ in range(150)
    ]
    passage = b" ".join(b"w%d" % k for k in range(70))
    texts += [b"", b" \n\t", b"a " * 90, passage + b" x " + passage, "é\n\né\né x [#]&".encode(), b"a\x0bb\x0cc"]
    for text, row in zip(texts, repetition.measure(texts)):
        got = dict(zip(repetition.FIELDS, row.tolist()))
        words = re.findall(r"[^\x20\x09-\x0D]+", text.decode())
        assert got["n_words"] == len(words)
        assert got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text.decode()))
        lines = [x for x in text.decode().split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert (got["n_repeat_words"], got["covered_words"], got["longest_repeat"]) == brute_repeats(words)


def test_repetition_does_not_depend_on_chunks(monkeypatch):
    texts = [b"a b c d a b c d", b"a b c", None, b"x y z x y z"] * 3
    whole = repetition.measure(texts)
    monkeypatch.setattr(repetition, "WORDS_AT_ONCE", 4)
    assert (repetition.measure(texts) == whole).all()


def brute_fingerprint(text, size=3):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    grams = grams or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    rnd = random.Random(8)
    texts = ["", " ", "A b", "one", "x y z", "É e a\x0bb"] + [random_text(rnd, rnd.randint(0, 400)) for _ in range(60)]
    raw = [t.encode() for t in texts]
    want = [brute_fingerprint(t) for t in texts]
    assert simhash.fingerprints(raw, 3).tolist() == want
    assert simhash.fingerprints([None], 3).tolist() == [0]
    monkeypatch.setattr(simhash, "TEXT_AT_ONCE", 5)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 3)
    assert simhash.fingerprints(raw, 3).tolist() == want


def components(values, links):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_tiles_lose_no_link():
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [s ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for s in seeds for b, c in rng.integers(0, 64, (12, 2))]
    values = np.unique(np.concatenate([seeds, np.array(near, np.uint64), np.array([0, 7, 15], np.uint64)]))
    rng.shuffle(values)
    links = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 3]
    node, root = simhash.link_tiles(values, None, 3)
    assert components(values.tolist(), zip(node.tolist(), root.tolist())) == components(values.tolist(), links)
    half = len(values) // 2
    parts = [simhash.link_tiles(values[:half], values[half:], 3)]
    parts += [simhash.link_tiles(x, None, 3) for x in (values[:half], values[half:])]
    found = [(int(a), int(b)) for n, r in parts for a, b in zip(n, r)]
    assert components(values.tolist(), found) == components(values.tolist(), links)


def test_escaping_is_reversible():
    rnd = random.Random(10)
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "s>", "/", "x", "\n"]
    for _ in range(2000):
        turns = [
            (rnd.choice(["user", "assistant", "", "</s>"]), "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 12))))
            for _ in range(rnd.randint(0, 4))
        ]
        text = "".join(chat.render(*t)[0] for t in turns)
        assert list(chat.turns(text)) == turns
        for role, said in turns:
            rendered, span = chat.render(role, said)
            assert (span is not None) == (role == "assistant")
            if span:
                assert chat.unescape(rendered[slice(*span)]) == said


def test_codes_and_decoding():
    for count in (2, 4, 7, 12):
        code = langid.codewords(count)
        gaps = [(code[a] != code[b]).sum() for a in range(count) for b in range(a)]
        assert min(gaps) >= max(1, code.shape[1] // 4)
        assert all(abs(column.sum()) < count for column in code.T)
        model = langid.Model([str(k) for k in range(count)], code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]))
        best, score = model.decode(code * 3)
        assert best.tolist() == list(range(count)) and ((score > 0) & (score <= 1)).all()
    assert langid.codewords(1).shape == (1, 0)


def test_gram_sums_do_not_depend_on_pieces(monkeypatch):
    weights = np.random.default_rng(3).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    texts = ["the cat".encode(), None, b"", "él niño 12 x".encode() * 20, b"q"]
    whole = langid.gram_sums(texts, weights)
    for text, row in zip(texts, whole):
        raw = b" " + (text or b"").translate(langid._OTHER) + b" "
        two, three = langid.grams(np.frombuffer(raw, np.uint8))
        assert row[-1] == len(two) + len(three)
        assert np.allclose(row[:-1], weights[two].sum(axis=0) + weights[three].sum(axis=0), atol=1e-3)
    monkeypatch.setattr(langid, "BYTES_AT_ONCE", 7)
    split = langid.gram_sums(texts, weights)
    assert np.allclose(split[:, -1], whole[:, -1]) and np.allclose(split, whole, atol=1e-3)


def test_raking():
    rng = np.random.default_rng(1)
    mass = rng.uniform(1, 100, (4, 3, 2))
    mass[1, 1, 0] = 0
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.2, 0.5, 0.3]), np.array([0.7, 0.3])]
    fitted = mixing.rake(mass, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(fitted.sum(axis=tuple(a for a in range(3) if a != axis)), goal, atol=1e-7)
    # Raking keeps the odds ratios of the first table.
    start = mass / mass.sum()
    ratio = lambda t: t[0, 0, 1] * t[2, 2, 1] / (t[0, 2, 1] * t[2, 0, 1])
    assert np.isclose(ratio(start), ratio(fitted))
    p = mixing.probabilities(mass, fitted * mass.sum() / np.where(mass > 0, mass, 1), 0.5)
    assert np.isclose((mass * p).sum(), 0.5 * mass.sum()) and p.max() <= 1


def test_mixing_plan_keeps_rest():
    targets = {"source": {"a": 1.0, "b": 1.0}, "lang": {"x": 1.0}}
    made = mixing.plan([("a", "x", 90), ("b", "x", 10), ("rest", "x", 100), ("rest", "rest", 0)], targets, 1.0)
    fitted = made.mass * made.weight / made.mass.sum()
    assert np.allclose(fitted.sum(axis=1), [0.25, 0.25, 0.5])
    assert mixing.plan([], targets).probability.shape == (3, 2)


def test_mixing_plan_reaches_targets_and_budget():
    # A value of 2% is to have 30%: at most 2.5% without repeated rows.
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.5, "y": 0.5}}
    made = mixing.plan([("a", "x", 10), ("a", "y", 10), ("b", "x", 90), ("b", "y", 890)], targets)
    drawn = made.mass * made.copies
    assert np.isclose(drawn.sum(), mixing.BUDGET * 1000) and made.copies.max() > 1
    assert all(np.isclose(after, goal, atol=1e-6) for _, _, _, goal, after in made.reached())
    with pytest.warns(UserWarning, match="contradict"):
        made = mixing.plan([("a", "x", 10), ("b", "y", 90)], targets)
    assert made.copies.max() <= 1 and np.isclose((made.mass * made.copies).sum(), 80)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(BYTES, public_tokenizers.PATTERN)


def test_edited_counts_equal_full_counts(counter):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rnd = random.Random(11)
    letters = "abc d\n\n  't'reé1!"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 400)))
        tree = token_counts.TokenTree(counter, counter.split(text))
        assert tree.total == len(library.encode(text, add_special_tokens=False).ids)
        for _ in range(rnd.randint(1, 5)):
            start = rnd.randint(0, len(text))
            end = min(len(text), start + rnd.choice([0, 0, 1, 3, 40]))
            new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 30])))
            tree.replace(start, end, new)
            text = text[:start] + new + text[end:]
            assert tree.text() == text
            assert tree.total == len(library.encode(text, add_special_tokens=False).ids), (text, start)
            assert sum(tree.tokens[tree.width :]) == tree.total


def test_edits_touch_little(counter):
    text = "the quick brown fox " * 2000
    tree = token_counts.TokenTree(counter, counter.split(text))
    tree.replace(20_000, 20_001, "XY")
    assert tree.encoded < 20


def test_topk_block_against_brute_force():
    rng = np.random.default_rng(12)
    for density in (0.1, 1.0):
        dense = rng.integers(-3, 4, (200, 12)) * (rng.uniform(size=(200, 12)) < density)
        ids = rng.permutation(200).astype(np.int64)
        rows = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense]
        block = topk.Block(
            ids,
            np.array([len(t) for t, _ in rows]),
            np.concatenate([t for t, _ in rows]),
            np.concatenate([w for _, w in rows]).astype(np.int64),
        )
        for q in range(0, 200, 7):
            got = block.best(int(ids[q]), rows[q][0].tolist(), rows[q][1].tolist(), 5)
            scores = dense @ dense[q]
            order = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:5]
            assert sorted((-int(s), int(i)) for i, s in zip(*got)) == order


def test_warc_bundle_round_trip(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}", frame_bytes=300, bundle_bytes=1500)
    made = {}
    index = []
    for k in range(30):
        body = (f"<p>é{k}</p>\r\n\r\n" * (k % 5)).encode()
        digest = hashlib.sha1(body).hexdigest()
        refers = "3" if k % 7 == 6 else None
        url = None if k % 4 == 0 else f"http://x/ {k}\r\nEvil: 1"
        writer.add(str(k), warc.record(str(k), url, None if refers else body, digest, len(body), refers))
        made[str(k)] = (str(k), "revisit" if refers else "response", refers, len(body), digest)
    writer.close()
    for row in zip(*writer.take().to_pydict().values()):
        index.append(row)
    assert len({r[1] for r in index}) > 1
    for name, uri, frame, offset, length in index:
        bundle = warc.Bundle(uri)
        data = bundle.frame(frame)
        head, block, end = warc.parse(data, offset)
        assert end - offset == length and "Evil" not in head
        assert warc.described(head, block) == made[name]
        bundle.close()
    # Whole bundles are plain Zstandard too.
    import zstandard

    path = index[0][1].removeprefix("file://")
    with open(path, "rb") as file:
        plain = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == sum(r[1] == index[0][1] for r in index)
