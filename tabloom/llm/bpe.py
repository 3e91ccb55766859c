"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of a word's tree holds the rank of the pair that begins at a symbol; the
root holds the lowest rank, and going down to the left on ties yields the leftmost
such pair.  A merge changes three leaves and their paths, until the root is empty.
Words of one batch that are not yet known are merged together, one row of arrays per
word; longer words get a tree of their own.

The vocabulary is a tokenizer file whose path is a parameter; the file must be at that
path on every executor.  Its special tokens are recognised in the text as the file
says, without adding any.

Defined results: a null text counts as empty and has no ids; an empty list of ids
decodes to the empty text.  Repeated rows are encoded alike, other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabloom.llm.ship import ship

EMPTY = np.iinfo(np.int32).max
# Words of up to this many symbols are merged together.
TOGETHER = 256
# Cells of the trees that are worked at once.
CELLS_AT_ONCE = 1_000_000
# Words of a generation that a Python worker remembers, and characters encoded at once.
REMEMBERED = 150_000
CHARS_AT_ONCE = 1_000_000
# Texts whose ids are held at once where only digests are wanted.
TEXTS_AT_ONCE = 512
# Characters whose case, composition and class are the same in all Unicode versions in
# use; other texts go through the tokenizer file's own normalizer and splitter.
SETTLED = regex.compile(
    "[^\u0000-ԯ‐-⁠぀-ゖァ-ヺ一-龥가-힣]"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes are themselves, the others count up from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """Merges, symbols and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [""] * self.size
        for token, number in vocab.items():
            self.tokens[number] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, number in self.special.items():
            self.tokens[number] = token
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._index(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        split = [p["pattern"]["Regex"] for p in steps if p["type"] == "Split"]
        self.words = regex.compile(split[0]) if split else None
        # Words of this and of the former generation, so that common words stay.
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    # Text to words

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, as they are merged."""
        if SETTLED.search(text) is None:
            # The library lowers letter by letter, without the final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return self.words.findall(text)
        text = self.library.normalizer.normalize_str(text)
        letters = {c: b for b, c in enumerate(byte_letters())}
        return [
            bytes(letters[c] for c in piece).decode("utf-8", "surrogateescape")
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)
        ]

    def split(self, text: str) -> list[str | tuple]:
        if not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str | tuple] = []
        longest = sorted(self.special, key=len, reverse=True)
        for part in re.split(f"({'|'.join(map(re.escape, longest))})", text):
            # A special token stands apart from words as a tuple.
            out.extend([(part,)] if part in self.special else self.pieces(part))
        return out

    # Words to ids

    def _index(self, keys: np.ndarray) -> None:
        """An open table of pair keys, probed one slot further until all have a place."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + len(keys), -1, np.int64)
        self.slot_ranks = np.full(len(self.slots), EMPTY, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]
            placed = self.slots[at] == keys[left]
            self.slot_ranks[at[placed]] = left[placed]
            left, at = left[~placed], at[~placed] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = self._slot(key)
        held = self.slots.take(at)
        rank = self.slot_ranks.take(at)
        other = held != key
        rank[other] = EMPTY
        on = np.flatnonzero(other & (held >= 0))
        at, key = at[on], key[on]
        while len(on):
            at = at + 1
            held = self.slots.take(at)
            other = held != key
            rank[on[~other]] = self.slot_ranks.take(at[~other])
            more = other & (held >= 0)
            at, key, on = at[more], key[more], on[more]
        return rank

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """Ids (packed) of words of similar length.

        Every word has a row of ``width + 1`` symbols and of ``2 * width`` tree nodes;
        all rows take their next merge at the same time.
        """
        count = len(words)
        sizes = np.array([len(w) for w in words])
        width = 1
        while width < max(int(sizes.max()) - 1, 1):
            width *= 2
        rows = np.arange(count)
        inside = np.arange(width + 1) < sizes[:, None]
        raw = np.zeros((count, width + 1), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        symbols[rows, sizes - 1] = self.final[raw[rows, sizes - 1]]
        trees = np.full((count, 2 * width), EMPTY, np.int32)
        paired = inside[:, 1:]
        trees[:, width:][paired] = self.pair_ranks(symbols[:, :-1][paired], symbols[:, 1:][paired])
        level = width
        while level > 1:
            trees[:, level // 2 : level] = np.minimum(
                trees[:, level : 2 * level : 2], trees[:, level + 1 : 2 * level : 2]
            )
            level //= 2
        # Flat views; a symbol's neighbours are flat positions too.
        symbol, alive, tree = symbols.ravel(), inside.ravel(), trees.ravel()
        place = np.arange(count * (width + 1))
        after, before = place + 1, place - 1
        stop = rows * (width + 1) + sizes

        def put(base: np.ndarray, leaf: np.ndarray, rank) -> None:
            node = leaf + width
            tree[base + node] = rank
            step = width
            while step > 1:
                node = node >> 1
                below = base + 2 * node
                tree[base + node] = np.minimum(tree.take(below), tree.take(below + 1))
                step >>= 1

        row = rows[trees[:, 1] != EMPTY]
        while len(row):
            base = row * (2 * width)
            origin = row * (width + 1)
            lowest = tree.take(base + 1)
            node = np.ones(len(row), np.int64)
            level = 1
            while level < width:
                node = 2 * node
                node += tree.take(base + node) != lowest
                level *= 2
            at = origin + node - width
            gone = after.take(at)
            then = after.take(gone)
            made = self.merged.take(lowest)
            symbol[at] = made
            alive[gone] = False
            after[at] = then
            more = np.flatnonzero(then < stop.take(row))
            has = np.flatnonzero(at > origin)
            before[then[more]] = at[more]
            prior = before.take(at[has])
            found = self.pair_ranks(
                np.concatenate((made[more], symbol.take(prior))),
                np.concatenate((symbol.take(then[more]), made[has])),
            )
            # The removed symbol's leaf empties unless it was the last symbol's, which has none.
            leaf = np.flatnonzero(gone - origin < width)
            own = np.full(len(row), EMPTY, np.int32)
            own[more] = found[: len(more)]
            put(
                np.concatenate((base, base[leaf], base[has])),
                np.concatenate((at - origin, (gone - origin)[leaf], prior - origin[has])),
                np.concatenate((own, np.full(len(leaf), EMPTY, np.int32), found[len(more) :])),
            )
            row = row[tree.take(base + 1) != EMPTY]
        packed = symbol[alive].astype("<u4").tobytes()
        ends = np.cumsum(inside.sum(axis=1)) * 4
        return [packed[s:e] for s, e in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]

    def merge_alone(self, word: bytes) -> bytes:
        """Ids (packed) of one long word."""
        symbol = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbol[-1] = int(self.final[word[-1]])
        n, size, rank_of = len(symbol), self.size, self.rank_of
        width = 1 << max(n - 2, 0).bit_length()
        tree = [EMPTY] * (2 * width)
        for k in range(n - 1):
            tree[width + k] = rank_of.get(symbol[k] * size + symbol[k + 1], EMPTY)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, rank: int) -> None:
            node = leaf + width
            tree[node] = rank
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        merged = self.merged
        while width > 0 and (lowest := tree[1]) != EMPTY:
            node = 1
            while node < width:
                node *= 2
                node += tree[node] != lowest
            at = node - width
            gone = after[at]
            then = after[gone]
            symbol[at] = made = int(merged[lowest])
            symbol[gone] = -1
            after[at] = then
            if then < n:
                before[then] = at
                put(at, rank_of.get(made * size + symbol[then], EMPTY))
            else:
                put(at, EMPTY)
            if gone < width:
                put(gone, EMPTY)
            if (prior := before[at]) >= 0:
                put(prior, rank_of.get(symbol[prior] * size + made, EMPTY))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def learn(self, words: set[str | tuple]) -> None:
        """Merge the words that are not remembered yet."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.former, self.known = self.known, {}
            new = words
        again = new & self.former.keys()
        self.known.update((w, self.former[w]) for w in again)
        new = new - again
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for word in new:
            if isinstance(word, tuple):
                self.known[word] = np.array([self.special[word[0]]], "<u4").tobytes()
                continue
            raw = word.encode("utf-8", "surrogateescape")
            if len(raw) > TOGETHER:
                self.known[word] = self.merge_alone(raw)
            else:
                groups.setdefault(max(len(raw) - 2, 0).bit_length(), []).append((word, raw))
        for bits, members in groups.items():
            at_once = max(1, CELLS_AT_ONCE >> (bits + 1))
            for k in range(0, len(members), at_once):
                part = members[k : k + at_once]
                merged = self.merge_together([raw for _, raw in part])
                self.known.update(zip((word for word, _ in part), merged))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        chunk: list[list[str]] = []
        held = 0

        def finish() -> None:
            self.learn(set().union(*chunk))
            known = self.known.__getitem__
            out.extend(b"".join(map(known, words)) for words in chunk)
            chunk.clear()

        for text in texts:
            chunk.append(self.split(text) if text else [])
            held += len(text or "")
            if held >= CHARS_AT_ONCE:
                finish()
                held = 0
        finish()
        return out

    def decode(self, packed: bytes | None) -> str:
        """Tokens joined by spaces: the file names no decoder, so word ends stay."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed or b"", "<u4").tolist()])


@lru_cache(maxsize=4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode(text, path: str):
    """Ids of a text column as little-endian unsigned 32-bit integers (binary)."""
    ship()

    @arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for batch in batches:
            yield pa.array(bpe.encode(batch.to_pylist()), pa.binary())

    return ids(text)


def decode(ids, path: str):
    """The text that a column of packed ids decodes to, special tokens included."""
    ship()

    @arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for batch in batches:
            yield pa.array([bpe.decode(x) for x in batch.to_pylist()], pa.string())

    return text(ids)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(text, path: str):
    """Struct column of ``DIGESTS``: each text is encoded, decoded from its ids, and
    both are hashed before the next slice of texts is taken up."""
    ship()

    @arrow_udf(DIGESTS)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                for ids in bpe.encode(batch.slice(at, TEXTS_AT_ONCE).to_pylist()):
                    back = bpe.decode(ids).encode()
                    rows.append(
                        (len(ids) >> 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                    )
            columns = list(zip(*rows)) if rows else [[], [], []]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digest(text)


def token_digests(docs, path: str, doc_id: str = "doc_id", text: str = "text"):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), digests(body, path).alias("d")).select("doc_id", "d.*")
