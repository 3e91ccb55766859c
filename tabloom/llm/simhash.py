"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Every distinct fingerprint is compared with every other one, in bounded tiles, except
where the population counts of two tiles (of the whole fingerprint between tiles, of
its 16-bit parts within a task) already differ by more than the radius.  The result is
therefore exact.  A task gives a spanning forest of the links it found, never the pairs
of a group, and the forests are merged by star contraction on Spark.

Defined results: a null or empty text has no words and fingerprint zero, linked like
any other.  Repeated rows give repeated result rows with the same component.  A null
``doc_id`` is never a component's smallest id unless all of its ids are null.  Other
columns of the input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabloom.functions.sizing import cut_lineage
from tabloom.llm.places import by_place
from tabloom.llm.ship import ship

# Fingerprints in one tile; a task holds two tiles (2 x 1 MB) and what links them.
TILE_ROWS = 131_072
# Rows of the blocks that are compared at once inside a task.
BLOCK_ROWS = 256
# Shingle hashes whose bits are counted at once, and bytes of text split at once.
HASHES_AT_ONCE = 131_072
TEXT_AT_ONCE = 4_000_000
HASH_SEED = 42

_SPACES = bytes(range(9, 14))
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + _SPACES, bytes(range(97, 123)) + b" " * len(_SPACES)
)


def _word_lists(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a folded text in lists that share their last ``size - 1`` words."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + TEXT_AT_ONCE
        if end < len(text):
            cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut
        words = held + text[at:end].split()
        at = end
        if len(words) < size and at < len(text):
            held = words
            continue
        yield words
        held = words[len(words) - size + 1 :] if size > 1 else []


def shingle_hashes(text: bytes | None, size: int) -> Iterator[list[int]]:
    """XXH64 of every shingle of a text, in lists; a short text is one shingle."""
    digest = xxhash.xxh64_intdigest
    first = True
    for words in _word_lists((text or b"").translate(_FOLD), size):
        if len(words) >= size:
            yield [
                digest(b" ".join(x), HASH_SEED) for x in zip(*(words[k:] for k in range(size)))
            ]
        elif words and first:
            yield [digest(b" ".join(words), HASH_SEED)]
        first = False


def fingerprints(texts: list[bytes | None], size: int) -> np.ndarray:
    """The unsigned 64-bit fingerprints of the texts."""
    total = np.zeros(len(texts), np.int64)
    ones = np.zeros((len(texts), 64), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def count() -> None:
        if not hashes:
            return
        bits = np.unpackbits(
            np.array(hashes, np.dtype("<u8")).view(np.uint8).reshape(-1, 8),
            axis=1,
            bitorder="little",
        )
        docs = np.array([k for k, _ in owners])
        lengths = np.array([n for _, n in owners])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        np.add.at(ones, docs, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
        np.add.at(total, docs, lengths)
        hashes.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for found in shingle_hashes(text, size):
            for at in range(0, len(found), HASHES_AT_ONCE):
                part = found[at : at + HASHES_AT_ONCE]
                hashes.extend(part)
                owners.append((k, len(part)))
                if len(hashes) >= HASHES_AT_ONCE:
                    count()
    count()
    set_bits = 2 * ones > total[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.dtype("<u8")).reshape(-1)


def with_fingerprint(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in a column ``__fingerprint`` (long)."""
    ship(docs.sparkSession)

    @arrow_udf("long")
    def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(fingerprints(batch.to_pylist(), size).view(np.int64))

    return docs.withColumn("__fingerprint", fingerprint(F.col(text).cast("binary")))


class Forest:
    """Union-find over row numbers, fed with arrays of links."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._count = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self._waiting.append((a, b))
        self._count += len(a)
        if self._count >= 1_000_000:
            self.flush()

    def flush(self) -> None:
        if not self._waiting:
            return
        a = np.concatenate([x for x, _ in self._waiting])
        b = np.concatenate([x for _, x in self._waiting])
        self._waiting, self._count = [], 0
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(above := root[root], root):
                root[:] = above


def _parts(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class _Tile:
    """Fingerprints ordered by the counts of their parts, cut into blocks."""

    def __init__(self, values: np.ndarray):
        values = np.ascontiguousarray(values)
        parts = _parts(values)
        order = np.lexsort(parts.T[::-1])
        self.values = values[order]
        parts = parts[order]
        starts = np.arange(0, len(values), BLOCK_ROWS)
        self.blocks = [(s, min(s + BLOCK_ROWS, len(values))) for s in starts]
        self.low = np.minimum.reduceat(parts, starts, axis=0)
        self.high = np.maximum.reduceat(parts, starts, axis=0)


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int):
    """``(node, root)`` of a forest that joins what lies within ``radius`` bits.

    ``right`` is None when a tile is compared with itself.
    """
    a = _Tile(left)
    b = a if right is None else _Tile(right)
    shift = 0 if right is None else len(left)
    forest = Forest(len(left) + (0 if right is None else len(right)))
    for i, (s, e) in enumerate(a.blocks):
        gap = np.maximum(b.low - a.high[i], a.low[i] - b.high).clip(min=0).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if right is None:
            near = near[near >= i]
        mine = a.values[s:e, None]
        for j in near:
            s2, e2 = b.blocks[j]
            roots_a, roots_b = forest.root[s:e], forest.root[s2 + shift : e2 + shift]
            if roots_a[0] == roots_b[0] and (roots_a == roots_a[0]).all():
                if (roots_b == roots_a[0]).all():
                    continue
            hit = np.bitwise_count(mine ^ b.values[None, s2:e2]) <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                forest.link(x + s, y + s2 + shift)
    forest.flush()
    values = a.values if right is None else np.concatenate([a.values, b.values])
    node = np.flatnonzero(forest.root != np.arange(len(forest.root)))
    return values[node], values[forest.root[node]]


def near_links(
    distinct: DataFrame, fingerprint: str, radius: int, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """``(node, root)`` links that connect fingerprints within ``radius`` bits.

    ``distinct`` holds each fingerprint (long) once.  What comes to the driver is one
    count per population count, 65 rows at most.
    """
    rows = distinct.select(F.col(fingerprint).alias("fp"))
    rows = rows.withColumn("ones", F.bit_count("fp"))
    ship(distinct.sparkSession)
    counts = {r["ones"]: r["n"] for r in rows.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    tiles = [-(-counts.get(p, 0) // tile_rows) for p in range(65)]
    first = np.concatenate(([0], np.cumsum(tiles)))
    # Tiles are numbered by population count, so the partners of a tile are a range.
    table = F.array(
        *(
            F.struct(
                F.lit(int(first[p])).alias("first"),
                F.lit(max(tiles[p], 1)).alias("tiles"),
                F.lit(int(first[max(p - radius, 0)])).alias("low"),
                F.lit(int(first[min(p + radius, 64) + 1]) - 1).alias("high"),
            )
            for p in range(65)
        )
    )
    spread = (
        rows.withColumn("t", F.element_at(table, F.col("ones") + 1))
        .withColumn("tile", F.col("t.first") + F.pmod(F.xxhash64("fp"), F.col("t.tiles")).cast("int"))
        .select(
            "fp",
            "tile",
            F.explode(F.sequence("t.low", "t.high")).alias("partner"),
        )
        .select(
            F.least("tile", "partner").alias("lo"),
            F.greatest("tile", "partner").alias("hi"),
            (F.col("tile") > F.col("partner")).alias("is_right"),
            "fp",
        )
    )

    def compare(group: pa.Table) -> pa.Table:
        values = group["fp"].to_numpy().view(np.uint64)
        is_right = group["is_right"].to_numpy()
        same = group["lo"][0].as_py() == group["hi"][0].as_py()
        left, right = values[~is_right], values[is_right]
        if len(left) == 0 or (not same and len(right) == 0):
            node = root = np.empty(0, np.uint64)
        else:
            node, root = link_tiles(left, None if same else right, radius)
        return pa.table({"node": node.view(np.int64), "root": root.view(np.int64)})

    return spread.groupBy("lo", "hi").applyInArrow(compare, "node long, root long")


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of each component, by star contraction.

    Large and small stars alternate until the links no longer change; each pass is two
    partial aggregates and two joins, and is cut off by a reliable checkpoint.
    """
    edges = cut_lineage(
        links.filter("node <> root")
        .select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
        .distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            return edges
        before = tuple(state)
        both = edges.union(edges.select(F.col("root"), F.col("node")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = (
            both.join(least, "node")
            .filter("root > node")
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
            .distinct()
        )
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").select(
            F.greatest("root", "least").alias("node"), F.least("root", "least").alias("root")
        )
        own = least.select("node", F.col("least").alias("root"))
        edges = cut_lineage(small.filter("node <> root").union(own).distinct())


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 3,
    radius: int = 3,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, group_root``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest id that links
    reach, ``group_root`` a fingerprint (hex) that names the component.
    """
    marked = cut_lineage(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", size)
        .select("doc_id", F.col("__fingerprint").alias("fp"))
    )
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = connected(near_links(distinct, "fp", radius, tile_rows))
    rooted = distinct.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least_id"
    )
    groups = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(groups, "root")
    return marked.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.lpad(F.lower(F.hex("root")), 16, "0").alias("group_root"),
    )


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id.

    Rows that repeat that id are told apart by their text hash and then by a number
    given within the (few) rows that share both.  Columns stay as they are.
    """
    columns = docs.columns
    docs, (doc_id, text) = by_place(docs, doc_id, text)
    found = near_duplicates(docs, doc_id, text, **options)
    best = found.groupBy("group_root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint")).alias("best"),
        F.count("*").alias("rows"),
    )
    keep = best.select(F.col("best.doc_id").alias("__keep_id"), F.col("best.fingerprint").alias("__keep_fp"), "rows")
    # Ids that occur once need no further look at the texts.
    ids = found.groupBy("doc_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    single = keep.join(ids, F.col("__keep_id").eqNullSafe(ids["doc_id"]), "left_anti").select("__keep_id")
    several = keep.join(ids, F.col("__keep_id").eqNullSafe(ids["doc_id"]), "left_semi").select(
        "__keep_id", "__keep_fp"
    )
    names = docs.columns
    once = docs.join(single, F.col(doc_id).eqNullSafe(F.col("__keep_id")), "left_semi")
    rest = docs.join(several, F.col(doc_id).eqNullSafe(F.col("__keep_id")), "left_semi")
    rest = with_fingerprint(rest, text, options.get("size", 3)).withColumn(
        "__fp", F.lpad(F.lower(F.hex("__fingerprint")), 16, "0")
    )
    rest = rest.join(
        several,
        F.col(doc_id).eqNullSafe(several["__keep_id"]) & (F.col("__fp") == several["__keep_fp"]),
        "left_semi",
    )
    first = rest.groupBy(F.col(doc_id).alias("__id"), "__fp").agg(
        F.first(F.struct(*(F.col(c) for c in names))).alias("__row")
    )
    return once.union(first.select("__row.*")).toDF(*columns)
