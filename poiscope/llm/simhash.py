"""Near-duplicate documents by fingerprints at a small Hamming distance, found through pivot distance tables.

A document's fingerprint has a bit set where over half of the XXH64 hashes of its shingles have it. Every
distinct fingerprint gets a table of its Hamming distances to fixed reference fingerprints (pivots): zero, and
one pivot per pair of neighbouring bits. By the triangle inequality two fingerprints that differ in at most two
bits have tables that differ by at most two in every coordinate, so a larger difference discards a pair;
survivors are verified by counting differing bits.

Not all pairs are looked at. The pivots fall into three thirds over disjoint bits. Two differing bits leave one
third untouched, where the two tables say the same, so fingerprints meet only in cells of equal distances over a
third. A large cell is cut into parts by hash, and each pair of parts is a tile of its own, so no task gathers a
cell whole. A tile hands on links enough to connect what is linked (a forest), never all pairs; components are then
closed over distinct fingerprints. Copies share a fingerprint and are never compared.

Defined results: a null text, or one without words, has fingerprint zero and is linked like any other; fewer
words than a shingle form one shingle, the whole sequence. Rows that repeat an id keep a row each. A row without
id has a fingerprint and links others; its component is the smallest id reachable, null if none is. Only id and
text are read; no other column name matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from poiscope.llm.boosting import written
from poiscope.llm.components import components, per_slice, slice_of, slices_seen
from poiscope.llm.words import byte_words

SEED = 42
BITS = 2  # largest distance of a link; the three thirds below hold for two
PART = 2048
AT_ONCE = 1 << 15

#: Reference fingerprints: zero, then each pair of neighbouring bits.
PIVOTS = np.array([0] + [3 << b for b in range(0, 64, 2)], np.uint64)
#: Pivots of each third; their bits are disjoint between thirds.
THIRDS = [range(1, 12), range(12, 23), range(23, 33)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the bits of all shingle hashes, repeats included."""
    found = byte_words(text)
    if not found:
        return 0
    size = min(words, len(found))
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths)[: len(found) - size + 1].tolist()
    stops = stops[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), AT_ONCE):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + AT_ONCE], stops[i : i + AT_ONCE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every pivot."""
    return np.stack([np.bitwise_count(prints ^ p) for p in PIVOTS], axis=1).astype(np.int8)


def cells(table: np.ndarray) -> list[np.ndarray]:
    """For each third, a number that is equal where its pivots tell two fingerprints alike.

    A pivot's distance less that of zero says how many of the pivot's two bits are set: 0, 1 or 2.
    """
    held = (table[:, :1] + 2 - table[:, 1:]) // 2
    return [held[:, [p - 1 for p in third]].astype(np.int64) @ 3 ** np.arange(len(third)) for third in THIRDS]


def close_pairs(tile: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs within equal values of `tile`, which is sorted: neighbours, then neighbours but one, .."""
    table = distance_table(prints)
    at, step = np.arange(len(prints)), 1
    while len(at):
        at = at[: np.searchsorted(at, len(prints) - step)]
        at = at[tile[at] == tile[at + step]]
        i = at[np.abs(table[at, 0] - table[at + step, 0]) <= BITS]
        for k in range(0, len(i), AT_ONCE):
            a = i[k : k + AT_ONCE]
            a = a[np.abs(table[a] - table[a + step]).max(axis=1, initial=0) <= BITS]
            a = a[np.bitwise_count(prints[a] ^ prints[a + step]) <= BITS]
            if len(a):
                yield a, a + step
        step += 1


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the pairs, those that join two trees."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(a), top(b)
            if x != y:
                above[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def _placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        prints = f["print"].to_numpy()
        for third, cell in enumerate(cells(distance_table(prints.view(np.uint64)))):
            yield pd.DataFrame({"third": np.full(len(f), third), "cell": cell, "print": prints})


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the tiles of a partition sorted by tile; the last tile of a batch waits for the next one."""

    def linked(tile: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        pairs = np.array(forest(close_pairs(tile, prints.view(np.uint64))), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": prints[pairs[:, 0]], "v": prints[pairs[:, 1]]})

    tile, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for f in frames:
        tile, prints = np.r_[tile, f["tile"].to_numpy()], np.r_[prints, f["print"].to_numpy()]
        if len(tile):
            begin = np.searchsorted(tile, tile[-1])
            yield linked(tile[:begin], prints[:begin])
            tile, prints = tile[begin:], prints[begin:]
    yield linked(tile, prints)


def print_links(prints: DataFrame, part: int = PART) -> DataFrame:
    """(u, v) of distinct fingerprints `print` that connect all of those at most two bits apart."""
    placed = prints.mapInPandas(_placed, "third long, cell long, print long")
    # Cells are at most 2 * 3^11 + 3^10 in number, whatever the input.
    large = (
        placed.groupBy("third", "cell")
        .agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
        .filter("parts > 1")
    )
    cut = placed.join(F.broadcast(large), ["third", "cell"], "left").withColumn(
        "mine", F.pmod(F.xxhash64("print"), F.coalesce("parts", F.lit(1)))
    )
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: j != F.col("mine"))
    )
    tiles = cut.withColumn("other", F.explode(others)).select(
        F.xxhash64("third", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "print"
    )
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInPandas(_links, "u long, v long")


def fingerprint_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, part: int = PART
) -> DataFrame:
    """(id, fingerprint, component_id) for every row; the fingerprint as 16 hexadecimal digits."""

    @F.pandas_udf("long")
    def prints_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), prints_of(F.col(text_col)).alias("print"))
    rows = written(rows.withColumn("_slice", slice_of(F.col("id"))), "fingerprints")
    classes = written(rows.groupBy("print").agg(F.min("id").alias("low"), slices_seen().alias("_slices")), "classes")
    found = components(print_links(classes.select("print"), part))
    lows = (
        found.join(classes, found["node"] == classes["print"])
        .groupBy("component")
        .agg(F.min("low").alias("least"))
    )
    linked = found.join(lows, "component").select(F.col("node").alias("print"), "least")
    named = classes.join(linked, "print", "left").select("print", F.coalesce("least", "low").alias("component_id"), "_slices")
    done = rows.join(per_slice(named), ["print", "_slice"])
    return done.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
