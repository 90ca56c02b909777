"""Benchmark decontamination: size-partitioned MinHash containment of short items in long documents.

An item is the set of its runs of five words, words being runs of letters and digits in lower case. Items are
partitioned by size; for the items of a partition a document is cut into chunks of about half an item's
size, and each chunk and each item has the minimum of its shingles under several permutations. An item
of which four fifths lie in a document has its minimum there, and a chunk that short cannot often
hide it, so a document is a candidate if any chunk agrees with the item under any permutation. Candidates are
confirmed by counting the item's shingles, as words, in the whole document.

Items are the query set: they are indexed in blocks of at most `items_at_once` and `words_at_once`
words, and every block is held against all documents. Nothing of the documents is shuffled.

Defined results: items of fewer words than a shingle are one shingle of their whole sequence; items without
words match nothing; a null text contains nothing; items that repeat an id are matched each on its own. Only the named columns are read,
others pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.words import hashed, permutations, shingles, tidied

WORD = re.compile(r"[^\W_]+")
PERMUTATIONS = 24
WORDS_AT_ONCE = 100_000
ROWS = 500
FOUND = "array<struct<item_id: long, n_shared: long, n_item: long>>"
ARROW_FOUND = pa.list_(pa.struct([(name, pa.int64()) for name in ("item_id", "n_shared", "n_item")]))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def runs(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*[words[i:] for i in range(k)]))


class _Coordinate:
    """Which items have a value as their minimum; a bit table turns most other values away."""

    def __init__(self, values: np.ndarray, items: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.items = values[order], items[order]
        self.shift = np.uint64(64 - max(10, int(np.ceil(np.log2(64 * len(values))))))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.values >> self.shift] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in values, item) of every agreement."""
        at = np.flatnonzero(self.bits[values >> self.shift])
        low, high = (np.searchsorted(self.values, values[at], side) for side in ("left", "right"))
        found = np.repeat(at, high - low)
        within = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return found, self.items[np.repeat(low, high - low) + within]


class Items:
    """Index of one block of items."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, percent: int):
        self.ids, self.sets, self.lengths, self.percent = [], [], [], percent
        self.hashes: dict[str, int] = {}  # of the items' words
        partitions = defaultdict(list)  # (words of a shingle, words of a chunk) -> items
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            k = min(shingle, len(words))
            found = frozenset(runs(words, k))
            own = hashed(words)
            self.hashes.update(zip(words, own.tolist()))
            chunk = max(1, 1 << max(0, int(np.log2(len(found) / 2)))) if len(found) > 1 else 1
            partitions[k, chunk].append((len(self.ids), np.unique(shingles(own, k))))
            self.ids.append(item_id)
            self.sets.append(found)
            self.lengths.append(k)
        self.xor, self.times = permutations(PERMUTATIONS, seed=2)
        self.partitions = {}
        for (k, chunk), members in partitions.items():
            at = np.array([m[0] for m in members])
            # In chunks of one shingle every permutation says the same.
            turns = range(PERMUTATIONS if chunk > 1 else 1)
            self.partitions[k, chunk] = [
                _Coordinate(np.array([((s ^ self.xor[t]) * self.times[t]).min() for _, s in members]), at) for t in turns
            ]

    def hashed(self, words: list[str]) -> np.ndarray:
        """Hashes of a text's words, 0 for words in no item: a run that holds one is in no item either."""
        return np.fromiter(map(self.hashes.get, words, repeat(0)), np.uint64, len(words))

    def candidates(self, hashes: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs that agree somewhere, given the hashes of the words of each text."""
        out: set[tuple[int, int]] = set()
        for k in {k for k, _ in self.partitions}:
            rolled = [shingles(h, k) for h in hashes]
            flat = np.concatenate(rolled) if rolled else np.zeros(0, np.uint64)
            if not len(flat):
                continue
            lengths = np.array([len(r) for r in rolled])
            text_of = np.repeat(np.arange(len(rolled)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            chunks = {c: np.flatnonzero(place % c == 0) for kk, c in self.partitions if kk == k}
            for turn in range(PERMUTATIONS):
                wanted = [c for c in chunks if turn < len(self.partitions[k, c])]
                if not wanted:
                    break
                values = (flat ^ self.xor[turn]) * self.times[turn]
                for c in wanted:
                    low = np.minimum.reduceat(values, chunks[c]) if c > 1 else values
                    at, items = self.partitions[k, c][turn].hits(low)
                    out.update(zip(text_of[chunks[c][at]].tolist(), items.tolist()))
        return out

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """The items contained in each text.

        Of the texts at work only hashes are held; the words of those with candidates are cut out once more.
        """
        out: list[list[dict]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            held, total, first = [], 0, at
            while at < len(texts) and (not held or total < WORDS_AT_ONCE):
                held.append(self.hashed(words_of(texts[at])))
                total += len(held[-1])
                at += 1
            by_text = defaultdict(list)
            for text, item in sorted(self.candidates(held)):
                by_text[text].append(item)
            for text, items in by_text.items():
                words = words_of(texts[first + text])
                whole = {k: set(runs(words, k)) for k in {self.lengths[i] for i in items}}
                for item in items:
                    shared = len(self.sets[item] & whole[self.lengths[item]])
                    if 100 * shared >= self.percent * len(self.sets[item]):
                        out[first + text].append(
                            {"item_id": self.ids[item], "n_shared": shared, "n_item": len(self.sets[item])}
                        )
        return out


def items_found(
    benchmark: DataFrame,
    text: Column,
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    items_at_once: int = 20_000,
    words_at_once: int = 2_000_000,
) -> Column:
    """Array of (item_id, n_shared, n_item) for a text column: the items of which percent lies in the text.

    The benchmark is read to the driver block by block; a block is bounded by both parameters (one item at least).
    """
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)).toLocalIterator()
    blocks, held, total = [], [], 0

    def close() -> None:
        index = Items(held, shingle, percent)

        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                # Slice by slice, so that few texts are held as strings.
                found = [f for at in range(0, len(texts), ROWS) for f in index.find(texts.slice(at, ROWS).to_pylist())]
                yield pa.array(found, ARROW_FOUND)

        @F.arrow_udf(FOUND)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return tidied(find(batches))

        blocks.append(run(text))

    for item_id, item_text in rows:
        held.append((item_id, item_text))
        total += len(item_text or "") // 2
        if len(held) >= items_at_once or total >= words_at_once:
            close()
            held, total = [], 0
    if held or not blocks:
        close()
    return F.concat(*blocks) if len(blocks) > 1 else blocks[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, n_shared, n_item, containment), one row for each item that a document contains."""
    found = docs.select(F.col(id_col).alias("_id"), items_found(benchmark, F.col(text_col), **options).alias("_found"))
    # The outer form keeps the optimizer from testing, and so computing, the array a second time.
    each = found.select(F.col("_id").alias(id_col), F.explode_outer("_found").alias("f")).filter("f IS NOT NULL")
    return each.select(
        id_col, "f.item_id", "f.n_shared", "f.n_item", (F.col("f.n_shared") / F.col("f.n_item")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    names = docs.columns
    return docs.select("*", F.size(items_found(benchmark, F.col(text_col), **options)).alias("_n_items")).filter("_n_items = 0").select(*names)
