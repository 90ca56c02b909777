"""Spelling variants: words one edit apart, found by Gram matrices over blocks of letter counts.

The letters of a word, counted, are a vector. One replaced letter moves it by a squared distance of two, one
inserted or deleted letter by one. Words are blocked by their length and by how many of their letters fall in each of
four classes of letters; one edit leads to the same block or to one of a few adjacent ones, of the same length or
one longer. For a block and an adjacent one, one matrix product gives all squared distances between their distinct
vectors; words of the vectors that are near enough are verified letter by letter.

Blocks are cut into parts of bounded bytes by a hash of the letters; a task holds one part of each of two blocks.
What leaves it is, per word, the number of its near words and the best of them, never a pair for each.

Occurrences are damaged on purpose, by rule: a run whose checksum with its document is divisible by `every` loses one
letter. So the variants of frequent words are known to be there.

Defined results: a null or empty text has no words; a row without id counts with an empty id. Rows that repeat an id
count each. Only id and text are read; no other column name matters. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.boosting import written

CLASSES = 4
PART_WORDS = 2048
PART_BYTES = 1 << 20
REMEMBERED = 300_000
RATIO = 10
# Letters of words, from U+0041 to U+007A and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """(word, n) of all damaged words of at least `least` letters."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def of(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            begin = zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i))
            for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), begin)
                if not h % every:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                yield word, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for word, n in of(batch.slice(k, 500)):
                    seen[word] = seen.get(word, 0) + n
                if len(seen) > REMEMBERED:
                    yield packed(seen)
                    seen = {}
        yield packed(seen)

    def packed(seen: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def block_of(word: Column) -> Column:
    """How many letters of a word fall in each class: a letter's class is its code point's remainder."""
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    kept = ["".join(x for x in letters if ord(x) % CLASSES != c) for c in range(CLASSES)]
    return F.array(*(F.length(F.translate(word, k, "")) for k in kept))


def adjacent(block: Column) -> Column:
    """A block, and those that one edit of its words leads to: of the same length and larger, or one longer.

    Every pair of adjacent blocks is named from one side only.
    """
    unit = [[int(i == j) for j in range(CLASSES)] for i in range(CLASSES)]
    # A replaced letter moves a count from class j to class i; i < j makes the block larger.
    moves = [[0] * CLASSES, *unit]
    moves += [[a - b for a, b in zip(unit[i], unit[j])] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return F.array(*(F.array(*(block[c] + F.lit(m[c]) for c in range(CLASSES))) for m in moves))


class Part:
    """Words of one length: letters, distinct count vectors, and which words have which vector."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.n = words, np.array(counts, np.int64)
        length = len(words[0])
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)
        ordered = np.sort(self.letters, axis=1)
        self.by = np.argsort(ordered.view(f"S{length}").ravel(), kind="stable")
        ordered = ordered[self.by]
        self.first = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)])
        self.size = np.diff(np.r_[self.first, len(words)])
        held = ordered[self.first]
        cell = np.arange(len(held))[:, None] * 256 + held
        # Squares must be whole numbers that the type tells apart.
        kind = np.float32 if length < 1000 else np.float64
        self.vectors = np.bincount(cell.ravel(), minlength=256 * len(held)).reshape(-1, 256).astype(kind)
        self.used = self.vectors.any(axis=0)


def squared_distances(a: Part, b: Part) -> np.ndarray:
    """All squared distances between the vectors of two parts, by one product."""
    used = a.used | b.used
    x, y = a.vectors[:, used], b.vectors[:, used]
    (x_one, x_square), (y_one, y_square) = ((np.ones_like(v[:, :1]), (v * v).sum(axis=1, keepdims=True)) for v in (x, y))
    return np.hstack([x, x_square, x_one]) @ np.hstack([-2 * y, y_one, y_square]).T


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one letter: replaced where both are as long, else inserted in y."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    n = x.shape[1]
    ahead = np.c_[x != y[:, :n], np.ones(len(x), bool)].argmax(axis=1)
    behind = np.c_[(x != y[:, 1:])[:, ::-1], np.ones(len(x), bool)].argmax(axis=1)
    return ahead + behind >= n


def near_pairs(a: Part, b: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of words one edit apart, b's as long or one longer; each pair once if a is b."""
    wanted = 2 if a.letters.shape[1] == b.letters.shape[1] else 1
    i, j = np.nonzero(np.abs(squared_distances(a, b) - wanted) < 0.5)
    if a is b:
        i, j = i[i < j], j[i < j]
    # All words of the one vector with all of the other, in slices.
    many = a.size[i] * b.size[j]
    step = max(1, (1 << 22) // b.letters.shape[1])
    ends = np.cumsum(many)
    at = 0
    while at < len(i):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step)))
        m, p, q = many[at:stop], i[at:stop], j[at:stop]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = np.repeat(b.size[q], m)
        x = a.by[np.repeat(a.first[p], m) + inner // wide]
        y = b.by[np.repeat(b.first[q], m) + inner % wide]
        good = one_edit(a.letters[x], b.letters[y])
        yield x[good], y[good]
        at = stop


def best_near(a: Part, b: Part) -> Iterator[pd.DataFrame]:
    """(word, n_near, best_n, best) of the words of two parts that have near words in the other one."""
    found = [(np.zeros(0, np.int64),) * 2, *near_pairs(a, b)]
    i, j = (np.concatenate(side) for side in zip(*found))
    if a is b:
        sides = [(a, np.r_[i, j], a, np.r_[j, i])]
    else:
        sides = [(a, i, b, j), (b, j, a, i)]
    for own, mine, other, theirs in sides if len(i) else []:
        rank = np.empty(len(other.words), np.int64)
        rank[np.argsort(np.array(other.words))] = np.arange(len(other.words))
        order = np.lexsort((rank[theirs], -other.n[theirs], mine))
        mine, theirs = mine[order], theirs[order]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        yield pd.DataFrame(
            {
                "word": [own.words[k] for k in mine[first].tolist()],
                "n_near": np.diff(np.r_[first, len(mine)]),
                "best_n": other.n[theirs[first]],
                "best": [other.words[k] for k in theirs[first].tolist()],
            }
        )


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, home = None, None
    for f in frames:
        for key, same, words, n, words_2, n_2 in zip(f["key"], f["same"], f["words"], f["n"], f["words_2"], f["n_2"]):
            if at != key:
                at, home = key, Part(words.split("\n"), n)
            visitor = home if same else Part(words_2.split("\n"), n_2)
            yield from best_near(*sorted((visitor, home), key=lambda p: p.letters.shape[1]))


def near_words(words: DataFrame, part_words: int = PART_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of distinct words (word, n) that have near words: how many, and the most frequent.

    Of equally frequent ones the smallest in code-point order is the best. Words must be of lower-case Latin-1 letters.
    """
    placed = words.select("word", "n", block_of(F.col("word")).alias("block"), F.array_sort(F.split("word", "")).alias("letters"))
    sizes = placed.groupBy("block").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / part_words, F.sum(F.length("word")) / part_bytes)).alias("parts")
    )
    # Words of equal letters share a part, unless they are too many for one.
    many = placed.groupBy("letters").agg(F.ceil(F.count(F.lit(1)) / part_words).alias("salts")).filter("salts > 1")
    salt = F.pmod(F.xxhash64("word"), F.coalesce("salts", F.lit(1)))
    cut = placed.join(many, "letters", "left").join(sizes, "block")
    cut = cut.withColumn("part", F.pmod(F.xxhash64(F.col("letters"), salt), F.col("parts")))
    listed = cut.groupBy("block", "part").agg(F.collect_list(F.struct("word", "n")).alias("all"))
    parts = written(
        listed.select(
            "block", "part", F.array_join("all.word", "\n").alias("words"), F.col("all.n").alias("n")
        ),
        "parts",
    )
    visits = parts.select(
        F.explode(adjacent(F.col("block"))).alias("block"),
        F.col("block").alias("block_2"),
        F.col("part").alias("part_2"),
        F.col("words").alias("words_2"),
        F.col("n").alias("n_2"),
    )
    alike = F.col("block") == F.col("block_2")
    tiles = parts.hint("merge").join(visits, "block").filter(~alike | (F.col("part") <= F.col("part_2")))
    tiles = tiles.select(
        F.concat_ws(" ", F.col("block").cast("array<string>"), "part").alias("key"),
        (alike & (F.col("part") == F.col("part_2"))).alias("same"),
        "words", "n", "words_2", "n_2",
    )
    found = tiles.mapInPandas(_compared, "word string, n_near long, best_n long, best string")
    # Ordered so that the least is the most frequent, then the smallest.
    best = F.min(F.struct((-F.col("best_n")).alias("low"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.low")).alias("best_n"), "b.best"
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form): the last word that forms lead to.

    Every step doubles the links followed. A form is at least `RATIO` times as frequent, so 64 bits hold 19 links at most.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        at = moved.select("word", "root")
        if moved.filter("next IS NOT NULL").isEmpty():
            return at


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = 7,
    least_count: int = 2,
    every: int = 31,
    ratio: int = RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words that occur often enough.

    The form is the near word of largest n, if that is `ratio` times the word's own n; null else.
    """
    if ratio < 2:
        raise ValueError("forms lead to an end only where each is more frequent than the word before")
    counted = word_counts(docs, id_col, text_col, least_letters, every)
    words = written(counted.filter(F.col("n") >= least_count), "words")
    fits = F.col("best_n") >= ratio * F.col("n")
    near = words.join(near_words(words), "word", "left").select(
        "word",
        F.when(fits, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best_n")).alias("form_n"),
    )
    near = written(near, "near")
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
