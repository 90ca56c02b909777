"""Byte-pair encoding by speculation: propose tokens greedily, verify neighbours, merge only what fails.

Every word of a batch that is not remembered is cut by greedy longest match. The proposal is the
exact encoding if each token encodes to itself and no two neighbours would have merged across their
border. The second test runs for all pairs of the batch at once in numpy: undo the later of the two
facing symbols again and again, and see whether the pair that faces each other then would have merged
before the symbol undone was formed. Words that fail either test are merged in the order of ranks.

The vocabulary file (tokenizers JSON of a BPE with word ends, lower case, byte-level characters and no
decoder) is named by a parameter and read on the executors. Encodings of recent text chunks, and what they
decode to, are remembered per Python worker, at most `REMEMBERED` of them.

Defined results: null texts count as empty and give no tokens; strings of special tokens in a text
become those tokens; decoding joins token strings with one space, as the library does for a
vocabulary without decoder. Only the text column is read; other columns pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from poiscope.llm.words import tidied

REMEMBERED = 300_000
AT_ONCE = 30_000
ROWS = 500
NEVER = np.int64(2**40)

# The pattern of words, white space that str.split() knows and the pattern does not.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_SPACE = "\x1c\x1d\x1e\x1f"
CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
WORD_END = "</w>"
END = "\0"
MARKS = frozenset(".,;:!?")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_characters() -> list[str]:
    """The printable character standing for each byte: itself where it is visible, else from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


def cut(flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Consecutive stretches of the given lengths as little-endian 32-bit numbers."""
    data, stops = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = text
        # Ids in the order of the merges, as the pair test needs; parts come before their whole.
        left, right, whole = (np.array([self.ids[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join))
        if len(merges) and not ((np.diff(whole) > 0).all() and (left < whole).all() and (right < whole).all()):
            raise ValueError("ids do not follow the order of the merges")
        self.size, self.base = size, int(whole[0]) if len(merges) else size
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.left[whole], self.right[whole] = left, right
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.wholes = keys[order], whole[order]
        self.sound = np.ones(size, bool)  # encodes to itself
        apart = self.compatible(left, right, whole)
        for t, l, r, a in zip(whole.tolist(), left.tolist(), right.tolist(), apart.tolist()):
            self.sound[t] = a and self.sound[l] and self.sound[r]
        # Finds the longest token at a place; the end of a word is one more character.
        self.finder = ahocorasick.Automaton()
        self.lengths = np.zeros(size, np.int64)
        for token, i in self.ids.items():
            key = token.removesuffix(WORD_END) + END if token.endswith(WORD_END) else token
            self.lengths[i] = len(key)
            self.finder.add_word(key, i)
        self.finder.make_automaton()
        self.characters = byte_characters()
        self.words = regex.compile(WORDS)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.remembered: dict[str, bytes] = {}
        self.said: dict[str, str] = {}  # the remembered ids, decoded

    def whole_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Id of the merge of each pair, NEVER where there is none."""
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.wholes[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: no merge across their border comes before `limit`."""
        x, y, fine = x.copy(), y.copy(), np.ones(len(x), bool)
        limit = np.full(len(x), NEVER) if limit is None else limit.copy()
        at = np.arange(len(x))
        while len(at):
            across = self.whole_of(x, y) < limit
            fine[at[across]] = False
            undo_x = x > y
            go_on = ~across & (np.where(undo_x, x, y) >= self.base)
            at, x, y, undo_x = at[go_on], x[go_on], y[go_on], undo_x[go_on]
            # Of equal merges the left one happens first.
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return fine

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) of the greedy longest match over all words at once.

        A word has none where the match ends before it does: the longest token took its last letter, but does not end words.
        """
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        if not len(words):
            return sizes, sizes
        found = np.fromiter(self.finder.iter_long(END.join(words) + END), np.dtype([("end", np.int64), ("id", np.int64)]))
        word = np.searchsorted(np.cumsum(sizes), found["end"], side="right")
        covered = np.bincount(word, self.lengths[found["id"]], len(words)) == sizes
        kept = covered[word]
        return found["id"][kept], np.bincount(word[kept], minlength=len(words))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words at once: (ids, number of ids per word).

        In each round every word applies its earliest merge at all its places, from the left.
        """
        ids = self.ids
        symbols = np.array([t for w in words for t in [*[ids[c] for c in w[:-1]], ids[w[-1] + WORD_END]]], np.int64)
        word = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], np.int64))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            whole = np.full(len(symbols), NEVER)
            whole[:-1] = self.whole_of(symbols[:-1], symbols[1:])
            whole[:-1][word[1:] != word[:-1]] = NEVER
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(whole, first), np.diff(np.r_[first, len(word)]))
            ended = best == NEVER
            if ended.any():
                done.append((word[ended], symbols[ended]))
                word, symbols, whole, best = (x[~ended] for x in (word, symbols, whole, best))
            hit = whole == best
            # Of places that overlap (x x x), every other one counts.
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0)) if len(hit) else at
            hit &= (at - run) % 2 == 0
            symbols = np.where(hit, whole, symbols)
            stays = ~np.r_[False, hit[:-1]] if len(hit) else hit
            word, symbols = word[stays], symbols[stays]
        word, symbols = (np.concatenate([d[i] for d in done]) for i in (0, 1)) if done else (word, symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        flat, lengths = self.propose(words)
        fine = lengths > 0
        word_of = np.repeat(np.arange(len(words)), lengths)
        if len(flat):
            fine[word_of[~self.sound[flat]]] = False
            inside = word_of[1:] == word_of[:-1]
            pairs, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
            together = self.compatible(pairs // self.size, pairs % self.size)[back]
            fine[word_of[1:][inside][~together]] = False
        failed = np.flatnonzero(~fine)
        merged, counts = self.merge([words[i] for i in failed.tolist()])
        out = cut(flat, lengths)
        for i, ids in zip(failed.tolist(), cut(merged, counts)):
            out[i] = ids
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks (text between white space) and remember them."""
        chars, texts = self.characters, []
        for c in chunks:
            c = c if c.isascii() else unicodedata.normalize("NFC", c)
            texts.append(c.lower() if "Σ" not in c else "".join(map(str.lower, c)))
        # Most chunks are a word, or a word and a mark.
        find = self.words.findall
        pieces = [[t] if t.isalpha() else [t[:-1], t[-1]] if t[-1:] in MARKS and t[:-1].isalpha() else find(t) for t in texts]
        words = list(dict.fromkeys(w for p in pieces for w in p))
        keys = [w if w.isascii() and w.isprintable() else "".join([chars[b] for b in w.encode()]) for w in words]
        ids = self.encode_words(keys)
        ids_of, said_of = dict(zip(words, ids)), dict(zip(words, map(self.decode, ids)))
        for c, p in zip(chunks, pieces):
            if len(p) == 1:
                self.remembered[c], self.said[c] = ids_of[p[0]], said_of[p[0]]
            else:
                self.remembered[c] = b"".join([ids_of[w] for w in p])
                self.said[c] = " ".join([said_of[w] for w in p])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        return [b"".join(ids) for ids, _ in self.coded(texts)]

    def coded(self, texts: list[str | None]) -> list[tuple[Iterator[bytes], Iterator[str]]]:
        """Of each text the ids of its chunks and special tokens, and what they decode to; some may be empty."""
        out, at = [], 0
        while at < len(texts):
            # As many texts as bring AT_ONCE new chunks, one at least.
            if len(self.remembered) > REMEMBERED:
                self.remembered, self.said = {}, {}
            known, said, new, held = self.remembered, self.said, set(), []
            while at < len(texts) and (not held or len(new) < AT_ONCE):
                text = texts[at] or ""
                segments, parts = [text], []
                if self.specials and "<" in text:
                    segments, parts = self.specials.split(text), self.specials.findall(text)
                odd = any(c in text for c in NOT_SPACE)
                chunks = [CHUNK.findall(s) if odd else s.split() for s in segments]
                for cs in chunks:
                    new.update(set(cs).difference(known))
                held.append((chunks, parts))
                at += 1
            self._learn(list(new))
            for chunks, parts in held:
                ids, words = map(known.__getitem__, chunks[0]), map(said.__getitem__, chunks[0])
                for part, cs in zip(parts, chunks[1:]):
                    special = np.array([self.special[part]], "<u4").tobytes()
                    ids = chain(ids, [special], map(known.__getitem__, cs))
                    words = chain(words, [part], map(said.__getitem__, cs))
                out.append((ids, words))
        return out

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _extended(batch: pa.RecordBatch, kept: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*kept, *added]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *added.values()], names)


def encode_documents(
    docs: DataFrame, path: str | None = None, text_col: str = "text", into: str = "ids", decoded_into: str | None = None
) -> DataFrame:
    """All columns of `docs` and the binary column `into`: the ids as little-endian unsigned 32-bit numbers.

    decoded_into: also decode the ids again, in the same pass. Columns of the names added are replaced.
    """
    path = path or vocabulary_path()
    added = {into: T.BinaryType()} | ({decoded_into: T.StringType()} if decoded_into else {})
    kept = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # keeps what is held and sent small
                part = batch.slice(start, ROWS)
                coded = known.coded(part.column(text_col).to_pylist())
                new = {into: pa.array([b"".join(ids) for ids, _ in coded], pa.binary())}
                if decoded_into:
                    # Tokens are joined by one space wherever they stand, so chunks can be decoded one by one.
                    new[decoded_into] = pa.array([" ".join(filter(None, words)) for _, words in coded], pa.string())
                yield _extended(part, kept, new)

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added.items()])
    return docs.mapInArrow(lambda batches: tidied(run(batches), vocabulary.cache_clear), schema)


def decode_documents(docs: DataFrame, path: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of `docs` and the text of their ids; null ids stay null."""
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [None if i is None else known.decode(i) for i in part.column(ids_col).to_pylist()]
                yield _extended(part, kept, {into: pa.array(texts, pa.string())})

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(into, T.StringType())])
    return docs.mapInArrow(run, schema)
