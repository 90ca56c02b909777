"""Language identification by unigrams over pieces, summed over all segmentations.

For each language the pieces of a fixed public vocabulary (a sentencepiece model, named by a
parameter) get probabilities from the labelled documents: the words are segmented by the model and its
pieces are counted, all documents and whole texts, inside the tasks; at most one row per language and
piece leaves a task. A text is scored word by word: a forward pass over the letters sums the probability
of every segmentation into pieces, so no single segmentation has to be right. Words so unlikely that a sum
leaves the range of numbers are summed again in logarithms. The texts' log
probabilities with the languages' shares as prior give the posterior of the best language.

The letters of a text are its words: runs of letters, in Unicode composed form and lower case. Words of
over 200 letters are scored in stretches of 200. Recent words are remembered per task.

Defined results: null texts and texts without a letter are `und` with score 0; documents without a
label, or held out, teach nothing; if nothing is labelled every text is `und`. Ties go to the first
language by name. Only the id, text and label columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.words import tidied

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
STRETCH = 200
REMEMBERED = 150_000
AT_ONCE = 20_000
TEXTS_AT_ONCE = 500
UNKNOWN_SHARE = 1e-7
LEAST_SUM = 1e-250
UNDEFINED = "und"


def piece_model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _matcher(path: str) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """Finds all pieces in a text; the lengths of the pieces."""
    model, finder = _pieces(path), ahocorasick.Automaton()
    lengths = np.ones(len(model) + 1, np.int32)
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            lengths[i] = len(piece)
            finder.add_word(piece, i)
    finder.make_automaton()
    return finder, lengths


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def _stretches(word: str) -> list[str]:
    return [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]


class Unigrams:
    """Log probabilities of words under each language."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, share: np.ndarray, path: str):
        self.languages, self.log_prior, self.path = languages, log_prior, path
        # A constant per letter keeps the products of long words in range; it is taken out again.
        self.scale = 16.0
        _, self.lengths = _matcher(path)
        self.factor = share * self.scale ** self.lengths[:, None]
        self.log_factor = np.log(self.factor)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def forward(self, words: list[str], logs: bool = False) -> np.ndarray:
        """log p(word | language), words x languages; `logs` keeps the sums in logarithms, which takes longer."""
        finder, lengths = _matcher(self.path)
        marked = [START + w for w in words]
        text = "\n".join(marked) + "\n"
        size = np.array([len(w) for w in marked])
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        found = np.fromiter(finder.iter(text), np.dtype([("end", np.int32), ("piece", np.int32)]))
        letters = np.concatenate([np.arange(b, b + n) for b, n in zip(begin.tolist(), size.tolist())])
        end = np.r_[found["end"], letters]
        piece = np.r_[found["piece"], np.full(len(letters), len(lengths) - 1)]  # a letter in no piece
        step = end - np.repeat(begin, size + 1)[end]
        order = np.lexsort((end, step))
        end, piece, step = end[order], piece[order], step[order]
        start = end - lengths[piece] + 1
        total = np.zeros((len(text) + 1, self.factor.shape[1]))
        total[begin] = 0 if logs else 1
        borders = np.searchsorted(step, np.arange(size.max() + 1))
        for a, b in zip(borders[:-1], borders[1:]):
            e = end[a:b]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            if logs:
                total[e[first] + 1] = np.logaddexp.reduceat(self.log_factor[piece[a:b]] + total[start[a:b]], first)
            else:
                total[e[first] + 1] = np.add.reduceat(self.factor[piece[a:b]] * total[start[a:b]], first)
        scale = (size * np.log(self.scale))[:, None]
        if logs:
            return total[begin + size] - scale
        # Every prefix of a word has a segmentation; one that is next to nothing has lost digits, or all of them.
        small = np.flatnonzero(np.minimum.reduceat(total[: begin[-1] + size[-1] + 1], begin).min(axis=1) < LEAST_SUM)
        total[begin[small] + size[small]] = 1
        out = np.log(total[begin + size]) - scale
        if len(small):
            out[small] = self.forward([words[i] for i in small.tolist()], logs=True)
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, number of words) of each text."""
        out, counts, at = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            if len(self.rows) > REMEMBERED:
                self.forget()
            held, new, stop = [], {}, at
            while stop < len(texts) and (stop == at or (len(new) < AT_ONCE and stop - at < TEXTS_AT_ONCE)):
                words = words_of(texts[stop])
                if any(len(w) > STRETCH for w in words):
                    words = [s for w in words for s in _stretches(w)]
                held.append(words)
                new.update((w, None) for w in words if w not in self.rows)
                stop += 1
            unseen = list(new)
            for i in range(0, len(unseen), AT_ONCE):
                part = unseen[i : i + AT_ONCE]
                self.rows.update(zip(part, range(len(self.scores), len(self.scores) + len(part))))
                self.scores = np.concatenate([self.scores, self.forward(part)])
            lengths = np.array([len(h) for h in held])
            rows = np.fromiter((self.rows[w] for h in held for w in h), np.int64, int(lengths.sum()))
            if len(rows):
                full = np.flatnonzero(lengths)
                first = np.r_[0, np.cumsum(lengths)[:-1]][full]
                out[at + full] = np.add.reduceat(self.scores[rows], first)
            counts[at:stop] = lengths
            at = stop
        return out, counts


def piece_counts(labelled: DataFrame, path: str) -> DataFrame:
    """(lang, piece, n) over the columns lang and text; piece -1 counts the documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, words, sums, docs = _pieces(path), {}, {}, Counter()

        def settle(lang: str) -> None:
            seen = words.pop(lang)
            keys = list(seen)
            ids = model.encode(keys, num_threads=1)
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            weights = np.repeat(np.fromiter(seen.values(), np.float64, len(keys)), [len(x) for x in ids])
            sums[lang] = sums.get(lang, 0) + np.bincount(flat, weights, len(model))

        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                docs[lang] += 1
                seen = words.setdefault(lang, Counter())
                seen.update(words_of(text))
                if len(seen) > REMEMBERED:
                    settle(lang)
        for lang in list(words):
            settle(lang)
        for lang, n in docs.items():
            piece = np.flatnonzero(sums[lang])
            yield pd.DataFrame({"lang": lang, "piece": [-1, *piece], "n": [n, *sums[lang][piece].astype(np.int64)]})

    counted = labelled.select("lang", "text").mapInPandas(lambda frames: tidied(count(frames)), "lang string, piece long, n long")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame, lang_col: str, text_col: str, path: str, teaches: Column | None = None
) -> Unigrams | None:
    """Unigrams of all labelled documents; None if there are none.

    What reaches the driver is one number per language and piece of the vocabulary.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & (F.lit(True) if teaches is None else teaches))
    rows = piece_counts(labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), path).toPandas()
    languages = sorted(rows["lang"].unique())
    if not languages:
        return None
    _, lengths = _matcher(path)
    counts = np.zeros((len(lengths), len(languages)))
    column = rows["lang"].map({l: i for i, l in enumerate(languages)}).to_numpy()
    docs_row = (rows["piece"] < 0).to_numpy()
    counts[rows["piece"].to_numpy()[~docs_row], column[~docs_row]] = rows["n"].to_numpy()[~docs_row]
    prior = np.zeros(len(languages))
    prior[column[docs_row]] = rows["n"].to_numpy()[docs_row]
    # Pieces never seen in a language share the weight of a tenth of a sight each.
    share = (counts + 0.1) / (counts + 0.1).sum(axis=0)
    share[-1] = UNKNOWN_SHARE
    return Unigrams(languages, np.log(prior / prior.sum()), share, path)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    teaches: Column | None = None,
    path: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """(id, lang_pred, score) for every row; `carry` adds the whole row as struct `row`."""
    model = train(docs, lang_col, text_col, path or piece_model_path(), teaches)

    def judged(texts: list[str | None]) -> tuple[list[str], list[float]]:
        if model is None:
            return [UNDEFINED] * len(texts), [0.0] * len(texts)
        log_p, words = model.score(texts)
        log_p += model.log_prior
        best = log_p.argmax(axis=1)
        score = 1 / np.exp(log_p - log_p.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.where(words > 0, np.array(model.languages, object)[best], UNDEFINED)
        return names.tolist(), np.where(words > 0, score, 0.0).tolist()

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # Slice by slice, so that few texts are held as strings.
            found = [judged(texts.slice(at, TEXTS_AT_ONCE).to_pylist()) for at in range(0, len(texts), TEXTS_AT_ONCE)]
            names, scores = ([v for f in found for v in f[i]] for i in (0, 1))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(judge(batches))

    rows = docs.select(
        F.col(id_col).alias("_id"), predict(F.col(text_col)).alias("_found"), *[F.struct("*").alias("row")] * carry
    )
    return rows.select(F.col("_id").alias(id_col), "_found.lang_pred", "_found.score", *["row"] * carry)
