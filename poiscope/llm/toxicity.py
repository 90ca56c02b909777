"""Toxicity: boosted trees over dense features of the whole text, calibrated by isotonic regression.

Features: densities of hits in a fixed list of insults and in a lexicon learnt from the labels, how many
hits stand within five words of a second-person word, capitals, punctuation, and obfuscated
spellings (with the hits among them once symbols are undone). The learnt lexicon holds words and
beginnings of words that labelled toxic texts have and clean ones do not.

At most `most_labelled` labelled texts are used, chosen by a hash of their id: half for the lexicon, three
tenths for the trees, two tenths for the calibration. Texts are read whole; scoring covers all rows.

Defined results: a null or empty text is scored like any text without words; with no labels every score is
0, with one label only its value. Labels that repeat an id count as toxic if any is. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.boosting import bounded_sample, fit_trees, probability, written
from poiscope.llm.language_id import words_of

# Insults, second-person words, letters that symbols stand for.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb loser losers trash garbage scum clown pathetic worthless disgusting
    imbecile fool coward liar jerk bastard bitch asshole fuck fucking shit crap retard freak ugly vermin
    idiotisch dumm dummkopf trottel versager abschaum arschloch widerlich wertlos erbärmlich
    imbécile crétin débile minable ordure salaud connard abruti dégoûtant
    idiota imbécil estúpido estúpida basura patético asqueroso inútil payaso perdedor cabrón
    """.split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
UNDONE = str.maketrans("013457@$!", "oieastasi")

OBFUSCATED = re.compile(r"[^\W\d_]+(?:[\d@$!*._\-]+[^\W\d_]+)+")
SYMBOLS = re.compile(r"[\d@$!*._\-]+")
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
REMEMBERED = 200_000
LEXICON = 4000

# Classes of bytes: capitals, end marks, other punctuation, digits.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(range(65, 91))] = 1
_CLASS[[33, 63]] = 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b not in (33, 63)]] = 3
_CLASS[list(range(48, 58))] = 4


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked apart."""
    return ["=" + word, *[word[:k] for k in BEGINNINGS if len(word) >= k]]


class Weights(dict):
    """Largest lexicon weight of a word's terms, remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        weight = max([self.lexicon.get(t, 0.0) for t in terms_of(word)])
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = weight
        return weight


def dense(text: str | None, weights: Weights) -> list[float]:
    text = text or ""
    words = words_of(text)
    n = max(len(words), 1)
    learnt = np.fromiter(map(weights.__getitem__, words), float, len(words))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    hits = np.union1d(np.flatnonzero(learnt), np.array(fixed, np.int64))
    second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    if len(hits) and len(second):
        right = np.searchsorted(second, hits)
        gap = np.minimum(
            np.abs(second[np.minimum(right, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(right - 1, 0)])
        )
        near = int((gap <= NEAR).sum())
    else:
        near = 0
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
    chars = max(len(text), 1)
    hidden = OBFUSCATED.findall(text)
    undone = [SYMBOLS.sub("", h.lower().translate(UNDONE)) for h in hidden]
    undone += [SYMBOLS.sub("", h.lower()) for h in hidden]
    return [
        math.log1p(len(words)),
        len(fixed) / n,
        float(len(fixed)),
        float((learnt > 0).sum()) / n,
        float((learnt > 0).sum()),
        float(learnt.sum()) / n,
        float(learnt.max()) if len(learnt) else 0.0,
        near / n,
        float(near),
        len(second) / n,
        kinds[1] / chars,
        kinds[2] / chars,
        kinds[3] / chars,
        kinds[4] / chars,
        len(hidden) / n,
        float(sum(u in INSULTS or weights[u] > 0 for u in undone if u)),
    ]


@lru_cache(maxsize=2)
def _weights(lexicon: tuple[tuple[str, float], ...]) -> Weights:
    return Weights(dict(lexicon))


def learn_lexicon(rows: DataFrame, min_docs: int = 3, least: float = 2.0) -> dict[str, float]:
    """Log-odds weights of terms of (text, label); LEXICON of them at most, those in most toxic texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(f["text"], f["label"]):
                seen[label].update({t for w in set(words_of(text)) for t in terms_of(w)})
            # Terms of clean texts only cannot enter, but clean sights of the others count.
            for label, c in ((label, c) for label, c in seen.items() if c):
                yield pd.DataFrame({"term": list(c), "toxic": list(c.values()) if label else 0, "clean": 0 if label else list(c.values())})

    counted = rows.mapInPandas(count, "term string, toxic long, clean long").groupBy("term")
    sums = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= min_docs)
    texts = rows.groupBy("label").count().collect()
    sizes = {r["label"]: r["count"] for r in texts}
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1.0))
    best = sums.withColumn("weight", odds).filter(F.col("weight") >= least).orderBy(F.desc("toxic"), "term").limit(LEXICON)
    return {r["term"]: r["weight"] for r in best.collect()}


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    teaches: Column | None = None,
    most_labelled: int = 20_000,
) -> DataFrame:
    """(id, score) for every row of `docs`.

    labels: (id, label 0/1), read where `teaches` (over its columns) holds; at most `most_labelled` rows are used.
    """
    known = labels.filter(F.lit(True) if teaches is None else teaches).filter(F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = bounded_sample(known, "_id", most_labelled)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # The labels chosen are at most most_labelled pairs of numbers.
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("_id")), F.lit(10))
    sample = written(base.join(F.broadcast(chosen), "_id").select("text", "label", part.alias("part")), "toxic-texts")
    lexicon = tuple(sorted(learn_lexicon(sample.filter("part < 5").select("text", "label")).items()))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        weights = _weights(lexicon)
        return pd.Series([dense(t, weights) for t in texts])

    learning = written(sample.filter("part >= 5").select(features("text").alias("features"), "label", "part"), "toxic-features")
    model = fit_trees(learning.filter("part < 8"))
    judged = probability(learning.filter("part >= 8"), model, "raw").select("raw", F.col("label").cast("double").alias("label"))
    scored = probability(base.select("_id", features("text").alias("features")), model, "raw")
    if judged.select("label").distinct().count() == 2:
        scored = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(judged).transform(scored)
    else:
        scored = scored.withColumn("score", F.col("raw"))
    return scored.select(F.col("_id").alias(id_col), "score")
