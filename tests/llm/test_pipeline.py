"""The pipeline against a plain version on its own documents, and the registered names."""

import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from poiscope.llm import bpe, near_dedup, words as word_hashes
from poiscope.llm.bpe import vocabulary_path
from poiscope.llm.common import table
from poiscope.llm.decontamination import runs, words_of
from poiscope.llm.language_id import identify
from poiscope.llm.queries import QUERIES
from poiscope.llm.words import byte_words


@pytest.fixture(scope="module")
def kept_in_languages(spark, directory):
    docs = table(spark, directory, "documents")
    return corpus_pipeline.language_id(spark, docs, directory).toPandas().sort_values("doc_id")


def test_plain_version(spark, directory, kept_in_languages):
    texts, seen = {}, set()
    for i, t in zip(kept_in_languages["doc_id"], kept_in_languages["text"]):
        key = re.sub("[\x20\x09-\x0d]+", " ", t)
        if key not in seen:
            seen.add(key)
            texts[i] = t
    sets = {i: set(runs(w, min(5, len(w)))) for i, w in ((i, byte_words(t)) for i, t in texts.items())}
    label = {i: i for i in texts}
    ids, changed = sorted(texts), True
    while changed:
        changed = False
        for n, x in enumerate(ids):
            for y in ids[:n]:
                both = len(sets[x] & sets[y]) if label[x] != label[y] else 0
                if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    texts = {i: t for i, t in texts.items() if label[i] == i}
    items = [set(runs(w, min(5, len(w)))) for w in (words_of(r["text"]) for r in table(spark, directory, "benchmark").collect())]
    for i in list(texts):
        whole = set(runs(words_of(texts[i]), 5))
        if any(100 * len(s & whole) >= 80 * len(s) for s in items):
            del texts[i]
    library = Tokenizer.from_file(vocabulary_path())
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in corpus_pipeline.run(spark, directory).collect()}
    assert got == expected


def test_rejected_languages(spark, directory, kept_in_languages):
    judged = {r["doc_id"]: r for r in identify(table(spark, directory, "documents")).collect()}
    gone = set(judged) - set(kept_in_languages["doc_id"])
    assert all(judged[i]["lang_pred"] == "und" or judged[i]["score"] < 0.6 for i in gone)
    assert len(gone) <= 0.05 * len(judged)


def test_stages_keep_columns(spark, directory):
    docs = table(spark, directory, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, directory)
        assert done.columns == docs.columns and done.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, directory).count() == 0


def test_names():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert "pipeline" in QUERIES and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_workers_forget(spark):
    """After a task a worker holds no hashes of words; a vocabulary stays for tasks of its own operator only."""
    list(word_hashes.tidied(iter([word_hashes.hashed(["one", "two"])])))
    assert not word_hashes.HASHES
    list(word_hashes.tidied((bpe.vocabulary(p) for p in [bpe.vocabulary_path()]), bpe.vocabulary.cache_clear))
    list(word_hashes.tidied(iter(()), bpe.vocabulary.cache_clear))
    assert bpe.vocabulary.cache_info().currsize == 1
    list(word_hashes.tidied(iter(())))
    assert bpe.vocabulary.cache_info().currsize == 0

    def held(frames):
        for f in frames:
            yield f.assign(id=len(word_hashes.HASHES))

    docs = spark.createDataFrame([(i, f"some words of document {i} and more of them") for i in range(40)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 40
    assert {r["id"] for r in spark.range(0, 40, 1, 8).mapInPandas(held, "id long").collect()} == {0}
