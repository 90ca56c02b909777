"""Exact, near, line and substring deduplication against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from poiscope.llm.alignment import EQUAL, MINE, THEIRS, UNLIKE, alignments, reaches
from poiscope.llm.components import components, sieved
from poiscope.llm.exact_dedup import drop_exact_copies, exact_groups
from poiscope.llm.line_dedup import drop_repeated_lines
from poiscope.llm.near_dedup import best_candidates, drop_near_duplicates, joining_links, near_duplicates, open_members, sketch
from poiscope.llm.perfect_hash import PerfectHash, build
from poiscope.llm.substring_dedup import (
    Fenwick, _crossed, _hashes, _joined, _linked, _runs, _seeds, _sieve, aligned, blocks_of, chains, passages, repeated_passages,
    seeds_of, words_of,
)
from poiscope.llm.words import byte_words, hashed, hashes_of, shingle_set


def text_of(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "X"), (6, "a  b"), (7, "a\nb"), (7, "a\nb"), (None, "a b"), (9, "a b" * 40_000)]


def exact_plain(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        same = groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")]
        keep = min((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(documents, weak):
    rows = EDGES + [(100 + i, f"copy {i % 7}") for i in range(300)]
    options = {"digest": lambda t: F.length(t) % 3} if weak else {}
    got = exact_groups(documents(rows), **options).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == exact_plain(rows)


def test_exact_digest_and_rows_kept(documents, spark):
    docs = documents([(1, "a  b"), (2, "a b"), (3, None)])
    digests = {r["doc_id"]: r["digest"] for r in exact_groups(docs).collect()}
    assert bytes(digests[1]) == bytes(digests[2]) == hashlib.sha256(b"a b").digest()
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert exact_groups(documents([])).count() == 0


def test_exact_runs_without_python(documents):
    docs = documents([(1, "a")])
    for df in (exact_groups(docs), drop_exact_copies(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def lines_plain(rows, min_chars, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            ids = held[key(x)]
            last = max((j for j in ids if j is not None), default=None)
            if len(key(x)) < min_chars or len(ids) < min_docs or (i is not None and i == last):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(documents):
    rng = random.Random(1)
    common = [text_of(rng, 12) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, common[0])]
    for i in range(10, 90):
        lines = [rng.choice(common) if rng.random() < 0.5 else text_of(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(x if rng.random() < 0.7 else f"  {x.upper()}\t" for x in lines)))
    rows.append((95, "\n".join([common[1]] * 500 + ["é" * 40])))
    got = drop_repeated_lines(documents(rows), per_shard=16).collect()
    assert sorted(map(tuple, got), key=str) == lines_plain(rows, 40, 5)
    assert drop_repeated_lines(documents([])).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_lines(documents([]), min_docs=0)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        a, b = (rng.integers(0, 2**63, n, np.uint64) for _ in range(2))
        slots = PerfectHash(*build(a, b)).slots(a, b)
        assert sorted(slots.tolist()) == list(range(n))
    with pytest.raises(ValueError):
        build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def near_plain(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = byte_words(t)
        sets.append({tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set())
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                both, union = len(sets[x] & sets[y]), len(sets[x] | sets[y])
                if label[x] != label[y] and union and 100 * both >= percent * union:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return sorted((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, label))


@pytest.mark.parametrize("k", [2, 5])
def test_near(documents, k):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "\x0b one\ttwo \n"), (7, text_of(rng, 20_000))]
    for i in range(20, 60):
        words = text_of(rng, rng.randrange(30, 300)).split()
        for c in range(rng.randrange(1, 6)):
            edited = [w if rng.random() > rng.choice((0.0, 0.01, 0.04)) else "edited%d" % rng.randrange(99) for w in words]
            rows.append((i * 10 + c, " ".join(edited)))
    got = near_duplicates(documents(rows), words=k).collect()
    assert sorted(map(tuple, got)) == near_plain(rows, k)
    left = drop_near_duplicates(documents(rows), words=k)
    assert sorted(r["doc_id"] for r in left.collect()) == [r[0] for r in near_plain(rows, k) if r[3]]


def test_near_edges(documents):
    assert near_duplicates(documents([])).count() == 0
    rows = [(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, None)]
    got = sorted(map(tuple, near_duplicates(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (2, 1, 2, True), (2, 1, 2, True), (3, 0, 3, True)], key=str)
    with pytest.raises(ValueError):
        near_duplicates(documents([]), percent=50)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 400 + i) for i in range(50)] + [(7, 7)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    parent = {x: x for e in links for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert dict(map(tuple, got)) == {x: find(x) for x in parent} and len(got) == len(parent)


def test_passages(documents):
    rng = random.Random(4)
    shared = text_of(rng, 60).split()
    fuzzy = [w if i % 17 else "changed" for i, w in enumerate(shared)]
    short = text_of(rng, 30).split()
    rows = [(1, None), (2, "few words"), (None, " ".join(shared))]
    for i in range(10, 40):
        inside = {0: shared, 1: fuzzy, 2: short}.get(i % 5, [])
        rows.append((i, " ".join([*text_of(rng, rng.randrange(200)).split(), *inside, *text_of(rng, rng.randrange(200)).split()])))
    rows += [(50, "again " * 2000), (51, "again " * 2000)]
    texts = {i: words_of(t) for i, t in rows}
    got = repeated_passages(documents(rows)).collect()
    found = collections.defaultdict(list)
    for r in got:
        assert r["other_id"] < r["doc_id"] and r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        found[r["doc_id"]].append(texts[r["doc_id"]][r["start_word"] : r["end_word"]])
    for i in range(11, 40):
        wanted = {0: shared, 1: fuzzy}.get(i % 5)
        if wanted:
            assert any(" ".join(wanted[3:-3]) in " ".join(f) for f in found[i]), i
        else:
            assert not found[i]
    assert repeated_passages(documents([])).count() == 0


def test_chain_is_best():
    """The Fenwick tree finds the same best score as trying all predecessors."""
    rng = random.Random(5)
    for _ in range(50):
        blocks = np.array([(rng.randrange(300), rng.randrange(300), rng.randrange(6, 20)) for _ in range(25)])
        score = {}
        for i in np.argsort(blocks[:, 0], kind="stable").tolist():
            x, y, n = blocks[i].tolist()
            gains = [
                score[j] - 0.1 * (x - blocks[j][0] - blocks[j][2] + y - blocks[j][1] - blocks[j][2])
                for j in score
                if blocks[j][0] + blocks[j][2] <= x and blocks[j][1] + blocks[j][2] <= y
            ]
            score[i] = n + max([0.0, *gains])
        best = chains(blocks)[0]
        assert best[-1] == max(score, key=lambda i: score[i]) or abs(score[best[-1]] - max(score.values())) < 1e-9
    tree = Fenwick(3)
    tree.put(2, 5.0, 7)
    assert tree.get(2) == (float("-inf"), -1) and tree.get(3) == (5.0, 7)


@pytest.mark.parametrize("identity, least", [(0.8, 0.95), (0.9, 1), (0.95, 1)])
def test_passages_at_the_identity_promised(documents, identity, least):
    """Passages of 60 words with edited words spread at random, found with nearly all of their words."""
    rng = random.Random(7)
    rows = []
    for i in range(100):
        shared = text_of(rng, 60, 10**6).split()
        edited = list(shared)
        for j in rng.sample(range(1, 59), round(60 * (1 - identity))):
            edited[j] = f"edited{rng.randrange(10**6)}"
        for k, inside in ((2 * i, shared), (2 * i + 1, edited)):
            rows.append((k, " ".join([text_of(rng, 40, 10**6), *inside, text_of(rng, 40, 10**6)])))
    got = {r["doc_id"]: r for r in repeated_passages(documents(rows)).collect()}
    assert all(r["other_id"] == i - 1 and r["identity"] >= 0.8 for i, r in got.items())
    whole = [i for i, r in got.items() if r["start_word"] <= 44 and r["end_word"] >= 96]
    assert len(whole) >= least * 100


@pytest.mark.parametrize("filling", [(60, 60), (45, 80)])
def test_passages_with_other_words_between(documents, filling):
    """Two passages in one order with unlike words between them are both reported."""
    rng = random.Random(8)
    one, two = text_of(rng, 60, 10**6), text_of(rng, 60, 10**6)
    rows = [(i, f"{one} {text_of(rng, n, 10**6)} {two}") for i, n in enumerate(filling)]
    got = sorted((r["start_word"], r["end_word"]) for r in repeated_passages(documents(rows)).collect())
    assert got == [(0, 60), (60 + filling[1], 120 + filling[1])]


def test_passages_whose_parts_stand_in_earlier_documents(documents):
    """Every pair of different texts that shares a passage has a row, whatever shorter parts of it others hold; copies have one."""
    rng = random.Random(9)
    shared, other = text_of(rng, 60, 10**6).split(), text_of(rng, 60, 10**6)
    parts = {1: shared[:36], 2: shared[24:], 5: shared, 6: shared[:36], 7: shared[24:], 9: shared, 11: shared}
    rows = [(i, " ".join([text_of(rng, 30, 10**6), *w, text_of(rng, 30, 10**6)])) for i, w in parts.items()]
    rows += [(3, None), (4, other), (20, other.upper()), (21, f"{other}!"), (22, "too short to be a passage"), (23, "too short to be a passage")]
    # A document that holds the parts before the whole.
    rows.append((30, " ".join([*shared[:36], text_of(rng, 120, 10**6), *shared[24:], text_of(rng, 120, 10**6), *shared])))
    rows.append((40, dict(rows)[9].upper()))
    got = repeated_passages(documents(rows)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    assert pairs == {(9, 5), (11, 5), (11, 9), (30, 5), (30, 9), (30, 11), (20, 4), (21, 4), (40, 5), (40, 9)}
    assert len({tuple(r)[1:] for r in got if r["other_id"] == 5 and r["doc_id"] in (9, 40)}) == 1
    assert {(r["start_word"], r["end_word"], r["n_equal"], r["identity"]) for r in got if r["other_id"] == 4} == {(0, 60, 60, 1.0)}


@pytest.mark.parametrize("edits", [0, 2, 7])
def test_passages_many_documents_hold(documents, edits):
    """A passage and a line of many documents: links of the passage grow with the documents, not with their pairs; the line has none."""
    rng = random.Random(10)
    line, shared = text_of(rng, 14, 10**6), text_of(rng, 60, 10**6).split()
    rows = [(i, f"{text_of(rng, 60, 10**6)} {line} {text_of(rng, 60, 10**6)}") for i in range(200)]
    for i in range(200, 320):
        inside = list(shared)
        for j in rng.sample(range(60), edits):
            inside[j] = f"edited{rng.randrange(10**6)}"
        rows.append((i, f"{text_of(rng, 40, 10**6)} {' '.join(inside)} {text_of(rng, 40, 10**6)} {line}"))
    got = repeated_passages(documents(rows)).collect()
    assert all(r["other_id"] >= 200 and r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50 for r in got)
    label = {i: i for i in range(200, 320)}
    for _ in label:
        for r in got:
            label[r["doc_id"]] = label[r["other_id"]] = min(label[r["doc_id"]], label[r["other_id"]])
    assert edits == 7 or set(label.values()) == {200}
    assert edits == 7 or len(got) < 20 * 120


def test_passages_of_frequent_seeds_are_all_tested():
    """Of occurrences of one seed every two that share a passage are linked or in one class, whatever stands around the others."""
    rng = np.random.default_rng(11)
    for size, edits in ((30, 4), (400, 4), (400, 9)):
        words = rng.integers(0, 256, (size, 105)).astype(np.int16)
        family = rng.integers(0, size // 6, size)
        base = rng.integers(0, 256, (size // 6, 105)).astype(np.int16)
        for i, f in enumerate(family):
            places = rng.choice(60, edits, replace=False) + 20
            words[i, 20:80] = base[f, 20:80]
            words[i, places] = rng.integers(0, 256, edits)
        words[:, 44:61] = words[0, 44:61]
        x, y = _linked(np.arange(size), np.zeros(size, int), words, 50, 80)
        assert (x > y).all()
        label = np.arange(size)
        for _ in range(size):
            np.minimum.at(label, x, label[y])
            np.minimum.at(label, y, label[x])
        u, v = np.triu_indices(size, 1)
        alike = (words[u, 20:80] == words[v, 20:80]).cumsum(axis=1)
        alike = (alike[:, 49:] - np.c_[np.zeros(len(u), int), alike[:, :10]]).max(axis=1) >= 40
        assert alike.any() and (label[u[alike]] == label[v[alike]]).all()


def test_blocks_without_a_passage_are_told_before_alignment():
    """What the bounds turn away has no passage by alignment."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        a = rng.integers(0, rng.choice([3, 8, 40, 256]), 200).astype(np.uint8)
        b = np.where(rng.random(200) < rng.choice([0.1, 0.3, 0.5, 0.95]), rng.integers(0, 256, 200), a).astype(np.uint8)
        b = np.delete(b, rng.integers(0, 200, rng.integers(0, 6)))
        x, n = int(rng.integers(0, 180)), int(rng.choice([5, 12, 20]))
        y = int(min(len(b) - n, x))
        b[y : y + n] = a[x : x + n] if x + n <= 200 else b[y : y + n]
        if x + n <= 200:
            rows.append((a.tobytes(), b.tobytes(), [(x, y, n)]))
    may = _sieve(rows, 50, 75)
    real = [bool(passages(aligned(*row)[2], 50, 75)) for row in rows]
    assert any(real) and not all(may) and not any(r and not m for r, m in zip(real, may))


def test_passages_cut_by_identity():
    """A chain under the identity keeps the parts that reach it, each as long as it can be."""
    path = [(1, 1, 1)] * 60 + [(1, 1, 0)] * 70 + [(1, 1, 1)] * 50 + [(1, 0, 0)] * 5
    assert passages(path, 50, 80) == [(0, 60, 0, 60, 60), (130, 180, 130, 180, 50)]
    assert passages(path, 61, 80) == [] and passages([], 50, 80) == []
    assert passages([(1, 1, 1)] * 60 + [(1, 1, 0)] * 20 + [(1, 1, 1)] * 60, 50, 80) == [(0, 140, 0, 140, 120)]


def between_plain(a, b):
    """Columns of an alignment of both with the most equal words, equal ones at the start on the diagonal."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    rows = [[0] * (len(y) + 1)]
    for w in x:
        last, row = rows[-1], [0]
        for j, v in enumerate(y):
            row.append(last[j] + 1 if w == v else max(last[j + 1], row[j]))
        rows.append(row)
    i, j, path = len(x), len(y), []
    while i or j:
        if i and j and (x[i - 1] == y[j - 1] or rows[i][j] == rows[i - 1][j - 1]):
            i, j = i - 1, j - 1
            path.append(EQUAL if x[i] == y[j] else UNLIKE)
        elif i and rows[i][j] == rows[i - 1][j]:
            i -= 1
            path.append(MINE)
        else:
            j -= 1
            path.append(THEIRS)
    return [EQUAL] * head + path[::-1]


def outwards_plain(a, b):
    """(words of a, words of b, columns) of a walk from the start in a band of 8, ending where all scores are 12 below the best."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    low = float("-inf")
    last = {j: -j for j in range(min(8, len(b)) + 1)}
    rows, best, equal = [last], 0, [(0, 0, 0)]
    for i, w in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - 8), min(len(b), i + 8) + 1):
            score = max(last.get(j, low), row.get(j - 1, low)) - 1
            if j:
                score = max(score, last.get(j - 1, low) + (1 if w == b[j - 1] else -1))
            if score >= best - 12:
                row[j] = score
                best = max(best, score)
                if j and w == b[j - 1] and score == last.get(j - 1, low) + 1:
                    equal.append((i + j, i, j))
        if not row:
            break
        rows.append(row)
        last = row
    _, i, j = max((n, i, j) for n, i, j in equal if rows[i][j] >= best - 4)
    ends, path = (head + i, head + j), []
    while i or j:
        here, up = rows[i][j], rows[i - 1] if i else {}
        same = bool(i and j and a[i - 1] == b[j - 1])
        if i and j and here == up.get(j - 1, low) + (1 if same else -1):
            i, j = i - 1, j - 1
            path.append(EQUAL if same else UNLIKE)
        elif i and here == up.get(j, low) - 1:
            i -= 1
            path.append(MINE)
        else:
            j -= 1
            path.append(THEIRS)
    return *ends, [EQUAL] * head + path[::-1]


def test_alignments_of_many_chains():
    """Alignments in numpy are those of the plain walk and of the plain alignment of gaps, and reaches tells how far they go."""
    rng = random.Random(13)
    rows = []
    for _ in range(300):
        kinds, rate = rng.choice([3, 10, 60, 250]), rng.choice([0, 0.05, 0.1, 0.2, 0.4])
        noise = lambda n: [rng.randrange(kinds) for _ in range(rng.choice(n))]  # noqa: E731, B023
        a = noise([5, 60, 200, 400])
        b = [v for w in a for v in ((w,) if rng.random() >= rate else rng.choice([(), (rng.randrange(kinds),), (w, rng.randrange(kinds))]))]
        before, other = noise([0, 3, 150]), noise([0, 3, 150])
        a, b = [*before, *a, *noise([0, 3, 150])], [*other, *b, *noise([0, 3, 150])]
        # Two seeds that are equal and in order, if there are.
        first = next(((i, j) for i in range(len(before), len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]), None)
        if first:
            i, j = first
            second = [(p, q, 5) for p in range(i + 5, min(len(a) - 4, i + 60)) for q in range(j + 5, min(len(b) - 4, j + 60)) if a[p : p + 5] == b[q : q + 5]]
            rows.append((a, b, [(i, j, 5), *second[-1:]]))
    sizes, others = np.cumsum([0] + [len(a) for a, _, _ in rows]), np.cumsum([0] + [len(b) for _, b, _ in rows])
    bounds = np.stack([sizes[:-1], sizes[1:], others[:-1], others[1:]], axis=1)
    flat = [np.concatenate([r[side] for r in rows]).astype(np.int16) for side in (0, 1)]
    moved = [np.array(c) + [x, y, 0] for (_, _, c), x, y in zip(rows, sizes, others)]
    got = alignments(*flat, bounds, moved, 0)
    low, high, most = reaches(*flat, bounds, moved)
    for k, (a, b, chain) in enumerate(rows):
        path, (x, y, _) = [], chain[0]
        for i, (p, q, n) in enumerate(chain):
            if i:
                path += between_plain(a[chain[i - 1][0] + 5 : p], b[chain[i - 1][1] + 5 : q])
            path += [EQUAL] * n
        i, j, left = outwards_plain(a[max(0, x - 128) : x][::-1], b[max(0, y - 128) : y][::-1])
        p, q = chain[-1][0] + 5, chain[-1][1] + 5
        m, _, right = outwards_plain(a[p : p + 128], b[q : q + 128])
        path = left[::-1] + path + right
        assert (got[k][0] - sizes[k], got[k][1] - others[k], got[k][2].tolist()) == (x - i, y - j, path)
        assert (low[k] - sizes[k], high[k] - sizes[k]) == (x - i, p + m) and most[k] >= path.count(EQUAL)
    assert len(rows) > 150


def test_texts_read_many_at_once():
    """Hashes, seeds and digests of texts read together are those of each text alone."""
    rng = random.Random(14)
    raw = [bytes(rng.randrange(256) for _ in range(n % 70)) for n in range(500)]
    ends = np.cumsum([len(w) for w in raw])
    sizes = np.diff(np.r_[0, ends])
    assert hashes_of(b"".join(raw), ends - sizes, sizes).tolist() == [xxhash.xxh64_intdigest(w) for w in raw]
    odd = [None, "", "a", "a b c d e", "a b c d e f g", "\u0130stanbul \u01c5 \u00df a_b " + "x y z " * 9, "\u00bd \u00b2 \u4e2d\u6587 \u0000 ok", " . ", "again " * 300, "\u0130"]
    texts = [*odd, *(text_of(rng, rng.randrange(80)) for _ in range(40)), *odd]
    bodies = _joined(texts)
    assert [b.decode().split(" ")[:-1] for b in bodies] == [words_of(t) for t in texts]
    counts = np.array([len(words_of(t)) for t in texts])
    h, at, who = _seeds(_hashes(bodies), counts)
    for k, t in enumerate(texts):
        seeds, places = seeds_of(hashed(words_of(t)))
        assert h[who == k].tolist() == seeds.tolist() and at[who == k].tolist() == places.tolist()


def test_passages_whose_seeds_repeat_in_both_documents(documents):
    """A passage that keeps eight words in a row only, which stand in both documents before it too, has a row."""
    rng = random.Random(15)
    seed, new = text_of(rng, 8, 10**6), lambda n: text_of(rng, n, 10**6)
    left, right = new(30).split(), new(30).split()
    edited = [[w if i % 5 else f"edited{i}" for i, w in enumerate(side)] for side in (left[::-1], right)]
    one = " ".join([*left, seed, *right])
    two = " ".join([*edited[0][::-1], seed, *edited[1]])
    rows = [(1, f"{new(70)} {seed} {new(70)} {one} {new(70)}"), (2, f"{new(90)} {seed} {new(80)} {two} {new(70)}")]
    got = [tuple(r) for r in repeated_passages(documents(rows)).collect()]
    assert len(got) == 1 and got[0][0] == 2 and got[0][3] == 1 and got[0][1] >= 175 and got[0][2] - got[0][1] >= 50


@pytest.mark.parametrize("count", [2, 12])
def test_passages_of_one_word_are_whole(documents, count):
    """A word that many documents repeat for longer than an alignment reaches is one passage in each."""
    rng = random.Random(16)
    sizes = [600, 600, 900, *[600] * 9][:count]
    rows = [(i, f"{text_of(rng, 60, 10**6)} {'again ' * n}{text_of(rng, 60, 10**6)}") for i, n in enumerate(sizes)]
    got = collections.defaultdict(list)
    for r in repeated_passages(documents(rows)).collect():
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
    for i, n in enumerate(sizes[1:], 1):
        assert max(e - s for s, e in got[i]) == min(n, 600)
        assert {w for s, e in got[i] for w in range(s, e)} == set(range(60, 60 + n))


def test_runs_of_places():
    """Every place is in one run, of equal steps of at most the widest; matches of runs are those of all their places."""
    rng = random.Random(17)
    for _ in range(300):
        group, places = [], []
        for k in range(rng.randrange(1, 5)):
            steps = [rng.choice([2, 2, 2, 3, 7, 150]) for _ in range(rng.randrange(1, 9))]
            group += [k] * len(steps)
            places += list(itertools.accumulate(steps))
        group, places = np.array(group), np.array(places)
        held = []
        for first, n, step in zip(*_runs(group, places, 100)):
            assert (n == 1) == (step == 0) and step <= 100 and (np.diff(places[first : first + n]) == step).all()
            assert len(set(group[first : first + n].tolist())) == 1
            held += range(first, first + n)
        assert held == list(range(len(places)))
        n, m, d = rng.randrange(1, 6), rng.randrange(1, 6), rng.choice([6, 9, 50])
        e = rng.choice([d, d, 7])
        runs = [np.array([v]) for v in (10, n, d if n > 1 else 0, 3, m, e if m > 1 else 0)]
        got = [np.concatenate(c) for c in zip(*(part[1:] for part in _crossed(*runs)))]
        x, y = np.array([(10 + i * d, 3 + j * e) for i in range(n) for j in range(m)]).T
        blocks = [blocks_of(np.zeros(len(c[0]), int), *c)[1].tolist() for c in (got, (x, y, np.full(len(x), 5)))]
        assert sorted(blocks[0]) == sorted(blocks[1])


def components_of_sets(texts, k, percent=80):
    """Components by one product of the incidence matrix: fit for a few thousand texts."""
    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    column = {}
    held = np.zeros((len(texts), len(set().union(*sets))), np.float32)
    for i, found in enumerate(sets):
        held[i, [column.setdefault(x, len(column)) for x in found]] = 1
    size = held.sum(axis=1)
    label = np.arange(len(texts))
    links = []
    for i in range(len(texts)):
        both = held[i] @ held[:i].T
        links += [(i, j) for j in np.flatnonzero(100 * both >= percent * (size[i] + size[:i] - both)).tolist()]

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in links:
        a, b = top(i), top(j)
        label[max(a, b)] = min(a, b)
    return [int(top(i)) for i in range(len(texts))]


@pytest.mark.parametrize("count, words, edits, part", [(1200, 200, (5, 8), 256), (2300, 120, (1, 4), 1024)])
def test_near_families_lose_no_link(documents, count, words, edits, part):
    """Variants of one template, many pairs of which are just under the similarity."""
    rng = random.Random(count)
    template = text_of(rng, words, 10**6).split()
    texts = []
    for _ in range(count):
        new = list(template)
        for at in rng.sample(range(words), rng.randrange(edits[0], edits[1] + 1)):
            new[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(new))
    got = near_duplicates(documents(enumerate(texts), clashing=False), words=2, part=part).collect()
    assert [r["component_id"] for r in sorted(got)] == components_of_sets(texts, 2)


def test_near_families_hand_on_no_pairs():
    """A task hands on a row per member, not per pair, however many pairs are alike."""
    rng = random.Random(9)
    template = text_of(rng, 150, 10**6).split()
    texts = []
    for _ in range(300):
        new = list(template)
        for at in rng.sample(range(150), rng.randrange(1, 12)):
            new[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(new))
    f = pd.DataFrame([(0, i, n, short) for i, (n, _, _, _, short) in enumerate(sketch(texts, 2))], columns=["tile", "rep", "n", "short"])
    got = best_candidates(80)(f)
    assert 200 < len(got) < 300 and got["more"].sum() > 200 and (got["owner"] > got["other"]).all()
    sets = [shingle_set(hashed(byte_words(t)), 2) for t in texts]
    links = joining_links(np.arange(300), np.arange(300), sets, 80)
    wanted = components_of_sets(texts, 2)
    assert len(links) == 300 - len(set(wanted)) < 300
    label = list(range(300))
    for u, v in links:
        both = len(np.intersect1d(sets[u], sets[v]))
        assert 100 * both >= 80 * (len(sets[u]) + len(sets[v]) - both)
        low, high = sorted((label[u], label[v]))
        label = [low if x == high else x for x in label]
    assert label == wanted
    assert joining_links(np.arange(300), np.array(wanted), sets, 80) == []
    # Sets go only where a candidate pair of different components with an owner that goes on is left.
    f = f.assign(component=[0, 1] * 150, going=f["rep"] >= 200, token=2**32 + 5, tokens=[[2**32 + 5, 2**33 - 7]] * 300)
    values = np.stack([np.frombuffer(x, np.uint8) for x in f["short"]])
    alike = (values[:, None] == values[None]).sum(axis=2) >= 80
    sizes = f["n"].to_numpy()
    alike &= 100 * np.minimum.outer(sizes, sizes) >= 80 * np.maximum.outer(sizes, sizes)
    left = {x for i in range(200, 300) for j in range(i) if alike[i, j] and (i - j) % 2 for x in (i, j)}
    assert open_members(80)(f)["rep"].tolist() == sorted(left)
    assert open_members(80)(f.assign(token=2**33 - 7)).empty  # they have met in a list before
    assert open_members(80)(f.assign(component=0)).empty and open_members(80)(f.assign(going=False)).empty


def test_near_drifting_chain(documents):
    """Each text is near the one before it and far from most others."""
    rng = random.Random(6)
    words = text_of(rng, 200, 10**6).split()
    texts = []
    for _ in range(400):
        for at in rng.sample(range(200), 8):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_duplicates(documents(rows, clashing=False), words=2).collect()
    assert [r["component_id"] for r in sorted(got)] == components_of_sets(texts, 2)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_sieve_holds_back_none_that_is_wanted(spark, bits):
    docs = spark.range(-20_000, 20_000).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS id"))
    wanted = spark.range(-20_000, 20_000, 97)
    got = {r["id"] for r in sieved(docs, "id", wanted, bits).collect()}
    assert got >= {r["id"] for r in wanted.collect()} and None not in got
    assert len(got) < (5000 if bits == 1 << 20 else 30_000)
