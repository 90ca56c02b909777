"""Fingerprints, spelling variants and conversation repair against plain versions."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from poiscope.llm import conversations as talk
from poiscope.llm.conversations import damaged, repair_reports, repaired_turns
from poiscope.llm.simhash import THIRDS, PIVOTS, cells, distance_table, fingerprint, fingerprint_groups
from poiscope.llm.spelling import near_words, roots, spelling_groups

SPACE = "[\x20\x09-\x0d]"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Fingerprints


def print_plain(text, words=3):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(text or ""))
    k = min(words, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_plain(rows):
    prints = [print_plain(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        if (prints[x] ^ prints[y]).bit_count() <= 2:
            label[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return sorted(((i, f"{p:016x}", least.get(top(x))) for x, ((i, _), p) in enumerate(zip(rows, prints))), key=str)


def close_family(rng, count):
    """Long texts that differ in a word: fingerprints a few bits apart, many distinct."""
    words = [f"w{rng.randrange(900)}" for _ in range(1500)]
    for _ in range(count):
        words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
        yield " ".join(words)


@pytest.mark.parametrize("part", [2048, 3])
def test_fingerprint_groups(documents, part):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "X"), (6, "a  b"), (7, "a\x0bb C"), (7, "a b c d"), (None, "a b c"), (None, None)]
    rows += [(8, "é É ß"), (9, "lone words here " * 30_000)]
    rows += [(100 + i, t) for f in range(3) for i, t in enumerate(close_family(rng, 60), 100 * f)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    got = fingerprint_groups(documents(rows), part=part).collect()
    assert sorted(map(tuple, got), key=str) == groups_plain(rows)
    assert fingerprint_groups(documents([])).count() == 0


def test_fingerprint_hash_is_that_of_the_engine(documents):
    text = "Ein Wort mit Umläuten öffnet"
    docs = documents([(1, lowered(text))], clashing=False)
    words = F.split("text", " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.array_join(F.slice(words, i, 3), " ")))
    hashes = [h % 2**64 for h in docs.select(parts).first()[0]]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_cells_lose_no_pair_and_tables_bound_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 500, np.uint64, endpoint=False)
    flips = np.array([1 << a | 1 << b for a, b in rng.integers(0, 64, (500, 2)).tolist()], np.uint64)
    one, two = distance_table(x), distance_table(x ^ flips)
    assert np.abs(one - two).max() <= 2
    assert np.logical_or.reduce([a == b for a, b in zip(cells(one), cells(two))]).all()
    assert sorted(p for t in THIRDS for p in t) == list(range(1, len(PIVOTS)))
    assert [int(c.max()) for c in cells(distance_table(np.array([2**64 - 1], np.uint64)))] == [3**11 - 1, 3**11 - 1, 3**10 - 1]


# Spelling variants


def variants_of(word):
    """All words one edit away over a small alphabet, as patterns: a hole for the letter edited."""
    return {(word[:i] + "\0" + word[i + 1 :]) for i in range(len(word))}


def one_edit_plain(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted_plain(rows, least=7, every=31):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def spelling_plain(n):
    near = {w: [x for x in n if one_edit_plain(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        end = w
        while form[end] is not None:
            end = form[end]
        out.append((w, form[w], end, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def varied(rng, word, letters="abcdé÷"):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("every", [31, 3])
def test_spelling(documents, every):
    rng = random.Random(every)
    base = ["".join(rng.choice("abcdÉé") for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "short words only"), (None, "Abcdabcd abcdabcd"), (4, "x" * 50_000 + " " + "x" * 50_000), (5, "x" * 49_999)]
    rows += [(6, "x" * 49_999 + "1" + "X" * 49_999), (7, "Straße" * 3), (7, "Straße" * 3)]
    for i in range(10, 130):
        words = rng.choices(base, range(1, 26), k=40) + [varied(rng, rng.choice(base)) for _ in range(20)]
        words += [varied(rng, varied(rng, rng.choice(base))) for _ in range(10)]
        rows.append((i, ", ".join(w if rng.random() < 0.9 else w.upper().replace("É", "é") for w in words)))
    expected = spelling_plain(counted_plain(rows, every=every))
    got = sorted(map(tuple, spelling_groups(documents(rows), every=every).collect()))
    assert got == expected
    assert any(f is not None for _, f, *_ in got) and any(c[4] > 1 for c in got)
    assert spelling_groups(documents([])).count() == 0


@pytest.mark.parametrize("parts", [(2048, 1 << 20), (2, 1 << 20), (50, 30)])
def test_near_words_however_blocks_are_cut(spark, parts):
    rng = random.Random(9)
    n = {"".join(rng.choice("abcé") for _ in range(rng.randrange(3, 7))): rng.randrange(1, 5) for _ in range(400)}
    got = near_words(spark.createDataFrame(list(n.items()), "word string, n long"), *parts).collect()
    expected = []
    for w in n:
        if near := [x for x in n if one_edit_plain(w, x)]:
            best = min(near, key=lambda x: (-n[x], x))
            expected.append((w, len(near), n[best], best))
    assert sorted(map(tuple, got)) == sorted(expected)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(18)] + [("a", "w05"), ("b", "c")]
    got = dict(map(tuple, roots(spark.createDataFrame(links, "word string, form string")).collect()))
    assert got == {**{f"w{i:02}": "w18" for i in range(18)}, "a": "w18", "b": "c"}


# Conversations


def repair_plain(rows):
    """(cost, audit) by trying edits breadth-wise over prefixes: rows of (initial, fault)."""
    best = {(0, ""): {"": 0}}
    layers = [{("", ""): 0}]
    form = re.compile("(s?(ua)+)?")

    def begins(roles):
        return re.fullmatch("(s?(ua)*u?)?", roles)

    def grown(layer):
        """All insertions after a layer, up to two at a place."""
        out = dict(layer)
        for _ in range(3):
            for (roles, audit), cost in list(out.items()):
                for r in "ua":
                    if begins(roles + r):
                        key = (roles + r, audit + "I")
                        out[key] = min(out.get(key, cost + 2), cost + 2)
        return out

    layer = grown(layers[0])
    for initial, fault in rows:
        new = {}

        def put(roles, audit, cost):
            if begins(roles) and cost < new.get((roles, audit), 10**9):
                new[roles, audit] = cost

        for (roles, audit), cost in layer.items():
            put(roles, audit + "D", cost + 3)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial:
                    put(roles + initial, audit + "K", cost + more)
                for r in "ua":
                    put(roles + r, audit + "R", cost + 2 + more)
        layer = grown(new)
        least = min(layer.values())
        layer = {k: c for k, c in layer.items() if c <= least + 8}
    return min((cost, audit) for (roles, audit), cost in layer.items() if form.fullmatch(roles))


@pytest.mark.parametrize("segment", [256, 2, 3])
def test_lightest_edits(monkeypatch, segment):
    monkeypatch.setattr(talk, "SEGMENT", segment)
    rng = random.Random(segment)
    cases = [c for n in range(4) for c in itertools.product(itertools.product("sux", ["", "blank", "truncated"]), repeat=n)]
    cases = rng.sample(cases, 100) + [[(rng.choice("suuaax"), rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randrange(4, 8))] for _ in range(60)]
    for case in cases:
        edits, quiet = [], talk.Repair()
        repair = talk.Repair(lambda *e: edits.append(e))
        for i, (initial, fault) in enumerate(case):
            for r in (repair, quiet):
                r.add(talk.letter_of(initial, fault), {"s": "system", "u": "user", "a": "assistant"}.get(initial, "x"), str(i))
        found = repair.close()
        assert found == quiet.close()
        assert found[:2] == repair_plain(case), case
        said = "\n".join(f"{role}:{text}" for edit, role, text in edits if edit != "D")
        assert found[2] == hashlib.sha256(said.encode()).hexdigest()
        assert "".join(e[0] for e in edits) == found[1]
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for edit, role, _ in edits if edit != "D"))
        assert [t for edit, _, t in edits if edit != "I"] == [str(i) for i in range(len(case))]


def dijkstra_plain(rows):
    """(cost, audit) over whole rows, without segments."""
    (value,) = talk.lightest("".join(talk.letter_of(*r) for r in rows), {talk.START: (0, "")}, True).values()
    return value[:2]


def test_long_conversations_pass_in_segments(monkeypatch):
    monkeypatch.setattr(talk, "SEGMENT", 16)
    rng = random.Random(5)
    for odds in (["", ""], ["", "blank", "truncated"], ["blank"]):
        for roles in ("ua", "suax", "u", "s", "uax"):
            case = [(rng.choice(roles), rng.choice(odds)) for _ in range(200)]
            repair = talk.Repair()
            for initial, fault in case:
                repair.add(talk.letter_of(initial, fault), initial, "")
                assert len(repair.rows) < 16 and len(repair.items) <= 4 and not repair.held
            assert repair.close()[:2] == dijkstra_plain(case)


def reports_plain(rows):
    """Reports of rows (conv, turn, role, text) as the contract words it."""
    out, kept = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    for conv, held in kept.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in held:
            last = re.sub(f"{SPACE}+$", "", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        turns = {t for t, _, _ in held if t is not None}
        cost, audit = dijkstra_plain([(r[1][:1], f) for r, f in zip(held, faults)])
        said, left = [], iter(held)
        for edit in audit:
            want = "u" if not said or said[-1][0] != "u" else "a"
            name = {"u": "user", "a": "assistant"}[want]
            if edit == "I":
                said.append(f"{name}:")
                continue
            _, role, text = next(left)
            if edit != "D":
                said.append(f"{role if edit == 'K' else name}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


CASES = "conv_id long, turn long, role string, text string"


def conversations_of(spark, rows):
    df = spark.createDataFrame(list(rows), CASES)
    for name in ("conv", "kind", "digest", "fault", "when", "first", "copy"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def test_reports(spark):
    rng = random.Random(8)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "Same."), (1, 5, "user", "Same."), (1, 9, "", "Who?")]
    rows += [(2, None, None, None), (2, 1, "user", None), (3, 1, "user", "x" * 200_000 + ".")]
    rows += [(4, 7, "user", "Tie."), (4, 7, "user", "Tie."), (4, 7, "assistant", "Other tie"), (4, 7, "system", "Third!\n ")]
    for conv in range(10, 250):
        for turn in range(rng.randrange(1, 12)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", " "])
            text = rng.choice(["Yes.", "No!", f"Words {rng.randrange(40)}.", "cut off", " \t", "Who?\n"])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
    rows += [(300, t, ["user", "assistant"][t % 2], f"Turn {t % 700}.") for t in range(1500)]
    rng.shuffle(rows)
    table = conversations_of(spark, rows)
    got = sorted(map(tuple, repair_reports(damaged(table)).collect()), key=str)
    assert got == reports_plain(rows)
    # The edits told one by one leave what the digest is of.
    told = collections.defaultdict(list)
    for r in sorted(repaired_turns(damaged(table)).collect(), key=lambda r: (str(r["conv"]), r["place"])):
        told[r["conv"]].append(r)
    for conv, *_, audit, digest in got:
        assert audit == "".join(r["edit"] for r in told[conv])
        assert digest == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in told[conv] if r["edit"] != "D").encode()).hexdigest()
    assert repair_reports(damaged(conversations_of(spark, []))).count() == 0


def test_registered_variant_queries(spark, directory):
    from poiscope.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{directory}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, directory).collect()), key=str) == reports_plain(rows)
    docs = [tuple(r) for r in spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_simhash"](spark, directory).collect()), key=str) == groups_plain(docs)
