"""Near-duplicate documents by an inverted join over signature coordinates.

A document is the set of its word shingles; its signature holds the minimum of the set under each of 48
permutations, and a byte of the minimum under 80 more. Equal sets become one class first, known by 128 bits of hash over the whole set. Classes are
posted under (coordinate, value). Two sets of the wanted similarity agree in at least 24 coordinates but for a chance of
about one in a million, so only the 25 rarest coordinates of a class are posted (prefix), values held by one class and
classes that share too few values are skipped. Candidates are pairs that meet so and agree in 80 of all 128 coordinates,
which two sets of the wanted similarity fail to do as rarely, and two sets of half of it nearly always do.

The members of a posting list, or of two bounded parts of a long one, meet in a task, which counts the coordinates
in which each two agree, if their sizes allow the similarity. Of a pair the class with the larger id is the owner. Each task hands on
an owner's best candidate and whether it has more; an owner's best two are confirmed on the full sets, and the links
found are closed to components. Most families end here. Where an owner has more candidates, the members of its lists that
are in a candidate pair of different components send their full sets to the first list of the pair, and all pairs of
different components are tested in the task. Of the links found a task hands on those that join its components, so rows stay as many as the members of lists
while no pair goes untested.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; fewer words
than a shingle form one shingle; a row without id is left alone (component null, kept). Documents are known by
id: where rows repeat one with different texts, either text may stand for it. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.boosting import written
from poiscope.llm.components import components, forget, per_slice, sieved, slice_of, slices_seen
from poiscope.llm.words import byte_words, hashed, permutations, shingle_set, tidied

COORDINATES = 48
MATCHES = 24
ESTIMATE = 128  # coordinates of which a pair is compared, the ones posted among them, on one byte each
LIKELY = 80
PREFIX = COORDINATES - MATCHES + 1
CONFIRMED = 2  # best candidates of an owner that are confirmed on their own
AT_ONCE = 1024  # shingles under all permutations at a time
REMEMBERED = 4_000_000  # shingles of sets that a task keeps at hand
PART = 1024  # members of a list that meet at once are at most two of these
PART_SHINGLES = 1_000_000  # shingles of the members of a list whose sets meet at once are about two of these at most


def sketch(texts: Iterator[str | None], words: int) -> Iterator[tuple[int, int, int, np.ndarray | None, bytes | None]]:
    """(set size, two hashes of the set, signature, one byte of each coordinate) of each text."""
    xor, times = permutations(ESTIMATE)
    for text in texts:
        found = shingle_set(hashed(byte_words(text)), words)
        if not len(found):
            yield 0, 0, 0, None, None
            continue
        low = np.full(ESTIMATE, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(found), AT_ONCE):
            part = found[i : i + AT_ONCE]
            low = np.minimum(low, ((part[:, None] ^ xor) * times).min(axis=0))
        whole = xxhash.xxh128_intdigest(found.tobytes())
        signed = np.array([whole >> 64, whole & (2**64 - 1)], np.uint64).view(np.int64)
        high = (low >> np.uint64(32)).astype(np.uint32)
        yield len(found), int(signed[0]), int(signed[1]), high[:COORDINATES].view(np.int32), high.astype(np.uint8).tobytes()


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    kind = "struct<n: long, a: long, b: long, sig: array<int>, short: binary>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return tidied(pd.DataFrame(list(sketch(texts, words)), columns=["n", "a", "b", "sig", "short"]) for texts in batches)

    return docs.select("id", run("text").alias("s")).select("id", "s.*")


def _postings(classes: DataFrame) -> DataFrame:
    """(rep, token): the rarest shared values of each class that shares enough of them."""
    tokens = classes.select("rep", F.posexplode("sig").alias("i", "v")).select(
        "rep", (F.col("i").cast("long") * F.lit(2**32) + F.col("v")).alias("token")
    )
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    per_class = tokens.join(common, "token").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("held", "token"))).alias("tokens")
    )
    # Values nobody else holds come first in the prefix.
    length = F.lit(PREFIX - COORDINATES) + F.size("tokens")
    return per_class.filter(F.size("tokens") >= MATCHES).select("rep", F.explode(F.slice("tokens", 1, length)).alias("t")).select(
        "rep", "t.token"
    )


def _meetings(placed: DataFrame, part: int, heavy: Column | None = None) -> DataFrame:
    """(tile, rep, component, further columns): members of lists (rep, token, component) that hold several components.

    A tile is a list, or two parts of a long one. heavy: what a member weighs as a share of a part, beside its own number.
    """
    parts = F.ceil(F.count(F.lit(1)) / part)
    lists = (
        placed.groupBy("token")
        .agg(
            F.min("component").alias("first"),
            F.max("component").alias("last"),
            (parts if heavy is None else F.greatest(parts, F.ceil(F.sum(heavy)))).alias("parts"),
        )
        .filter("first <> last")
        .select("token", "parts")
    )
    mine = F.pmod(F.xxhash64("rep"), F.col("parts"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: j != F.col("mine"))
    )
    met = placed.join(lists, "token").withColumn("mine", mine).withColumn("other", F.explode(others))
    tile = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile")
    return met.select(tile, *placed.columns)


def _by_tile(of: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task over rows sorted by tile that calls `of` with the rows of whole tiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            begin = int(np.searchsorted(f["tile"].to_numpy(), f["tile"].iat[-1]))
            if begin:
                yield of(f.iloc[:begin])
            rest = f.iloc[begin:]
        if rest is not None:
            yield of(rest)

    return run


def _likely_pairs(f: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of owners, places of others, matches) of the pairs of (tile, rep, n, short) that meet in a tile and agree well
    enough, in portions. Sets of too unlike sizes do not."""
    tile, rep, n = (f[c].to_numpy() for c in ("tile", "rep", "n"))
    values = np.frombuffer(b"".join(f["short"]), np.uint8).reshape(-1, ESTIMATE)
    at, step = np.arange(len(f)), 1
    while len(at):
        at = at[: np.searchsorted(at, len(f) - step)]
        at = at[tile[at] == tile[at + step]]
        i = at[rep[at] != rep[at + step]]
        i, j = np.where(rep[i] > rep[i + step], i, i + step), np.where(rep[i] > rep[i + step], i + step, i)
        fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            same = np.count_nonzero(values[a] == values[b], axis=1)
            likely = same >= LIKELY
            yield a[likely], b[likely], same[likely]
        step += 1


def best_candidates(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of (tile, rep, n, short) in order of tile: of every owner in a batch of tiles the best candidate (owner, other, matches,
    more) and whether it has more."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(f["rep"].to_numpy(), return_inverse=True)
        # Best and places of first and last candidate of each owner; a candidate is its place after how many coordinates differ.
        best, first, last = (np.full(len(ids), v, np.int64) for v in (np.iinfo(np.int64).max, len(ids), -1))
        for a, b, same in _likely_pairs(f, percent):
            owner, other = code[a], code[b]
            np.minimum.at(best, owner, (ESTIMATE - same) * len(ids) + other)
            np.minimum.at(first, owner, other)
            np.maximum.at(last, owner, other)
        held = np.flatnonzero(last >= 0)
        low, other = np.divmod(best[held], len(ids))
        return pd.DataFrame({"owner": ids[held], "other": ids[other], "matches": ESTIMATE - low, "more": first[held] != last[held]})

    return of


def open_members(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of (tile, rep, component, going, n, short, token, tokens) in order of tile: the members (tile, rep, component) of a candidate
    pair of different components whose owner goes on, in the first of the lists that hold both."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        component, going = f["component"].to_numpy(), f["going"].to_numpy(bool)
        here = f["token"].to_numpy() + 2**31 >> 32  # the coordinate
        every, row = np.concatenate(f["tokens"].to_list()), np.repeat(np.arange(len(f)), f["tokens"].str.len())
        tokens, has = np.zeros((len(f), COORDINATES), np.int64), np.zeros((len(f), COORDINATES), bool)
        tokens[row, every + 2**31 >> 32], has[row, every + 2**31 >> 32] = every, True
        wanted = np.zeros(len(f), bool)
        for a, b, _ in _likely_pairs(f, percent):
            apart = going[a] & (component[a] != component[b])
            a, b = a[apart], b[apart]
            both = (tokens[a] == tokens[b]) & has[a] & has[b]
            # An id with several texts may be here by a token of another of them.
            first = (both.argmax(axis=1) == here[a]) | ~both[np.arange(len(a)), here[a]]
            wanted[a[first]] = wanted[b[first]] = True
        return f.loc[wanted, ["tile", "rep", "component"]]

    return of


def _candidates(postings: DataFrame, classes: DataFrame, percent: int, part: int) -> DataFrame:
    """(owner, next, more): every owner's best candidates (-matches, other) in order, and whether it has others."""
    meetings = _meetings(postings.withColumn("component", F.col("rep")), part).select("tile", "rep")
    rows = meetings.join(classes.select("rep", "n", "short"), "rep").repartition("tile").sortWithinPartitions("tile")
    found = rows.mapInPandas(_by_tile(best_candidates(percent)), "owner long, other long, matches long, more boolean")
    every = F.sort_array(F.collect_set(F.struct((-F.col("matches")).alias("low"), "other")))
    return found.groupBy("owner").agg(every.alias("every"), F.max("more").alias("more")).select(
        "owner", F.slice("every", 1, CONFIRMED).alias("next"), (F.col("more") | (F.size("every") > CONFIRMED)).alias("more")
    )


def joining_links(rep: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (u, v) that join all components whose members are linked, as many as it takes.

    Every member outside the largest component is held against all others, by the lists of who has each of its shingles.
    """
    size = np.array([len(s) for s in sets])
    label = np.unique(component, return_inverse=True)[1]
    held, who, ends = np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size.cumsum()
    order = np.argsort(held, kind="stable")
    new = np.r_[True, np.diff(held[order]) != 0]
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    begin, many = np.empty(len(held), np.int64), np.empty(len(held), np.int64)
    begin[order], many[order] = first[run], np.diff(np.r_[first, len(held)])[run]
    holders, tested, out = who[order], np.zeros(len(sets), bool), []
    while True:
        open_ = np.flatnonzero((label != np.bincount(label).argmax()) & ~tested)
        if not len(open_):
            return out
        i = open_[0]
        tested[i] = True
        own = slice(ends[i] - size[i], ends[i])
        b, m = begin[own], many[own]
        b, m = b[m > 1], m[m > 1]
        at = np.repeat(b - m.cumsum() + m, m) + np.arange(m.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (label != label[i]))
        if len(near):
            joined, where = np.unique(label[near], return_index=True)
            out += [(int(rep[i]), int(rep[j])) for j in near[where]]
            label[np.isin(label, joined)] = label[i]


def _links_in_tiles(meetings: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) that join the components met in each tile. Every member's set goes to each of its tiles."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"rep": f["rep"], "body": [shingle_set(hashed(byte_words(t)), words).tobytes() for t in f["text"]]})

    def of(f: pd.DataFrame) -> pd.DataFrame:
        tile, rep, component, out = f["tile"].to_numpy(), f["rep"].to_numpy(), f["component"].to_numpy(), []
        borders = np.flatnonzero(np.diff(tile)) + 1
        for lo, hi in zip(np.r_[0, borders], np.r_[borders, len(f)]):
            found = [np.frombuffer(b, np.uint64) for b in f["body"].iloc[lo:hi]]
            out += joining_links(rep[lo:hi], component[lo:hi], found, percent)
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    bodies = _texts_of(base, meetings.select("rep").distinct()).mapInPandas(lambda frames: tidied(sets(frames)), "rep long, body binary")
    rows = meetings.join(bodies, "rep").repartition("tile").sortWithinPartitions("tile")
    return rows.mapInPandas(_by_tile(of), "u long, v long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity. A leader's text goes once to each slice of its members."""
    members = pairs.withColumn("_slice", slice_of(F.col("member")))
    leading = per_slice(members.groupBy("leader").agg(slices_seen().alias("_slices")))
    rows = members.join(texts, F.col("member") == F.col("rep")).select("leader", "_slice", "member", F.lit(1).alias("kind"), "text")
    heads = leading.join(texts, F.col("leader") == F.col("rep")).select(
        "leader", "_slice", F.col("leader").alias("member"), F.lit(0).alias("kind"), "text"
    )
    together = rows.unionByName(heads).repartition("leader", "_slice").sortWithinPartitions("leader", "_slice", "kind")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, at, sets, held = None, None, {}, 0
        for f in frames:
            out = []
            for leader, member, kind, text in zip(f["leader"], f["member"], f["kind"], f["text"]):
                found = sets.get(member)
                if found is None:
                    found = shingle_set(hashed(byte_words(text)), words)
                    if held > REMEMBERED:
                        sets, held = {}, 0
                    sets[member] = found
                    held += len(found)
                if not kind:
                    lead, at = found, leader
                    continue
                if at != leader:
                    raise RuntimeError(f"no text for {leader}")
                both = len(np.intersect1d(lead, found, assume_unique=True))
                if 100 * both >= percent * (len(lead) + len(found) - both):
                    out.append((int(member), int(leader)))
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return together.mapInPandas(lambda frames: tidied(compare(frames)), "u long, v long")


def _texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the ids (rep); of an id that is there with several texts one of them."""
    wanted = sieved(base, "id", ids)  # else the texts of all documents would be shuffled
    return wanted.join(ids, F.col("id") == F.col("rep")).groupBy("rep").agg(F.max("text").alias("text"))


def _closed(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after further links (u, v)."""
    if found is None:
        return components(links)
    label = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    between = links.join(label("u"), "u", "left").join(label("v"), "v", "left").select(
        F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v")
    )
    moved = components(between.filter("u <> v"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = found.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    closed = written(known.unionByName(moved.join(found, "node", "left_anti")), "components")
    forget(moved)
    forget(found)
    return closed


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    part: int = PART,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Links join sets with 100 * intersection >= percent * union. percent must be 80 or more, for which the signature is made.
    """
    if percent < 80:
        raise ValueError("signatures are made for a similarity of 80 per cent or more")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(_sketches(base, words), "sketches")
    classes = written(
        sketches.filter("n > 0 AND id IS NOT NULL")
        .withColumn("_slice", slice_of(F.col("id")))
        .groupBy("a", "b")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short"), slices_seen().alias("_slices")),
        "classes",
    )
    postings = written(_postings(classes), "postings")
    candidates = written(_candidates(postings, classes, percent, part), "candidates")
    pairs = candidates.select(F.col("owner").alias("member"), F.explode("next.other").alias("leader"))
    ids = pairs.select(F.explode(F.array("member", "leader")).alias("rep")).distinct()
    texts = written(_texts_of(base, ids), "texts")
    new = written(_confirmed(pairs, texts, words, percent), "confirmed")
    found = None if new.isEmpty() else _closed(None, new)
    forget(texts)
    forget(new)
    going = candidates.filter("more").select(F.col("owner").alias("rep"))
    if not going.isEmpty():
        open_ = postings.join(going, "rep", "left_semi").select("token").distinct()
        owners = going.withColumn("going", F.lit(True))
        lists = postings.groupBy("rep").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
        placed = postings.join(open_, "token", "left_semi").join(classes.select("rep", "n", "short"), "rep").join(owners, "rep", "left").join(lists, "rep")
        placed = placed.withColumns({"component": F.col("rep"), "going": F.col("going").isNotNull()})
        if found is not None:
            known = found.select(F.col("node").alias("rep"), F.col("component").alias("_in"))
            placed = placed.join(known, "rep", "left").withColumn("component", F.coalesce("_in", "rep")).drop("_in")
        met = _meetings(placed, part, F.col("n") / PART_SHINGLES).repartition("tile").sortWithinPartitions("tile")
        meetings = written(met.mapInPandas(_by_tile(open_members(percent)), "tile long, rep long, component long"), "meetings")
        new = written(_links_in_tiles(meetings, base, words, percent), "links")
        if not new.isEmpty():
            found = _closed(found, new)
        forget(meetings)
        forget(new)
    forget(candidates)
    named = classes.select("a", "b", "rep", "_slices")
    if found is not None:
        named = named.join(found, F.col("rep") == F.col("node"), "left").withColumn("rep", F.coalesce("component", "rep"))
    lookup = per_slice(named.select("a", "b", F.col("rep").alias("component_id"), "_slices"))
    placed = sketches.withColumn("_slice", slice_of(F.col("id")))
    linked = placed.filter("n > 0 AND id IS NOT NULL").join(lookup, ["a", "b", "_slice"]).select("id", "n", "component_id")
    alone = sketches.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    done = linked.unionByName(alone)
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows that stay: one document of each component, with all their columns."""
    dropped = near_duplicates(docs, id_col, text_col, words).filter("NOT kept").select(F.col(id_col).alias("_gone"))
    return docs.join(dropped, docs[id_col] == F.col("_gone"), "left_anti")
