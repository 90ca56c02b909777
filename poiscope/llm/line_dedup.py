"""Line deduplication: documents probe a sharded minimal perfect hash over all line hashes.

The distinct keys of long enough lines, with the number of documents that hold them and the largest
id among these, are cut into shards of about `per_shard` keys. A shard is one row: a minimal perfect
hash, and arrays of fingerprints, counts and last ids in the order of its slots. Documents send their
line hashes to the shard's task, where they are looked up in the arrays; only the hashes to be
dropped come back. Keys that hold at least one 2000th of all probes are at most 2000 by arithmetic;
they form one more shard, which every task has, so their probes do not meet anywhere.

Keys are told apart by 128 bits of hash.

Defined results: a null or empty text is one empty line; each input row counts as one document, also
if it repeats an id; a null id is never the largest. Only id and text are read, other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.common import SPACE_CHARS, lower_ascii, whole
from poiscope.llm.perfect_hash import PerfectHash, build
from poiscope.plans.durable import scratch_path

HOT_SHARE = 2000
NO_ID = int(np.iinfo(np.int64).min)  # stands for a missing id
MOST = np.iinfo(np.uint16).max
INDEX = "shard long, sizes array<long>, bits binary, prints binary, counts binary, last binary"
PROBE = "id long, a long, b long, target long, dropped boolean"


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _print(b: np.ndarray) -> np.ndarray:
    return (b >> np.uint64(32)).astype(np.uint32)


def _shard_row(shard: int, frame: pd.DataFrame) -> dict:
    a, b = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
    sizes, bits = build(a, b)
    order = np.argsort(PerfectHash(sizes, bits).slots(a, b))
    return {
        "shard": shard,
        "sizes": sizes,
        "bits": bits,
        "prints": _print(b[order]).tobytes(),
        "counts": np.minimum(frame["n"].to_numpy(np.int64)[order], MOST).astype(np.uint16).tobytes(),
        "last": frame["last"].to_numpy(np.int64)[order].tobytes(),
    }


class _Shard:
    def __init__(self, row):
        self.hash = PerfectHash(list(row["sizes"]), row["bits"])
        self.prints = np.frombuffer(row["prints"], np.uint32)
        self.counts = np.frombuffer(row["counts"], np.uint16)
        self.last = np.frombuffer(row["last"], np.int64)

    def probe(self, ids: pd.Series, a: np.ndarray, b: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(found, dropped) for each probe."""
        slot = self.hash.slots(a, b)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == _print(b[found])
        at = slot[found]
        ids = ids.to_numpy(np.int64)[found]
        other = (ids == NO_ID) | (ids != self.last[at])
        dropped = np.zeros(len(a), bool)
        dropped[found] = (self.counts[at] >= min_docs) & other
        return found, dropped


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    per_shard: int = 65_536,
) -> DataFrame:
    """(id, n_lines, n_dropped, text) per row: the text without the lines dropped.

    Lines whose key has at least min_chars code points and is held by at least min_docs documents
    (65,535 at most) stay only in the largest id that holds the key.
    """
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"min_docs must be between 1 and {MOST}")
    spark = docs.sparkSession
    row_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    base = docs.select(row_id.alias("id"), F.col(text_col).alias("text"))
    long_keys = F.filter(F.transform(lines_of(F.col("text")), _key), lambda k: F.length(k) >= min_chars)
    probes = base.select("id", F.explode(F.array_distinct(F.transform(long_keys, _hash))).alias("h")).select("id", "h.a", "h.b")

    counted_at = scratch_path(spark, "line-counts")
    probes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).write.parquet(counted_at)
    counted = spark.read.parquet(counted_at)
    keys, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-keys // per_shard))
    hot_least = max(min_docs, total // HOT_SHARE + 1)
    hot_rows = counted.filter(F.col("n") >= hot_least).toPandas()  # at most HOT_SHARE rows
    hot = _shard_row(-1, hot_rows) if len(hot_rows) else None

    def build_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_shard_row(int(key[0]), frame)])

    shard = F.pmod(F.col("a"), F.lit(shards))
    index = counted.filter(F.col("n") < hot_least).groupBy(shard.alias("s")).applyInPandas(build_shard, INDEX)

    def probe_hot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = _Shard(hot) if hot else None
        for f in frames:
            a, b = (f[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
            found, dropped = arrays.probe(f["id"], a, b, min_docs) if hot else (np.zeros(len(f), bool),) * 2
            f["target"] = f["a"] % shards
            f["dropped"] = pd.Series(np.where(found, dropped, None), f.index, object)
            yield f[~found | dropped]

    def probe_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, at = None, None
        for f in frames:
            for target, part in f.groupby("target", sort=True):
                if part["sizes"].notna().any():  # the index row comes first
                    head = part[part["sizes"].notna()].iloc[0]
                    arrays, at = _Shard(head), target
                part = part[part["sizes"].isna()]
                if not len(part):
                    continue
                if at != target:
                    raise RuntimeError(f"no arrays for shard {target}")
                a, b = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
                yield part.loc[arrays.probe(part["id"], a, b, min_docs)[1], ["id", "a", "b"]]

    probed = probes.mapInPandas(probe_hot, PROBE)
    resolved_at = scratch_path(spark, "line-probes")
    probed.write.parquet(resolved_at)
    probed = spark.read.parquet(resolved_at)
    nothing = [F.lit(0).cast(t).alias(c) for c, t in (("id", "long"), ("a", "long"), ("b", "long"))]
    empty = [F.lit(None).cast(t.strip().split(" ", 1)[1]).alias(t.strip().split(" ", 1)[0]) for t in INDEX.split(", ")[1:]]
    together = (
        probed.filter(F.col("dropped").isNull())
        .select("id", "a", "b", "target", F.lit(1).alias("kind"), *empty)
        .unionByName(index.select(*nothing, F.col("shard").alias("target"), F.lit(0).alias("kind"), "sizes", "bits", "prints", "counts", "last"))
        .repartition("target")
        .sortWithinPartitions("target", "kind")
    )
    cold = together.mapInPandas(probe_shards, "id long, a long, b long")
    dropped = cold.unionByName(probed.filter("dropped").select("id", "a", "b"))
    per_doc = dropped.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("a", "b")).alias("_gone"))

    joined = base.join(per_doc, F.col("id") == F.col("_id"), "left")
    lines = lines_of(F.col("text"))

    def stays(line: Column) -> Column:
        key = _key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("_gone"), _hash(key))

    kept = F.when(F.col("_gone").isNull(), lines).otherwise(F.filter(lines, stays))
    return joined.select("id", F.size(lines).cast("long").alias("n_lines"), kept.alias("_kept")).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        "n_lines",
        (F.col("n_lines") - F.size("_kept")).alias("n_dropped"),
        F.array_join("_kept", "\n").alias("text"),
    )
