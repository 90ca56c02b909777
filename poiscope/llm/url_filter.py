"""URL filter: rules for hosts and paths, and boosted trees on lexical features for the rest.

The trees learn from URLs with a verdict, at most `most_labelled` of them. Features: lengths of host and path,
depth, labels of the host, share of digits, entropy of the host's characters, parameters, hyphens,
fragment, and how often the ending of the host and of the path was blocked among the labelled URLs,
drawn towards the mean for rare endings. Endings are counted over the same bounded sample, so that
table is bounded too.

Defined results: host and path are empty for a null URL or one without `://`; such URLs are judged by
the trees like any other; with no labelled URL the verdict is allow. Only the id and url columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.boosting import bounded_sample, fit_trees, probability, written
from poiscope.llm.common import lower_ascii, whole

ALLOW, BLOCK = "allow", "block"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
DRAWN = 20.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(whole(url), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def endings(host: str, path: str) -> tuple[str, str, str]:
    """Last label and last two labels of the host, extension of the path's last segment."""
    labels, last = host.split("."), path.rstrip("/").rpartition("/")[2]
    return "h:" + labels[-1], "h2:" + ".".join(labels[-2:]), "p:" + (last.rpartition(".")[2] if "." in last else "")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str, host: str, path: str, blocked: dict[str, float], mean: float) -> list[float]:
    query, _, fragment = url.partition("#")[0].partition("?")[2], *url.partition("#")[1:]
    digits = sum(c.isdigit() for c in url)
    return [
        float(len(url)),
        float(len(host)),
        float(len(path)),
        float(path.strip("/").count("/") + (path.strip("/") != "")),
        float(host.count(".") + 1),
        digits / max(len(url), 1),
        sum(c.isdigit() for c in host) / max(len(host), 1),
        _entropy(host),
        float(query.count("&") + (query != "")),
        float(host.count("-")),
        float(fragment != ""),
        float(url.startswith("https")),
        *[blocked.get(e, mean) for e in endings(host, path)],
    ]


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    labelled: DataFrame | None = None,
    most_labelled: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) for every row.

    labelled: URLs to learn from, (url, verdict); by default the input's own URLs that a rule judges.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    base = base.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        learnt = base.filter("by_rule IS NOT NULL").select("url", "host", "path", F.col("by_rule.verdict").alias("verdict"))
    else:
        learnt = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
    sample = written(
        bounded_sample(learnt, "url", most_labelled).withColumn("label", (F.col("verdict") == BLOCK).cast("int")), "url-labels"
    )

    @F.pandas_udf("array<string>")
    def ends(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([list(endings(h, p)) for h, p in zip(host, path)])

    mean = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    counted = sample.select(F.explode(ends("host", "path")).alias("e"), "label").groupBy("e")
    blocked = {
        r["e"]: (r["b"] + DRAWN * mean) / (r["n"] + DRAWN)
        for r in counted.agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    }

    @F.pandas_udf("array<double>")
    def features(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([lexical(u or "", h, p, blocked, mean) for u, h, p in zip(url, host, path)])

    model = fit_trees(written(sample.select(features("url", "host", "path").alias("features"), "label"), "url-features"))
    scored = probability(base.withColumn("features", features("url", "host", "path")), model, "block_score")
    by_trees = F.when(F.col("block_score") >= threshold, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "by_rule.rule",
        F.coalesce("by_rule.verdict", by_trees).alias("verdict"),
        "block_score",
    )
