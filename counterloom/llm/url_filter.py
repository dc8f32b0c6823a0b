"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

Null urls and urls without ``://`` have an empty host and path; no rule fits them and the trees judge them like any other.
Repeated rows are judged alike. Without labelled urls of both kinds the trees allow everything. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one. Rules become one expression, so they are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character, from the number of occurrences of each distinct one."""
    n = F.length(text).cast("double")

    def add(total: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.coalesce(F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)), F.lit(0.0))


def lexical_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add length, depth, digit ratio, entropy and parameter counts as double columns ``f_*``, ``host``, ``path`` and ``suffix``,
    the last two labels of the host."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    digits = F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))
    features = {
        "f_length": F.length(u), "f_host_length": F.length(host), "f_path_length": F.length(path),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "f_labels": _count(host, ".") + 1,
        "f_hyphens": _count(host, "-"), "f_digit_ratio": F.when(F.length(u) > 0, digits / F.length(u)).otherwise(0.0),
        "f_parameters": _count(u, "="), "f_fragment": _count(u, "#"), "f_dots": _count(path, "."),
        "f_entropy": _entropy(u), "f_host_entropy": _entropy(host),
    }
    held = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return held.withColumns({k: v.cast("double") for k, v in features.items()} | {"suffix": F.substring_index(host, ".", -2)})


def with_suffix_statistics(rows: DataFrame, label: str, smoothing: float = 50.0) -> DataFrame:
    """Add how many rows share the host's suffix and the smoothed share of 1 among their labels. Counts are combined before the
    shuffle; the join back may have a hot suffix, which adaptive execution splits."""
    base = rows.agg(F.coalesce(F.avg(label), F.lit(0.5))).scalar()
    stats = rows.groupBy("suffix").agg(F.count("*").alias("_n"), F.sum(label).alias("_ones"), F.count(label).alias("_seen"))
    rate = (F.coalesce("_ones", F.lit(0)) + smoothing * base) / (F.col("_seen") + smoothing)
    return rows.join(stats.select("suffix", F.log1p("_n").alias("f_suffix_count"), rate.alias("f_suffix_rate")), "suffix")


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, page_id: str = "page_id", url: str = "url", trees: int = 20, depth: int = 4, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """Verdict of every url: (page_id, host, path, rule, verdict, score).

    ``labelled`` has (page_id, label): 1 to block, 0 to allow; the larger label counts where a page has several. The trees learn
    from all labelled rows; ``score`` is their probability of 1, null where a rule decides.
    """
    rows = lexical_features(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    labels = labelled.groupBy("page_id").agg(F.max("label").cast("double").alias("label"))
    rows = rows.withColumns({"rule": rule, "rule_verdict": verdict}).join(labels, "page_id", "left")
    rows = with_suffix_statistics(rows, "label")
    names = [c for c in rows.columns if c.startswith("f_")]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    known = rows.where("label is not null").select("features", "label")
    if len(known.select("label").distinct().head(2)) == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=1.0, seed=seed).fit(known)
        score = vector_to_array(F.col("probability"))[1]
        rows = model.transform(rows)
    else:
        score = F.lit(0.0)
    by_trees = F.when(score >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_trees).alias("verdict"), F.when(F.col("rule").isNull(), score).alias("score"))
