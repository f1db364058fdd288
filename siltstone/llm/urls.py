"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule fits. DataFrame functions only.

Features of a url, all whole numbers: lengths of the url, host, path and query; depth of host and path; digits and hyphens; entropy of the host's
and the path's characters; number of parameters; and suffix statistics, the smoothed share of blocked urls among the labelled ones with the same last
host label, the same last two, the same first path segment, or the same file name ending.

The trees are fitted on a sample of the labelled urls (those that a rule fits, or a caller's own): at most ``SAMPLE`` distinct urls, those of the
least hash, so copies of a url count once. It is stored with every feature cut into at most ``BINS`` bins. Each level of each tree is one
aggregation: sums of gradients and curvatures by (node, feature, bin), a table whose size does not depend on the data, from which the driver takes the best
splits. Gradients are rounded to whole numbers before they are summed, so the trees do not depend on the order of rows. What is
broadcast (suffix statistics) has four rows a sampled url at most. All urls are scored in one narrow pass, without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is scored like any other; without any labelled
url nothing is blocked; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import forget, table, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The most distinct labelled urls to fit on.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_ROWS, PRIOR = 16, 12, 3, 0.5, 1.0, 5, 4
#: Gradients are whole millionths, margins whole thousandths.
PART, MILLI = 1_000_000, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("label", "site", "head", "ending")
NAMES = ("n_url", "n_host", "n_path", "n_query", "host_depth", "path_depth", "digits", "hyphens", "host_entropy", "path_entropy", "params", *SUFFIXES)


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (with url) and host, path and query."""
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    out = rows.withColumn("_rest", rest)
    return out.withColumns({
        "host": F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1),
    }).drop("_rest")


def matched(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Entropy of the characters in thousandths of a nat."""
    n = F.length(text)
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    bits = F.aggregate(kinds, F.lit(0.0), lambda a, c: a + F.transform(F.array(n - F.length(F.replace(text, c, F.lit("")))), lambda k: k * F.log(k))[0])
    return F.when(n > 0, F.floor((F.log(n) - bits / n) * MILLI + 0.5)).otherwise(0).cast("int")


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path, query) and the lexical features, with the keys of the suffix statistics in the place of their shares."""
    url, host, path, query = F.coalesce("url", F.lit("")), F.col("host"), F.col("path"), F.col("query")
    return rows.withColumns({
        "n_url": F.length(url), "n_host": F.length(host), "n_path": F.length(path), "n_query": F.length(query),
        "host_depth": _count(host, r"[^.]+"), "path_depth": _count(path, r"[^/]+"),
        "digits": F.floor(_count(url, r"[^0-9]+") * 1000 / F.greatest(F.length(url), F.lit(1))).cast("int"), "hyphens": _count(host, r"[^-]+"),
        "host_entropy": entropy(host), "path_entropy": entropy(path),
        "params": F.when(query == "", 0).otherwise(_count(query, r"[^&]+") + 1),
        "label": F.regexp_extract(host, r"([^.]*)$", 1), "site": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1),
        "head": F.regexp_extract(path, r"^/?([^/]*)", 1), "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]+)/?$", 1),
    })


@dataclass(frozen=True)
class Model:
    """Base margin and trees: nested (feature, threshold, low, high) with whole leaves; and the suffix statistics (kind, key, share)."""

    base: int
    trees: list
    shares: DataFrame

    def margin(self, values: list[Column]) -> Column:
        def spelled(node) -> Column:
            return F.lit(node) if isinstance(node, int) else F.when(values[node[0]] <= node[1], spelled(node[2])).otherwise(spelled(node[3]))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + spelled(tree)
        return out.cast("long")

    def with_margin(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with features) and margin, in thousandths: above zero a url is rather blocked."""
        return with_shares(rows, self.shares).withColumn("margin", self.margin([F.col(c) for c in NAMES]))


def with_shares(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """The keys of the suffix statistics replaced by their shares; one half for a key that no labelled url has."""
    for kind in SUFFIXES:
        own = shares.filter(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("share").alias("_share"))
        rows = rows.join(F.broadcast(own), kind, "left").withColumn(kind, F.coalesce("_share", F.lit(500))).drop("_share")  # a row a sampled url at most
    return rows


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """url and blocked of about so many distinct urls, and no more: those of the least hash."""
    rank = F.shiftrightunsigned(F.xxhash64("url"), 24)
    rows = labelled.filter(F.col("url").isNotNull()).select("url", "blocked", rank.alias("rank"))
    n = rows.agg(F.approx_count_distinct("url")).first()[0]
    near = rows if n <= most else rows.filter(F.col("rank") < int((1 << 40) * min(1.0, 1.5 * most / n)))  # what is ordered is bounded, too
    return near.groupBy("rank", "url").agg(F.max("blocked").alias("blocked")).orderBy("rank", "url").limit(most).select("url", "blocked")


def _best(sums: dict[tuple[int, int], tuple[int, int, int]], n_features: int) -> tuple[float, int, int, tuple, tuple] | None:
    """gain, feature, bin and the sums of both sides of the best split of a node, the first among equals."""
    best = None
    for f in range(n_features):
        bins = sorted(b for x, b in sums if x == f)
        total = [sum(sums[f, b][i] for b in bins) for i in range(3)]
        low = [0, 0, 0]
        for b in bins[:-1]:
            low = [x + y for x, y in zip(low, sums[f, b], strict=True)]
            high = [x - y for x, y in zip(total, low, strict=True)]
            if min(low[2], high[2]) >= LEAST_ROWS:
                gain = sum(sign * (g / PART) ** 2 / (h / PART + RIDGE) for sign, (g, h, _) in ((1, low), (1, high), (-1, total)))
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, b, tuple(low), tuple(high))
    return best


def leaf(sums: tuple[int, int, int]) -> int:
    """Margin of a leaf: the shortened step against the gradient."""
    return math.floor(-RATE * MILLI * sums[0] / PART / (sums[1] / PART + RIDGE) + 0.5)


def with_gradients(rows: DataFrame, margin: Column) -> DataFrame:
    """g and h: gradient and curvature of the logistic loss at the margin, in whole millionths; the margin is computed once a row."""
    p = F.lit(1.0) / (F.exp(-F.col("_margin") / float(MILLI)) + 1.0)
    each = rows.withColumn("_margin", margin).withColumn("_p", p)
    g, h = F.col("_p") - F.col("blocked"), F.col("_p") * (F.lit(1.0) - F.col("_p"))
    return each.withColumns({"g": F.floor(g * PART + 0.5).cast("long"), "h": F.floor(h * PART + 0.5).cast("long")}).drop("_margin", "_p")


def train(labelled: DataFrame, most: int = SAMPLE) -> Model:
    """Trees fitted on ``labelled`` (url, blocked: 1 or 0)."""
    sample = written(with_features(with_parts(_sample(labelled, most))), "urls")
    keys = sample.select("blocked", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in SUFFIXES))).alias("k"))
    share = F.floor((F.sum("blocked") * 1000 + 500 * PRIOR) / (F.count(F.lit(1)) + PRIOR)).cast("int")
    shares = written(keys.groupBy("k.kind", "k.key").agg(share.alias("share")), "shares")
    rows = with_shares(sample, shares)
    cuts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"), *(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 4 * most).alias(c) for c in NAMES)).first()
    n, blocked = cuts["n"], cuts["blocked"]
    if not n:
        return Model(-MILLI, [], shares)
    base = math.floor(MILLI * math.log((blocked + 1) / (n - blocked + 1)) + 0.5)
    edges = [sorted(set(cuts[c])) for c in NAMES]
    bins = F.array(*(sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges[i]), F.lit(0)) for i, c in enumerate(NAMES)))
    binned = written(rows.select("blocked", bins.alias("bins")), "binned")
    trees: list = []
    values = [F.get("bins", F.lit(i)) for i in range(len(NAMES))]
    rough: list = []  # the trees with bins as thresholds
    for _ in range(TREES):
        nodes = written(with_gradients(binned, Model(base, rough, shares).margin(values)).select("g", "h", "bins"), "gradients")  # a row a sampled url
        splits: dict[int, tuple] = {}  # node to (gain, feature, bin, low, high); the children of i are 2 i and 2 i + 1
        for depth in range(DEPTH):
            node = F.lit(1)
            for _ in range(depth):
                side = F.lit(0)
                for i, s in splits.items():
                    side = F.when(node == i, F.when(values[s[1]] <= s[2], 2 * i).otherwise(2 * i + 1)).otherwise(side)
                node = side
            sums: dict[int, dict] = {}
            each = nodes.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin")).filter(F.col("node") >= 1 << depth)
            for r in each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).collect():
                sums.setdefault(r["node"], {})[r["feature"], r["bin"]] = (r["g"], r["h"], r["n"])
            found = {i: s for i in sorted(sums) if (s := _best(sums[i], len(NAMES)))}
            if not found:
                break
            splits |= found
        forget(nodes)
        if not splits:
            break

        def grown(i: int, own: tuple, exact: bool, splits: dict = splits):
            if i not in splits:
                return leaf(own)
            _, f, b, low, high = splits[i]
            return (f, edges[f][b] if exact else b, grown(2 * i, low, exact), grown(2 * i + 1, high, exact))

        trees.append(grown(1, (0, 0, 0), True))
        rough.append(grown(1, (0, 0, 0), False))
    return Model(base, trees, shares)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: Model | None = None, *keep: str) -> DataFrame:
    """``keep`` and host, path, rule, verdict, margin of every url; without a model one is fitted on the urls that rules fit."""
    rule, verdict = matched(rules)
    rows = with_parts(pages.select(*keep, "url")).withColumns({"rule": rule, "verdict": verdict})
    if model is None:
        model = train(rows.filter(F.col("rule").isNotNull()).select("url", (F.col("verdict") == "block").cast("int").alias("blocked")))
    scored = model.with_margin(with_features(rows))
    said = F.coalesce("verdict", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select(*keep, "host", "path", "rule", said.alias("verdict"), "margin")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, None, "page_id")
