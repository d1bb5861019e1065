"""URL filters: rules first, then boosted trees on lexical features, in DataFrame functions and MLlib alone.

The longest rule whose host is the URL's host or a parent of it, and whose path begins the URL's
path, decides. URLs with a rule are the labelled ones: on at most about ``rows_per_label`` of each
verdict (a documented bound; weights restore the verdicts' proportions), gradient-boosted trees are
fitted; they judge the URLs without a rule. What a row learns from of its suffix, the share of blocked
URLs, comes from the other folds' labelled rows, so that no label explains itself. The fitted trees
become one SQL expression, so scoring is generated code over columns.

A URL that is null or has no ``://`` has an empty host and path, no rule, and is judged by the
trees like any other. If the labelled URLs are all of one verdict, that is the verdict of the rest;
without any, ``allow``. Repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "params", "has_query", "has_fragment", "secure", "longest", "suffix_block", "suffix_rows")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """pages with host, path and the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url).cast("double")
    chars = F.split(url, "")
    # the entropy of a string's characters from the counts of its distinct ones
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size * F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)))
    host, path = F.col("host"), F.col("path")
    return pages.select(
        "*", size.alias("length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"), _count(path, "/").alias("depth"),
        _count(host, r"\.").alias("labels"), F.when(size > 0, _count(url, "[0-9]") / size).otherwise(0.0).alias("digits"), _count(host, "[0-9]").alias("host_digits"), _count(host, "-").alias("hyphens"),
        F.when(size > 0, entropy).otherwise(0.0).alias("entropy"), _count(url, "[?&][^=&#?]+=").alias("params"), F.contains(url, F.lit("?")).cast("double").alias("has_query"), F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(url, F.lit("https://")).cast("double").alias("secure"), F.coalesce(F.array_max(F.transform(F.split(url, r"[^A-Za-z0-9]+"), F.length)), F.lit(0)).cast("double").alias("longest"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def _tree_sql(text: str) -> str:
    """MLlib's printed tree as nested CASE."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(i: int) -> tuple[str, int]:
        line = lines[i]
        if line.startswith("Predict:"):
            return line.split(":")[1].strip(), i + 1
        test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        left, i = node(i + 1)
        right, i = node(i + 1)  # after its Else line
        return f"(CASE WHEN {FEATURES[int(test[1])]} <= {float(test[2])!r}D THEN {left}D ELSE {right}D END)".replace(")D", ")"), i

    sql = node(0)[0]
    return sql if sql.startswith("(") else f"{sql}D"


def boosted(train: DataFrame, *, trees: int = 20, depth: int = 3):
    """MLlib's model of ``y`` over FEATURES in a vector ``x``, with the rows' ``weight``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(train).select("x", "y", "weight")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).setFeaturesCol("x").setLabelCol("y").setWeightCol("weight").fit(rows)


def model_sql(model) -> str:
    """The model's probability of ``block`` as SQL over FEATURES."""
    margin = " + ".join(f"{float(w)!r}D * {_tree_sql(t.toDebugString)}" for w, t in zip(model.treeWeights, model.trees))
    return f"1D / (1D + exp(-2D * ({margin})))"


#: Rows of one URL share a fold.
FOLDS = 5


def _suffixes(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocked and all labelled rows by suffix, and by suffix and fold; a row per suffix, which public suffixes bound."""
    by_fold = runtime.stored(labelled.groupBy("suffix", "fold").agg(F.sum("y").alias("fold_y"), F.count(F.lit(1)).cast("double").alias("fold_n")), "suffixes")
    return by_fold.groupBy("suffix").agg(F.sum("fold_y").alias("all_y"), F.sum("fold_n").alias("all_n")), by_fold


def _shares(rows: DataFrame, every: DataFrame, by_fold: DataFrame | None = None) -> DataFrame:
    """rows with the smoothed share of blocked rows of their suffix and their number; without the row's own fold, if by_fold is given."""
    out = rows.join(every, "suffix", "left")
    y, n = F.coalesce("all_y", F.lit(0.0)), F.coalesce("all_n", F.lit(0.0))
    if by_fold is not None:
        out = out.join(by_fold, ["suffix", "fold"], "left")
        y, n = y - F.coalesce("fold_y", F.lit(0.0)), n - F.coalesce("fold_n", F.lit(0.0))
    return out.withColumn("suffix_block", (y + 1) / (n + 2)).withColumn("suffix_rows", F.log1p(n))


def judge(pages: DataFrame, *, rules=RULES, rows_per_label: int = 10000, trees: int = 20, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict and ``p_block`` of every URL."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.select("*", rule.alias("rule"), verdict.alias("by_rule")))
    labelled = rows.where("by_rule is not null").withColumn("y", (F.col("by_rule") == "block").cast("double")).withColumn("fold", F.pmod(F.xxhash64(F.lit(23), "url"), F.lit(FOLDS)))
    every, by_fold = _suffixes(labelled)
    total = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = runtime.bounded_rows(labelled.withColumn("key", F.xxhash64("url", "page_id")), "key", "y", rows_per_label)
    sample = runtime.stored(_shares(sample, every, by_fold).select("y", *FEATURES), "urls")
    seen = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) == 2:
        weight = F.when(F.col("y") == 1, total[1.0] / seen[1.0]).otherwise(total[0.0] / seen[0.0])
        p = model_sql(boosted(sample.withColumn("weight", weight), trees=trees, depth=depth))
    else:
        p = f"{float(max(seen, default=0.0))!r}D"
    runtime.drop_stored(sample)
    out = _shares(rows, every).withColumn("p_block", F.expr(p))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(runtime.table(spark, sf_dir, "pages"))
