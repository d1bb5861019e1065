"""Ranks and running sums over a whole order without a task that holds it.

Rows are cut into buckets along the order (by the first digits of a hash, or by approximate quantiles
of a value). Sums within a bucket are a window over that bucket alone; sums over the buckets before it
come from a table with a row per bucket. Results are exact whatever the cuts.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cuts of a value's order.
CUTS = 256


def running(df: DataFrame, bucket: Column, order: list, sums: dict[str, Column], *keys: str, inclusive: bool = True) -> DataFrame:
    """df with the sums of columns over the rows up to each row, within the keys; ``bucket`` must not fall along the order."""
    cut = df.select("*", bucket.alias("_bucket"), *(v.alias(f"_{n}") for n, v in sums.items()))
    each = cut.groupBy(*keys, "_bucket").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    ahead = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_all_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums))
    same = cut["_bucket"] == before["_b"]
    for k in keys:
        same = same & cut[k].eqNullSafe(before[f"_of_{k}"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = [(F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) + F.col(f"_before_{n}")).alias(n) for n in sums]
    return cut.join(before, same).select(*df.columns, *out)


def hash_places(df: DataFrame, h: Column, by: str, *keys: str) -> DataFrame:
    """df with ``place``, the rank from 1 by a hexadecimal hash and then ``by``, within the keys."""
    hashed = df.withColumn("_h", h)
    return running(hashed, F.substring("_h", 1, 4), ["_h", by], {"place": F.lit(1).cast("long")}, *keys).drop("_h")


def cuts(df: DataFrame, value: str) -> list[float]:
    """Approximate quantiles of a value, CUTS at most."""
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / CUTS for i in range(1, CUTS)]).alias("q")).first()["q"] or []
    return sorted({q for q in found if q == q})


def with_bucket(df: DataFrame, value: str, falling: bool = False) -> DataFrame:
    """df with ``_cut``, a bucket number along the order of a value (nulls first, NaN last)."""
    inf = float("inf")
    inner = [q for q in cuts(df, value) if -inf < q < inf]
    double = df.withColumn("_double", F.col(value).cast("double"))
    made = Bucketizer(splits=[-inf, *inner, inf], inputCol="_double", outputCol="_made", handleInvalid="keep").transform(double)
    number = F.coalesce(F.col("_made").cast("int"), F.lit(-1))
    return made.withColumn("_cut", -number if falling else number).drop("_double", "_made")
