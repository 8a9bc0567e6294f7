"""How far two results of a metric lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-15


def errors(reference: DataFrame, compared: DataFrame, key: str = "id") -> DataFrame:
    """One row of counts and errors, of (key, value) each."""
    r = reference.select(F.col(key).alias("k"), F.col("value").alias("r"), F.lit(True).alias("in_r"))
    c = compared.select(F.col(key).alias("k"), F.col("value").alias("c"), F.lit(True).alias("in_c"))
    d = F.when(F.col("in_r") & F.col("in_c"), F.col("c") - F.col("r"))
    a = F.abs(d)
    return r.join(c, "k", "full").agg(
        F.count("in_r").alias("n_ref"),
        F.count("in_c").alias("n_cmp"),
        F.count(d).alias("n_common"),
        F.count_if(F.col("in_c").isNull()).alias("missing_in_compare"),
        F.count_if(F.col("in_r").isNull()).alias("missing_in_reference"),
        F.avg(a).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.max(a).alias("max_abs_error"),
        F.max_by("k", F.struct(a, "k")).alias("max_abs_error_key"),
        F.avg(a / F.greatest(F.abs("r"), F.lit(EPS))).alias("mape"),
        F.avg(d).alias("mean_signed_error"),
        F.sum(a).alias("l1_error"),
        F.sqrt(F.sum(d * d)).alias("l2_error"),
    )


def flattened(edges: DataFrame) -> DataFrame:
    """(src, dst, value) by unordered pair, as (id, value); numbers order as numbers."""
    number = F.expr("try_cast(src as double) is not null and try_cast(dst as double) is not null")
    swap = F.when(number, F.expr("try_cast(src as double) > try_cast(dst as double)")).otherwise(F.col("src") > F.col("dst"))
    return edges.select(F.when(swap, F.concat_ws("|", "dst", "src")).otherwise(F.concat_ws("|", "src", "dst")).alias("id"), "value")
