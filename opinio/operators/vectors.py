"""Review pooling and semantic importance (centroid closeness).

Per-product statistics (centroid, min/max similarity, max votes) are
aggregations joined back on the product key.  The joined side has one row
per product; Spark broadcasts it when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE splits a skewed product
partition otherwise -- no step sorts a whole product in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions import vectors as vx


def review_embedding_mean(reviews: DataFrame, sentences: DataFrame, key: str = "product_id",
                          id_col: str = "review_id", vec_col: str = "embedding") -> DataFrame:
    """Mean-pool sentence vectors per review; a review without sentences gets
    a zero vector of the product's dimension (no vectors at all -> null)."""
    pooled = (sentences.groupBy(key, id_col)
              .agg(vx.mean_vector(vec_col).alias("_pooled")))
    dims = sentences.groupBy(key).agg(F.max(F.size(vec_col)).alias("_dim"))
    out = (reviews.join(pooled, [key, id_col], "left").join(dims, key, "left"))
    return out.withColumn(
        "review_vec",
        F.when(F.col("_pooled").isNotNull(), F.col("_pooled"))
        .when(F.col("_dim").isNotNull(), F.array_repeat(F.lit(0.0), F.col("_dim"))))\
        .drop("_pooled", "_dim")


def semantic_importance(df: DataFrame, key: str = "product_id", vec_col: str = "review_vec",
                        out: str = "importance", digits: int = 9) -> DataFrame:
    """Closeness of each row's unit vector to its key's normalised centroid,
    min-max scaled to [0, 1] within the key; all equal (or no vectors) -> 0.

    Similarities are rounded to ``digits`` before scaling so that ties are
    decided the same way regardless of floating-point summation order.
    """
    unit = df.withColumn("_unit", vx.l2_normalize(vec_col))
    cent = (unit.where(F.col("_unit").isNotNull()).groupBy(key)
            .agg(vx.mean_vector("_unit").alias("_c")))
    cent = cent.withColumn("_c", vx.l2_normalize("_c"))
    sim = (unit.join(cent, key, "left")
           .withColumn("_sim", F.round(F.greatest(F.lit(-1.0), F.least(
               F.lit(1.0), vx.dot("_unit", "_c"))), digits)))
    mm = sim.groupBy(key).agg(F.min("_sim").alias("_lo"), F.max("_sim").alias("_hi"))
    res = sim.join(mm, key, "left").withColumn(
        out, F.when(F.col("_hi") > F.col("_lo"),
                    F.round((F.col("_sim") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), digits))
        .otherwise(F.lit(0.0)))
    return res.drop("_unit", "_c", "_sim", "_lo", "_hi")


def helpful_boost(df: DataFrame, key: str = "product_id", votes: str = "helpful_votes",
                  weight: float = 0.5, out: str = "boost") -> DataFrame:
    """clip(votes / max(votes), 0, 1) * weight; max <= 0 -> 0; null votes -> 0."""
    v = F.coalesce(F.col(votes).cast("double"), F.lit(0.0)) if votes in df.columns else F.lit(0.0)
    d = df.withColumn("_v", v)
    mx = d.groupBy(key).agg(F.max("_v").alias("_mx"))
    return (d.join(mx, key, "left")
            .withColumn(out, F.when(F.col("_mx") > 0, F.least(F.lit(1.0), F.greatest(
                F.lit(0.0), F.col("_v") / F.col("_mx"))) * F.lit(float(weight))).otherwise(F.lit(0.0)))
            .drop("_v", "_mx"))


def importance_and_boost(reviews: DataFrame, sentences: DataFrame, key: str, id_col: str, vec_col: str,
                         votes: str, weight: float, dim: int, digits: int = 9) -> DataFrame:
    """``reviews`` (narrow rows) with importance and boost, as semantic_importance
    and helpful_boost define them.

    The sentence vectors are pooled and written once; one grouped pass gives the
    centroid and the largest votes of a key, a second one the range of the
    similarities.  Only these per-key rows are joined back.
    """
    from opinio.session import materialize
    pooled = sentences.groupBy(F.col(key).alias("_pk"), F.col(id_col).alias("_pi")).agg(
        vx.mean_vector(vec_col).alias("_pooled"))
    v = F.coalesce(F.col(votes).cast("double"), F.lit(0.0)) if votes in reviews.columns else F.lit(0.0)
    unit = materialize(
        reviews.join(pooled, F.col(key).eqNullSafe(F.col("_pk")) & (F.col(id_col) == F.col("_pi")), "left")
        .withColumn("_unit", vx.l2_normalize(F.coalesce("_pooled", F.array_repeat(F.lit(0.0), dim))))
        .withColumn("_v", v).drop("_pk", "_pi", "_pooled"))
    cent = unit.groupBy(F.col(key).alias("_ck")).agg(vx.mean_vector("_unit").alias("_c"), F.max("_v").alias("_mx"))
    cent = cent.withColumn("_c", vx.l2_normalize("_c"))
    sim = materialize(unit.join(cent, F.col(key).eqNullSafe(F.col("_ck")))
                      .withColumn("_sim", F.round(F.greatest(F.lit(-1.0), F.least(
                          F.lit(1.0), vx.dot("_unit", "_c"))), digits))
                      .withColumn("boost", F.when(F.col("_mx") > 0, F.least(F.lit(1.0), F.greatest(
                          F.lit(0.0), F.col("_v") / F.col("_mx"))) * F.lit(float(weight))).otherwise(F.lit(0.0)))
                      .drop("_unit", "_c", "_ck", "_mx", "_v"))
    span = sim.groupBy(F.col(key).alias("_ck")).agg(F.min("_sim").alias("_lo"), F.max("_sim").alias("_hi"))
    return (sim.join(span, F.col(key).eqNullSafe(F.col("_ck")))
            .withColumn("importance", F.when(F.col("_hi") > F.col("_lo"), F.round(
                (F.col("_sim") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), digits)).otherwise(F.lit(0.0)))
            .drop("_sim", "_ck", "_lo", "_hi"))
