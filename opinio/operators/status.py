"""Row counts of a job's stages, and what became of each product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: messages of a run without rows.
NO_REVIEWS = "No reviews found in the input file."
NONE_LEFT = "No reviews remain after filtering"
# ---------------------------------------------------------------------------


class NoRows(ValueError):
    """A stage that must have rows has none."""


class StageCounts:
    """Counts the rows that pass each stage, while the job runs that reads them.

    ``through`` adds an observation to a stage's frame: no job of its own and no
    second pass.  ``counts`` is there when an action has run on what came of the
    last stage; a stage whose frame is planned several times (a self join) reports
    the first.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def through(self, df: DataFrame, stage: str) -> DataFrame:
        self._seen[stage] = Observation(stage)
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        return {stage: o.get["n"] for stage, o in self._seen.items()}


def require_rows(df: DataFrame, message: str = NONE_LEFT) -> DataFrame:
    """``df`` itself, or ``NoRows`` with the message if it has no row.  Runs a job (the
    first row that is found ends it)."""
    if df.isEmpty():
        raise NoRows(message)
    return df


def product_status(products: DataFrame, stages: Sequence[tuple[str, DataFrame]], key: str = "product_id") -> DataFrame:
    """(product, a count per stage, status, message): what became of every product.

    ``products`` names all products asked for; ``stages`` are the frames of reviews that
    each step left, in order, the first being what was read.  ``status`` is ``no_reviews``,
    ``none_after_<stage>`` for the first stage that left nothing, or ``ok``.  Counts are
    combined before the shuffle; a product of the stages that was not asked for has no row.
    """
    out = products.select(key).distinct()
    for name, df in stages:
        n = df.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(n, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of").fillna(0, [f"n_{name}"])
    first, *rest = [name for name, _ in stages]
    status, message = F.when(F.col(f"n_{first}") == 0, "no_reviews"), F.when(F.col(f"n_{first}") == 0, NO_REVIEWS)
    for name in rest:
        status = status.when(F.col(f"n_{name}") == 0, f"none_after_{name}")
        message = message.when(F.col(f"n_{name}") == 0, NONE_LEFT)
    return out.withColumns({"status": status.otherwise("ok"), "message": message})
