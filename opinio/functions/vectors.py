"""Vector Column functions over ARRAY<FLOAT|DOUBLE> and the hashing encoder.

All JVM-side but the counting of the encoder (Arrow).  ``mean_vector`` is an aggregate (``Summarizer.mean``), which
Spark computes partially on the map side, so pooling per key never needs the
whole group in one task.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.functions.batches import hashed_counts


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector stays zero (its norm is taken as 1)."""
    def scaled(n):
        safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
        return F.transform(_c(v), lambda x: x.cast("double") / safe)
    # the norm is computed once and handed on as a lambda variable
    return F.when(_c(v).isNotNull(), F.transform(F.array(norm(v)), scaled)[0])


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is a zero vector."""
    return dot(l2_normalize(a), l2_normalize(b))


def mean_vector(v) -> Column:
    """Aggregate: element-wise mean of ARRAY vectors (as ARRAY<DOUBLE>)."""
    return vector_to_array(Summarizer.mean(array_to_vector(_c(v))))


def hash_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: first 8 hex digits of md5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hash_embed(col, dim: int = 64) -> Column:
    """Default offline encoder: token counts hashed into ``dim`` buckets (as ``hash_bucket``).

    Deterministic and identical in DuckDB (md5 prefix modulo dim), so the
    vector steps downstream stay checkable against SQL.  Tokens are split in the JVM and
    counted in Arrow batches: a lambda over buckets costs ``dim`` steps a token.
    """
    return hashed_counts(dim)(tx.spaced_words(col))
