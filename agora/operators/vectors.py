"""DataFrame-level vector operators."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import vectors as V
from agora.functions.constants import NOISE, QUANT_BITS


def normalize(df: DataFrame, col: str = "embedding", out: str | None = None) -> DataFrame:
    """D1."""
    return df.withColumn(out or col, V.l2_normalize(col))


def quantize(df: DataFrame, col: str = "embedding", bits: int = QUANT_BITS,
             out: str = "quantized") -> DataFrame:
    """Storage form, ints in [0, 2^bits−1]."""
    return df.withColumn(out, V.quantize(col, bits))


def dequantize(df: DataFrame, col: str = "quantized", bits: int = QUANT_BITS,
               out: str = "embedding") -> DataFrame:
    """D3."""
    return df.withColumn(out, V.dequantize(col, bits))


def long_form(df: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding",
              pos_col: str = "dim", val_col: str = "value") -> DataFrame:
    """(id, dim, value) rows — for joins on a dimension and for checks."""
    return df.select(id_col, F.posexplode(vec_col).alias(pos_col, val_col))


def assemble(long_df: DataFrame, id_cols, pos_col: str = "dim", val_col: str = "value",
             out: str = "embedding") -> DataFrame:
    """Inverse of :func:`long_form`: one dense array per id, ordered by
    position (at most ``dim`` entries gathered per id)."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return (long_df.groupBy(*id_cols)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"),
                                                      F.col(val_col).alias("v")))).alias("_pv"))
            .select(*id_cols, F.transform("_pv", lambda s: s["v"]).alias(out)))


def weighted_mean(vec_col: str, weight_col: str | None = None):
    """Aggregate: mean of array vectors, in one buffer per group and task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    w = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    return vector_to_array(Summarizer.mean(v, w))


def topic_vectors(vectors: DataFrame, topics: DataFrame, id_col: str = "doc_id",
                  vec_col: str = "embedding", topic_col: str = "topic",
                  drop_noise: bool = True) -> DataFrame:
    """Mean document vector per topic, ``(topic, embedding, n)``: a topic
    holding a third of all documents ships one buffer per map partition."""
    j = vectors.select(id_col, vec_col).join(topics.select(id_col, topic_col), id_col)
    if drop_noise:
        j = j.where(F.col(topic_col) != NOISE)
    return j.groupBy(topic_col).agg(weighted_mean(vec_col).alias("embedding"), F.count(F.lit(1)).alias("n"))


def projection_matrix(d: int, k: int, seed: int = 0) -> list[list[float]]:
    """Fixed ±1/√k matrix (d × k); entry sign from md5("seed:i:j"), the
    first hex digit's parity (even → +). A parameter, not data."""
    s = 1.0 / math.sqrt(k)
    out = []
    for i in range(d):
        row = []
        for j in range(k):
            h = hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()
            row.append(s if int(h[0], 16) % 2 == 0 else -s)
        out.append(row)
    return out


def random_projection(df: DataFrame, d: int, k: int, seed: int = 0, col: str = "embedding",
                      out: str = "projected") -> DataFrame:
    """y = xᵀR with the fixed matrix R (d·k literal values, independent
    of the row count), row-local — no shuffle."""
    cols_r = list(zip(*projection_matrix(d, k, seed)))  # k columns of length d
    lit_cols = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in cols_r])
    return df.withColumn(out, F.transform(lit_cols, lambda rc: V.dot(F.col(col), rc)))


#: Dimensions up to which the covariance is formed on the driver.
EXACT_DIMS = 1024


def _gram_times(rows: DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all vectors ``v`` of v (v . q) and of v, and their number. A task
    sends a row of each sum per dimension; equal dimensions are added by Spark."""
    width = q.shape[1]

    def run(batches):
        total, n = None, 0
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else None
            if x is None:
                continue
            part = np.hstack([x.T @ (x @ q), x.sum(axis=0)[:, None]])
            total, n = part if total is None else total + part, n + len(x)
        if total is not None:
            flat = total.ravel()
            ends = np.arange(len(total) + 1, dtype=np.int32) * (width + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array(np.full(len(total), n, np.int64))], names=["dim", "sums", "n"])

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    parts = rows.mapInArrow(run, "dim int, sums array<double>, n bigint")
    got = parts.groupBy("dim").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"), F.sum("n").alias("n")).collect()
    out, n = np.zeros((len(q), width + 1)), 0
    for r in got:
        out[r["dim"]], n = r["sums"].toArray(), r["n"]
    return out[:, :-1], out[:, -1], n


def principal_axes(df: DataFrame, k: int, col: str = "embedding", more: int = 10, tolerance: float = 1e-7,
                   seed: int = 0) -> np.ndarray:
    """The ``k`` leading axes of the vectors' covariance, a row each, by a randomised
    range finder: ``k + more`` random directions are multiplied by the covariance and
    made orthogonal again, until the share of the variance that they hold grows by
    less than ``tolerance``. A pass reads all vectors; what reaches the driver is
    dimensions x (k + more), never dimensions squared. Signs: an axis' largest
    component is positive. Null vectors take no part; without vectors an error."""
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        raise ValueError("no vectors")
    k, width = min(k, dims), min(dims, k + more)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))
    held = 0.0
    while True:
        sums, total, n = _gram_times(rows, q)
        y = sums / n - np.outer(total / n, (total / n) @ q)
        inner = q.T @ y
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        now = float(values[-k:].sum())
        if now <= held * (1 + tolerance) or width == dims:
            axes = (q @ turn[:, ::-1][:, :k]).T
            break
        held = now
        q, _ = np.linalg.qr(y)
    return axes * np.where(axes[np.arange(k), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]


def project(df: DataFrame, axes: np.ndarray, col: str = "embedding", out: str = "projected") -> DataFrame:
    """Each vector's coordinates on ``axes`` (a row each); null for a null vector."""
    @F.pandas_udf("array<double>")
    def along(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else axes @ np.asarray(x, float))
    return df.withColumn(out, along(F.col(col)))


def pca(df: DataFrame, k: int, col: str = "embedding", out: str = "projected") -> DataFrame:
    """Principal components with ``pyspark.ml.feature.PCA``, which forms the
    d × d covariance on the driver; above ``EXACT_DIMS`` dimensions by
    :func:`principal_axes`, which needs d × k (axes up to their sign)."""
    dims = df.where(F.col(col).isNotNull()).select(F.size(col)).head()
    if dims and dims[0] > EXACT_DIMS:
        return project(df, principal_axes(df, k, col), col, out)
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    tmp = df.withColumn("_v", array_to_vector(F.col(col).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(tmp)
    return model.transform(tmp).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
