"""Text embedding.

The default embedder is pure Spark: signed feature hashing of the first
``max_tokens`` tokens — bucket = first six hex digits of md5(token) mod
dim, sign from the parity of the seventh — summed per document and
L2-normalised. A user model plugs in as a callable run over Arrow
batches, loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.constants import MAX_TOKENS
from agora.functions.text import tokenize, truncate_tokens

DEFAULT_DIM = 64


#: Documents whose tokens are summed at once; each has at most ``max_tokens``.
_ROWS = 512


def _hashed(id_col: str, dim: int):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                lists = b.column("tokens").fill_null([])
                row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                words = lists.flatten().dictionary_encode()
                digests = [hashlib.md5(w.encode()).hexdigest() for w in words.dictionary.to_pylist()]
                bucket = np.array([int(h[:6], 16) % dim for h in digests], np.int64)
                sign = np.array([1.0 if int(h[6], 16) % 2 == 0 else -1.0 for h in digests])
                code = words.indices.to_numpy(zero_copy_only=False)
                m = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=b.num_rows * dim) \
                    if len(code) else np.zeros(b.num_rows * dim)
                m = m.reshape(b.num_rows, dim)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(id_col), vectors], names=[id_col, "embedding"])
    return run


def hashing_embed(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  dim: int = DEFAULT_DIM, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(id, embedding array<double>)``, one row per row of ``df``. Texts without
    tokens get the zero vector. A task holds the tokens of ``_ROWS`` documents at a
    time and hashes each distinct one once; a document is summed inside its row, so nothing is shuffled."""
    toks = df.select(id_col, truncate_tokens(tokenize(F.col(text_col)), max_tokens).alias("tokens"))
    kind = df.schema[id_col].dataType.simpleString()

    return toks.mapInArrow(_hashed(id_col, dim), f"`{id_col}` {kind}, embedding array<double>")


#: Models that factories made, one per Python worker.
_models: dict[bytes, Callable] = {}


def worker_model(factory: Callable[[], Callable]) -> Callable:
    """The factory's model, made once in each Python worker."""
    name = cloudpickle.dumps(factory)
    if name not in _models:
        _models[name] = factory()
    return _models[name]


def model_embed(df: DataFrame, embedder: Callable[[list[str]], np.ndarray] | Callable[[], Callable],
                text_col: str = "text", id_col: str = "doc_id", batch_size: int = 8,
                factory: bool = False, max_tokens: int | None = None) -> DataFrame:
    """Pluggable model: ``embedder(texts) -> (n, d) array`` run over Arrow
    batches; the id of any type stays with its row, NULL texts are skipped,
    output is L2-normalised.

    With ``factory`` the callable makes the model, once per Python worker.
    ``max_tokens`` cuts texts to that many white-space-separated words (a model
    with its own tokenizer may cut further). The id keeps its type."""
    def run(batches):
        fn = worker_model(embedder) if factory else embedder
        for b in batches:
            b = b.filter(b.column("text").is_valid())
            for start in range(0, b.num_rows, batch_size):
                part = b.slice(start, batch_size)
                m = np.asarray(fn(part.column("text").to_pylist()), dtype=np.float64)
                m = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), vectors], names=[id_col, "embedding"])

    text = F.col(text_col) if max_tokens is None else F.array_join(
        F.slice(F.split(F.col(text_col), r"\s+"), 1, max_tokens), " ")
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), text.alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, embedding array<float>")


def embed_text(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", embedder=None,
               dim: int = DEFAULT_DIM, max_tokens: int = MAX_TOKENS, batch_size: int = 8,
               factory: bool = False) -> DataFrame:
    """D5 dispatcher; NULL text rows are dropped first."""
    df = df.where(F.col(text_col).isNotNull())
    if embedder is None:
        return hashing_embed(df, text_col, id_col, dim, max_tokens)
    return model_embed(df, embedder, text_col, id_col, batch_size, factory, max_tokens)


def embed_column(df: DataFrame, text_col: str = "text", embedder=None, out: str = "embedding", **settings) -> DataFrame:
    """``df``'s rows that have a text, with the embedding as a further column:
    the text is read once, and rows that repeat stay apart."""
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(text_col).alias("_text"))
    done = embed_text(rows, "_text", "_row", embedder, **settings)
    return done.select("_row.*", F.col("embedding").alias(out))
