"""DuckDB SQL fragments mirroring ``agora.sources.fixtures`` and the column
functions, used to write the independent oracle statements."""

from __future__ import annotations

from agora.functions.constants import ENGLISH_STOP_WORDS, TOKEN_PATTERN


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


STOP = sql_list(ENGLISH_STOP_WORDS)
TOKPAT = sql_str(TOKEN_PATTERN)

DOCS = """docs AS (
  SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS clean_text, lang, source
  FROM documents)"""

SRC_CLUSTERS = r"""clusters AS (
  SELECT doc_id,
         CASE WHEN CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) = 0 THEN -1
              ELSE CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) END AS cluster
  FROM documents)"""

VECTORS = """vectors AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""

VEC_CLUSTERS = """vclusters AS (
  SELECT vec_id AS doc_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM embeddings)"""


def tokens_expr(text: str, stop: bool = True) -> str:
    t = f"regexp_extract_all(lower({text}), {TOKPAT})"
    if stop:
        t = f"list_filter({t}, lambda tok: NOT list_contains({STOP}, tok))"
    return t


def ngrams_expr(tokens: str, min_n: int, max_n: int) -> str:
    parts = []
    for n in range(min_n, max_n + 1):
        if n == 1:
            parts.append(tokens)
        else:
            parts.append(
                f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(0, len({tokens}) - {n - 1}), "
                f"lambda i: array_to_string({tokens}[i + 1:i + {n}], ' ')) ELSE []::VARCHAR[] END")
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def norm(a: str) -> str:
    return f"sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"


def cosine(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {norm(a)} = 0 OR {norm(b)} = 0 THEN 0.0 "
            f"ELSE {dot(a, b)} / ({norm(a)} * {norm(b)}) END")
