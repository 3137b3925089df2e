"""Pack tokenised documents into fixed windows by non-negative least squares.

Whole windows are cut off each document; what is left of it is an item shorter
than the window. The items' length histogram (at most ``window - 1`` numbers, the
only thing that reaches the driver) is explained by shallow combinations of two
or three lengths that fill a window exactly: non-negative least squares gives
their repeat counts, which are rounded to what the histogram can supply. Items
are dealt to the combinations by their rank among items of equal length; the
residual ones are packed greedily, cut where a window is full. So every window
but the last residual one is full.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.llm.common import CACHES, list_array, slices
from agora.session import write_shared

WINDOW = 2048
#: Parts that the items of one length are dealt into for ranking.
SALTS = 64
_MEMO_WORDS, _MEMO_BYTES = 400_000, 64
_workers: dict[str, "WordTokenizer"] = {}
CACHES.append(_workers)


class WordTokenizer:
    """Token ids of UTF-8 texts, by a tokenizer file that lower-cases and whose
    pre-tokenizer never joins anything across ASCII white space: a text's ids are
    then its lower-cased words' ids one after another, and words met before come
    from a bounded memo. Texts that may hold a special token go whole."""

    _MARK = "\x01"  # stands alone between words, and in none of them
    _PLAIN = re.compile(rb"[a-z]+[.,]?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids are kept in 16 bits")
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._odd = re.compile(b"|".join(map(re.escape, [self._MARK.encode(), *special])), re.I)
        if len(self._whole(self._MARK)) != 1 or len(self._whole("|")) != 1:
            raise ValueError("a mark must be one token")
        self.lean = self._lean(path)
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _lean(self, path: str):
        """The same model without normaliser, if a-z words come out alike."""
        from tokenizers import Tokenizer, pre_tokenizers
        lean = Tokenizer.from_file(path)
        lean.normalizer, lean.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        probe = " | ".join(["the", "quizzical", "abcdefghijklmnopqrstuvwxyz"])
        same = lean.encode(probe + " . ,", add_special_tokens=False).ids == self._whole(probe + " . ,").tolist()
        return lean if same else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids: some hundred words go through a tokenizer as one text,
        with a mark between them that is one token of its own. Words of a-z, with
        at most one stop or comma after them, need no normaliser."""
        out = [b""] * len(words)
        plain, rest = [], []
        for i, w in enumerate(words):
            (plain if self.lean is not None and self._PLAIN.fullmatch(w) else rest).append(i)
        for tokenizer, some, mark in ((self.lean, plain, "|"), (self.tokenizer, rest, self._MARK)):
            mark_id = int(self._whole(mark)[0])
            between = f" {mark} ".encode()
            for lo in range(0, len(some), 512):
                part = some[lo: lo + 512]
                text = between.join([words[i] for i in part])
                if tokenizer is self.lean:
                    text = text.replace(b".", b" .").replace(b",", b" ,")
                ids = np.array(tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u2")
                marks = np.flatnonzero(ids == mark_id).tolist()
                whole = ids.tobytes()
                for i, a, b in zip(part, [0, *(m + 1 for m in marks)], [*marks, len(ids)]):
                    out[i] = whole[2 * a: 2 * b]
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]  # bytes: ASCII letters, and below ASCII white space, only
        split = [t.split() for t in low]
        odd = [i for i, t in enumerate(low) if self._odd.search(t)]
        for i in odd:
            split[i] = []
        words = list(chain.from_iterable(split))
        if len(self.memo) > _MEMO_WORDS:  # what isn't met again in this generation goes
            self.old, self.memo = self.memo, {}
        got = list(map(self.memo.get, words))
        missing = [i for i, g in enumerate(got) if g is None]
        new: dict[bytes, bytes | None] = {}
        for i in missing:  # a word that is met again moves on, it isn't held twice
            if words[i] not in new:
                new[words[i]] = self.old.pop(words[i], None)
        unknown = [w for w, g in new.items() if g is None]
        new.update(zip(unknown, self._encode(unknown)))
        for i in missing:
            got[i] = new[words[i]]
        self.memo.update((w, g) for w, g in new.items() if len(w) <= _MEMO_BYTES)
        out, a = [], 0
        for s in split:
            out.append(np.frombuffer(b"".join(got[a: a + len(s)]), "<u2"))
            a += len(s)
        for i in odd:
            out[i] = self._whole(texts[i].decode())
        return out


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer in each Python worker."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def _parts(batches):
    """Blocks of texts; the tokenizers kept in this worker stay. (A function of
    the module, so that a task meets the worker's own cache, not a copy.)"""
    return slices(batches, "text", 1 << 20, _workers)


def tokenize(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text",
             end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """``key``, ``n`` (ids with the closing ``end_id``), ``full_crcs`` (one CRC-32
    of each whole window), ``tail`` (16-bit ids after them) and ``tail_crc``."""
    def run(batches):
        tok = None
        for part in _parts(batches):
            tok = tok or _tokenizer(path)
            n, crcs, tails, tail_crcs = [], [], [], []
            for ids in tok.ids([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]):
                ids = np.append(ids, np.array([end_id], "<u2"))
                wide = ids.astype("<u4")
                cut = len(ids) // window * window
                n.append(len(ids))
                crcs.append(np.array([zlib.crc32(wide[i: i + window]) for i in range(0, cut, window)], np.int64))
                tails.append(ids[cut:].tobytes())
                tail_crcs.append(zlib.crc32(wide[cut:]))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(n, pa.int64()), list_array(crcs, pa.int64()),
                 pa.array(tails, pa.binary()), pa.array(tail_crcs, pa.int64())],
                names=[key, "n", "full_crcs", "tail", "tail_crc"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = documents.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{key}` {kind}, n bigint, full_crcs array<bigint>, tail binary, tail_crc bigint")


# ------------------------------------------------------- the least squares

def combinations(window: int = WINDOW, grid: int = 64) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window: all pairs, and all
    triples whose shortest length is on the grid or that hold one length twice."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    triples = [np.array([[s, b, window - s - b] for b in range(s, (window - s) // 2 + 1)]).reshape(-1, 3)
               for s in range(grid, window // 3 + 1, grid)]
    twice = np.array([[s, s, window - 2 * s] for s in range(1, (window - 1) // 2 + 1)]).reshape(-1, 3)
    return np.unique(np.sort(np.concatenate([pairs, *triples, twice]), axis=1), axis=0)


def solve(histogram: np.ndarray, window: int = WINDOW, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used, within the histogram.

    Multiplicative updates lower the squared error of A x = histogram and keep x
    non-negative; then counts are rounded, larger ones first, never above what
    is left of the combination's lengths, and a last greedy round uses up what
    rounding left over."""
    combos = combinations(window)
    h = histogram.astype(float)
    h[0] = 0
    combos = combos[((combos == 0) | (h[combos] > 0)).all(axis=1)]
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    part = combos > 0
    times = lambda x: np.bincount(combos.ravel(), weights=(part * x[:, None]).ravel(), minlength=len(h))
    back = lambda v: (v[combos] * part).sum(axis=1)
    x = np.full(len(combos), h.sum() / 3 / len(combos))
    target = back(h)
    for _ in range(rounds):
        x *= target / np.maximum(back(times(x)), 1e-12)
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable")
    for wanted in (np.rint(x).astype(np.int64), np.full(len(x), left.sum())):
        for c in order.tolist():
            lengths, each = np.unique(combos[c][part[c]], return_counts=True)
            k = min(int(wanted[c]), int((left[lengths] // each).min()))
            if k > 0:
                counts[c] += k
                left[lengths] -= k * each
    return combos[counts > 0], counts[counts > 0]


@dataclass
class Deal:
    """Where items of each length go by rank: ``slots`` (len, lo, hi, sequence of
    rank lo, offset), then from rank ``dealt[len]`` on into residual windows,
    beginning at ``base[len]`` tokens."""

    slots: list[tuple[int, int, int, int, int]]
    dealt: np.ndarray
    base: np.ndarray
    first_residual: int


def deal(histogram: np.ndarray, first: int, window: int = WINDOW) -> Deal:
    combos, counts = solve(histogram, window)
    dealt = np.zeros(len(histogram), np.int64)
    slots, sequence = [], first
    for lengths, k in zip(combos.tolist(), counts.tolist()):
        offset = 0
        for n in lengths:
            if n:
                slots.append((n, int(dealt[n]), int(dealt[n]) + k, sequence, offset))
                dealt[n] += k
                offset += n
        sequence += k
    rest = (histogram - dealt) * np.arange(len(histogram))
    return Deal(slots, dealt, np.concatenate(([0], np.cumsum(rest)[:-1])), sequence)


def pack(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text",
         end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: ``key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    Each row is a document of its own, so rows that repeat are packed as often
    as they come; null and empty texts give the end id alone; an empty table
    gives no piece. Other columns are ignored. Equal rows are interchangeable,
    so reruns agree.
    """
    spark = documents.sparkSession
    tokens = write_shared(tokenize(documents, path, key, text, end_id, window)
                          .withColumn("row", F.monotonically_increasing_id()), "tokens")
    items = tokens.select(
        F.col(key).alias("key"), "row", "n", "full_crcs", "tail_crc",
        (F.col("n") % window).cast("int").alias("len"), F.size("full_crcs").cast("long").alias("wholes"),
        F.pmod(F.xxhash64(key, "tail_crc", "n"), F.lit(SALTS)).alias("salt"))
    # ranks in two steps: within (length, salt), and the parts' own sums
    groups = write_shared(items.groupBy("len", "salt").agg(
        F.count("*").alias("items"), F.sum("wholes").alias("wholes")), "groups")
    per_length = groups.groupBy("len").agg(F.sum("items").alias("items"), F.sum("wholes").alias("wholes")).collect()
    histogram, wholes = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in per_length:  # at most `window` rows
        histogram[r["len"]], wholes[r["len"]] = r["items"], r["wholes"]
    whole_base = np.concatenate(([0], np.cumsum(wholes)[:-1]))
    plan = deal(np.where(np.arange(window) > 0, histogram, 0), int(wholes.sum()), window)

    before = W.partitionBy("len").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    lengths = spark.createDataFrame(
        [(i, int(whole_base[i]), int(plan.dealt[i]), int(plan.base[i])) for i in range(window)],
        "len int, whole_base long, dealt long, base long")
    parts = (groups.withColumn("rank_base", F.coalesce(F.sum("items").over(before), F.lit(0)))
             .withColumn("salt_wholes", F.coalesce(F.sum("wholes").over(before), F.lit(0)))
             .select("len", "salt", "rank_base", "salt_wholes"))
    # `parts` has at most window * SALTS rows and `lengths` has `window`
    placed = (items.withColumn("in_part", F.row_number().over(_order()) - 1)
              .withColumn("wholes_before", F.coalesce(F.sum("wholes").over(
                  _order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .join(F.broadcast(parts), ["len", "salt"])
              .join(F.broadcast(lengths), "len")
              .withColumn("rank", F.col("rank_base") + F.col("in_part")))
    whole = placed.select("key", "n", F.posexplode("full_crcs").alias("j", "crc"),
                          (F.col("whole_base") + F.col("salt_wholes") + F.col("wholes_before")).alias("at")).select(
        "key", (F.col("j").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("at") + F.col("j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    tails = placed.filter("len > 0").withColumn("start", F.col("n") - F.col("len"))
    slots = spark.createDataFrame(
        plan.slots, "slot_len int, lo long, hi long, sequence long, at long").coalesce(1)
    slotted = tails.join(F.broadcast(slots), (F.col("len") == F.col("slot_len")) & (F.col("rank") >= F.col("lo"))
                         & (F.col("rank") < F.col("hi"))).select(
        "key", "start", F.col("len").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"),
        F.col("at").alias("offset"))

    residual = (tails.filter(F.col("rank") >= F.col("dealt"))
                .withColumn("position", F.col("base") + (F.col("rank") - F.col("dealt")) * F.col("len"))
                .withColumn("sequence_id", plan.first_residual + F.floor(F.col("position") / window))
                .withColumn("offset", F.col("position") % window)
                .withColumn("room", window - F.col("offset")))
    uncut = residual.filter("len <= room").select(
        "key", "start", F.col("len").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    cut = _cut(residual.filter("len > room").select("row", "key", "start", "n", "sequence_id", "offset", "room")
               .join(tokens.select("row", "tail"), "row"))
    return whole.unionByName(slotted).unionByName(uncut).unionByName(cut).withColumnRenamed("key", key)


def _order() -> W:
    return W.partitionBy("len", "salt").orderBy("key", "tail_crc", "n", "row")


def _cut(rows: DataFrame) -> DataFrame:
    """The two pieces of each item that a full residual window cuts."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            tails = [np.frombuffer(t, "<u2").astype("<u4") for t in b.column("tail").to_pylist()]
            room, n = b.column("room").to_numpy(), b.column("n").to_numpy()
            start, seq, off = (b.column(c).to_numpy() for c in ("start", "sequence_id", "offset"))
            for lo in (True, False):
                ids = [t[:r] if lo else t[r:] for t, r in zip(tails, room.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), pa.array(start if lo else start + room),
                     pa.array([len(i) for i in ids], pa.int64()),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(n),
                     pa.array(seq if lo else seq + 1), pa.array(off if lo else off * 0)],
                    names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                                "sequence_id bigint, offset bigint")
