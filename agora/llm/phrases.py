"""Phrase collocations by best-first growth with branch and bound.

A phrase scores by its weakest cut: ``a * a / (l * r)`` where ``a``, ``l`` and ``r``
count the phrase and the parts before and after the cut. Phrases grow word by
word. Words are counted first, then the two-word phrases of frequent words. Their
counts bound every phrase that grows from them: no phrase that begins with u v
scores above f(u v) / f(u), none that ends with v w above f(v w) / f(w).

So three-word phrases are only expanded where a bound reaches the cutoff of their
language, or where they can cover a two-word phrase that does. With these all
phrases at or above the cutoff are known, and so is which of them survive; a
language is settled when at least ``top`` survive (ties of the last one are all at
or above the cutoff), or when its cutoff is 0. The cutoff starts at the ``top``-th
best two-word phrase and comes down, best bounds first, for languages that are
not settled; each round is one pass over the texts.

Tasks count what they can before anything is shuffled. Words travel as codes: a
small number for the ``HEAD`` most frequent words, a bounded table, else 63 bits
of a hash that is checked to tell all words of the corpus apart.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.llm import common
from agora.llm.common import Texts, hashed, mix64, signed, slices, texts_of
from agora.session import write_shared

LEAST, TOP, COVER, SCALE = 10, 2000, 50, 1_000_000
HEAD = 1 << 17
#: Places of a table that tells tasks which words or phrases may matter; where two
#: fall on one place, more is counted than needed, never less.
LEAST_PLACES, MOST_PLACES = 1 << 16, 1 << 24
WINDOW = 2_000_000  # tokens counted at once in a task
GROW = 4
_ODD = hashed(np.arange(2), 61) | np.uint64(1)
_END, _GAP = 2, 1
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _END


def _byte_values(seed: int) -> np.ndarray:
    v = hashed(np.arange(256), 67 + seed)
    v[65:91] = v[97:123]  # A-Z as a-z
    v[_KIND > 0] = 0
    return v


class Pieces:
    """The words of a block of texts: where they begin and end, whether the next
    word goes on in the same piece, and which text they are in."""

    def __init__(self, t: Texts):
        self.buf = t.buf
        letter = _KIND[t.buf] == 0
        begins, ends = letter.copy(), letter.copy()
        if len(letter):
            first = t.bounds[:-1][t.bounds[:-1] < len(letter)]
            last = t.bounds[1:][t.bounds[1:] > 0] - 1
            begins[1:] &= ~letter[:-1]
            begins[first] = letter[first]
            ends[:-1] &= ~letter[1:]
            ends[last] = letter[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(t.bounds, self.starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(_KIND[t.buf] == _END), self.starts) + self.row
        self.goes_on = np.zeros(len(self.starts), bool)
        self.goes_on[:-1] = piece[1:] == piece[:-1]

    def hashes(self, languages: np.ndarray, values: np.ndarray, step: int = 1 << 22) -> np.ndarray:
        """A hash of each word in the language of its text; runs of about ``step``
        bytes at a time, so a very long text needs little memory."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + step)))
            a, b = self.starts[i], self.ends[j - 1]
            own = self.starts[i:j] - a
            at = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
            powers = common._powers(int(at.max()) + 1)
            out[i:j] = np.add.reduceat(values[self.buf[a:b]] * powers[at], own)
            i = j
        return mix64(out * _ODD[0] + languages[self.row])

    def words(self, some: np.ndarray) -> list[bytes]:
        low = self.buf.copy()
        low[(low >= 65) & (low <= 90)] += 32
        data = low.tobytes()
        return [data[a:b] for a, b in zip(self.starts[some].tolist(), self.ends[some].tolist())]


def _of_languages(column: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    names = column.dictionary_encode()
    digests = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in names.dictionary.to_pylist()]
    return np.frombuffer(b"".join(digests), np.uint64)[names.indices.to_numpy()]


# ------------------------------------------------------------------- the words

def _vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """``(lang, word, hash, f)`` of every word of all texts."""
    def run(batches):
        values = _byte_values(seed)
        held: list[tuple] = []
        size = 0

        def batch():
            h = np.concatenate([x[0] for x in held])
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([x[1] for x in held]), minlength=len(u))
            words = [w for x in held for w in x[2]]
            langs = [w for x in held for w in x[3]]
            return pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in at.tolist()], pa.string()),
                 pa.array([words[i] for i in at.tolist()], pa.binary()).cast(pa.string()),
                 pa.array(signed(u)), pa.array(n.astype(np.int64))], names=["lang", "word", "hash", "f"])

        for part in slices(batches, "text"):
            p = Pieces(texts_of(part.column("text")))
            u, at, n = np.unique(p.hashes(_of_languages(part.column("lang")), values),
                                 return_index=True, return_counts=True)
            langs = part.column("lang").to_pylist()
            held.append((u, n, p.words(at), [langs[i] for i in p.row[at].tolist()]))
            size += len(u)
            if size > 500_000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    parts = docs.mapInArrow(run, "lang string, word string, hash bigint, f bigint")
    return parts.groupBy("lang", "word").agg(F.min("hash").alias("hash"), F.sum("f").alias("f"))


def _head(vocabulary: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the most frequent words, ``most`` at the most: all whose
    count reaches the least bound (in steps of a sixteenth of an octave) that not
    more than ``most`` words reach."""
    level = F.floor(F.log2("f") * 16)
    counts = sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    least, total = None, 0
    for r in counts:  # about a thousand levels at the most
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(vocabulary.filter(level >= least).select("hash").toArrow().column(0).to_numpy().view(np.uint64))


def _codes(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place in the table of frequent words, or else a negative number."""
    out = signed((h >> np.uint64(1)) | np.uint64(1 << 63)).copy()
    if len(head):
        at = np.searchsorted(head, h)
        at[at == len(head)] = 0
        there = head[at] == h
        out[there] = at[there]
    return out


def _places(parts: list[np.ndarray], size: int) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix64(h * _ODD[1] + p.view(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64)


def _table(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Which ``flags`` the rows with some place have; at most ``MOST_PLACES``."""
    rows = write_shared(rows, "flagged")
    size = LEAST_PLACES
    wanted = 8 * rows.count()
    while size < min(wanted, MOST_PLACES):
        size *= 2

    def run(batches):
        for b in batches:
            place = _places([b.column(c).to_numpy() for c in columns], size)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), b.column("flags")], names=["place", "flags"])

    found = rows.mapInArrow(run, "place int, flags int").groupBy("place").agg(F.bit_or("flags").alias("flags")).toArrow()
    out = np.zeros(size, np.uint8)
    out[found.column("place").to_numpy()] = found.column("flags").to_numpy()
    return out


# ----------------------------------------------------------------- the phrases

@dataclass
class Words:
    """What tasks know of the words: byte values of the hash, frequent words, and
    the places of the other words that come often enough."""

    seed: int
    head: np.ndarray
    others: np.ndarray

    def phrases(self, docs: DataFrame, size: int, wanted=None) -> DataFrame:
        """``(w1, ..., f)``: the phrases of ``size`` frequent words, or those of them
        whose codes ``wanted`` says yes to."""
        names = [f"w{i}" for i in range(1, size + 1)]

        def run(batches):
            values = _byte_values(self.seed)
            held: list[tuple] = []
            tokens = 0

            def batch():
                h, goes_on = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                u, at = np.unique(h, return_inverse=True)
                codes = _codes(u, self.head)
                often = (codes >= 0) | (self.others[_places([codes], len(self.others))] > 0)
                ok = often[at]
                good = ok[: len(h) - size + 1].copy()
                for i in range(1, size):
                    good &= ok[i: len(h) - size + 1 + i] & goes_on[i - 1: len(h) - size + i]
                place = np.flatnonzero(good)
                if wanted is not None:
                    place = place[wanted([codes[at[place + i]] for i in range(size)])]
                # words as numbers among the window's own, so a phrase is one number
                own, small = np.unique(at, return_inverse=True)
                if len(own) ** size < 1 << 62:
                    key = np.zeros(len(place), np.int64)
                    for i in range(size):
                        key = key * len(own) + small[place + i]
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                else:
                    rows = np.stack([small[place + i] for i in range(size)], axis=1)
                    _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
                return pa.RecordBatch.from_arrays(
                    [*(pa.array(codes[at[place[first] + i]]) for i in range(size)), pa.array(n.astype(np.int64))],
                    names=[*names, "f"])

            for part in slices(batches, "text"):
                p = Pieces(texts_of(part.column("text")))
                h = p.hashes(_of_languages(part.column("lang")), values)
                if len(h) < size:
                    h, p.goes_on = np.append(h, np.zeros(size, np.uint64)), np.append(p.goes_on, np.zeros(size, bool))
                held.append((h, p.goes_on))
                tokens += len(h)
                if tokens > WINDOW:
                    yield batch()
                    held, tokens = [], 0
            if held:
                yield batch()

        kind = ", ".join(f"{c} bigint" for c in names) + ", f bigint"
        return docs.mapInArrow(run, kind).groupBy(*names).agg(F.sum("f").alias("f"))

    def coded(self, vocabulary: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                codes = _codes(b.column("hash").to_numpy().view(np.uint64), self.head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes), *(b.column(c) for c in ("lang", "word", "f"))], names=["code", "lang", "word", "f"])
        return vocabulary.mapInArrow(run, "code bigint, lang string, word string, f bigint")


def _words(docs: DataFrame, least: int) -> tuple[Words, DataFrame, DataFrame]:
    """The words as tasks know them, ``(code, lang, word, f)`` of the frequent
    ones, and ``(lang, n)``."""
    seed = 0
    while True:
        vocabulary = write_shared(_vocabulary(docs, seed), "vocabulary")
        same = vocabulary.groupBy(F.shiftrightunsigned("hash", 1)).count().filter("count > 1")
        if same.isEmpty():
            break
        seed += 1
    often = vocabulary.filter(F.col("f") >= least)
    head = _head(often, HEAD)
    known = Words(seed, head, np.zeros(LEAST_PLACES, np.uint8))
    table = write_shared(known.coded(often), "words")
    known.others = _table(table.filter("code < 0").select("code", F.lit(1).alias("flags")), ["code"])
    return known, table, vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(SCALE * a * a / (l * r)) in whole numbers of up to 38 digits."""
    big = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(SCALE).cast("decimal(7,0)"), big(l) * big(r))


def _bound(part: str, whole: str) -> Column:
    """floor(SCALE * part / whole): no phrase that grows from the part scores more."""
    return F.call_function("div", F.col(part).cast("decimal(15,0)") * F.lit(SCALE).cast("decimal(7,0)"),
                           F.col(whole).cast("decimal(15,0)"))


def _cutoffs(two: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """``(lang, n, cutoff)`` of the open languages: a score that at least ``rank``
    two-word phrases reach, or 0 if there are fewer. Any cutoff is right; scores
    are taken in sixteenths of an octave, so a language has some hundred levels."""
    level = F.floor(F.log2(F.col("score") + 1) * 16)
    levels = two.groupBy("lang", level.alias("level")).count()
    upto = F.sum("count").over(W.partitionBy("lang").orderBy(F.desc("level")))
    reached = levels.withColumn("upto", upto).filter(F.col("upto") >= rank).groupBy("lang").agg(F.max("level").alias("level"))
    cutoff = F.greatest(F.lit(0), F.floor(F.pow(F.lit(2.0), F.col("level") / 16)) - 1)
    return open_.join(reached, "lang", "left").select("lang", "n", F.coalesce(cutoff, F.lit(0)).cast("long").alias("cutoff"))


_PREFIX, _SUFFIX, _COVERS = 1, 2, 4


def _expanded(known: Words, docs: DataFrame, frontier: DataFrame, least: int) -> DataFrame:
    """``(w1, w2, w3, f)`` of the three-word phrases that some bound leaves open.
    ``frontier``: ``(w1, w2, flags)`` of two-word phrases."""
    table = _table(frontier, ["w1", "w2"])

    def wanted(codes):
        left, right = (table[_places(codes[i: i + 2], len(table))] for i in (0, 1))
        return ((left & _PREFIX > 0) & (right & _SUFFIX > 0)) | ((left | right) & _COVERS > 0)

    return write_shared(known.phrases(docs, 3, wanted).filter(F.col("f") >= least), "three")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                 top: int = TOP, cover: int = COVER) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of
    two or three words.

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line
    breaks and those into words at blanks and tabs; ``lang`` null counts as ``und``.
    ``n`` counts all words of the language, ``a`` the phrase (at least ``least``),
    ``l`` and ``r`` its parts at the cut of the lowest floor(1,000,000 * a * a / (l *
    r)), which is ``score``; ties to the earlier cut. A two-word phrase goes if a
    counted three-word phrase that contains it has at least ``cover`` percent of its
    count. Ranks go by score, then ``a``, both falling, then the phrase in byte
    order. Counts up to 10^15 are exact. Repeated rows count as often as they are
    there; other columns are ignored; without words there are no rows.
    """
    docs = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    known, words, sizes = _words(docs, least)
    word = lambda i, *c: words.select(F.col("code").alias(f"w{i}"), *c)
    two = known.phrases(docs, 2).filter(F.col("f") >= least).withColumnRenamed("f", "a")
    two = (two.join(word(1, "lang", F.col("f").alias("l")), "w1").join(word(2, F.col("f").alias("r")), "w2")
           .select("lang", "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"),
                   _bound("a", "l").alias("prefix"), _bound("a", "r").alias("suffix")))
    two = write_shared(two, "two")
    open_, rank, found = write_shared(sizes, "languages"), top, None
    while not open_.isEmpty():
        cut = write_shared(_cutoffs(two, open_, rank), "cutoffs")
        here = two.join(cut, "lang")
        reach = lambda c, flag: F.when(F.col(c) >= F.col("cutoff"), flag).otherwise(0)
        frontier = here.select("w1", "w2", (reach("prefix", _PREFIX) + reach("suffix", _SUFFIX)
                                            + reach("score", _COVERS)).alias("flags")).filter("flags > 0")
        three = _expanded(known, docs, frontier, least)
        side = lambda x, y, one, both: two.select(
            F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(both), *one)
        three = (three.withColumnRenamed("f", "a")
                 .join(side("w1", "w2", ["lang", F.col("l").alias("f1")], "f12"), ["w1", "w2"])
                 .join(side("w2", "w3", [F.col("r").alias("f3")], "f23"), ["w2", "w3"])
                 .withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3")))
        later = F.col("s2") < F.col("s1")
        three = write_shared(three.select(
            "lang", "w1", "w2", "w3", "a", F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
            F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score")), "grown")
        covers = (three.select("w1", "w2", "a").unionAll(three.select("w2", "w3", "a"))
                  .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
        pairs = (here.filter(F.col("score") >= F.col("cutoff")).join(covers, ["w1", "w2"], "left")
                 .filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
                 .select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", "n", "score", "cutoff"))
        grown = three.join(cut, "lang").filter(F.col("score") >= F.col("cutoff")).select(*pairs.columns)
        known_all = write_shared(pairs.unionByName(grown), "surviving")
        enough = known_all.groupBy("lang").agg(F.count("*").alias("k"))
        state = write_shared(cut.join(enough, "lang", "left").select(
            "lang", "n", ((F.col("cutoff") == 0) | (F.coalesce("k", F.lit(0)) >= top)).alias("settled")), "state")
        part = known_all.join(state.filter("settled").select("lang"), "lang", "left_semi").drop("cutoff")
        found = part if found is None else found.unionByName(part)
        open_ = state.filter("not settled").drop("settled")
        docs = docs.join(open_.select("lang"), "lang", "left_semi")
        rank *= GROW
    if found is None:
        return documents.sparkSession.createDataFrame(
            [], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    for i in (1, 2, 3):
        found = found.join(word(i, F.col("word").alias(f"t{i}")), f"w{i}", "left")
    named = found.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
