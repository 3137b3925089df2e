"""Language-model scores by a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class). Words of about equal
total frequency that are neighbours in byte order form a class; the end of a text
has a class of its own. The class factor is a softmax over weights of hashed
history features: the last word, the last two words, and two skips (the word
before the last, and the one before that). The word factor is a softmax over the
words of the class as well, with a weight for the hashed feature (class, last word,
word) on top of log P0(word), the add-half relative frequency inside the class with
one place for all unseen words. The penalised weights have a closed form:

    weight = log(1 + n(last, word) / (prior * P0(word))), and the sum over the class is
    1 + n(last, class) / prior, so
    P(word | class, last) = (n(last, word) + prior * P0(word)) / (n(last, class) + prior)

All features that training texts have get a count, without a least one; ``prior``
is the one of the highest likelihood on every eighth training text when that is left
out, or P0 alone if none is better. Feature keys are hashes whose bits follow the number
of tokens, so that there are at least 256 places for every feature that may come.

The counts grow with the input. They travel as sorted, packed blocks of keys, about
``BLOCK_KEYS`` in a block. Texts are scored in parts of about ``PART_BYTES``; a part
gathers its distinct keys once and sends them to their blocks with the counts of its own
training texts, gets the sums over all parts back and is scored in numpy.

Training is distributed: a pass over all training texts gives each (feature,
class) count that was observed and each that the model expects, summed over tasks
by Spark; their difference is the likelihood's gradient, and every weight takes
the scaled step log(observed / expected) / features along its sign (generalised
iterative scaling). Scoring is a pass of sparse numpy batches.

Word counts are taken over all texts. The ``HEAD`` most frequent words (a
bounded table) are known to every task; a document's other words are looked up by
a join with the whole vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import Texts, hashed, mix64, signed, slices, texts_of
from agora.session import write_shared

CLASSES, BUCKETS, ROUNDS, HEAD = 32, 1 << 13, 2, 1 << 17
FEATURES = 4
#: Priors of the word factor that are tried.
PRIORS = [4.0**i for i in range(-1, 11)]
DEV = 8
#: Least bits of a feature's key, entries of a block of counts, bytes of text of a part.
KEY_BITS, BLOCK_KEYS, PART_BYTES = 40, 1 << 21, 1 << 22
#: Bits of the keys of words outside the head, which are their hashes: base counts are exact.
WORD_BITS = 62
_BLOCK = 512  # buckets that travel together
_CHUNK, _TOKENS = 1 << 16, 1 << 11  # tokens whose counts are added at once, whose classes are weighed at once
_STEP = 1 << 18  # bytes that are hashed at once
_BEGIN, _END = hashed(np.arange(2), 41)
_MIX = hashed(np.arange(FEATURES), 43) | np.uint64(1)
_PAIR = hashed(np.arange(3), 47) | np.uint64(1)
_LN10 = float(np.log(10))


def _prefixes(t: Texts, starts: np.ndarray) -> np.ndarray:
    """The first four bytes of each word as a number in byte order."""
    buf = np.append(t.buf, np.zeros(4, np.uint8))
    lower = (buf >= 65) & (buf <= 90)
    buf[lower] += 32
    row_end = np.repeat(t.bounds[1:], np.diff(np.searchsorted(starts, t.bounds)))
    out, inside = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for j in range(4):
        b = buf[starts + j]
        inside &= (b > 32) | ((b < 9) | (b > 13)) & (b != 32)
        inside &= starts + j < row_end
        out = out * 256 + np.where(inside, b, 0)
    return out


class Tokens:
    """Words and one end per text of a block: hashes, prefixes, text numbers, and
    the hashed features of each token's history."""

    def __init__(self, t: Texts):
        starts, first = t.words()
        words, _ = t.word_hashes(_STEP, (starts, first))
        n = np.diff(first)
        rows = np.arange(len(n))
        # three beginnings, the words, the end
        begin = np.cumsum(n + 4) - (n + 4)
        at = np.arange(len(words)) + np.repeat(begin - first[:-1] + 3, n)
        line = np.full(int((n + 4).sum()), _BEGIN, np.uint64)
        line[at] = words
        ends = begin + n + 3
        line[ends] = _END
        self.place = np.sort(np.concatenate([at, ends]))
        self.line = line
        self.row = np.repeat(rows, n + 1)
        self.hash = line[self.place]
        self.is_end = np.zeros(len(self.place), bool)
        self.is_end[np.cumsum(n + 1) - 1] = True
        self.prefix = np.full(len(self.place), -1, np.int64)
        self.prefix[~self.is_end] = _prefixes(t, starts)

    def features(self, lo: int, hi: int) -> np.ndarray:
        """FEATURES x tokens: bucket numbers."""
        p = self.place[lo:hi]
        a, b, c = self.line[p - 1], self.line[p - 2], self.line[p - 3]
        raw = np.stack([a * _MIX[0], (a * np.uint64(3) + b) * _MIX[1], b * _MIX[2], c * _MIX[3]])
        return (mix64(raw) >> np.uint64(64 - int(BUCKETS).bit_length() + 1)).astype(np.int64)


# ------------------------------------------------------------- the class factor

@dataclass
class ClassModel:
    """``edges``: first prefix of classes 1...; ``weights``: features x buckets x
    classes; ``bias``: log frequency of classes. The last class is the end."""

    edges: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def classes(self, t: Tokens) -> np.ndarray:
        out = np.searchsorted(self.edges, t.prefix, "right")
        out[t.is_end] = len(self.bias) - 1
        return out

    def log_p(self, features: np.ndarray) -> np.ndarray:
        """Tokens x classes: natural log of P(class | history)."""
        s = np.repeat(self.bias[None, :], features.shape[1], axis=0)
        for w, f in zip(self.weights, features):
            s += w[f]
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return s


class Odds:
    """A class model with its weights as factors, so that a token's classes take
    products and no powers; each feature's largest factor in a bucket is 1. Products
    too small for single precision are left to the model."""

    def __init__(self, model: ClassModel):
        self.model = model
        self.factors = np.exp(model.weights - model.weights.max(axis=2, keepdims=True))
        self.factors[0] *= np.exp(model.bias)  # shares of classes
        self.ones = np.ones(len(model.bias), np.float32)

    def _products(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens x classes: multiples of P(class | history), their sums, and the
        tokens whose sums are too small for single precision."""
        s = np.take(self.factors[0], features[0], axis=0)
        for w, f in zip(self.factors[1:], features[1:]):
            s *= np.take(w, f, axis=0)
        total = s @ self.ones
        return s, total, np.flatnonzero(~(total > 1e-25))

    def p(self, features: np.ndarray) -> np.ndarray:
        """Classes x tokens: P(class | history)."""
        out = np.empty((len(self.ones), features.shape[1]), np.float32)
        for lo in range(0, features.shape[1], _TOKENS):
            f = features[:, lo: lo + _TOKENS]
            s, total, low = self._products(f)
            if len(low):
                s[low], total[low] = np.exp(self.model.log_p(f[:, low])), 1
            s /= total[:, None]
            out[:, lo: lo + _TOKENS] = s.T
        return out

    def log_of(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history) of each token's own class."""
        out = np.empty(len(classes), np.float32)
        for lo in range(0, len(classes), _TOKENS):
            f, c = features[:, lo: lo + _TOKENS], classes[lo: lo + _TOKENS]
            s, total, _ = self._products(f)
            own = s.ravel()[np.arange(len(c)) * len(self.ones) + c]
            low = np.flatnonzero(~(own > 1e-25))
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log(own / total)
            if len(low):
                own[low] = self.model.log_p(f[:, low])[np.arange(len(low)), c[low]]
            out[lo: lo + _TOKENS] = own
        return out


def _counts(odds: Odds, t: Tokens, expected: bool, into: np.ndarray) -> None:
    """Add a block's observed or expected (feature bucket, class) counts."""
    classes, k = odds.model.classes(t), len(odds.ones)
    for lo in range(0, len(classes), _CHUNK):
        f = t.features(lo, lo + _CHUNK)
        c = classes[lo: lo + _CHUNK]
        if not expected:
            for i in range(FEATURES):
                into[i] += np.bincount(f[i] * k + c, minlength=BUCKETS * k).reshape(BUCKETS, k)
            continue
        p = odds.p(f)
        for i in range(FEATURES):
            for j in range(k):
                into[i, :, j] += np.bincount(f[i], weights=p[j], minlength=BUCKETS)


def _summed(training: DataFrame, model: ClassModel, expected: bool) -> np.ndarray:
    """Counts over all training texts. Each task sends its sums in blocks of
    buckets; a block's sums are added as they stream in. What reaches the driver
    is one table of the weights' size."""
    shape = (FEATURES, BUCKETS, len(model.bias))
    size = _BLOCK * shape[2]

    def local(batches):
        # expected counts come class by class, so a class's buckets are neighbours
        sums = np.zeros((shape[0], shape[2], shape[1])).transpose(0, 2, 1) if expected else np.zeros(shape)
        odds = Odds(model)
        for part in slices(batches, "text"):
            _counts(odds, Tokens(texts_of(part.column("text"))), expected, sums)
        flat = sums.astype(np.float32, order="C").reshape(-1, size)
        some = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(
                [pa.compress(flat[i].tobytes(), codec="zstd", asbytes=True) for i in some], pa.binary())],
            names=["block", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sums in zip(b.column("block").to_pylist(), b.column("sums").to_pylist()):
                v = np.frombuffer(pa.decompress(sums, 4 * size, codec="zstd", asbytes=True), np.float32)
                total[block] = total[block] + v if block in total else v.astype(float)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                names=["block", "sums"])

    blocks = FEATURES * BUCKETS // _BLOCK
    kind = "block int, sums binary"
    out = np.zeros((blocks, size))
    for r in training.mapInArrow(local, kind).repartition(blocks, "block").mapInArrow(add, kind).collect():
        out[r["block"]] += np.frombuffer(r["sums"], float)
    return out.reshape(shape)


def step(model: ClassModel, observed: np.ndarray, expected: np.ndarray, damp: float = 8.0) -> None:
    """One scaled gradient step; ``damp`` pseudo-counts at the class frequencies
    keep rare buckets near zero."""
    prior = damp * np.exp(model.bias)
    model.weights += (np.log((observed + prior) / (expected + prior)) / FEATURES).astype(np.float32)


def train(training: DataFrame, edges: np.ndarray, class_counts: np.ndarray, rounds: int = ROUNDS) -> ClassModel:
    """``training``: column ``text``. At weights zero the expected counts need no
    pass: each bucket's total shared out by class frequency."""
    share = (class_counts + 0.5) / (class_counts + 0.5).sum()
    model = ClassModel(edges, np.zeros((FEATURES, BUCKETS, len(share)), np.float32), np.log(share).astype(np.float32))
    observed = _summed(training, model, False)
    step(model, observed, observed.sum(axis=2, keepdims=True) * share)
    for _ in range(rounds - 1):
        step(model, observed, _summed(training, model, True))
    return model


# ------------------------------------------------------------------ vocabulary

def vocabulary(documents: DataFrame) -> DataFrame:
    """``(hash, prefix, n, n_train)`` of every token of all texts (``text``,
    ``train``). Tasks count their own tokens first."""
    def run(batches):
        held: list[tuple] = []
        size = 0

        def merged():
            h, p, n, m = (np.concatenate([x[i] for x in held]) for i in range(4))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, p[at], np.bincount(back, weights=n, minlength=len(u)), np.bincount(back, weights=m, minlength=len(u))

        def batch(x):
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(x[0])), pa.array(x[1]), pa.array(x[2].astype(np.int64)), pa.array(x[3].astype(np.int64))],
                names=["hash", "prefix", "n", "n_train"])

        for part in slices(batches, "text"):
            t = Tokens(texts_of(part.column("text")))
            u, at, back = np.unique(t.hash, return_index=True, return_inverse=True)
            train_ = part.column("train").to_numpy(zero_copy_only=False).astype(float)[t.row]
            held.append((u, t.prefix[at], np.bincount(back, minlength=len(u)),
                         np.bincount(back, weights=train_, minlength=len(u))))
            size += len(u)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield batch(held[0])
                    held, size = [], 0
        if held:
            yield batch(merged())

    parts = documents.select("text", "train").mapInArrow(run, "hash bigint, prefix bigint, n bigint, n_train bigint")
    return parts.groupBy("hash").agg(F.min("prefix").alias("prefix"), F.sum("n").alias("n"),
                                     F.sum("n_train").alias("n_train"))


def head_of(vocab: DataFrame, most: int = HEAD) -> pa.Table:
    """The most frequent words, ``most`` at the most: all whose count reaches the
    least bound (exact up to 1,024, then in steps of a sixteenth of an octave)
    that not more than ``most`` words reach."""
    level = F.when(F.col("n") <= 1024, F.col("n").cast("double")).otherwise(
        F.floor(F.log2("n") * 16) * 1024)
    by_level = sorted(vocab.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    least, total = float("inf"), 0
    for r in by_level:  # about two thousand levels at the most
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return vocab.filter(level >= least).toArrow()


# ------------------------------------------------- words after the last word

def _pack(a: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte by byte of all numbers, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack(data, size), dtype=np.uint64)


def _blocks(keys: np.ndarray, bits: int, key_bits: int):
    """``(block, from, to)`` of the runs of ascending keys with the same top bits."""
    of = keys >> np.uint64(key_bits - bits)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if hi > lo:
            yield int(of[lo]), lo, hi


def key_size(tokens: int) -> int:
    """Bits of keys for two features a token, each with 256 places."""
    return min(62, max(KEY_BITS, (2 * max(1, tokens) - 1).bit_length() + 8))


def _follow(t: Tokens, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token's context (last word, class) and of the token in it."""
    context = mix64(t.line[t.place - 1] * _PAIR[0] + (classes.astype(np.uint64) + np.uint64(1)) * _PAIR[1])
    return context, mix64(context * _PAIR[2] + t.hash)


def _rare(h: np.ndarray) -> np.ndarray:
    """Keys of words outside the head."""
    return hashed(h, 53)


class Head:
    """The frequent words, known to every task: hashes (ascending) and counts. The
    top bits of a hash name a shelf; a shelf's words are looked through in turn."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = np.append(hashes, ~np.uint64(0)), np.append(counts, 0)
        self.shelf = np.searchsorted(hashes >> np.uint64(64 - self.BITS), np.arange(1 << self.BITS)).astype(np.int32)
        self.longest = int(np.diff(self.shelf, append=len(hashes)).max())
        self.size = len(hashes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are there, and their training counts (else 0)."""
        at = self.shelf[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        there = (self.hashes[at] == h) & (at < self.size)
        for _ in range(1, self.longest):
            on = np.flatnonzero(~there & (self.hashes[at] < h))
            if not len(on):
                break
            at[on] += 1
            there[on] = (self.hashes[at[on]] == h[on]) & (at[on] < self.size)
        return there, np.where(there, self.counts[at], 0)


_COUNTS = "block int, size int, keys binary, n binary, n_dev binary"


def feature_counts(training: DataFrame, model: ClassModel, head: Head, bits: int, key_bits: int) -> DataFrame:
    """``(block, size, keys, n, n_dev)``: each task's counts of all pairs, contexts
    and words outside the head in its training texts (``text``, ``dev``), and those
    in the left-out ones. ``bits`` of the keys name the block."""
    names = ["block", "size", "keys", "n", "n_dev"]
    shift = np.uint64(64 - key_bits)

    def rows(keys, n, d):
        return [(b, hi - lo, pack_keys(keys[lo:hi]), _pack(n[lo:hi]), _pack(d[lo:hi]))
                for b, lo, hi in _blocks(keys, bits, key_bits)]

    def batch(found):
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

    def summed(held):
        # the key above one bit that says left out: one sort counts both
        x = np.concatenate(held)
        x.sort()
        starts = np.flatnonzero(np.diff(x, prepend=~x[:1]))
        times = np.diff(starts, append=len(x))
        key, left = x[starts] >> np.uint64(1), (x[starts] & np.uint64(1)).astype(np.int64)
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        return key[first], np.add.reduceat(times, first), np.add.reduceat(times * left, first)

    def local(batches):
        held: list[np.ndarray] = []
        size = 0
        for part in slices(batches, "text"):
            t = Tokens(texts_of(part.column("text")))
            there, _ = head.find(t.hash)
            dev = part.column("dev").to_numpy(zero_copy_only=False).astype(np.uint64)[t.row]
            for keys, left in [*((k, dev) for k in _follow(t, model.classes(t))), (_rare(t.hash[~there]), dev[~there])]:
                held.append((keys >> shift << np.uint64(1)) | left)
                size += len(keys)
            if size > 4_000_000:
                yield batch(rows(*summed(held)))
                held, size = [], 0
        if size:
            yield batch(rows(*summed(held)))

    return training.mapInArrow(local, _COUNTS)


def sum_counts(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, their counts, and those in left-out texts, of the
    rows of one block."""
    return _merged(rows)[:3] if rows else (np.empty(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64))


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`sum_counts`, and the number of each row's each key among the distinct ones."""
    keys = np.concatenate([unpack_keys(r["keys"], r["size"]) for r in rows])
    keys, back = np.unique(keys, return_inverse=True)
    n, d = (np.bincount(back, weights=np.concatenate([_unpack(r[c], r["size"]) for r in rows]),
                        minlength=len(keys)).astype(np.int64) for c in ("n", "n_dev"))
    return keys, n, d, back


#: What a text's tokens count for: nothing, training, training and the choice of the prior.
UNSEEN, SEEN, LEFT = 0, 1, 2


def _own_counts(keys: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (of 62 bits), ascending, how often each comes in training texts, and
    in left-out ones: one sort of the keys with two bits of state below."""
    x = (keys << np.uint64(2)) | state
    x.sort()
    state, keys = x & np.uint64(3), x >> np.uint64(2)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    n, d = (np.add.reduceat(state >= s, first, dtype=np.int64) if len(first) else np.empty(0, np.int64) for s in (SEEN, LEFT))
    return keys[first], n, d


def _parts(documents: DataFrame, part_bytes: int) -> DataFrame:
    """``(part, docs)``: runs of rows with about ``part_bytes`` of text, as
    compressed Arrow; a longer text is a part of its own."""
    def run(batches):
        own = TaskContext.get().partitionId() << 32
        for at, part in enumerate(slices(batches, "text", part_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own + at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["part", "docs"])

    return documents.mapInArrow(run, "part bigint, docs binary")


class Part:
    """The tokens of a part with the keys of their features."""

    def __init__(self, docs: bytes, model: ClassModel, head: Head, key_bits: int, score: bool):
        self.rows = pa.ipc.open_stream(docs).read_all().combine_chunks()
        held, done, odds = [], 0, Odds(model) if score else None
        self.log_class = []
        for piece in slices(self.rows.to_batches(), "text"):
            t = Tokens(texts_of(piece.column("text")))
            of = model.classes(t)
            there, known = head.find(t.hash)
            context, pair = _follow(t, of)
            held.append((context, pair, t.hash[~there], there, known, of, t.row + done))
            done += piece.num_rows
            if score:
                self.log_class += [odds.log_of(t.features(lo, lo + _CHUNK), of[lo: lo + _CHUNK])
                                   for lo in range(0, len(of), _CHUNK)]
        context, pair, words, self.there, self.known, self.of, self.row = (np.concatenate(x) for x in zip(*held))
        self.keys = np.concatenate([context, pair]) >> np.uint64(64 - key_bits)
        self.words = words >> np.uint64(64 - WORD_BITS)
        self.state = self.rows.column("state").to_numpy().astype(np.uint64)[self.row]

    def asked(self, bits: int, key_bits: int, word_bits: int) -> list[tuple]:
        """``(block, size, keys, n, n_dev)`` of the part's distinct keys with their counts in
        the part itself. The blocks of words outside the head follow those of features."""
        out = []
        for keys, state, top, width, above in [(self.keys, np.tile(self.state, 2), bits, key_bits, 0),
                                               (self.words, self.state[~self.there], word_bits, WORD_BITS, 1 << bits)]:
            keys, n, d = _own_counts(keys, state)
            out += [(above + block, hi - lo, pack_keys(keys[lo:hi]), _pack(n[lo:hi]), _pack(d[lo:hi]))
                    for block, lo, hi in _blocks(keys, top, width)]
        return out


def follow_log10(n, total, p0, prior):
    """What the last word adds to the log10 of P0."""
    return (np.log(1 + n / (prior * p0)) + np.log(prior / (total + prior))) / type(prior)(_LN10)


# --------------------------------------------------------------------- scoring

def score(documents: DataFrame, key: str = "doc_id", text: str = "text", train_flag: str = "train",
          classes: int = CLASSES, rounds: int = ROUNDS, head: int = HEAD, priors: list[float] = PRIORS,
          block_keys: int = BLOCK_KEYS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every text,
    learnt from the rows whose boolean ``train_flag`` is true.

    Null texts count as empty: their one token is the end. Both scores are log10
    probabilities of the whole text; ``base_score`` is the add-half unigram score
    that ``score`` should beat. Repeated rows are scored alike; without training
    rows every word is unknown; an empty table gives an empty table. Other
    columns are ignored. ``block_keys`` and ``part_bytes`` change no result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"),
                            F.coalesce(F.col(train_flag), F.lit(False)).alias("train"))
    vocab = write_shared(vocabulary(docs), "vocabulary")
    n_all, n_train, v_train = vocab.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)),
        F.count(F.when(F.col("n_train") > 0, 1))).first()
    top = head_of(vocab, head)
    h = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, c = h[order], top.column("n_train").to_numpy()[order]
    prefix = top.column("prefix").to_numpy()[order]
    edges = _edges(prefix[prefix >= 0], c[prefix >= 0], classes)
    totals = _class_totals(vocab, edges)  # class -> training tokens, distinct words
    frequent = Head(h, c)

    model = train(docs.filter("train").select("text"), edges, totals[:, 0], rounds)
    room = np.log10(totals[:, 0] + 0.5 * (totals[:, 1] + 1))
    dev = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % DEV == 0
    blocks_of = lambda keys: max(0, int(np.ceil(np.log2(max(1, keys) / block_keys))))
    bits, key_bits, word_bits = blocks_of(2 * n_all), key_size(n_all), blocks_of(n_all - sum(top.column("n").to_pylist()))
    kind = documents.schema[key].dataType.simpleString()

    def ask(batches):
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("docs").to_pylist()):
                found = Part(data, model, frequent, key_bits, False).asked(bits, key_bits, word_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.int64()), *(pa.array([r[i] for r in found], k) for i, k in enumerate(
                        [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]))],
                    names=["part", "block", "size", "keys", "n", "n_dev"])

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        _, n, d, back = _merged(rows)
        ends = np.cumsum([r["size"] for r in rows]).tolist()
        out = [(r["part"], r["block"], r["size"], _pack(n[back[e - r["size"]: e]]), _pack(d[back[e - r["size"]: e]]))
               for r, e in zip(rows, ends)]
        return pa.Table.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(
                [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["part", "block", "size", "n", "n_dev"])

    def finish(part: pa.Table, answers: pa.Table) -> pa.Table:
        p = Part(part.column("docs").to_pylist()[0], model, frequent, key_bits, True)
        m = p.rows.num_rows
        found = sorted(answers.to_pylist(), key=lambda r: r["block"])  # blocks ascend as keys do
        of_features = [r for r in found if r["block"] < 1 << bits]
        n, d = (np.concatenate([_unpack(r[c], r["size"]) for r in of_features]).astype(np.float32) for c in ("n", "n_dev"))
        _, back = np.unique(p.keys, return_inverse=True)
        in_context, in_pair = np.split(back, 2)
        count = p.known.astype(np.int64)
        if len(p.words):
            of_words = np.concatenate([_unpack(r["n"], r["size"]) for r in found[len(of_features):]]).astype(np.int64)
            count[~p.there] = of_words[np.unique(p.words, return_inverse=True)[1]]
        p0 = ((count + 0.5) / (10.0 ** room)[p.of]).astype(np.float32)
        sums = lambda v, rows=p.row: np.bincount(rows, weights=v, minlength=m)
        flat = lambda a: pa.ListArray.from_arrays(
            pa.array(np.arange(m + 1, dtype=np.int32) * len(priors)), pa.array(a.T.ravel().astype(float)))
        pairs, totals_ = n[in_pair], n[in_context]
        gains = np.array([sums(follow_log10(pairs, totals_, p0, np.float32(x))) for x in priors]).reshape(len(priors), m)
        # the likelihood of left-out texts by the counts of the others
        own = p.state == LEFT
        rest, rest_total = (pairs - d[in_pair])[own], (totals_ - d[in_context])[own]
        left = np.array([sums(follow_log10(rest, rest_total, p0[own], np.float32(x)), p.row[own])
                         for x in priors]).reshape(len(priors), m)
        log_class = np.concatenate(p.log_class).astype(float) / _LN10
        return pa.Table.from_arrays(
            [p.rows.column("key").combine_chunks(), pa.array(np.bincount(p.row, minlength=m)),
             pa.array(sums(log_class - room[p.of])), pa.array(sums(np.log10(count + 0.5))),
             pa.array(sums(count > 0).astype(np.int64)), flat(gains), flat(left)],
            names=["key", "n_tokens", "outer", "logs", "known", "gains", "left"])

    state = F.when(~F.col("train"), UNSEEN).when(dev, LEFT).otherwise(SEEN).cast("byte")
    parts = write_shared(_parts(docs.select("key", "text", state.alias("state")), part_bytes), "parts")
    asked = parts.mapInArrow(ask, "part bigint, block int, size int, keys binary, n binary, n_dev binary")
    answers = asked.groupBy("block").applyInArrow(answer, "part bigint, block int, size int, n binary, n_dev binary")
    scored = write_shared(parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        finish, f"key {kind}, n_tokens bigint, outer double, logs double, known bigint, gains array<double>, "
                "left array<double>"), "scored")
    gain = F.lit(0.0)
    if priors:
        likelihood = [x or 0.0 for x in scored.agg(*(F.sum(F.col("left")[i]).alias(str(i)) for i in range(len(priors)))).first()]
        if max(likelihood) > 0:
            gain = F.col("gains")[int(np.argmax(likelihood))]
    base_room = float(np.log10(n_train + 0.5 * (v_train + 1)))
    return scored.select(
        F.col("key").alias(key), "n_tokens", F.col("known").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * base_room).alias("base_score"),
        (F.col("logs") + F.col("outer") + gain).alias("score"))


def _edges(prefix: np.ndarray, mass: np.ndarray, classes: int) -> np.ndarray:
    """First prefixes of all classes but the first: cuts of equal training mass
    over the frequent words in byte order."""
    order = np.argsort(prefix, kind="stable")
    cum = np.cumsum(mass[order])
    if not len(cum) or not cum[-1]:
        return np.empty(0, np.int64)
    at = np.searchsorted(cum, cum[-1] * np.arange(1, classes) / classes)
    return np.unique(prefix[order][at])


def _class_totals(vocab: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Training tokens and distinct training words of each class, the end last."""
    k = len(edges) + 2

    def run(batches):
        out = np.zeros((k, 2))
        for b in batches:
            p, n = b.column("prefix").to_numpy(), b.column("n_train").to_numpy()
            of = np.where(p < 0, k - 1, np.searchsorted(edges, p, "right"))
            out[:, 0] += np.bincount(of, weights=n, minlength=k)
            out[:, 1] += np.bincount(of, weights=n > 0, minlength=k)
        yield pa.RecordBatch.from_pydict({"of": np.arange(k, dtype=np.int32), "n": out[:, 0], "v": out[:, 1]})

    out = np.zeros((k, 2))
    rows = vocab.select("prefix", "n_train").mapInArrow(run, "of int, n double, v double") \
        .groupBy("of").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    for r in rows:
        out[r["of"]] = r["n"], r["v"]
    return out
