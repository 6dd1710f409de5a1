"""Documents scored by masked pseudo-likelihood.

Every token is predicted from its ``REACH`` neighbours on both sides, itself left out.  The sum of the logarithms of these
conditional probabilities is the document's score, and the mean over its tokens compares documents of unlike lengths.

The network: each neighbour's embedding, by its distance, is summed and put through tanh; a first softmax gives the
token's class and a second, of that class, its place within the class.  It is written and trained in numpy.

The corpus: words are counted over all documents, and every word with ``LEAST`` places is in the vocabulary.  The network's
tokens grow with the root of the vocabulary: the most frequent words have one each, and those after them share the last
quarter by bands of frequency.  A word's probability is its token's times its share of the token, by counts.  Words below
``LEAST`` are one token to the network, and their share is the probability of their spelling: a chain of bytes, each given
the one before, counted over all such words of the corpus.  Training sees every document once: in each of ``ROUNDS`` rounds every task starts from the
shared weights, takes Adagrad steps over the documents it reads whose hash is in that round, and hands its weights on as
one vector, weighted by its tokens.  The vectors of some tasks each are summed in the cluster, so that the driver adds no
more of them than the root of the number of tasks.  The result so depends on how the table is split into tasks.

Defined results: words are runs of characters other than space and tab to carriage return, A-Z in lower case; a null or
empty text has no tokens, score 0 and no mean; equal texts have equal scores, up to the last bits that batching changes;
ties in frequency go by hash; a null id takes part like any other; an empty table gives an empty result; columns that clash with those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import small_batches

#: Neighbours on each side, width of the network, classes and words of a class, tokens of a step.
REACH, WIDTH, CLASSES, STEP = 3, 16, 32, 4096
ROUNDS, RATE, SEED = 2, 0.15, 5
#: A network for n words has as many classes as the root of n by this, and CLASSES at least.
ROOT = 8
#: Places of a word of the vocabulary, at least.
LEAST = 10
#: The token of all other words, and what stands beyond a text's ends: the last embedding.
OTHER, OUTSIDE = 0, -1
OFFSETS = tuple(o for o in range(-REACH, REACH + 1) if o)


class Network:
    """Classes of ``CLASSES`` words; how many, a vector of weights tells by its length."""

    def __init__(self, vector: np.ndarray | None = None, classes: int = CLASSES):
        beyond = len(OFFSETS) * WIDTH
        if vector is not None:
            classes = (len(vector) - beyond) // (CLASSES * beyond + (WIDTH + 1) * (1 + CLASSES))
        self.classes = classes
        size = classes * CLASSES + 1  # the last stands beyond a text's ends
        self.shapes = {"embed": (len(OFFSETS), size, WIDTH), "top": (WIDTH, classes), "top_bias": (classes,), "low": (classes, WIDTH, CLASSES), "low_bias": (classes, CLASSES)}
        total = sum(int(np.prod(s)) for s in self.shapes.values())
        if vector is None:
            vector = np.random.default_rng(SEED).normal(0, 0.1, total)
        self.vector, at = np.array(vector, "f4"), 0
        self.part = {}
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.part[name] = self.vector[at : at + n].reshape(shape)
            at += n
        self.seen = None

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.part["embed"][0][context[:, 0]]
        for o in range(1, len(OFFSETS)):
            h += self.part["embed"][o][context[:, o]]
        return np.tanh(h, out=h)

    @staticmethod
    def _exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exponents, their sums) of each row of z; z is moved by a row's maximum where numbers would not hold them."""
        with np.errstate(over="ignore"):
            e = np.exp(z)
        total = e @ np.ones(z.shape[1], "f4")
        if not (len(total) == 0 or (np.isfinite(total).all() and total.min() > 1e-30)):
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e.sum(axis=1)
        return e, total

    def _forward(self, context: np.ndarray, target: np.ndarray) -> tuple:
        """Rows in the order of their class: order, cuts, hidden, class, place in it, and both logits."""
        high, low = np.divmod(target, CLASSES)
        order = np.argsort(high.astype(np.uint16) if self.classes <= 1 << 16 else high, kind="stable")
        high, low = high[order], low[order]
        cuts = np.searchsorted(high, np.arange(self.classes + 1))
        h = self._hidden(context[order])
        top = h @ self.part["top"]
        top += self.part["top_bias"]
        within = self.part["low_bias"][high]
        for c in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[c], cuts[c + 1])
            within[own] += h[own] @ self.part["low"][c]
        return order, cuts, h, high, low, top, within

    def score(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each target."""
        out = np.zeros(len(target))
        for start in range(0, len(target), STEP):
            own = slice(start, start + STEP)
            order, _, h, high, low, top, within = self._forward(context[own], target[own])
            rows, each = np.arange(len(h)), np.zeros(len(h))
            for z, pick in ((top, high), (within, low)):
                _, total = self._exponents(z)
                each += z[rows, pick] - np.log(total)
            out[start + order] = each
        return out

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step up the mean log-probability."""
        if self.seen is None:
            self.seen = np.full(len(self.vector), 1e-6, "f4")
        n = len(target)
        order, cuts, h, high, low, top, within = self._forward(context, target)
        context, rows = context[order], np.arange(n)
        change = np.zeros(len(self.vector), "f4")
        slope, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            slope[name] = change[at : at + size].reshape(shape)
            at += size
        errors = []
        for z, pick in ((top, high), (within, low)):
            e, total = self._exponents(z)
            e /= -total[:, None]
            e[rows, pick] += 1
            errors.append(e)
        e, f = errors
        slope["top"][:], slope["top_bias"][:] = h.T @ e, np.ones(n, "f4") @ e
        back = e @ self.part["top"].T
        for c in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[c], cuts[c + 1])
            slope["low"][c], slope["low_bias"][c] = h[own].T @ f[own], np.ones(cuts[c + 1] - cuts[c], "f4") @ f[own]
            back[own] += f[own] @ self.part["low"][c].T
        back *= 1 - h * h
        back /= n
        dense = slice(int(np.prod(self.shapes["embed"])), None)
        self._move(self.vector[dense], self.seen[dense], change[dense] / np.float32(n))
        # of the embeddings only those that occur
        size = self.shapes["embed"][1]
        seen = self.seen[: dense.start].reshape(self.shapes["embed"])
        for o in range(len(OFFSETS)):
            cell = context[:, o] % size
            order = np.argsort(cell.astype(np.uint16) if size <= 1 << 16 else cell, kind="stable")
            cell = cell[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            rows, slopes = cell[starts], np.add.reduceat(back[order], starts, axis=0)
            weights, squares = self.part["embed"][o][rows], seen[o][rows]
            self._move(weights, squares, slopes)
            self.part["embed"][o][rows], seen[o][rows] = weights, squares

    @staticmethod
    def _move(weights: np.ndarray, seen: np.ndarray, slope: np.ndarray) -> None:
        seen += slope * slope
        weights += np.float32(RATE) * slope / np.sqrt(seen)


def tokens(words: np.ndarray, known: W.Table, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, places in the vocabulary, -1 for words that it hasn't).  known: the place of each hash; place: the token of each."""
    at = known.get(words).astype(np.int64)
    if not len(place):
        return np.full(len(words), OTHER, np.int64), at
    return np.where(at >= 0, place[at], OTHER).astype(np.int64), at


def places(vocabulary: np.ndarray) -> W.Table:
    """The place of each hash."""
    return W.Table(vocabulary, np.arange(len(vocabulary)))


def contexts(own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The neighbours of every token."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(own) + REACH * (len(offsets) + 1), OUTSIDE, np.int64)
    spot = np.arange(len(own)) + REACH * (text + 1)
    padded[spot] = own
    return np.stack([padded[spot + o] for o in OFFSETS], axis=1)


def windows(words: np.ndarray, offsets: np.ndarray, vocabulary: W.Table, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of every token."""
    own, _ = tokens(words, vocabulary, place)
    return contexts(own, offsets), own


#: Bytes as they are spelled: lower case, and one white space.
_SPELLED = bytes(32 if b in W._SPACE.nonzero()[0] else W.LOWER[b] for b in range(256))


def spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, starts): each byte with the one before it, as one number, and where the words of W.hashes start."""
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(_SPELLED), np.uint8)
    pairs = data.astype(np.int32)
    pairs[1:] += data[:-1].astype(np.int32) << 8
    pairs[0] += 32 << 8
    first = data != 32
    first[1:] &= data[:-1] == 32
    return pairs, np.flatnonzero(first)


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the hash of every word of the table, and how often it occurs."""

    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for group in W.groups(x.as_py() for x in batch.column(0)):
                held.append(W.hashes(group)[0])
                size += len(held[-1])
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return df.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Words(tuple):
    """(hashes, tokens) of the vocabulary, and the logarithm of each word's share of its token."""

    share: np.ndarray


def classes_for(words: int) -> int:
    """Classes of the network for so many words, growing with their root."""
    return max(CLASSES, int(np.ceil(np.sqrt(words) / ROOT)))


def vocabulary(df: DataFrame, text: str = "text", least: int = LEAST) -> Words:
    """All words with so many places; a class has words of all frequencies."""
    got = counts(df, text).filter(F.col("n") >= least).toArrow()
    word, n = (got.column(c).to_numpy() for c in ("word", "n"))
    order = np.lexsort((word, -n))
    word, n = word[order].view(np.uint64), n[order]
    classes = classes_for(len(word))
    size = classes * CLASSES
    slot = np.arange(1, len(word) + 1)  # OTHER has the first
    if len(word) >= size:
        alone = size - 1 - size // 4
        through = np.cumsum(n[alone:])
        slot[alone:] = 1 + alone + (through - n[alone:]) * (size // 4) // through[-1]
    share = np.log(n / np.bincount(slot, n)[slot]) if len(n) else np.zeros(0)
    order = np.argsort(word)
    out = Words((word[order], ((slot % classes) * CLASSES + slot // classes)[order].astype(np.int32)))
    out.share = share[order].astype("f4")
    return out


def spelling(df: DataFrame, words: Words, text: str = "text") -> np.ndarray:
    """The log-probability of each byte after each other, as spelled() numbers them, from all words that the vocabulary hasn't."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(words[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = places(shared.value), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for group in W.groups(x.as_py() for x in batch.column(0)):
                hashed, _ = W.hashes(group)
                if not len(hashed):
                    continue
                pairs, starts = spelled(group)
                rare = known.get(hashed) < 0
                total += np.bincount(pairs[starts[0] :][np.repeat(rare, np.diff(np.append(starts, len(pairs))))], minlength=1 << 16)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    got = df.select(text).mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    n = np.ones(1 << 16)
    n[got.column("pair").to_numpy()] += got.column("n").to_numpy()
    n = n.reshape(256, 256)
    n[32, 32] = 0
    out = np.log(np.maximum(n, 1e-300) / n.sum(axis=1, keepdims=True))
    out[32, 32] = 0  # between words
    return out.ravel()


def shares(texts: list[bytes], at: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The log-probability of each word given its token: its share, or its spelling where the vocabulary hasn't it."""
    if not len(at):
        return np.zeros(0)
    out = share[at].astype("f8") if len(share) else np.zeros(len(at))
    rare = at < 0
    if rare.any():
        pairs, starts = spelled(texts)
        out[rare] = np.add.reduceat(table[pairs], starts)[rare]
    return out


def _batch(value: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["value", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0.0, 0
    for batch in batches:
        for value, seen in zip(batch.column(0), batch.column(1), strict=True):
            total, n = total + np.frombuffer(value.as_buffer(), "f8"), n + seen.as_py()
    if n:
        yield _batch(total, n)


def train(df: DataFrame, words: tuple[np.ndarray, np.ndarray], text: str = "text", rounds: int = ROUNDS) -> Network:
    """A network trained on all rows of df(doc_id, text)."""
    small_batches(df.sparkSession)
    net = Network(classes=classes_for(len(words[0])))
    for turn in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast((net.vector, *words))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, hashed, place = shared.value  # noqa: B023
            known, own, seen, around, targets = places(hashed), Network(start), 0, [], []

            def steps(last: bool) -> None:
                nonlocal seen
                if not around:
                    return
                context, target = np.concatenate(around), np.concatenate(targets)
                full = len(target) if last else len(target) // STEP * STEP
                for i in range(0, full, STEP):
                    own.learn(context[i : i + STEP], target[i : i + STEP])
                seen += full
                around[:], targets[:] = [context[full:]], [target[full:]]

            for batch in batches:
                for group in W.groups(x.as_py() for x in batch.column(0)):
                    context, target = windows(*W.hashes(group), known, place)
                    around.append(context)
                    targets.append(target)
                    if sum(map(len, targets)) >= 8 * STEP:
                        steps(False)
            steps(True)
            if seen:
                yield _batch(own.vector.astype("f8") * seen, seen)

        part = df.filter(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(rounds)) == turn).select(text)
        # one vector of each task; as many sums of some of them as there are vectors in one
        fitted = part.mapInArrow(fit, "value binary, n bigint")
        tasks = max(1, int(np.sqrt(fitted.rdd.getNumPartitions())))
        total, n = 0.0, 0
        for row in fitted.repartition(tasks).mapInArrow(_summed, "value binary, n bigint").toLocalIterator():
            total, n = total + np.frombuffer(row.value, "f8"), n + row.n
        if n:
            net = Network(total / n)
    return net


def score(df: DataFrame, words: Words, net: Network, text: str = "text", table: np.ndarray | None = None) -> DataFrame:
    """df with n_tokens, log_likelihood and mean_log_likelihood: of words, with the table of spelling(), or else of tokens alone."""
    names = ("n_tokens", "log_likelihood", "mean_log_likelihood")
    shared = df.sparkSession.sparkContext.broadcast((net.vector, *words, words.share, table))

    made: list = []  # once in a task

    @F.arrow_udf("n bigint, total double")
    def scored(column: pa.Array) -> pa.Array:
        vector, hashed, place, share, spells = shared.value
        if not made:
            made.extend((Network(vector), places(hashed)))
        (own, known), sizes, totals = made, [], []
        for group in W.groups(x.as_py() for x in column):
            words_, offsets = W.hashes(group)
            size = np.diff(offsets)
            target, at = tokens(words_, known, place)
            each = own.score(contexts(target, offsets), target)
            if spells is not None:
                each += shares(group, at, share, spells)
            sizes.append(size)
            totals.append(np.bincount(np.repeat(np.arange(len(group)), size), each, len(group)))
        sizes, totals = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, totals))
        return pa.StructArray.from_arrays([pa.array(sizes.astype(np.int64)), pa.array(totals)], ["n", "total"])

    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in names]
    out = df.select(*kept, scored(F.col(text)).alias("__s"))
    mean = F.when(F.col("__s.n") > 0, F.col("__s.total") / F.col("__s.n"))
    return out.select(*kept, F.col("__s.n").alias("n_tokens"), F.col("__s.total").alias("log_likelihood"), mean.alias("mean_log_likelihood"))
