"""SpotSigs document fingerprints.

An anchor is a very common word.  Anchors are learned: of the documents that hold words of a script (Latin, Cyrillic,
Arabic, ...), each word that ``SHARE`` of them hold is one.  A script of fewer than ``LEAST_DOCS`` documents teaches none;
there, and beside the learned ones, common words of four languages serve.  To count exactly, two passes are made: a word
that is common in the table is common in the rows of some task, so that the second pass counts only words that were
common in one.

The chain of the ``chain`` content words (words that aren't anchors) that follow an anchor is a spot signature, and a
document's fingerprint is the set of its signatures: running text with function words makes many, lists and navigation
few.  The document's start counts as an anchor too; a text without content words has all its words as its one signature; an
empty text has none.  Stretches without anchors (tables, codes) are covered too: of every ``GAP`` content words in a row
where no signature starts, the chain at the word with the smallest hash is one more, whatever stands before it.  A
fingerprint's string is that whole set, 32 bits to a signature, ascending, in base 64.

Likeness of two fingerprints is the Jaccard of their sets, 1 where both are empty.  :func:`similar` finds all pairs of
different fingerprints at or above a threshold: sets are dealt out by bands of their length such that only equal and
neighbouring bands can reach the threshold, within a band by their rarest signatures (a prefix long enough that similar
sets share one), and a comparison ends where the lengths rule the threshold out.

:func:`against_next` compares each document with the one of the next id, without sorting the table in one place: the table
is cut into ranges of (id, hash of text), each range's first row is sent to the range before it too, and each range is read
as a stream in order.  So a null or repeated id that many documents have is many ranges; only rows that are equal in id
and text are always one.

Defined results: a null text is empty; a null id sorts first; rows that repeat an id follow by the hash of their text; the
last document's next is the first, a lone one's is itself; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import small_batches, stored

CHAIN = 2
#: Content words in a row without a signature, at most.
GAP = 16
#: A word that this part of the documents of its script hold is an anchor, if there are so many documents.
SHARE, LEAST_DOCS = 1 / 16, 64
#: Scripts by the first byte of a word: from which byte on each starts.
_SCRIPTS = np.asarray([0x00, 0xCD, 0xD0, 0xD6, 0xD8, 0xE0, 0xE1, 0xE3, 0xEA, 0xF0])
#: The common words of English, German, French and Spanish that serve as anchors.
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was with
das dem den der des die ein eine für im in ist mit nicht sich und von zu auf auch
au aux avec dans de des du elle en est et il la le les par pas pour que qui sur un une
con de del el en es la las lo los no para por que se su un una y
""".split()
_ANCHORS = np.unique(W.hashes([" ".join(ANCHORS).encode("utf-8")], W.LETTERS)[0] & ~np.uint64(15))


def _per_document(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(script and word of each document's distinct words, those of every script that it holds with word 0), as two arrays."""
    for group in W.groups(texts):
        hashed, offsets = W.hashes(group, W.LETTERS)
        script = np.searchsorted(_SCRIPTS, W.leading(group, W.LETTERS), "right").astype(np.uint64) - np.uint64(1)
        # a word of one script has one hash: the script takes the last bits
        word = (hashed & ~np.uint64(15)) | script
        yield W.distinct(word, offsets)[0], W.distinct(script, offsets)[0]


def learn(df: DataFrame, text: str = "text", share: float = SHARE, least_docs: int = LEAST_DOCS) -> np.ndarray:
    """The hashes of all anchors but for their last four bits, ascending: the fixed ones and those of the table."""
    small_batches(df.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(word, script, n): of the words in known, or else of those common here; and of each script, as word null."""
        held, scripts = [], np.zeros(16, np.int64)
        total, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold() -> None:
            nonlocal total, counts
            joined, which = np.unique(np.concatenate([total, *held]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([counts, np.ones(len(which) - len(counts))]), len(joined)).astype(np.int64)
            total = joined
            held.clear()

        size = 0
        for batch in batches:
            for words, of in _per_document(x.as_py() for x in batch.column(0)):
                held.append(words if known is None else words[np.isin(words, known)])
                scripts += np.bincount(of.astype(np.int64), minlength=16)
                size += len(held[-1])
                if size > 2_000_000:
                    fold()
                    size = 0
        fold()
        if known is None:
            keep = counts >= share * scripts[(total & np.uint64(15)).astype(np.int64)]
            total, counts = total[keep], counts[keep]
        there = np.flatnonzero(scripts)
        word = pa.concat_arrays([pa.array(total.view(np.int64)), pa.nulls(len(there), pa.int64())])
        script = np.concatenate([(total & np.uint64(15)).astype(np.int32), there.astype(np.int32)])
        yield pa.RecordBatch.from_arrays([word, pa.array(script), pa.array(np.concatenate([counts, scripts[there]]))], names=["word", "script", "n"])

    schema = "word bigint, script int, n bigint"
    rows = df.select(text)
    common = rows.mapInArrow(lambda b: counted(b, None), schema).filter("word IS NOT NULL").select("word").distinct().toArrow()
    shared = df.sparkSession.sparkContext.broadcast(np.sort(common.column("word").to_numpy().view(np.uint64)))
    summed = stored(rows.mapInArrow(lambda b: counted(b, shared.value), schema).groupBy("word", "script").agg(F.sum("n").alias("n")))
    docs = summed.filter("word IS NULL").select("script", F.col("n").alias("docs"))  # a row for each script
    found = summed.filter("word IS NOT NULL").join(F.broadcast(docs), "script").filter((F.col("n") >= F.col("docs") * share) & (F.col("docs") >= least_docs)).select("word").toArrow()
    return np.unique(np.concatenate([_ANCHORS, found.column("word").to_numpy().view(np.uint64) & ~np.uint64(15)]))


def signatures(texts: list[bytes], chain: int = CHAIN, gap: int = 0, anchors: np.ndarray = _ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, offsets): each text's set of spot signatures as ascending 32-bit numbers, and with gap those that fill gaps."""
    hashed, offsets = W.hashes(texts, W.LETTERS)
    anchor = np.isin(hashed & ~np.uint64(15), anchors)
    content = np.flatnonzero(~anchor)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    # the content word that follows: after an anchor, or at a text's start
    opens = np.zeros(len(hashed), bool)
    starts = offsets[:-1][np.diff(offsets) > 0]
    opens[starts] = True
    opens[1:] |= anchor[:-1]
    if not len(content):
        at = np.zeros(0, np.int64)
    else:
        # only the first of a row of content words follows an anchor; rows of anchors lead to the same chain
        first = content[opens[content]]
        extra = np.searchsorted(content, starts[anchor[starts]]) if len(starts) else np.zeros(0, np.int64)
        at = np.unique(np.concatenate([np.searchsorted(content, first), extra[extra < len(content)]]))
    if gap and len(content) >= gap:
        spots = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(content)))])
        of = text_of[content]
        bare = np.flatnonzero((spots[gap:] == spots[:-gap]) & (of[gap - 1 :] == of[: len(of) - gap + 1]))
        at = np.unique(np.concatenate([at, bare + hashed[content[bare[:, None] + np.arange(gap)]].argmin(axis=1)]))
    if len(at):
        links = np.minimum(at[:, None] + np.arange(chain), len(content) - 1)
        words = content[links]
        same = (text_of[words] == text_of[words[:, :1]]) & (at[:, None] + np.arange(chain) < len(content))
        values = np.where(same, hashed[words], np.uint64(0))
        with np.errstate(over="ignore"):
            made = np.zeros(len(at), np.uint64)
            for j in range(chain):
                made = W.mix(made + values[:, j] * np.uint64(2 * j + 3))
        of = text_of[words[:, 0]]
    else:
        made, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # texts of anchors alone: all their words as one
    bare = np.setdiff1d(np.unique(text_of), np.unique(of))
    if len(bare):
        rest = [hashlib.blake2b(hashed[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest() for i in bare]
        made, of = np.concatenate([made, np.frombuffer(b"".join(rest), np.uint64)]), np.concatenate([of, bare])
        order = np.argsort(of, kind="stable")
        made, of = made[order], of[order]
    return W.distinct(made >> np.uint64(32), np.searchsorted(of, np.arange(len(texts) + 1)))


def packed(one: np.ndarray) -> str:
    return base64.b64encode(one.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sets, or 0 at once where their lengths keep it below ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or Fraction(small, large) < Fraction(str(least)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (small + large - common)


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", chain: int = CHAIN, anchors: np.ndarray = _ANCHORS) -> DataFrame:
    """df with its texts' fingerprints."""
    shared = df.sparkSession.sparkContext.broadcast(anchors)

    @F.arrow_udf("string")
    def made(column: pa.Array) -> pa.Array:
        out = []
        for group in W.groups(x.as_py() for x in column):
            values, offsets = signatures(group, chain, GAP, shared.value)
            out += [packed(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.array(out, pa.string())

    return df.withColumn(name, made(F.col(text)))


def similar(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all pairs a < b of fingerprints (doc_id, fingerprint) that differ, at or above least.

    Documents with one fingerprint are one class, and the smallest of their ids stands for it: copies aren't put in pairs.
    Empty sets pair with nothing.  Prefixes and lengths are compared in whole numbers.
    """
    part = Fraction(str(least))
    num, den = F.lit(part.numerator).cast("bigint"), F.lit(part.denominator).cast("bigint")

    @F.arrow_udf("array<bigint>")
    def values(column: pa.Array) -> pa.Array:
        return pa.array([unpacked(x.as_py()).astype("int64") for x in column], pa.list_(pa.int64()))

    @F.arrow_udf("double")
    def compared(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = unpacked(x.as_py()), unpacked(y.as_py())
            common = len(np.intersect1d(a, b, assume_unique=True))
            either = len(a) + len(b) - common
            out.append(common / either if common * part.denominator >= part.numerator * either else None)
        return pa.array(out, pa.float64())

    classes = stored(prints.filter("doc_id IS NOT NULL AND fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    sets = classes.select("doc_id", values(F.col("fingerprint")).alias("v")).withColumn("n", F.size("v").cast("bigint"))
    # a little wider than the threshold, so that rounding never puts two that reach it two bands apart
    width = -math.log(least) * (1 + 1e-9) if least < 1 else 1e-9
    sets = sets.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("bigint"))
    each = sets.select("doc_id", "n", "band", F.explode("v").alias("s"))
    frequency = each.groupBy("s").agg(F.count("*").alias("df"))
    prefix = F.col("n") - F.call_function("div", F.col("n") * num + den - 1, den) + 1
    order = Window.partitionBy("doc_id").orderBy("df", "s")
    rare = each.join(frequency, "s").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= prefix)
    # stored, so that the join deals both sides anew and can split a signature with many sets
    keyed = stored(rare.select("s", "doc_id", "n", F.explode(F.array("band", F.col("band") + 1)).alias("at")))
    left, right = keyed.alias("l"), keyed.alias("r").hint("merge")
    near = (F.col("l.n") * den >= F.col("r.n") * num) & (F.col("r.n") * den >= F.col("l.n") * num)
    pairs = left.join(right, (F.col("l.s") == F.col("r.s")) & (F.col("l.at") == F.col("r.at")) & (F.col("l.doc_id") < F.col("r.doc_id")) & near)
    pairs = pairs.select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    one = classes.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("fa"))
    two = classes.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("fb"))
    out = pairs.join(one, "a").join(two, "b").select("a", "b", compared(F.col("fa"), F.col("fb")).alias("likeness"))
    return out.filter("likeness IS NOT NULL")


def edited(text: str, following: str) -> str:
    """text with its last half (of code points, rounded down) replaced by the first as many of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(pairs: Iterator[tuple[int | None, str, str]], chain: int, anchors: np.ndarray) -> Iterator[tuple]:
    """Of (id, text, next text): a row of the comparison."""
    held: list[tuple[int | None, str, str]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        changed = [edited(t, f) for _, t, f in held]
        texts = [x.encode("utf-8") for _, t, f in held for x in (t, f)]
        data = [c.encode("utf-8") for c in changed]
        unique = list(dict.fromkeys(texts + data))  # the next text of one is mostly the text of the one after it
        place = {t: i for i, t in enumerate(unique)}
        values, offsets = signatures(unique, chain, GAP, anchors)
        values = values.astype("<u4")
        get = lambda t: values[offsets[(i := place[t])] : offsets[i + 1]]
        for k, (doc_id, t, _) in enumerate(held):
            own, then, new = get(texts[2 * k]), get(texts[2 * k + 1]), get(data[k])
            yield doc_id, len(t), hashlib.sha256(data[k]).hexdigest(), packed(own), packed(new), likeness(own, new), likeness(own, then)

    for row in pairs:
        held.append(row)
        size += len(row[1]) + len(row[2])
        if size >= 1 << 20:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def against_next(df: DataFrame, text: str = "text", chain: int = CHAIN, anchors: np.ndarray | None = None) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's, as in SCHEMA; anchors from the table unless given."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(learn(df, text) if anchors is None else anchors)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_ = F.col("doc_id").cast("bigint")
    rows = df.select(id_.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    ranges = rows.select("at", "h").repartitionByRange(parts, "at", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("at", "h")).alias("head")).collect()
    heads = sorted({(r.head["at"], r.head.h) for r in ranges})  # one to a range
    if not heads:
        return spark.createDataFrame([], SCHEMA)

    @F.arrow_udf("array<struct<part: int, ends: int>>")
    def goes(at: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for key in zip(at.to_pylist(), h.to_pylist(), strict=True):
            own = max(0, bisect_right(heads, key) - 1)
            to = [{"part": own, "ends": 0}]
            if key == heads[own]:  # a range's first row goes to the range before too, where it only ends the stream
                to.append({"part": (own - 1) % len(heads), "ends": 1})
            out.append(to)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("ends", pa.int32())])))

    sent = rows.withColumn("to", F.explode(goes("at", "h"))).select("doc_id", "text", "at", "h", "to.part", "to.ends")
    dealt = sent.repartitionById(len(heads), F.col("part")).sortWithinPartitions("part", "ends", "at", "h")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        last, over = None, False
        for batch in batches:
            for doc_id, t, ends in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ends").to_pylist(), strict=True):
                # rows equal to a range's first all end the range before: one of them is enough
                if ends and over:
                    continue
                t, over = t.as_py(), bool(ends)
                if last is not None:
                    yield (*last, t)
                last = None if ends else (doc_id, t)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in _compared(stream(batches), chain, shared.value):
            out.append(row)
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return dealt.mapInArrow(compare, SCHEMA)
