"""N-gram Jaccard join by universe partition and pigeonhole, and its connected components.

A document's set holds the hashes of its n-word shingles.  Sets with the same content are one class; its smallest id
stands for it from then on, so copies cost nothing more.

Candidates.  Sizes are cut into bands.  Two sets of sizes a and b with Jaccard t or more differ in at most
H = (1 - t) / (1 + t) * (a + b) elements; below, H is that of a band's largest sets.  A band deals the universe of hashes
into m > H segments, so similar sets agree wholly in m - H of them at least.  A set's part in each segment is hashed, with
band and segment, into a signature.  Sets near a band's upper end sign in the next band too, where their larger partners
are.

Cost-based allocation.  A signature costs what its postings hold, and a set may leave its costliest m - H - 1 out: order
all signatures by their number of postings; sets that agree in m - H agree in one that neither has left out.  Costliest
are empty segments, in which half the corpus may agree, then segments with nothing but what many texts quote.

- Large bands have a quarter more segments than H + 1.  Empty segments are left out first, as far as they may be, and of
  the others those with ``COSTLY`` postings or more, the costliest first.
- Small bands, of fewer than ``LARGE`` segments, have H + 1, and none to leave out.  Empty segments are left out all the
  same, and what they would have found is found by one deletion elsewhere: suppose two sets agree in e segments, all
  empty.  The other H + 1 - e differ by H elements in all, so fewer than e of them differ by two or more; the others
  differ by one, and one side is the other without an element.  So a set with E empty segments goes through its segments
  in order until it has passed E that hold two elements or more, and signs each filled one passed once more, as it is
  and without each of its elements.  The shorter of two sets' passages holds a segment where this meets.  A set that
  has no E such segments passes all, and signs its empty segments too.

A sketch of each set says which cells of the universe hold an odd number of its elements.  Each element that one of two
sets has alone changes one cell, so sets whose sketches differ in more than H cells aren't similar.  A pair that fails
this goes no further: it isn't even a row of the join that would have made it.  ``CELLS`` cells tell smaller sets apart;
larger ones have a second sketch with a cell for each element, which is looked at once pairs are distinct.

Verification is exact, on whole sets.  Pairs are never listed for whole groups: first all sets of a signature are
compared with the smallest id of it, and links are joined into components; then, in signatures whose sets are still in
several components, with the largest id; only pairs that are then still in different components, and were not compared
before, are compared one by one.  Pairs within a component need no comparison, as they change nothing.

Components are found by alternating large-star and small-star steps on tables in the shared folder.

Defined results: words are runs of characters other than space and tab to carriage return, A-Z in lower case; fewer words
than n make one shingle; a null text and one without words have an empty set, and link with nothing; a row that repeats an
id gets the component of its own set; a null id is never linked; an empty table gives an empty result; other columns are
not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import small_batches, stored

#: Ratio of a band's largest size to its smallest.
BAND = Fraction(5, 4)
#: Segments of the smallest large band, and postings of a signature that may be left out.
LARGE, COSTLY = 12, 2
#: Cells of a sketch, in 64-bit words of 64.
CELLS = 1024
#: Ids up to which a list of them is broadcast.
FEW = 2_000_000


class Bands:
    """Size bands, and the number of segments of each, for Jaccard >= threshold (a fraction)."""

    def __init__(self, threshold: Fraction, most: int = 1 << 31):
        self.threshold = threshold
        lows, low = [], 1
        while low <= most:
            lows.append(low)
            low = max(low + 1, int(low * BAND))
        self.lows = np.asarray([*lows, low], np.int64)
        last = self.lows[1:] - 1
        enough = np.asarray([int((1 - threshold) / (1 + threshold) * 2 * int(x)) + 1 for x in last], np.int64)
        self.segments = np.where(enough >= LARGE, enough + enough // 4, enough)
        self.spare = self.segments - enough  # how many signatures a set may leave out

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def reaches_next(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a set this large may be similar to one of the next band."""
        return sizes * self.threshold.denominator // self.threshold.numerator >= self.lows[band + 1]


def sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's set of shingles."""
    hashed, offsets = W.hashes(texts)
    return W.distinct(*W.runs(hashed, offsets, n))


def signatures(values: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, slots, sets): what each set signs, and a slot for each, the band times 2 ** 32 and how many more the set may leave out there."""
    sizes = np.diff(offsets)
    band = bands.of(np.maximum(sizes, 1))
    out: list[np.ndarray] = []
    of: list[np.ndarray] = []
    slots: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for up in (0, 1):
            take = (sizes > 0) & (True if not up else bands.reaches_next(sizes, band))
            rows = np.flatnonzero(take)
            if not len(rows):
                continue
            at_band = band[rows] + up
            m = bands.segments[at_band]
            first = np.concatenate([[0], np.cumsum(m)])
            inside = np.repeat(take, sizes)
            x, local = values[inside], np.repeat(np.arange(len(rows)), sizes[rows])
            segment = ((W.mix(x ^ np.uint64(0xA5A5A5A5)) >> np.uint64(33)).astype(np.int64) * m[local]) >> 31
            cell = first[local] + segment
            part = W.mix(x + np.uint64(0x632BE59BD9B4E019))
            total, count = np.zeros(first[-1], np.uint64), np.bincount(cell, minlength=first[-1])
            order = np.argsort(cell, kind="stable")
            filled = np.flatnonzero(count)
            total[filled] = np.add.reduceat(part[order], np.concatenate([[0], np.cumsum(count[filled])])[:-1])
            row_of = np.repeat(np.arange(len(rows)), m)
            seed = W.mix((at_band[row_of].astype(np.uint64) << np.uint64(32)) + (np.arange(first[-1]) - first[row_of]).astype(np.uint64))

            def running(flag: np.ndarray) -> np.ndarray:
                """How many of a set's segments up to and with each are flagged."""
                through = np.cumsum(flag)
                return through - np.repeat(through[first[1:] - 1] - np.bincount(row_of[flag], minlength=len(rows)), m)  # noqa: B023

            empties = np.bincount(row_of[count == 0], minlength=len(rows))
            spare = bands.spare[at_band]
            small = (spare == 0)[row_of]
            passed = running(count >= 2)
            short = small & (passed[first[1:] - 1] < empties)[row_of]
            # in a large band, the first empty segments are signed where there are more than may be left out
            over = ~small & (count == 0) & (running(count == 0) <= (empties - spare)[row_of])
            signed = (count > 0) | short | over
            slot = (at_band << 32) + np.maximum(spare - empties, 0)
            out.append(W.mix(total[signed] + seed[signed]))
            of.append(rows[row_of[signed]])
            slots.append(slot[row_of[signed]])
            ahead = small & (passed - (count >= 2) < empties[row_of])  # fewer than E were passed before this segment
            if ahead.any():
                c = cell[ahead[cell]]
                whole = np.flatnonzero(ahead & (count > 0))
                for made, where in ((total[c] - part[ahead[cell]], c), (total[whole], whole)):
                    out.append(W.mix(made + W.mix(seed[where] + np.uint64(1))))
                    of.append(rows[row_of[where]])
                    slots.append(slot[row_of[where]])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(slots), np.concatenate(of)


def sketches(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(small, large): each set's sketches, in 64-bit numbers; the large one is empty for a set of no more than CELLS / 2 elements."""
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = (W.mix(values ^ np.uint64(0x5C5C5C5C)) >> np.uint64(32)).astype(np.int64)
    odd = np.bincount(of * CELLS + place % CELLS, minlength=len(sizes) * CELLS) & 1
    small = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view(np.int64).reshape(-1, CELLS // 64)
    large = [np.zeros(0, np.int64)] * len(sizes)
    for i in np.flatnonzero(sizes > CELLS // 2):
        cells = max(2 * CELLS, 1 << int(sizes[i] - 1).bit_length())  # a power of two: halves fold onto each other
        odd = np.bincount(place[offsets[i] : offsets[i + 1]] % cells, minlength=cells) & 1
        large[i] = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view(np.int64).ravel()
    return small, large


def sketched(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, large) of each row; digest is null for an empty set."""

    @F.arrow_udf("n bigint, digest binary, sketch array<bigint>, large array<bigint>")
    def made(column: pa.Array) -> pa.Array:
        counts, digests, odd, large = [np.zeros(0, np.int64)], [], [np.zeros((0, CELLS // 64), np.int64)], []
        for group in W.groups(x.as_py() for x in column):
            values, offsets = sets(group, n)
            counts.append(np.diff(offsets))
            small, more = sketches(values, offsets)
            odd.append(small)
            large += more
            digests += [hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        cells = np.concatenate(odd)
        sketch = pa.ListArray.from_arrays(pa.array((np.arange(len(cells) + 1) * (CELLS // 64)).astype("int32")), pa.array(cells.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(digests, pa.binary()), sketch, pa.array(large, pa.list_(pa.int64()))], ["n", "digest", "sketch", "large"])

    out = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), made(F.col(text)).alias("s"))
    return out.select("doc_id", F.col("s.n").alias("n_shingles"), F.col("s.digest").alias("digest"), F.col("s.sketch").alias("sketch"), F.col("s.large").alias("large"))


def signed(df: DataFrame, n: int, threshold: Fraction, text: str = "text") -> DataFrame:
    """(rep, signature, slot) of each row's signatures."""
    bands = Bands(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id").to_numpy(zero_copy_only=False), 0
            for group in W.groups(x.as_py() for x in batch.column("text")):
                found, slots, of = signatures(*sets(group, n), bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(group)][of]), pa.array(found.view(np.int64)), pa.array(slots)], names=["rep", "signature", "slot"])
                at += len(group)

    return df.select("doc_id", F.col(text).alias("text")).mapInArrow(sign, "rep bigint, signature bigint, slot bigint")


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df's rows whose doc_id is in the stored table ids(doc_id), which is broadcast only where it is counted to be small."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")


def near(one: Column, two: Column, threshold: Fraction) -> Column:
    """Whether sketches (struct of n and s) leave room for two sets to be similar."""
    up, down = threshold.numerator, threshold.denominator
    differ = sum((F.bit_count(one["s"][i].bitwiseXOR(two["s"][i])) for i in range(1, CELLS // 64)), F.bit_count(one["s"][0].bitwiseXOR(two["s"][0])))
    sizes = one["n"] + two["n"]
    small, large = F.least(one["n"], two["n"]), F.greatest(one["n"], two["n"])
    return (small * down >= large * up) & (differ * (down + up) <= sizes * (down - up))


def near_large(one: Column, two: Column, threshold: Fraction) -> Column:
    """The same by the large sketches (struct of n and l), where both have one."""
    up, down = threshold.numerator, threshold.denominator
    folded = lambda x, size: F.when(F.size(x) <= size, x).otherwise(F.transform(F.slice(x, 1, size), lambda v, i: v.bitwiseXOR(F.get(x, i + size))))
    size = F.least(F.size(one["l"]), F.size(two["l"]))
    # of sets that may be similar, one sketch is at most twice the other
    each = F.zip_with(folded(one["l"], size), folded(two["l"], size), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(each, F.lit(0), lambda total, x: total + x)
    return (size == 0) | (differ * (down + up) <= (one["n"] + two["n"]) * (down - up))


def plausible(pairs: DataFrame, sketch: DataFrame, threshold: Fraction) -> DataFrame:
    """Of (a, b), those whose sketches are near.  sketch: (doc_id, k, large), of which only those in pairs are moved."""
    pairs = stored(pairs)
    one, two = (
        among(sketch, stored(pairs.select(F.col(c).alias("doc_id")).distinct())).select(F.col("doc_id").alias(c), F.col("k").alias(f"k{c}"), F.struct(F.col("k.n").alias("n"), F.col("large").alias("l")).alias(f"l{c}"))
        for c in "ab"
    )
    met = pairs.join(one, "a").join(two, "b").filter(near(F.col("ka"), F.col("kb"), threshold))
    return met.filter(near_large(F.col("la"), F.col("lb"), threshold)).select("a", "b")


def linked(pairs: DataFrame, documents: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Of the stored (a, b), those whose texts' sets are similar.  documents: (doc_id, text), of which only those in pairs are moved."""
    up, down = threshold.numerator, threshold.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("ta"), batch.column("tb")
            for start in range(0, len(left), 256):
                one, two = left.slice(start, 256).to_pylist(), right.slice(start, 256).to_pylist()
                unique = {t: i for i, t in enumerate(dict.fromkeys(one + two))}
                values, offsets = [], [0]
                for group in W.groups(unique):
                    v, o = sets(group, n)
                    values.append(v)
                    offsets += (o[1:] + offsets[-1]).tolist()
                values = np.concatenate(values)
                for a, b in zip(one, two, strict=True):
                    i, j = unique[a], unique[b]
                    x, y = values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(down * common >= up * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (among(documents, stored(pairs.select(F.col(c).alias("doc_id")).distinct())).select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b): the smallest id that can be reached."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large star: larger neighbours are linked to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the node and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == state:
            break
        state = after
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _labelled(members: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """members(signature, rep, first) with each rep's component and the signature's last rep, in signatures of ``least`` sets or more that still have several components."""
    named = members.join(found, members["rep"] == found["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    spread = named.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("sets"))
    return named.join(spread.filter((F.col("x") < F.col("y")) & (F.col("sets") >= least)).select("signature", "last"), "signature")


def _allotted(members: DataFrame) -> DataFrame:
    """members(signature, rep, slot, first, postings) without what each set leaves out, and with first as it is then."""
    costly = members.filter(F.col("postings") >= COSTLY)
    place = F.row_number().over(Window.partitionBy("rep", "slot").orderBy(F.desc("postings"), F.desc("signature")))
    kept = stored(costly.withColumn("place", place).filter(F.col("place") > F.col("slot").bitwiseAND(F.lit(0xFFFFFFFF))).select("signature", "rep"))
    again = kept.groupBy("signature").agg(F.min("rep").alias("first"), F.max("rep").alias("__last")).filter("first < __last").drop("__last")
    cheap = members.filter(F.col("postings") < COSTLY).select("signature", "rep", "first")
    return stored(cheap.unionByName(kept.join(again, "signature").select("signature", "rep", "first")))


def join(df: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row of df(doc_id, text).

    class_id is the smallest id with the same set, component_id the smallest that can be reached by links.
    """
    small_batches(df.sparkSession)
    documents = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(sketched(documents, n))
    usable = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    kinds = F.first(F.struct(F.col("n_shingles").alias("n"), F.col("sketch").alias("s")))
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), kinds.alias("k"), F.first("large").alias("large")))
    reps = stored(classes.select(F.col("rep").alias("doc_id")).distinct())
    each = signed(among(documents, reps), n, threshold).repartition("signature")
    shared = each.groupBy("signature").agg(F.min("rep").alias("first"), F.max("rep").alias("__last"), F.count(F.lit(1)).alias("postings"), F.min("slot").alias("__slot"))
    # slots are never negative; to ask keeps the column in, so that both sides below read one shuffle
    shared = shared.filter("first < __last AND __slot >= 0").drop("__last", "__slot")
    members = _allotted(stored(each.join(shared, "signature")))
    sketch = classes.select(F.col("rep").alias("doc_id"), "k", "large")
    pairs = stored(plausible(members.filter("first < rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), sketch, threshold))
    links = stored(linked(pairs, documents, n, threshold))
    found = stored(components(links))
    # compare with the largest id where components still differ
    left = stored(_labelled(members, found, 3))
    name = F.col("component")
    last = left.filter("rep = last").select("signature", F.col("component").alias("last_component")).distinct()
    again = left.join(last, "signature").filter((name != F.col("last_component")) & (F.col("rep") != F.col("last")))
    again = again.select(F.col("rep").alias("a"), F.col("last").alias("b")).distinct()
    again = stored(plausible(again, sketch, threshold).join(pairs, ["a", "b"], "left_anti"))
    if again.take(1):
        links = links.unionByName(linked(again, documents, n, threshold))
        found = stored(components(links))
    # and one by one, where they differ even then
    left = _labelled(members, found, 4).filter((F.col("rep") != F.col("first")) & (F.col("rep") != F.col("last")))
    left = stored(left.join(sketch.select(F.col("doc_id").alias("rep"), "k"), "rep").select("signature", "rep", "component", "k"))
    one = left.select("signature", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("k").alias("ka"))
    two = left.select("signature", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("k").alias("kb"))
    open_ = (one["signature"] == two["signature"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near(F.col("ka"), F.col("kb"), threshold)
    rest = plausible(one.join(two, open_).select("a", "b").distinct(), sketch, threshold)
    rest = stored(rest.join(pairs.unionByName(again), ["a", "b"], "left_anti"))
    if rest.take(1):
        links = links.unionByName(linked(rest, documents, n, threshold))
        found = stored(components(links))
    by_class = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    by_class = by_class.withColumnRenamed("digest", "__digest")
    out = rows.select("doc_id", "n_shingles", "digest").join(by_class, (F.col("digest") == F.col("__digest")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
