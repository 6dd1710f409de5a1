"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document's lines (split at line feeds, compared without white space at either end, blank ones passed over) are hashed.
A window is the smallest group of lines in a row, counted from its first line on, that holds ``least_words`` words.

1. Of every window the line with the smallest hash is a fingerprint.  Two documents that share a run of lines with
   ``least_words`` words share a window in it, and so a fingerprint at the same line: each such run is found.  Only
   fingerprints are stored: hash, place, the lines within ``least_words`` words of it on either side, and for each window
   that chose it a digest, counted forwards from the window's first line and backwards from its last.
2. Fingerprints are joined on their hash with the places where it occurs; those found at one place only go.
3. The places of a fingerprint are told apart by the digests of its windows, and each is joined with the first place of
   an equal one.  From such a pair of places the match is extended line by line, backwards and forwards, as far as the
   lines of both are equal (two hashes of each line and its words).  Digests only propose: a match counts if the lines
   that were compared hold ``least_words`` words.
4. The later place's lines of each match are deleted.  The first place of each run stays.

A repeated run of lines is the union of its windows forwards and backwards, each of which has its own first place, so
the matches of its fingerprints cover it to its last line.

Places are ordered by document id, then line.  A passage that a third of all documents hold costs one row for each of its
places: it is compared with its first place, never with all others.

Defined results: a null text stays null and counts as no lines; null ids come first; rows equal in id and text are one
document and keep the same lines; a run that repeats within its document, even overlapping itself, loses the later part;
texts without a deleted line are unchanged to the byte; an empty table gives an empty result; columns that clash with
those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, stored

#: Words of the shortest run of lines that is deleted where it repeats.
LEAST_WORDS = 50
#: Deleted ranges up to which their table is broadcast, 16 bytes each beside an id.
FEW = 500_000
ADDED = ("n_lines", "n_removed")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line that isn't blank: document (id and hash of text), line's number, its hashes and words.  Together by document."""
    each = df.select("doc_id", F.xxhash64(text).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "value"))
    words, body = F.regexp_count("value", F.lit(WORD)).cast("bigint"), F.btrim("value", F.lit(SPACES))
    each = each.select("doc_id", "doc", "line", F.xxhash64(body).alias("h"), F.xxhash64(body, F.lit(1)).alias("k"), words.alias("n")).filter("n > 0")
    return each.repartition("doc_id", "doc").dropDuplicates(["doc_id", "doc", "line"])


def fingerprints(each: DataFrame, least_words: int) -> DataFrame:
    """Of lines() those that are the smallest of a window: back and ahead, the lines around, and windows, digests of those that chose it."""
    document = Window.partitionBy("doc_id", "doc")
    through = F.sum("n").over(document.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("through", through).withColumn("before", F.col("through") - F.col("n")).withColumn("own", F.struct("line", "h", "k", "n"))
    digest = lambda own: F.xxhash64(F.transform(own, lambda x: x["h"]))
    chosen = lambda found: F.transform(F.filter(found, lambda x: x["f"] == F.col("line")), lambda x: x["w"])

    # forwards from each line: its window, and at each line the windows that chose it
    order = document.orderBy("before")
    ahead = order.rangeBetween(Window.currentRow, least_words - 1)
    each = each.withColumns({"on": F.collect_list("own").over(ahead), "end": F.max("through").over(ahead), "f": F.min(F.struct("h", "line")).over(ahead)["line"]})
    each = each.withColumn("f", F.when(F.col("end") - F.col("before") >= least_words, F.col("f"))).withColumn("w", F.struct("f", digest("on").alias("w")))
    picked = F.collect_list(F.when(F.col("f").isNotNull(), F.col("w"))).over(order.rangeBetween(-(least_words - 1), Window.currentRow))
    each = each.withColumns({"ahead": F.lead("on").over(order), "forwards": picked}).withColumn("forwards", chosen("forwards")).drop("on", "end", "w")

    # backwards: such a window holds the one that starts at its first line, and goes with the line that this one chose
    order = document.orderBy("through")
    behind = order.rangeBetween(-(least_words - 1), Window.currentRow)
    each = each.withColumns({"on": F.collect_list("own").over(behind), "start": F.min("before").over(behind), "g": F.first(F.struct("f")).over(behind)["f"]})
    each = each.withColumn("g", F.when(F.col("through") - F.col("start") >= least_words, F.col("g"))).withColumn("w", F.struct(F.col("g").alias("f"), digest("on").alias("w")))
    picked = F.collect_list(F.when(F.col("g").isNotNull(), F.col("w"))).over(order.rangeBetween(Window.currentRow, least_words - 1))
    each = each.withColumns({"back": F.lag("on").over(order), "backwards": picked}).withColumn("backwards", chosen("backwards"))

    windows = F.concat(F.transform("forwards", lambda w: F.struct(F.lit(0).alias("way"), w.alias("w"))), F.transform("backwards", lambda w: F.struct(F.lit(1).alias("way"), w.alias("w"))))
    none = F.array().cast("array<struct<line:int,h:bigint,k:bigint,n:bigint>>")
    around = (F.coalesce(F.reverse("back"), none).alias("back"), F.coalesce("ahead", none).alias("ahead"))
    return each.filter(F.size("forwards") > 0).select("h", F.struct("doc_id", "doc", "line").alias("place"), "k", "n", *around, windows.alias("windows"))


def _several(rows: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """Keys with more than one place, and the first.  Pre-aggregated: no group comes together in a task.

    Stored, so that a join with it deals both sides anew and can split a key with many places over tasks.
    """
    found = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(first).alias("__first"), F.max("place").alias("__last")).filter("__first.place < __last").drop("__last")
    return stored(found).hint("merge")


def _agree(a: Column, b: Column) -> Column:
    """How many of two lists' first lines are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["k"] == y["k"]) & (x["n"] == y["n"]), F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def _words(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])


def matches(places: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, doc, start, stop): runs of lines that repeat, at a later place, from the fingerprints of the table."""
    found = places.join(_several(places.select("h", "place"), ["h"], F.struct("place")).drop("__first"), F.col("h") == F.col("__h"), "left_semi")
    found = found.select("h", "place", "k", "n", "back", "ahead", F.explode("windows").alias("window")).withColumns({"way": F.col("window.way"), "w": F.col("window.w")}).drop("window")
    keys, first = ["h", "way", "w"], F.struct("place", "k", "n", "back", "ahead")
    pairs = found.join(_several(found, keys, first), [F.col(k) == F.col(f"__{k}") for k in keys])
    # line by line from the matched places, both ways
    pairs = pairs.filter("place > __first.place AND k = __first.k AND n = __first.n")
    pairs = pairs.select("place", "n", "back", "ahead", _agree(F.col("back"), F.col("__first.back")).alias("up"), _agree(F.col("ahead"), F.col("__first.ahead")).alias("down"))
    pairs = pairs.filter(F.col("n") + _words(F.slice("back", F.lit(1), F.col("up"))) + _words(F.slice("ahead", F.lit(1), F.col("down"))) >= least_words)
    end = lambda own, n: F.coalesce(F.get(own, F.col(n) - 1)["line"], F.col("place.line"))
    return pairs.select("place.doc_id", "place.doc", end("back", "up").alias("start"), end("ahead", "down").alias("stop"))


def deleted(df: DataFrame, least_words: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """(doc_id, doc, gone): for each document that loses lines, the ranges of their numbers, ascending and apart."""
    places = stored(fingerprints(lines(df, text), least_words))
    spans = matches(places, least_words).repartition("doc_id", "doc")
    # spans that touch become one
    ordered = Window.partitionBy("doc_id", "doc").orderBy("start", "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy("doc_id", "doc", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("doc_id", "doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))


def _full(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def dedup_lines(df: DataFrame, least_words: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """df with its texts cut, and n_lines and n_removed: lines that are not blank, before and deleted."""
    kept = [c for c in df.columns if c not in ADDED]
    gone = stored(deleted(df, least_words, text).withColumnsRenamed({"doc_id": "__id", "doc": "__doc", "gone": "__gone"}))
    # few ranges go to the texts; many and the texts are dealt out by document
    if (gone.agg(F.sum(F.size("__gone")).alias("n")).first().n or 0) <= FEW:
        gone = F.broadcast(gone)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__doc"))
    both = df.select(*kept, F.xxhash64(text).alias("__own")).join(gone, same, "left")
    split = F.split(F.col(text), "\n")
    inside = lambda i: F.exists("__gone", lambda g: (g["start"] <= i) & (i <= g["stop"]))
    # blank lines between deleted ones go with them
    cut = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(split, lambda _, i: ~inside(i)), "\n"))
    lost = F.size(F.filter(split, lambda x, i: _full(x) & inside(i)))
    n_lines = F.coalesce(F.size(F.filter(split, _full)), F.lit(0))
    out = both.select(*(cut.alias(c) if c == text else F.col(c) for c in kept), n_lines.cast("bigint").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(lost).cast("bigint").alias("n_removed"))
    return out
