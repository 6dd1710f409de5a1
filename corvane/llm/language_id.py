"""Language identification by compression.

For each language a zstandard dictionary of raw content is filled with texts in it.  A text, in lower case and without ASCII
punctuation and digits, is cut into pieces, each is compressed with every language's dictionary, and the language whose
dictionary gives the fewest bytes in all is chosen.  The margin is how many bytes more the second language takes (or no
dictionary, where one language is known), for each byte of the fewest; the score is the margin's place between none and
all, m / (m + ``MARGIN``).  Where the margin is narrow, or the sizes are equal, the text is rejected.

Learning reads every training row to learn how much there is.  All texts are cut into samples of ``SAMPLE_PIECE`` characters,
from their first to their last, and those at a level of a hash of id and place, or above, come to the driver: the lowest
level at which a language's have at most ``SAMPLE_CHARS`` characters, or its part of ``TOTAL_CHARS`` where there are many
languages.  So the sample is bounded, spread over all rows and whole texts, and the same on every run, and all of it is in
the dictionary.  Every language of the training rows is learned.  Predictions use nothing but the text.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and rejected; without any training rows
everything is ``und``; ties are rejected with score 0, and named after the language with more training rows, then by name; an
id that is null is never learned from; rows that repeat an id and text are learned from once; an empty table gives an empty
result; columns that clash with those added are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import LETTERS

#: Characters of a language's sample, of all samples, and of one piece of a text in it, at most.
SAMPLE_CHARS, TOTAL_CHARS, SAMPLE_PIECE = 200_000, 16_000_000, 2_000
#: Bytes of a piece that is compressed by itself, and zstandard's level.
PIECE, LEVEL = 4096, 9
#: Bytes of margin for each compressed byte at which the score is a half; scores below the second number are rejected.
MARGIN, LEAST_SCORE = 0.03, 0.1
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    contents: tuple[bytes, ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(b"\0".join(self.contents)).hexdigest()


def learn(training: DataFrame, text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> Model:
    """From rows (doc_id, text, lang), of which those with a null go unused."""
    rows = training.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"), F.char_length(text).alias("size"), F.xxhash64(text).alias("own"))
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / SAMPLE_PIECE).cast("int"))
    at = rows.select("doc_id", "own", "lang", "size", F.explode(places).alias("at"))
    chars = F.least(F.col("size") - F.col("at") * SAMPLE_PIECE, F.lit(SAMPLE_PIECE))
    sums = at.groupBy("lang", _place_level(F.col("at")).alias("level")).agg(F.sum(chars).alias("chars"), F.count_if(F.col("at") == 0).alias("n"))
    per = sums.groupBy("lang").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "chars")).alias("levels"))
    found = per.orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not found:
        return Model((), ())
    sample_chars = min(sample_chars, max(SAMPLE_PIECE, total_chars // len(found)))
    lowest = {}
    for row in found:
        total, lowest[row.lang] = 0, max(x.level for x in row.levels)
        for x in sorted(row.levels, key=lambda x: -x.level):
            total += x.chars
            if total > sample_chars:
                break
            lowest[row.lang] = x.level
    least = training.sparkSession.createDataFrame(list(lowest.items()), "lang string, least int")
    # of each text only the pieces that are drawn are cut out
    drawn = rows.join(F.broadcast(least), "lang").withColumn("drawn", F.filter(places, lambda i: _place_level(i) >= F.col("least"))).filter(F.size("drawn") > 0)
    piece = F.transform("drawn", lambda i: F.struct(i.alias("at"), F.substring("text", i * SAMPLE_PIECE + 1, F.lit(SAMPLE_PIECE)).alias("text")))
    texts: dict[str, list] = {name: [] for name in lowest}
    pieces = drawn.select("lang", "doc_id", "own", F.explode(piece).alias("x")).distinct()
    for row in pieces.toLocalIterator():
        texts[row.lang].append((hashlib.md5(f"{row.doc_id}|{row.own}|{row.x.at}".encode()).digest(), letters(row.x.text)))
    contents = [b"\n".join(dict.fromkeys(t for _, t in sorted(texts[name]))) for name in lowest]
    return Model(tuple(lowest), tuple(contents))


def _place_level(at: Column) -> Column:
    """The level of a piece, by its document's id and text and its place."""
    half = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("own"), at, F.lit(8)), 1)
    return F.bit_count(half.bitwiseAND(-half) - F.lit(1).cast("bigint")).cast("int")


def letters(text: str) -> bytes:
    """What is compressed of a text: its words in lower case."""
    return b" ".join(text.lower().encode("utf-8").translate(LETTERS).split())


_LOADED: dict[str, list] = {}
_PLAIN = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress


def _compressors(model: Model) -> list:
    if model.key not in _LOADED:
        _LOADED.clear()
        made = []
        for content in model.contents:
            words = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        _LOADED[model.key] = made
    return _LOADED[model.key]


def classify(model: Model, text: str | None, compressors: list | None = None) -> tuple[str, float]:
    """(language, score).  The score grows with the margin to the second language for each compressed byte; equal sizes give 0."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    compressors = compressors or _compressors(model)
    data = letters(text)
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = [sum(len(compress(p)) for p in pieces) for compress in compressors]
    best = min(sizes)
    second = sorted(sizes)[1] if len(sizes) > 1 else max(best, sum(len(_PLAIN(p)) for p in pieces))
    margin = (second - best) / max(1, best)
    return model.languages[sizes.index(best)], margin / (margin + MARGIN)


def identify(df: DataFrame, model: Model, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """df with lang_pred, score and rejected."""
    names = ("lang_pred", "score", "rejected")
    shared = df.sparkSession.sparkContext.broadcast(model)  # TOTAL_CHARS, about

    @F.arrow_udf("lang_pred string, score double")
    def predicted(column: pa.Array) -> pa.Array:
        compressors = _compressors(shared.value)
        pairs = [classify(shared.value, x.as_py(), compressors) for x in column]
        return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], ["lang_pred", "score"])

    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in names]
    out = df.select(*kept, predicted(F.col(text)).alias("__p"))
    rejected = (F.col("__p.lang_pred") == UNKNOWN) | (F.col("__p.score") < least_score)
    return out.select(*kept, F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"), rejected.alias("rejected"))


def fold(doc_id: Column, folds: int = 3) -> Column:
    """The fold of a document, from its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
