"""What several of the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_folder

#: A word, wherever an operator counts or compares words: a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


_MADE: list[str] = []


def made() -> int:
    """How many tables stored() has written that are still there: clear_stored() can go back to here."""
    return len(_MADE)


def clear_stored(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the tables that stored() has written since made() said so, but for the last ones, once nothing that reads them is needed.  Returns how many."""
    conf, gone = spark._jsc.hadoopConfiguration(), _MADE[since : len(_MADE) - but]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _MADE.remove(name)
    return len(gone)


def written(path: str) -> None:
    """Note a table in the shared folder for clear_stored()."""
    _MADE.append(path)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor takes nothing with it."""
    path = f"{shared_folder(df.sparkSession)}/corvane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 25) -> None:
    """Arrow batches of whole texts of no more rows and about as many bytes as this, unless the session has settings of its own.

    The settings are read when a plan runs, so they stay, and other plans of the session that use Arrow run with them too.
    """
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{size}b")):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, str(value))


def code_points_key(column: Column) -> Column:
    """Bytes of the UTF-8 form, which sort as code points do."""
    return F.encode(column, "UTF-8")


def level(key: Column, seed: int) -> Column:
    """Trailing zero bits of a hash: a row is at level z or above with a chance of 2 ** -z."""
    half = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1)
    return F.bit_count(half.bitwiseAND(-half) - F.lit(1).cast("bigint")).cast("int")


def unit(key: Column, seed: str) -> Column:
    """A number in (0, 1), the same on every engine: 52 bits of an MD5 of the key's text."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
