"""What the operators share: lineage cuts, lookups of hot keys, label splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.shared import new_folder, shipped

WORD_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and
    a lost executor costs only the tasks of later steps."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` made and nothing needs any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no column can clash with an operator's own."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """The name that column ``name`` of ``df`` has in ``numbered``: the column of just that name,
    else one that differs in case."""
    names = df.columns
    return f"c{names.index(name) if name in names else [n.lower() for n in names].index(name)}"


#: A key with more rows than this share of a table counts as hot, so hot keys are few.
HOT = 1e-4


def with_looked_up(rows: DataFrame, few: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``few`` (one row a key, column ``size``: how many of ``rows`` have it).
    Keys with at least HOT of the ``total`` rows, 1 / HOT at most, are broadcast, so no task gets
    all rows of a hot key; the others are joined in a shuffle."""
    least = max(1000, int(HOT * total))
    hot = F.broadcast(few.filter(F.col(size) >= least).drop(size))
    rest = few.filter(F.col(size) < least).drop(size)
    if total < least:
        return rows.join(rest, key)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))
