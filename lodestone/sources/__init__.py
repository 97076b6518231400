"""Readers and writers."""

from __future__ import annotations

import csv
from functools import reduce
from math import ceil
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines of one or more paths: value."""
    return spark.read.text(paths)


def delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Typed rows; malformed ones are dropped, quoted fields (a quote within is doubled) understood.

    With ``header`` each file's columns go by the names in its own first line, in any order and among others; a file that
    lacks a wanted column is an error. Files of equal first lines are read together.
    """
    if not header:
        return spark.read.csv(paths, schema=schema, sep=sep, mode="DROPMALFORMED", quote='"', escape='"')
    wanted = StructType.fromDDL(schema)
    first = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    heads = first.where("block = 0").groupBy("file").agg(F.min_by("value", "id").alias("head"))
    files: dict[tuple[str, ...], list[str]] = {}
    for r in heads.collect():  # one line a file
        names = tuple(n.strip() for n in next(csv.reader([r["head"].lstrip("\ufeff").rstrip("\r")], delimiter=sep)))
        if missing := [f.name for f in wanted if f.name not in names]:
            raise ValueError(f"no column {', '.join(missing)} in {r['file']}")
        files.setdefault(names, []).append(r["file"])
    out = None
    for names, of in sorted(files.items()):
        columns = StructType([StructField(f"_{i}", StringType()) for i in range(len(names))])
        rows = spark.read.csv([unquote(f) for f in of], schema=columns, sep=sep, header=True, mode="DROPMALFORMED", quote='"', escape='"')
        raw = {f.name: F.col(f"_{names.index(f.name)}") for f in wanted}
        sound = [raw[f.name].isNull() | raw[f.name].try_cast(f.dataType).isNotNull() for f in wanted]
        part = rows.where(reduce(lambda x, y: x & y, sound)).select(*(raw[f.name].try_cast(f.dataType).alias(f.name) for f in wanted))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], wanted)


def split_lines(df: DataFrame, schema: list[tuple[str, str]], pattern: str = r"\s+", value: str = "value") -> DataFrame:
    """Lines cut by a pattern and cast; lines with another number of parts or an unreadable number are dropped."""
    parts = df.select(F.split(F.trim(value), pattern).alias("p")).where(F.size("p") == len(schema))
    out = parts.select(*(F.col("p")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(schema)))
    return out.where(" AND ".join(f"`{name}` IS NOT NULL" for name, _ in schema))


def adjacency(df: DataFrame, value: str = "value") -> DataFrame:
    """Edges src, dst of lines ``person<sep>friend friend ...`` with any of ``: , space tab`` between."""
    parts = F.filter(F.split(F.trim(value), r"[:,\s]+"), lambda x: x != "")
    friends = F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("dst")
    pairs = df.select(parts.alias("p")).select(F.get("p", F.lit(0)).alias("src"), friends)
    return pairs.select(*(F.col(c).try_cast("long").alias(c) for c in ("src", "dst"))).where("src IS NOT NULL AND dst IS NOT NULL")


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(header, seq) records, splittable at the record separator."""
    record = spark.read.text(paths, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where(F.length("r") > 0)
    parts = record.select(F.split("r", r"\r?\n", 2).alias("p"))
    return parts.select(F.col("p")[0].alias("header"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"[\s]", "").alias("seq"))


def fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, seq, plus, qual) records of four lines, splittable at ``@`` after a line's end.

    A quality line that itself begins with ``@`` is cut off its record there. Records without one and such lines
    alternate within a file, so ordering just these by place pairs them again; whole records are not shuffled.
    Blank lines are skipped.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    cut = spark.read.text(paths, lineSep="\n@").select("value", *place)
    lines_ = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cut = cut.select(F.transform(lines_, lambda x: F.regexp_replace(x, r"\r\z", "")).alias("l"), "file", "block", "id")
    order = Window.partitionBy("file").orderBy("block", "id")
    loose = cut.where(F.size("l") < 4).withColumn("next", F.lead("l").over(order))
    cut_off = F.concat(F.lit("@"), F.coalesce(F.get("next", F.lit(0)), F.lit("")))
    mended = loose.where((F.size("l") == 3) & (F.size("next") <= 1)).select(F.concat("l", F.array(cut_off)).alias("l"))
    whole = cut.where(F.size("l") == 4).select("l").unionByName(mended)
    named = F.concat(F.lit("@"), F.regexp_replace(F.get("l", F.lit(0)), "^@", ""))
    return whole.select(named.alias("name"), *(F.get("l", F.lit(j)).alias(n) for j, n in enumerate(("seq", "plus", "qual"), 1)))


def spread(table: DataFrame) -> DataFrame:
    """A table as read, over at least as many partitions as there are cores, for costly work on each row.

    Only a table of few files is dealt out; one with partitions enough stays as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(cores)


def sql(text: str, **tables: DataFrame) -> DataFrame:
    """The result of a SQL text over DataFrames, which it names in braces, as in ``SELECT * FROM {orders}``.

    No view of the caller's is touched.
    """
    return next(iter(tables.values())).sparkSession.sql(text, **tables)


def json_rows(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    return spark.read.json(paths, schema=schema) if schema else spark.read.json(paths)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def buckets_needed(files: int, slots: int, most_per_bucket: int) -> int:
    """Number of merged files: a bucket per slot, or more where a bucket would exceed its limit."""
    return max(1, min(files, slots) if files <= slots * most_per_bucket else ceil(files / most_per_bucket))


def combined(spark: SparkSession, paths: str | list[str], most_bytes: int) -> DataFrame:
    """Text lines of many small files, at most about ``most_bytes`` to a partition.

    Spark packs small files by its own split size; where that gives fewer partitions than asked for, lines are dealt out.
    """
    source = spark.read.text(paths)
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions, wanted = source._jdf.queryExecution().toRdd().getNumPartitions(), max(1, ceil(size / most_bytes))
    return source.repartition(wanted) if partitions < wanted else source.coalesce(wanted)


def consolidate(spark: SparkSession, path: str, out: str, slots: int, most_per_bucket: int) -> int:
    """Many small text files as buckets_needed() larger ones; gives their number. Reading keeps its own parallelism."""
    source = spark.read.text(path)
    buckets = buckets_needed(len(source.inputFiles()), slots, most_per_bucket)
    source.repartition(buckets).write.mode("overwrite").text(out)
    return buckets


def write_text(df: DataFrame, path: str, sep: str = "\t", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep=sep)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def generate_counts(spark: SparkSession, n: int, keys: int, seed: int = 42) -> DataFrame:
    """Synthetic (key, freq) rows, the same for a seed whatever the partitions."""
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    freq = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 100
    return spark.range(n).select(F.concat(F.lit("key"), F.pmod("id", F.lit(keys))).alias("key"), freq.cast("int").alias("freq"))
