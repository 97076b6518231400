"""Counting words, characters, k-mers, bases and anagrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column, min_length: int = 1, marks: str = ",.;") -> Column:
    """Words between white space, one trailing mark stripped, then those of ``min_length`` and more.

    Marks go in one pass over the text, not word by word.
    """
    bare = F.regexp_replace(text, rf"[{re.escape(marks)}](?=[ \t\n\r]|\z)", "")
    return F.filter(F.split(bare, r"[ \t\n\r]+"), lambda w: F.length(w) >= min_length)


def word_count(df: DataFrame, text: str = "text", min_length: int = 1) -> DataFrame:
    """(word, n); null texts give nothing."""
    return df.select(F.explode(words(F.col(text), min_length)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def sorted_word_count(df: DataFrame, text: str = "text", min_length: int = 1, ascending: bool = False) -> DataFrame:
    order = F.col("n").asc() if ascending else F.col("n").desc()
    return word_count(df, text, min_length).orderBy(order, "word")


def word_postings(df: DataFrame, doc: str, text: str, min_length: int = 1) -> DataFrame:
    """(word, postings): array of (n, doc) by rising count, then doc."""
    counts = df.select(F.col(doc).alias("doc"), F.explode(words(F.col(text), min_length)).alias("word")).groupBy("word", "doc").agg(F.count("*").alias("n"))
    return counts.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("n", "doc"))).alias("postings"))


def _count_each(text: Column, chars: Column) -> Column:
    """Array of (ch, n): how often each of ``chars`` occurs in the text."""
    return F.transform(chars, lambda c: F.struct(c.alias("ch"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("long").alias("n")))


def char_count(df: DataFrame, text: str = "text", lower: bool = True, local: bool = True) -> DataFrame:
    """(ch, n) over all characters.

    ``local`` counts each row's characters first, so a row for each different one goes on; else a row for each character
    goes on to the combiner. Both give the same.
    """
    value = F.lower(text) if lower else F.col(text)
    rows = df.where(F.length(text) > 0).select(value.alias("t"))
    if not local:
        return rows.select(F.explode(F.split("t", "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    counts = _count_each(F.col("t"), F.array_distinct(F.split("t", "")))
    return rows.select(F.explode(counts).alias("c")).groupBy("c.ch").agg(F.sum("c.n").alias("n"))


def base_count(lines: DataFrame, line: str = "value") -> DataFrame:
    """(base, n) of sequence lines: A, C, G, T or other; header lines that begin with > don't count.

    Five sums over whole lines; bases that do not occur have no row.
    """
    value = F.translate(F.trim(line), "acgt", "ACGT")
    rows = lines.where(~F.col(line).startswith(">")).select(value.alias("t"))
    counts = [(F.length("t") - F.length(F.replace(F.col("t"), F.lit(b), F.lit("")))).cast("long") for b in "ACGT"]
    other = F.length(F.translate("t", "ACGT", "")).cast("long")
    sums = rows.agg(*(F.sum(c).alias(n) for n, c in zip("ACGT", counts, strict=True)), F.sum(other).alias("other"))
    each = F.array(*(F.struct(F.lit(n).alias("base"), F.col(n).alias("n")) for n in (*"ACGT", "other")))
    return sums.select(F.explode(each).alias("c")).select("c.*").where("n > 0")


def fastq_base_count(reads: DataFrame) -> DataFrame:
    """(base, n) over the sequences of FASTQ records, as sources.fastq() reads them."""
    return base_count(reads.select(F.col("seq").alias("value")))


def kmers(df: DataFrame, sequence: str, k: int) -> DataFrame:
    """(kmer, n) of all full-length substrings; sequences shorter than k give none."""
    pieces = F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{int(k)}}}))"), F.lit(1))  # a look-ahead at every position
    return df.select(F.explode(pieces).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def relative_frequency(df: DataFrame, tokens: Column, window: int = 2) -> DataFrame:
    """(word, neighbour, n, total, frequency): pairs at most ``window`` positions apart over the word's sum of pairs."""
    near = df.select(tokens.alias("t")).where(F.size("t") >= 2)
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # the text against itself, moved by 1 .. window words: no row carries the whole text along
    length = lambda d: F.greatest(F.size("t") - d, F.lit(0))
    moved = F.concat(*(F.zip_with(F.slice("t", 1, length(d)), F.slice("t", 1 + d, length(d)), pair) for d in range(1, window + 1)))
    pairs = near.select(F.explode(moved).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    # counted without direction, which halves rows and shuffle; both directions have the same count
    way = lambda x, y, n: F.struct(F.col(x).alias("word"), F.col(y).alias("neighbour"), n.alias("n"))
    n = F.col("n")
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", n * 2))).otherwise(F.array(way("a", "b", n), way("b", "a", n)))
    counts = pairs.select(F.explode(ways).alias("w")).select("w.*")
    # sums are combined before their shuffle, so that a frequent word's pairs can be split over tasks
    totals = counts.groupBy("word").agg(F.sum("n").alias("total"))
    return counts.join(totals, "word").withColumn("frequency", F.col("n") / F.col("total"))


def anagrams(df: DataFrame, text: str = "text", min_length: int = 2) -> DataFrame:
    """(letters, words, counts): words of the same letters, sorted, with their counts; at least two different words."""
    word = words(F.lower(text), min_length)
    counts = df.select(F.explode(word).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    key = F.array_join(F.array_sort(F.split("word", "")), "")
    grouped = counts.groupBy(key.alias("letters")).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("found"))
    return grouped.where(F.size("found") > 1).select("letters", F.col("found.word").alias("words"), F.col("found.n").alias("counts"))
