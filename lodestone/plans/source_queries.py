"""Sinks and sources: tables written as files of each kind to the shared folder, read back and compared with the tables."""

import uuid

from pyspark.sql import functions as F

from lodestone import sources
from lodestone.operators import text
from lodestone.plans.registry import query
from lodestone.tables import discard_at_exit, scratch


def _place(t):
    spark = t("region").sparkSession
    path = f"{scratch(spark)}/files-{uuid.uuid4().hex}"
    discard_at_exit(spark, path)
    return spark, path


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def text_lines_of_paths(t):
    spark, place = _place(t)
    t("nation").select("n_name").write.text(f"{place}/a")
    t("region").select("r_name").write.text(f"{place}/b")
    return sources.lines(spark, [f"{place}/a", f"{place}/b"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_single_file(t):
    spark, place = _place(t)
    for _ in range(2):  # the second run overwrites the first
        sources.write_text(t("customer").select("c_custkey", "c_name", "c_acctbal"), place, single=True)
    assert len(spark.read.text(place).inputFiles()) == 1
    return sources.delimited(spark, place, "c_custkey long, c_name string, c_acctbal double", sep="\t")


@query("SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS label, c_acctbal FROM customer")
def csv_by_header(t):
    """Two files whose columns differ in order and number."""
    spark, place = _place(t)
    rows = t("customer").select("c_custkey", F.format_string('%s, "%s"', "c_name", "c_mktsegment").alias("label"), "c_acctbal")
    out = lambda df, name: df.write.csv(f"{place}/{name}", header=True, escape='"')
    out(rows.where("c_custkey % 2 = 0"), "a")
    out(rows.where("c_custkey % 2 = 1").select("label", F.lit("x").alias("other"), "c_acctbal", "c_custkey"), "b")
    return sources.delimited(spark, [f"{place}/a", f"{place}/b"], "c_custkey long, label string, c_acctbal double", header=True)


@query("SELECT p_brand AS key, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def key_value_text(t):
    spark, place = _place(t)
    sources.write_text(t("part").select("p_brand", "p_size"), place)
    pairs = sources.split_lines(sources.lines(spark, place), [("key", "string"), ("value", "long")], "\\t")
    return pairs.groupBy("key").agg(F.sum("value").alias("total"))


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def records_by_folder(t):
    spark, place = _place(t)
    sources.write_parquet(t("orders").select("o_orderstatus", "o_orderkey"), place, "o_orderstatus")
    return sources.parquet(spark, place).select("o_orderstatus", "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation")
def json_files(t):
    spark, place = _place(t)
    t("nation").select("n_nationkey", "n_name").write.json(place)
    return sources.json_rows(spark, place, "n_nationkey long, n_name string")


_BASES = """SELECT base, count(*) AS n FROM (SELECT CASE WHEN c IN ('A','C','G','T') THEN c ELSE 'other' END AS base FROM (
  SELECT unnest(regexp_extract_all(translate(replace(p_name, ' ', ''), 'acgt', 'ACGT'), '(?s).')) AS c FROM part)) GROUP BY base"""


@query("SELECT 'part' || p_partkey AS header, replace(p_name, ' ', '') AS seq FROM part")
def fasta_records(t):
    """Sequences over several lines."""
    spark, place = _place(t)
    record = F.concat(F.lit(">part"), F.col("p_partkey"), F.lit("\n"), F.replace(F.col("p_name"), F.lit(" "), F.lit("\n")))
    t("part").select(record).write.text(place)
    return sources.fasta(spark, place)


@query(_BASES)
def fasta_base_count(t):
    spark, place = _place(t)
    record = F.concat(F.lit(">acgt"), F.col("p_partkey"), F.lit("\n"), F.replace(F.col("p_name"), F.lit(" "), F.lit("\n")))
    t("part").select(record).write.text(place)
    return text.base_count(sources.lines(spark, place))


@query(_BASES)
def fastq_base_count(t):
    """Qualities may begin with the separator."""
    spark, place = _place(t)
    seq = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    quality = F.concat(F.when(F.col("p_partkey") % 3 == 0, "@").otherwise("I"), F.repeat(F.lit("A"), F.length(seq) - 1))
    t("part").select(F.concat_ws("\n", F.concat(F.lit("@r"), F.col("p_partkey")), seq, F.lit("+"), quality)).write.text(place)
    return text.fastq_base_count(sources.fastq(spark, place))


@query("SELECT p_name AS value FROM part")
def small_files_combined(t):
    spark, place = _place(t)
    t("part").repartition(24).select("p_name").write.text(place)
    return sources.combined(spark, place, 8 << 10)


@query("SELECT p_name AS value, 6::BIGINT AS files FROM part")
def consolidated_files(t):
    spark, place = _place(t)
    t("part").repartition(24).select("p_name").write.text(f"{place}/many")
    sources.consolidate(spark, f"{place}/many", f"{place}/few", slots=2, most_per_bucket=4)
    few = spark.read.text(f"{place}/few")
    return few.select("value", F.lit(len(few.inputFiles())).cast("long").alias("files"))


@query("SELECT 'key' || i % 7 AS key, (('0x' || md5(i || ':42')[:6])::INT % 100)::INT AS freq FROM range(1000) r(i)")
def generated_counts(t):
    return sources.generate_counts(t("region").sparkSession, 1000, 7)
