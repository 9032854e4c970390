"""Readers and writers of the study's file formats. Compression follows from the suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLAST6 = "qseqid string, sseqid string, pident double, length int, qlen int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


def separator(path: str) -> str:
    """Comma for .csv, tab for everything else; a compression suffix is looked through."""
    bare = path.lower().removesuffix(".gz").removesuffix(".bz2")
    return "," if bare.endswith(".csv") else "\t"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A headed text table, all columns strings unless a schema is given; its name decides the separator."""
    reader = spark.read.option("header", True).option("sep", separator(path))
    return (reader.schema(schema) if schema else reader).csv(path)


def read_counts(spark: SparkSession, path: str, samples_on: str = "columns", keep: list[str] | None = None) -> DataFrame:
    """(feature, sample, count as a double) of a wide table with non-zero cells; what is no number is 0.

    ``samples_on`` says whether columns or rows are samples; ``keep`` limits the unpivoted columns.
    """
    wide = read_table(spark, path)
    key, *rest = wide.columns
    names = [c for c in rest if keep is None or c in keep]
    long = wide.unpivot([key], names, "_column", "_value").select(F.col(key).alias("_row"), "_column", F.coalesce(F.col("_value").try_cast("double"), F.lit(0.0)).alias("count")).where("count <> 0")
    feature, sample = ("_row", "_column") if samples_on == "columns" else ("_column", "_row")
    return long.select(F.col(feature).alias("feature"), F.col(sample).alias("sample"), "count")


def read_blast6(spark: SparkSession, path: str, least_identity: float = 97.0, least_coverage: float = 51.0) -> DataFrame:
    """Headerless hit tables (one file or a glob) with ``coverage`` and ``source_file``, filtered by identity and coverage."""
    hits = spark.read.schema(BLAST6).option("sep", "\t").csv(path).where("qlen > 0")
    hits = hits.withColumn("coverage", 100.0 * F.col("length") / F.col("qlen")).withColumn("source_file", F.col("_metadata.file_name"))
    return hits.where((F.col("pident") >= least_identity) & (F.col("coverage") >= least_coverage))


def best_hits(hits: DataFrame) -> DataFrame:
    """The hit of largest identity for each query; ties by subject."""
    return hits.groupBy("qseqid").agg(F.min(F.struct((-F.col("pident")).alias("x"), "sseqid", "pident", "coverage")).alias("h")).select("qseqid", "h.sseqid", "h.pident", "h.coverage")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): records split where a line begins with ``>`` by the text reader, lines joined, upper case."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substring("value", F.length(head) + 1, F.length("value"))
    return raw.select(F.substring_index(F.trim(head), " ", 1).alias("id"), F.trim(head).alias("description"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def write_fasta(seqs: DataFrame, path: str, header: Column | None = None, mode: str = "errorifexists") -> None:
    """One record for each row, ``header`` (by default the id) above the sequence."""
    seqs.select(F.concat(F.lit(">"), header if header is not None else F.col("id"), F.lit("\n"), F.col("seq")).alias("value")).write.mode(mode).text(path)


def read_fastq_pairs(spark: SparkSession, folder: str, pattern: str = r"^(.*)_R([12])(_.*)?\.fastq(?:\.gz)?$") -> DataFrame:
    """(stem, r1, r2): names of paired files in a folder, without reading them; unpaired ones have a null side."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fastq*").load(folder).select(F.substring_index("path", "/", -1).alias("name"))
    named = files.select("name", F.regexp_extract("name", pattern, 1).alias("stem"), F.regexp_extract("name", pattern, 2).alias("side")).where("side <> ''")
    return named.groupBy("stem").agg(F.min(F.when(F.col("side") == "1", F.col("name"))).alias("r1"), F.min(F.when(F.col("side") == "2", F.col("name"))).alias("r2"))


def read_two_fields(spark: SparkSession, path: str, names: tuple[str, str], header_word: str) -> DataFrame:
    """Ragged tab text: the first two fields, without blank lines and lines whose first field is ``header_word``; first by text wins."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).alias(names[0]), F.trim(F.get(parts, F.lit(1))).alias(names[1]))
    return rows.where(F.lower(names[0]) != header_word.lower()).groupBy(names[0]).agg(F.min(names[1]).alias(names[1]))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the data elements as a map from key to text."""
    data = "array<struct<_VALUE: string, _key: string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    entries = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda x: F.struct(x["_key"], x["_VALUE"])))
    nodes = read("node", f"_id string, data {data}").select(F.col("_id").alias("id"), entries.alias("data"))
    edges = read("edge", f"_source string, _target string, data {data}").select(F.col("_source").alias("a"), F.col("_target").alias("b"), entries.alias("data"))
    return nodes, edges


def read_named_files(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Headed tables whose file names carry columns: each group of ``pattern`` becomes one."""
    df = read_table(spark, path)
    return df.withColumns({n: F.regexp_extract(F.col("_metadata.file_name"), pattern, i + 1) for i, n in enumerate(names)})


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A headed text table; the suffix of ``path`` decides separator and compression, as in read_table."""
    packed = {"gz": "gzip", "bz2": "bzip2"}.get(path.lower().rsplit(".", 1)[-1], "none")
    df.write.mode(mode).option("compression", packed).option("header", True).option("sep", separator(path)).csv(path)


def write_square(pairs: DataFrame, path: str, diagonal: float = 0.0, mode: str = "errorifexists") -> None:
    """A square table of pair distances: the only place where pairs become wide."""
    square(pairs, diagonal).write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def square(pairs: DataFrame, diagonal: float = 0.0) -> DataFrame:
    both = pairs.select("id1", "id2", "dist").union(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "dist"))
    own = both.select("id1").distinct().select("id1", F.col("id1").alias("id2"), F.lit(diagonal).alias("dist"))
    names = [r[0] for r in both.select("id1").distinct().orderBy("id1").collect()]  # the columns of the table
    return both.union(own).groupBy("id1").pivot("id2", names).agg(F.first("dist"))
