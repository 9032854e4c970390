"""Sinks of results, resumable runs, audit tables, and small configuration files.

Paths go through Spark's file systems, so all of it works on shared stores.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def read_json_config(spark: SparkSession, path: str) -> dict:
    """A small JSON file (scenarios, layouts, suites) as a dictionary; it is read whole."""
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def whitelisted(spark: SparkSession, folder: str, names: list[str], suffix: str = ".tsv") -> tuple[list[tuple[str, str]], list[str]]:
    """((name, path) of the listed names that exist under ``folder``, in the list's order; the names that are missing)."""
    fs, top = _file_system(spark, folder)
    there = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(top)} if fs.exists(top) else {}
    return [(n, there[n + suffix]) for n in dict.fromkeys(names) if n + suffix in there], [n for n in dict.fromkeys(names) if n + suffix not in there]


def read_metadata(spark: SparkSession, path: str, sample: str, patient: str, kinds: list[str] | None = None) -> DataFrame:
    """Sample metadata with trimmed cells, ``sample`` first, and codes: S001.. by sample, P0.. by patient, both by dense order of ids."""
    from ..operators.aggregate import dense_codes

    rows = read_table(spark, path)
    rows = rows.select(*[F.trim(F.col(c)).alias(c) for c in rows.columns]).where(F.col(sample).isNotNull() & (F.col(sample) != ""))
    if kinds:
        rows = rows.where(F.col("Type").isin(kinds))
    rows = dense_codes(dense_codes(rows, sample, "sample_code", "S", 3, 1), patient, "patient_code", "P")
    return rows.select(sample, *[c for c in rows.columns if c != sample])


def read_taxonomy(spark: SparkSession, path: str, key: str = "Feature ID") -> DataFrame:
    """(feature, taxon, consensus): ids without what follows ``;``. A table without the columns it needs is refused."""
    rows = read_table(spark, path)
    if missing := [c for c in (key, "Taxon") if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    consensus = F.col("Consensus").try_cast("double") if "Consensus" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.substring_index(F.trim(F.col(key)), ";", 1).alias("feature"), F.trim("Taxon").alias("taxon"), consensus.alias("consensus"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object for each row; nulls are kept as such."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """GraphML of nodes (id, ...) and edges (a, b, ...), every other column a data element: part files that make the document in the order of their names."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda df, skip: [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), safe(F.col(c)), F.lit("</data>"))).otherwise("") for c in df.columns if c not in skip]
    kinds = {"double": "double", "float": "double", "int": "int", "bigint": "long", "boolean": "boolean"}
    keys = [f'<key id="{c}" for="{what}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for what, df, skip in (("node", nodes, ("id",)), ("edge", edges, ("a", "b"))) for c, t in df.dtypes if c not in skip]
    spark = nodes.sparkSession
    frame = lambda place, text: spark.createDataFrame([(place, text)], "place int, value string")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(keys) + '\n<graph edgedefault="undirected">'
    body = nodes.select(F.lit(1).alias("place"), F.concat(F.lit('<node id="'), safe(F.col("id")), F.lit('">'), *data(nodes, ("id",)), F.lit("</node>")).alias("value"))
    links = edges.select(F.lit(2).alias("place"), F.concat(F.lit('<edge source="'), safe(F.col("a")), F.lit('" target="'), safe(F.col("b")), F.lit('">'), *data(edges, ("a", "b")), F.lit("</edge>")).alias("value"))
    whole = frame(0, head).union(body).union(links).union(frame(3, "</graph>\n</graphml>"))
    whole.orderBy("place", "value").select("value").write.mode(mode).text(path)


def write_gml(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """GML of nodes (id, ...) and edges (a, b, ...): part files that make the document in the order of their names.

    Ids become labels beside numbers, which GML wants; numbers come from a hash of the id. Nulls are left out.
    """
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    plain = ("double", "float", "int", "bigint")
    data = lambda df, skip: [F.when(F.col(c).isNotNull(), F.concat(F.lit(f" {c} "), F.col(c).cast("string") if t in plain else text(F.col(c)))).otherwise("") for c, t in df.dtypes if c not in skip]
    number = lambda c: F.xxhash64(F.col(c).cast("string")).cast("string")
    spark = nodes.sparkSession
    frame = lambda place, line: spark.createDataFrame([(place, line)], "place int, value string")
    body = nodes.select(F.lit(1).alias("place"), F.concat(F.lit("node [ id "), number("id"), F.lit(" label "), text(F.col("id")), *data(nodes, ("id",)), F.lit(" ]")).alias("value"))
    links = edges.select(F.lit(2).alias("place"), F.concat(F.lit("edge [ source "), number("a"), F.lit(" target "), number("b"), *data(edges, ("a", "b")), F.lit(" ]")).alias("value"))
    frame(0, "graph [ directed 0").union(body).union(links).union(frame(3, "]")).orderBy("place", "value").select("value").write.mode(mode).text(path)


def append_table(df: DataFrame, path: str, header: str = "first") -> None:
    """Appends ``df`` as TSV files; the names of columns stand in every file (``all``), in those of the first call (``first``) or in none."""
    if header not in ("first", "all", "none"):
        raise ValueError(f"header is {header!r}, not first, all or none")
    fs, at = _file_system(df.sparkSession, path)
    named = header == "all" or header == "first" and not fs.exists(at)
    df.write.mode("append").option("sep", "\t").option("header", named).csv(path)


def read_stats(spark: SparkSession, path: str, sample: str, reads: str, strip: str = "") -> DataFrame:
    """(sample, reads): a TSV of reads by file, added up by sample after ``strip`` (a pattern) is taken off its name."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    name = F.regexp_replace(F.col(sample), strip, "") if strip else F.col(sample)
    return rows.select(name.alias("sample"), F.regexp_replace(reads, ",", "").try_cast("bigint").alias("n")).where("sample is not null").groupBy("sample").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reads"))


def cached(inputs: list[str], parameters: dict, folder: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``work``, kept under ``folder`` by the names, sizes and times of the input files and by the parameters.

    A second call with the same inputs and parameters reads what the first has written; a changed file or parameter
    computes anew. A result is published by renaming it when it is whole, so that a broken or second writer leaves none half done.
    """
    spark = SparkSession.getActiveSession()
    seen = []
    for path in inputs:
        fs, at = _file_system(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key = hashlib.sha256(json.dumps([sorted(seen), parameters], sort_keys=True, default=str).encode()).hexdigest()[:32]
    target = f"{folder.rstrip('/')}/{key}"
    fs, at = _file_system(spark, target)
    if not fs.exists(at):
        draft = f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}"
        work().write.parquet(draft)
        _, there = _file_system(spark, draft)
        if not fs.rename(there, at) and not fs.exists(at):
            raise OSError(f"{draft} could not become {target}")
        if fs.exists(there):
            fs.delete(there, True)  # another writer was first
    return spark.read.parquet(target)


def write_group_fasta(seqs: DataFrame, path: str, group: str, header: Column | None = None, mode: str = "errorifexists") -> None:
    """A folder of FASTA records for each value of ``group``."""
    seqs.select(group, F.concat(F.lit(">"), header if header is not None else F.col("id"), F.lit("\n"), F.col("seq")).alias("value")).write.mode(mode).partitionBy(group).text(path)


def annotated_header(taxon: str = "taxon", consensus: str = "consensus") -> Column:
    """``id||taxon||consensus``."""
    return F.concat_ws("||", "id", taxon, F.col(consensus).cast("string"))


def run_chunks(df: DataFrame, chunk: str, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Runs ``work`` on the rows of chunks that ``path`` does not hold yet and returns the results of all chunks.

    Each chunk is a partition of the table at ``path``, written as a whole in the run that made it; the ledger of
    finished chunks, ``path``/_ledger, is written after them, so a run that broke off does its chunks again and replaces
    what it had left. Chunks that were done before count in the result.
    """
    spark = df.sparkSession
    ledger = f"{path}/_ledger"
    fs, at = _file_system(spark, ledger)
    kind = dict(df.dtypes)[chunk]
    done = spark.read.schema(f"{chunk} {kind}").parquet(ledger) if fs.exists(at) else spark.createDataFrame([], f"{chunk} {kind}")
    left = df.join(done.distinct(), chunk, "left_anti")
    if not left.isEmpty():
        out = work(left)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(f"{path}/rows")
        left.select(chunk).distinct().write.mode("append").parquet(ledger)
    return spark.read.parquet(f"{path}/rows")


def append_once(df: DataFrame, key: list[str], path: str) -> DataFrame:
    """Appends the rows whose key the table at ``path`` does not hold and returns the table; a repeated call adds nothing."""
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    fresh = df.dropDuplicates(key)
    if fs.exists(at):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def audit(tables: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of tables to be joined on ``key``: manifest (name, n_rows, n_keys, n_repeated), columns (name, column, kind, output) with
    the table's name in front of a column that several hold, and collisions (column, tables)."""
    names = list(tables)
    spark = tables[names[0]].sparkSession
    manifest = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
        manifest = row if manifest is None else manifest.union(row)
    manifest = manifest.withColumn("n_repeated", F.col("n_rows") - F.col("n_keys"))
    cells = spark.createDataFrame([(n, c, t) for n in names for c, t in tables[n].dtypes if c != key], "name string, column string, kind string")
    shared = cells.groupBy("column").agg(F.array_sort(F.collect_set("name")).alias("tables")).where(F.size("tables") > 1)
    columns = cells.join(shared.select("column", F.lit(True).alias("s")), "column", "left").select("name", "column", "kind", F.when(F.col("s"), F.concat_ws("_", "name", "column")).otherwise(F.col("column")).alias("output"))
    return manifest, columns, shared
