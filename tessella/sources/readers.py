"""Readers with explicit schemas, and sinks that can run again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by the columns ``by`` over as many tasks as a shuffle has, for work that is long for its bytes: a small file is read
    by one task, and Spark joins shuffled parts of few bytes into one."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON Lines; a line that is no JSON is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def flat_file(spark: SparkSession, path: str | list[str], columns: dict[str, int], least_fields: int, encoding: str = "ISO-8859-1") -> DataFrame:
    """Tab-separated lines without quotes or header; ``columns`` names positions, shorter lines are skipped. ASCII-compatible encodings only."""
    return fields_of(spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("escape", "").schema("line string").csv(path), columns, least_fields)


def fields_of(lines: DataFrame, columns: dict[str, int], least_fields: int) -> DataFrame:
    """Named fields of tab-separated ``line``, of a flat file or of a member of an archive; shorter lines are skipped."""
    parts = F.split("line", "\t")
    return lines.select(parts.alias("f")).where(F.size("f") >= least_fields).select(*[F.col("f")[at].alias(name) for name, at in columns.items()])


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``member``, ``line`` of the text files in ZIP archives, read one archive a task and one line at a time."""
    return archive_lines(spark.read.format("binaryFile").load(path).select("path", "content"))


def archive_lines(archives: DataFrame) -> DataFrame:
    """``path``, ``member``, ``line`` of ZIP archives, one a row (path, content). A null archive has no lines."""
    import io
    import zipfile

    import pyarrow as pa

    names = ["path", "member", "line"]

    def lines(batches):
        held, size = [], 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not data.is_valid:
                    continue
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as f:
                            while part := f.readlines(1 << 20):
                                held += [(name, member, x.rstrip(b"\r\n").decode("latin-1")) for x in part]
                                size += sum(map(len, part))
                                if size >= 1 << 20 or len(held) >= 10_000:  # small archives share a batch
                                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)
                                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)

    return archives.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(lines, "path string, member string, line string")


def csv_table(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``url``: the distinct lines of journals that say what is done."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''").distinct()


def marked_sheet(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows of a Markdown table, without its head and rule; cells are trimmed, and escaped bars are bars."""
    cells = F.transform(F.split(F.regexp_extract("value", r"^\s*\|(.*)\|\s*$", 1), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rows = spark.read.text(path).where(r"value rlike '^\\s*\\|' and not value rlike '^\\s*\\|[\\s:|-]+$'").select(cells.alias("c"))
    return rows.where((F.size("c") == len(names)) & (F.col("c")[0] != names[0])).select(*[F.col("c")[k].alias(n) for k, n in enumerate(names)])


def replace_snapshot(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that only the partitions it holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report of few rows as one Markdown table with its head; bars and line ends inside cells are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(f"| {' | '.join(columns)} |",), (f"|{'---|' * len(columns)}",)], "value string").coalesce(1)
    head.unionByName(df.select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch space, or else beside the warehouse's tables; it is for whoever asked to fill and delete."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessella-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """The written folder goes when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
