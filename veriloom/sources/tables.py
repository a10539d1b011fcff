"""Parquet scans of the input tables, and the file formats the pipeline reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters are left to the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSource(FileNotFoundError):
    """None of the places of a table exists."""


def first_available(spark: SparkSession, places: list[str]) -> str:
    """The first of several places (local, shared or remote, whatever the file systems of the session reach) that exists; raises if none does."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return place
    raise NoSource(", ".join(places))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON Lines; blank lines are skipped, lines that do not parse end up in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if schema is not None and "_corrupt_record" not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_csv_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; every column stays text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One JSON array (or one object, giving a single row) per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


#: Bytes at the head of a file within which its first character that is no blank is looked for.
HEAD = 4096


def _formats(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Of all files below the paths those that hold one JSON value ("whole") and those with a record a line ("lines").

    Only the head of each file is looked at, on the executors: a bracket opens an array; a brace whose line does not parse opens an object spread over lines.
    """
    heads = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # The first line that is not blank: of a file's blocks the first, and in it the first line that the scan gives.
    first = heads.filter((F.col("at") == 0) & (F.trim("value") != "")).withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, HEAD), "n").alias("head"), F.min_by((F.length("value") <= HEAD) & F.try_parse_json("value").isNotNull(), "n").alias("parses"))
    whole = F.col("head").startswith("[") | (F.col("head").rlike(r"^\{\s*$"))
    out: dict[str, list[str]] = {"whole": [], "lines": []}
    for r in first.select("file", whole.alias("whole")).collect():  # one row a file, as the scan itself lists them
        out["whole" if r["whole"] else "lines"].append(r["file"])
    return out


def sniff_json(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records and lines that are no JSON object, of files that each hold an array, one object over several lines, or JSON Lines.

    Every file is read in its own format; empty files give nothing.
    """
    found = _formats(spark, [paths] if isinstance(paths, str) else paths)
    names = [f.name for f in schema.fields]
    records, bad = spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    if found["whole"]:
        records = records.unionByName(read_json_array(spark, found["whole"], schema).select(*names))
    if found["lines"]:
        lines = spark.read.text(found["lines"]).filter(F.trim("value") != "")
        parsed = lines.select("value", F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT").alias("good"))
        good = F.coalesce("good", F.lit(False))
        records = records.unionByName(parsed.filter(good).select(F.from_json("value", schema).alias("r")).select(*[F.col("r")[n].alias(n) for n in names]))
        bad = bad.unionByName(parsed.filter(~good).select(F.col("value").alias("line")))
    return records, bad


def read_many_json_lines(spark: SparkSession, root: str, schema: T.StructType | None = None, ending: str = "jsonl") -> DataFrame:
    """All files of that ending below a folder; files whose name starts with a dot are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"[!.]*.{ending}")
    return (reader.schema(schema) if schema is not None else reader).json(root)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written, so every record has all fields."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    write_csv(df.coalesce(1), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, line breaks stay inside quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A bounded table as one file with one JSON array."""
    one = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("r")).agg(F.collect_list("r").alias("r"))
    one.select(F.concat(F.lit("["), F.array_join("r", ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_round(df: DataFrame, path: str, number: int) -> None:
    """Adds the rows of a round; a round that runs again replaces its own rows."""
    df.write.mode("overwrite").json(f"{path}/round={number}")


def read_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rounds so far, with their number as ``round``."""
    return spark.read.schema(f"{schema}, round int").json(path)


def code_state(folder: str) -> dict[str, str | bool | None]:
    """The commit that is checked out in ``folder`` and whether files differ from it; None where there is no repository."""
    import subprocess

    def ask(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    changed = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "changed": None if changed is None else bool(changed)}


def bar_chart(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """A small table as a bar chart in SVG: one labelled bar a row, its length in proportion to the largest value."""
    from xml.sax.saxutils import escape

    top = max((v for _, v in rows), default=0.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{30 + 22 * len(rows)}" font-family="sans-serif" font-size="12">', f'<text x="8" y="18" font-weight="bold">{escape(title)}</text>']
    for k, (label, value) in enumerate(rows):
        y = 30 + 22 * k
        out.append(f'<text x="8" y="{y + 13}">{escape(label)}</text><rect x="220" y="{y + 2}" height="14" width="{max(0.0, value) / top * (width - 300):.1f}" fill="#4878a8"/><text x="{width - 72}" y="{y + 13}">{value:g}</text>')
    return "\n".join([*out, "</svg>"])


def write_figure(df: DataFrame, path: str, label: str, value: str, title: str) -> None:
    """The bar chart of a report's rows as one SVG file; the report must be small, as a chart is."""
    rows = [(str(r[label]), float(r[value] or 0.0)) for r in df.select(label, value).orderBy(label).collect()]
    df.sparkSession.createDataFrame([(bar_chart(rows, title),)], "value string").coalesce(1).write.mode("overwrite").text(path)
