"""Reading and writing: assay and score tables, alignments, coordinates, checked unions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local one only where none is set on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assayscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for plans that read it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_assays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All CSV files of a folder as text cells, with the assay's name from the file name, or from the folder
    assay=... where an assay is several files."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/assay=([^/]*)/[^/]*$", 1)
    return df.withColumn("assay", F.coalesce(F.nullif(folder, F.lit("")), F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")))


def pick_fields(manifest: DataFrame, reference: DataFrame, key: str, fields: list[str], kind: str, unknown: str = "Unknown") -> DataFrame:
    """The manifest's rows that the reference knows, with the listed fields as text ('' where absent or null)
    and the official type, `unknown` where it has none."""
    text = {f: F.coalesce(F.col(f"__ref.{f}").cast("string"), F.lit("")) if f in reference.columns else F.lit("") for f in fields}
    known = reference.select(F.col(key), F.struct(*reference.columns).alias("__ref"))
    official = F.coalesce(F.nullif(text[kind], F.lit("")), F.lit(unknown))
    out = manifest.join(known, key).withColumns(text | {"assay_type": official, "assay_type_official": official, "needs_manual_review": F.lit("0")})
    return out.select(*manifest.columns, *[f for f in fields if f not in manifest.columns], "assay_type", "assay_type_official", "needs_manual_review")


def out_of_range(table: DataFrame, keys: list[str], columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """row_no, field, value: values outside of [low, high], with the row's number in the order of the keys."""
    from assayscope.operators.ordering import positions

    t = positions(table, [], list(keys), "row_no")
    u = t.select((F.col("row_no") + 1).alias("row_no"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["row_no"], columns, "field", "value")
    return u.where((F.col("value") < low) | (F.col("value") > high))


def read_alignment_records(spark: SparkSession, path: str) -> DataFrame:
    """protein (file name), header, sequence of each FASTA record."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("protein", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    body = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), "")
    return raw.select("protein", F.get(lines, 0).alias("header"), body.alias("sequence"))


def read_ca_coords(lines: DataFrame) -> DataFrame:
    """structure, residue, x, y, z of the alpha carbons of lines(structure, line_no, value), fixed-width
    coordinate text; the last line of a residue wins."""
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    atoms = lines.where(F.startswith("value", F.lit("ATOM")) & (cut(13, 4) == "CA")).select(
        "structure", "line_no", cut(23, 4).try_cast("int").alias("residue"),
        *[cut(a, 8).try_cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))],
    )
    ok = atoms.dropna(subset=["residue", "x", "y", "z"])
    return ok.groupBy("structure", "residue").agg(*[F.max_by(c, "line_no").alias(c) for c in "xyz"])


def union_checked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of tables whose columns must agree in name and order."""
    for o in others:
        if o.columns != first.columns:
            raise ValueError(f"columns differ: {first.columns} and {o.columns}")
    for o in others:
        first = first.unionByName(o)
    return first


def union_of_keys(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union over all columns that occur, sorted by name; absent ones are null."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first.select(*sorted(first.columns))


def last_wins(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row per key: the one that comes last."""
    last = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(last.desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def minmax_labels(df: DataFrame, group: str, value: str, features: list[str]) -> DataFrame:
    """Rows with all features, value scaled to 0..1 within the group, and binary = scaled >= 0.5."""
    d = df.dropna(subset=[value, *features])
    w = Window.partitionBy(group)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    d = d.withColumn("scaled", F.when(hi == lo, 0.0).otherwise((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return d.withColumn("binary", (F.col("scaled") >= 0.5).cast("int"))


def method_counts(df: DataFrame, base: list[str]) -> DataFrame:
    """method, n: the columns that aren't base columns, with their values present; one without any counts too."""
    methods = [c for c in df.columns if c not in base]
    return df.agg(*[F.count(c).alias(c) for c in methods]).unpivot([], methods, "method", "n")


def sink_table(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """Write the declared columns in their order."""
    writer = df.select(*columns).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
