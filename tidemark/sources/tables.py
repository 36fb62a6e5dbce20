"""Scans, the transaction-identity join with its checks, caches and sinks."""

from __future__ import annotations

import json
import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema

FILES = {name: f"{name}.csv" for name in ("train_transaction", "train_identity", "test_transaction", "test_identity", "sample_submission")}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_csv(spark: SparkSession, name: str, folder: str, columns: list[str] | None = None, declared: T.StructType | None = None) -> DataFrame:
    """A logical table by name; a missing file raises FileNotFoundError. Without a declared schema all is text, then cast."""
    path = f"{folder}/{FILES.get(name, f'{name}.csv')}"
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; put the raw files of {name!r} into {folder}")
    reader = spark.read.option("header", True)
    df = reader.schema(declared).csv(path) if declared else reader.csv(path)
    df = rename_hyphens(df)
    return downcast(df.select(*columns) if columns else df)


def rename_hyphens(df: DataFrame) -> DataFrame:
    """id-NN becomes id_NN; other names stay."""
    return df.withColumnsRenamed({c: c.replace("-", "_") for c in df.columns if c.startswith("id-")})


def downcast(df: DataFrame) -> DataFrame:
    """Ids long, declared categories text, other numbers float or int; NaN becomes NULL once, here."""
    numeric = {c for block in schema.NUMERIC_BLOCKS.values() for c in block} | {schema.AMOUNT}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name == schema.ID:
            c = c.cast("long")
        elif f.name in schema.CATEGORICAL:
            c = c.cast("string")
        elif f.name == schema.TIME:
            c = c.cast("double")
        elif f.name == schema.TARGET:
            c = c.cast("int")
        elif f.name in numeric or isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c.cast("float"), F.lit(None).cast("float"))
        elif isinstance(f.dataType, T.LongType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def cached_parquet(df: DataFrame, path: str) -> DataFrame:
    """Build the Parquet copy if it is absent, and read it."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files in ``spark.checkpoint.dir``, written once: plans that follow begin at the files.

    A persisted frame would keep the whole plan that made it, which every later job reads and prints again. A local
    master without that setting gets a temporary folder; any other master without it gets a persisted frame.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            return df.persist()
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str, side: str) -> None:
    if not duplicated_keys(df, key).limit(1).isEmpty():
        raise ValueError(f"{side} has duplicate {key}")


def left_join(facts: DataFrame, dimension: DataFrame, key: str, flag: str = "has_identity_record", validate: bool = True, limit: int | None = None) -> DataFrame:
    """facts LEFT JOIN dimension with a 0/1 match flag taken from the join itself; both sides must have unique keys.

    An inner join would drop unmatched facts. ``limit`` bounds the fact side only.
    """
    if limit is not None:
        facts = facts.limit(limit)
    if validate:
        require_unique(facts, key, "the fact side")
        require_unique(dimension, key, "the dimension side")
    marked = dimension.withColumn(flag, F.lit(1))
    return facts.join(marked, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def match_rate(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """One row: facts, matched facts and their share."""
    flagged = facts.select(key).join(dimension.select(key).distinct().withColumn("m", F.lit(1)), key, "left")
    return flagged.agg(F.count("*").alias("n"), F.count("m").alias("n_matched")).withColumn("match_rate", F.col("n_matched") / F.col("n").cast("double"))


def checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """file, bytes, md5 of each file under a folder, of any size, streamed through the driver; no file gives no row."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder, glob)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(where) or []:
        if status.isFile():
            stream = system.open(status.getPath())
            try:
                out.append((status.getPath().getName(), status.getLen(), spark._jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)))
            finally:
                stream.close()
    return spark.createDataFrame(out, "file string, bytes long, md5 string")


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split(",") if first else []


def schema_check(spark: SparkSession, folder: str) -> dict:
    """What the raw files hold against what is declared: widths, rows, discrepancies, target, match rate, checksums.

    Headers are read as they are on disk, before names are normalised. Files that are absent are discrepancies, too.
    """
    report: dict = {"files": {}, "discrepancies": [], "checksums_md5": {r["file"]: r["md5"] for r in checksums(spark, folder, "*.csv").collect()}}
    headers: dict[str, list[str]] = {}
    for name, file in FILES.items():
        path = f"{folder}/{file}"
        if not _exists(spark, path):
            report["discrepancies"].append(f"{file} is absent")
            continue
        headers[name] = _header(spark, path)
        report["files"][name] = {"n_cols": len(headers[name]), "n_rows": spark.read.option("header", True).csv(path).count()}
    held = {name: set(columns) for name, columns in headers.items()}
    for one, two in (("train_transaction", "test_transaction"), ("train_identity", "test_identity")):
        if one in held and two in held:
            hyphens = [sorted(c for c in held[x] if c.startswith("id-")) for x in (one, two)]
            if bool(hyphens[0]) != bool(hyphens[1]):
                report["discrepancies"].append(f"{one} and {two} differ in hyphens of {', '.join(max(hyphens))}; read_csv renames them")
            plain = [{c.replace("-", "_") if c.startswith("id-") else c for c in held[x]} - {schema.TARGET} for x in (one, two)]
            if plain[0] != plain[1]:
                report["discrepancies"].append(f"{one} and {two} differ in {', '.join(sorted(plain[0] ^ plain[1]))}")
    facts, dimension = held.get("train_transaction", set()), {c.replace("-", "_") for c in held.get("train_identity", ())}
    widths = {block: sum(c in facts | dimension for c in columns) for block, columns in schema.NUMERIC_BLOCKS.items()}
    report["discrepancies"] += [f"block {b} has {widths[b]} columns of {len(columns)} declared" for b, columns in schema.NUMERIC_BLOCKS.items() if widths[b] != len(columns)]
    if absent := [c for c in schema.CATEGORICAL if c not in facts | dimension]:
        report["discrepancies"].append(f"declared categorical columns are absent: {', '.join(absent)}")
    declared = {schema.ID, schema.TIME, schema.TARGET, schema.AMOUNT, *schema.CATEGORICAL, *(c for columns in schema.NUMERIC_BLOCKS.values() for c in columns)}
    if odd := sorted((facts | dimension) - declared):
        report["discrepancies"].append(f"columns are not declared: {', '.join(odd)}")
    report |= {"target_in_train": schema.TARGET in facts, "target_in_test": schema.TARGET in held.get("test_transaction", set())}
    if "train_transaction" in held and "train_identity" in held:
        one, two = (spark.read.option("header", True).csv(f"{folder}/{FILES[x]}").select(schema.ID) for x in ("train_transaction", "train_identity"))
        report["train_identity_match_rate"] = match_rate(one, two, schema.ID).first()["match_rate"]
    return report


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(values: dict, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A small result as an aligned Markdown table: missing values as a dash, fractions with four digits.

    Raises for a result of more than ``limit`` rows; nothing is left out.
    """

    def shown(x) -> str:
        if x is None or x != x:
            return "—"
        return f"{x:.4f}" if isinstance(x, float) else str(x)

    found = df.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a table for reading has at most {limit} rows")
    rows = [[shown(x) for x in row] for row in found]
    width = [max(map(len, column)) for column in zip(df.columns, *rows)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, rows)])
