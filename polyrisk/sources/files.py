"""File sources in the reference's formats (A1 - A5).

CSV is read without schema inference (no extra pass over the data): every
column arrives as a string and only the mapped columns are cast.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from polyrisk.formats import CSV_TEXT, NON_CODE_ENTRIES, REFERENCE_NAMES
from polyrisk.functions import combo_from_text
from polyrisk.operators.scan import ranked

# The reference's raw long table: its names for the four canonical columns.
RAW_COLUMNS = {c: REFERENCE_NAMES[c] for c in ("subject_id", "episode_id", "code", "outcome")}


def read_long_csv(
    spark: SparkSession,
    path: str,
    columns: dict[str, str] | None = None,
    subject_type: str = "bigint",
) -> DataFrame:
    """Raw long table -> canonical exposure rows (duplicates kept): A1 + C1.

    ``episode_id`` stays a string (the reference only compares it for
    equality); unknown extra columns are pruned.
    """
    cols = columns or RAW_COLUMNS
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(
        F.col(cols["subject_id"]).cast(subject_type).alias("subject_id"),
        F.col(cols["episode_id"]).alias("episode_id"),
        F.col(cols["code"]).alias("code"),
        F.col(cols["outcome"]).cast("int").alias("outcome"),
    )


def read_multi_hot_csv(
    spark: SparkSession,
    path: str,
    key_columns: tuple[str, ...] = ("ID", "fin_grossesse"),
    outcome_column: str = "diagnosis",
    prefix: str = "_",
    ignore: tuple[str, ...] = ("risk",),
    subject_type: str = "bigint",
) -> DataFrame:
    """Wide 0/1 table -> episodes (subject_id, episode_id, outcome, combo, n_codes): A2.

    Each row's code set is built by one projection (no unpivot to rows x
    codes): ``array_compact`` of the codes whose cell is 1.  All-zero rows
    become empty combinations.  The column mark is removed wherever it stands,
    as in the vocabulary reader.  Without key columns (the reference drops
    them before training), a row's episode id is the hash of its content and
    its number among the rows of equal content, so it depends neither on the
    files nor on a retry.
    """
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    keys = [c for c in key_columns if c in wide.columns]
    code_cols = [c for c in wide.columns if c not in keys and c != outcome_column and c not in ignore]
    present = [
        F.when(F.col(f"`{c}`").cast("int") == 1, F.lit(c.replace(prefix, "") if prefix else c))
        for c in code_cols
    ]
    combo = F.sort_array(F.array_compact(F.array(*present))) if present else F.array().cast("array<string>")
    subject = (F.col(f"`{keys[0]}`") if keys else F.lit(None)).cast(subject_type)
    outcome = F.col(f"`{outcome_column}`").cast("int").alias("outcome")
    if len(keys) >= 2:
        out = wide.select(subject.alias("subject_id"), F.col(f"`{keys[1]}`").alias("episode_id"), outcome, combo.alias("combo"))
    else:
        out = _numbered(wide.select(subject.alias("subject_id"), outcome, combo.alias("combo")))
    return out.withColumn("n_codes", F.size("combo"))


def _numbered(rows: DataFrame, block: int = 100_000) -> DataFrame:
    """(subject_id, episode_id, outcome, combo) with ids made from each row's content.

    Equal rows are counted (partial sums map-side) and written out again with
    numbers, in blocks that are dealt out anew, so no task holds a frequent one.
    """
    content = F.sha2(F.to_json(F.struct("subject_id", "outcome", "combo")), 256)
    counts = rows.groupBy("subject_id", "outcome", "combo").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counts.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block)))).repartition("subject_id", "outcome", "combo", "_b")
    first = F.col("_b") * block
    numbers = F.explode(F.sequence(first + 1, F.least(first + block, "_n")))
    numbered = blocks.withColumn("_i", numbers)
    return numbered.select("subject_id", F.concat_ws("-", content, F.col("_i").cast("string")).alias("episode_id"), "outcome", "combo")


def read_vocabulary_json(spark: SparkSession, path: str, prefix: str = "_") -> DataFrame:
    """``{"columns": [...]}`` -> vocabulary (position 1..m, code): A3 (+ C3 strip).

    Non-code entries (risk, diagnosis) are dropped; positions keep file order.
    """
    doc = spark.read.option("multiLine", True).json(path)
    entries = doc.select(F.posexplode("columns").alias("pos", "entry"))
    codes = entries.where(~F.col("entry").isin(*NON_CODE_ENTRIES)).select(
        "pos", F.replace(F.col("entry"), F.lit(prefix), F.lit("")).alias("code")
    )
    return ranked(codes, [F.asc("pos")], "position", start=1).select("position", "code")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of ``sinks.write_csv`` under its own schema: array columns are read from their text.

    An empty text is an empty array, as a null one is written alike.
    """
    plain = StructType([StructField(f.name, StringType()) if f.dataType.typeName() == "array" else f for f in schema])
    raw = spark.read.schema(plain).options(**CSV_TEXT, multiLine=True).csv(path)
    arrays = [f.name for f in schema if f.dataType.typeName() == "array"]
    return raw.withColumns({c: combo_from_text(F.coalesce(c, F.lit(""))) for c in arrays}).select(*schema.names)


def read_trials_csv(spark: SparkSession, path: str) -> DataFrame:
    """Saved trial table (one row per trial, sorted by value): A5.

    ``hidden_dim_2`` is empty for one-layer trials and becomes NULL; the file
    carries no trial id, so ``rank`` (1-based file order) identifies rows.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    typed = raw.select(
        F.monotonically_increasing_id().alias("_order"),
        F.col("epoch").cast("int").alias("epoch"),
        F.col("activation"),
        F.col("layers").cast("int").alias("layers"),
        F.col("hidden_dim_1").cast("double").cast("int").alias("hidden_dim_1"),
        F.col("hidden_dim_2").cast("double").cast("int").alias("hidden_dim_2"),
        F.col("learning_rate").cast("double").alias("learning_rate"),
        *[F.col(c).cast("double").alias(c) for c in raw.columns if c == "learning_rate_penalty"],
        F.col("value").cast("double").alias("value"),
    )
    return ranked(typed, [F.asc("_order")], start=1).drop("_order")


def read_loss_csv(spark: SparkSession, path: str) -> DataFrame:
    """Loss curve file; accepts plain doubles and 1-tuples such as "(0.70,)": A5."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    number = F.regexp_extract(F.col("Loss_train"), r"([-+0-9.eE]+)", 1)
    return raw.select(F.col("Epoch").cast("int").alias("epoch"), number.cast("double").alias("loss_train"))


def read_best_params(spark: SparkSession, path: str) -> dict:
    """Best-parameter file (a Python dict literal, one line): A5/B5.

    A configuration file of a few bytes, parsed on the driver.
    """
    return ast.literal_eval(spark.read.text(path, wholetext=True).first().value.strip())
