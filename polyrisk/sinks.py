"""Writers for the reference's output files (B1-B8) and the wide multi-hot form.

Parquet of the long/array tables is the default storage; CSV writers exist
for the file formats the reference produced.  Writers never coalesce to one
file: a 100 TB job writes one file per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.formats import CODE_PREFIX, CSV_TEXT, REFERENCE_NAMES
from polyrisk.functions import combo_identity


def with_reference_names(df: DataFrame) -> DataFrame:
    """Rename canonical columns to the reference's file column names."""
    for ours, theirs in REFERENCE_NAMES.items():
        if ours in df.columns:
            df = df.withColumnRenamed(ours, theirs)
    return df


def vocabulary_codes(vocab: DataFrame) -> list[str]:
    """Ordered code list of a vocabulary: the header of the wide table, one entry a column."""
    return [r.code for r in vocab.orderBy("position").select("code").collect()]


def multi_hot(episodes: DataFrame, vocab: DataFrame, prefix: str = "_") -> DataFrame:
    """Wide 0/1 table, one column per vocabulary code, in vocabulary order: E2/B1.

    Built from the episode arrays by ``array_contains`` (a projection, no
    pivot shuffle); absent codes are 0 (zero-fill), unknown codes are not
    columns (lenient alignment).
    """
    codes = vocabulary_codes(vocab)
    cols = [F.array_contains("combo", c).cast("int").alias(f"{prefix}{c}") for c in codes]
    return episodes.select("subject_id", "episode_id", "outcome", *cols)


def write_episodes(episodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Canonical episodes as Parquet (the default replacement of B1)."""
    episodes.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; arrays become one text each, which names them.  B2, B3, B4, B6, B7.

    ``sources.files.read_csv`` gives the arrays back, whatever their codes hold.
    """
    out = df
    for field in df.schema.fields:
        if field.dataType.typeName() == "array":
            out = out.withColumn(field.name, combo_identity(field.name))
    out.write.mode(mode).options(**CSV_TEXT).csv(path)


def write_screens(screen: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The three screening outputs in one write, one folder per screen: B3."""
    screen.where(F.col("screen").isNotNull()).write.mode(mode).partitionBy("screen").option(
        "header", True
    ).csv(path)


def write_multi_hot_csv(episodes: DataFrame, vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The reference's wide CSV layout: keys, outcome, one 0/1 column per code: B1."""
    multi_hot(episodes, vocab).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row (best parameters B5)."""
    df.write.mode(mode).json(path)


def write_vocabulary_json(vocab: DataFrame, path: str, mode: str = "overwrite", prefix: str = CODE_PREFIX) -> None:
    """``{"columns": [...]}``: the marked code columns in vocabulary order, one document."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "code")))
    names = F.transform(ordered, lambda x: F.concat(F.lit(prefix), x["code"]))
    vocab.agg(names.alias("columns")).write.mode(mode).json(path)
