"""Named tables: corpus, evaluation questions, evaluation log, run parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RAW_COLUMNS = ("full_text", "source")


def use_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a database if it is absent and make it the current one."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{where}")
    spark.catalog.setCurrentDatabase(name)


def save_corpus(df: DataFrame, table: str) -> DataFrame:
    """Replace a table with its schema and read it back."""
    df.write.mode("overwrite").option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def project_corpus(corpus: DataFrame) -> DataFrame:
    """Only the columns that indexing needs."""
    return corpus.select(*RAW_COLUMNS)


def ensure_questions(questions: DataFrame, table: str) -> DataFrame:
    """Write the evaluation questions unless the table is already there."""
    spark = questions.sparkSession
    if not spark.catalog.tableExists(table):
        questions.write.mode("ignore").saveAsTable(table)
    return spark.table(table)


def append_log(rows: DataFrame, table: str) -> None:
    """Add runs to a table that keeps one partition per ``run_id`` and ``run_name``.

    A run that is logged again, as by a job that is repeated, replaces its own
    partitions and no others.
    """
    keys = ["run_id", "run_name"]
    ordered = rows.select(*[c for c in rows.columns if c not in keys], *keys)
    spark = rows.sparkSession
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in ordered.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({', '.join(keys)})")
    # An insert would take the mode from the session, which other threads share;
    # a write to the folder has it as an option of its own.
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'")
    folder = described.first()["data_type"]
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def parameter_rows(settings: DataFrame, run_name: str) -> DataFrame:
    """Turn a one-row-per-run frame of settings into ``(run_name, key, value)``."""
    names = [name for name in settings.columns if name != run_name]
    pairs = [F.struct(F.lit(name).alias("key"), F.col(name).cast("string").alias("value")) for name in names]
    return (
        settings.select(F.col(run_name).alias("run_name"), F.explode(F.array(*pairs)).alias("pair"))
        .select("run_name", "pair.key", "pair.value")
        .where(F.col("value").isNotNull())
    )
