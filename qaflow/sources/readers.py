"""Readers of corpora, QA sets, task files and earlier outputs. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaflow import schemas
from qaflow.functions.strings import strip
from qaflow.operators.tasks import tasks_from_rows
from qaflow.operators.validation import group_of_summary

_FORMATS = {".parquet": "parquet", ".jsonl": "json", ".json": "json"}


def _extension(path: str) -> str | None:
    tail = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return next((f for e, f in _FORMATS.items() if tail.endswith(e)), None)


def corpus_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The corpus as a file stream; offsets live in the query's checkpoint, so a restart goes on where it stopped."""
    return spark.readStream.schema(schemas.CORPUS).format(fmt).load(path)


def corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CORPUS).format(fmt).load(path)


def multihop(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Multi-hop rows; with ``split`` only that partition folder is read."""
    if split is None:
        return spark.read.schema(schemas.MULTIHOP).format(fmt).load(path)
    with_split = T.StructType([*schemas.MULTIHOP.fields, T.StructField("split", T.StringType())])
    return spark.read.schema(with_split).format(fmt).load(path).where(F.col("split") == split).drop("split")


def parquet_globs(spark: SparkSession, globs: list[str], columns: list[str] | None = None) -> DataFrame:
    """The union of glob patterns, columns pruned at the scan."""
    df = spark.read.parquet(*sorted(set(globs)))
    return df.select(*columns) if columns else df


def dataset_files(spark: SparkSession, paths: list[str], needed: list[str], schema: T.StructType | None = None, name: str = "input") -> DataFrame:
    """Parquet or JSON lines by extension; mixed extensions and missing columns are errors. A folder counts as Parquet."""
    kinds = {_extension(p) or "parquet" for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"{name} mixes formats {sorted(kinds)}")
    fmt = kinds.pop()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return schemas.require_columns(reader.format(fmt).load(sorted(set(paths))), needed, name)


def grouped_datasets(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """One input per class, all or none, tagged with the class unless the files carry it."""
    given = {k: v for k, v in paths.items() if v}
    if given and len(given) != len(paths):
        raise ValueError(f"give all of {sorted(paths)} or none")
    if not given:
        raise ValueError("no inputs")
    frames = [add_if_missing(dataset_files(spark, p, ["query", "context", "answer"], name=k), "example_type", k) for k, p in given.items()]
    return union_all(*frames)


def add_if_missing(df: DataFrame, column: str, value) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that one side lacks are null there."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def task_file(spark: SparkSession, path: str) -> DataFrame:
    """Task rows of JSON lines: bad JSON is an error, fields are stripped, rows without query or context go, keys are recomputed."""
    return tasks_from_rows(spark.read.option("mode", "FAILFAST").schema(schemas.TASK).json(path))


def earlier_outputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Outputs of this and other ranks under merged schemas, with the file that each row came from."""
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn("input_file", F.input_file_name())


def json_documents(spark: SparkSession, path: str, schema: T.StructType, name_glob: str = "*.json") -> DataFrame:
    """Whole-file JSON documents found recursively, with their folder as ``run_dir``."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name_glob)
    df = reader.schema(schema).json(path).withColumn("run_dir", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    return df.dropDuplicates(["run_dir"])


def runs_of_groups(spark: SparkSession, path: str, groups: list[str], name_glob: str = "*summary.json") -> DataFrame:
    """(run_dir, run_name, group, train_rows) of the run summaries below ``path`` that belong to one of ``groups``."""
    fields = "prompt_versions_filter array<string>, args struct<prompt_versions: string>, train_rows long"
    found = json_documents(spark, path, T.StructType.fromDDL(fields), name_glob)
    group = group_of_summary(F.col("prompt_versions_filter"), F.col("args.prompt_versions"))
    rows = found.select("run_dir", F.substring_index("run_dir", "/", -1).alias("run_name"), group.alias("group"), "train_rows")
    return rows.where(F.col("group").isin(*groups))


def prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REASONED_PREDICTION).json(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet dataset; the count comes from the footers."""
    return spark.read.parquet(path).count()


def shard(df: DataFrame, row_id: str, n: int, i: int) -> DataFrame:
    """Rows of one of ``n`` shards by row id."""
    return df.where(F.pmod(F.col(row_id), F.lit(n)) == i)


def after_offset(df: DataFrame, row_id: str, rows_seen: int) -> DataFrame:
    """Rows that an earlier run has not seen."""
    return df.where(F.col(row_id) > rows_seen)


def multihop_to_qa(df: DataFrame, mode: str = "all", cap: int = 0, source: str = "multihop") -> DataFrame:
    """Multi-hop rows as (query, context, reference_answer, source); rows without a query or a context go."""
    from qaflow.functions.docs import assemble, context_docs, supporting_pairs

    docs = context_docs(F.col("context"), df.schema["context"].dataType)
    pairs = supporting_pairs(F.col("supporting_facts"), df.schema["supporting_facts"].dataType)
    rows = df.select(
        strip(F.col("question")).alias("query"), assemble(docs, pairs, mode, cap).alias("context"), strip(F.col("answer")).alias("reference_answer"), F.lit(source).alias("source")
    )
    return rows.where("query <> '' AND context <> ''")


def corpus_to_qa(df: DataFrame, most: int = 6000, lang: str = "en") -> DataFrame:
    """Valid corpus rows as (query, truncated context, reference_answer '', source 'synth')."""
    from qaflow.functions.strings import truncate_chars
    from qaflow.operators.synth import valid_rows

    return valid_rows(df, lang).select(
        strip(F.col("query")).alias("query"), truncate_chars(F.col("query_seed_text"), most).alias("context"), F.lit("").alias("reference_answer"), F.lit("synth").alias("source")
    )


