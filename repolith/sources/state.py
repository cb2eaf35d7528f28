"""Tables of trees, jobs, caches and run metadata as JSON and text: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

JOBS = "job_id string, repo_url string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, error_message string, progress string, docs_path string, main_model string, commit_id string"
CACHE = "repo_url string, repo_url_hash string, docs_path string, created_at timestamp, last_accessed timestamp"
METADATA = (
    "generation_info struct<timestamp: string, main_model: string, generator_version: string, repo_path: string, commit_id: string>, "
    "statistics struct<total_components: int, leaf_nodes: int, max_depth: int>, files_generated array<string>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where there is no file."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


#: Fixed value: the tree of a run that has written none.
NO_TREE = '{"Overview": {"description": "Repository overview", "components": [], "children": {}}}'


def read_module_tree(spark: SparkSession, path: str, overview: bool = True) -> DataFrame:
    """(tree): the JSON text at ``path``. Without a file it is the overview alone, or with ``overview`` false null, as it then is
    for a text that is no JSON, too; with ``overview`` such a text is an error."""
    try:
        content = spark.read.text(path, wholetext=True).select(F.col("value").alias("tree"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.range(1).select(F.lit(NO_TREE if overview else None).cast("string").alias("tree"))
    parsed = F.parse_json("tree") if overview else F.try_parse_json("tree")
    return content.select(F.to_json(parsed).alias("tree"))


def completed_jobs(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, JOBS).filter("status = 'completed'")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CACHE)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, METADATA)


def write_json(df: DataFrame, path: str) -> None:
    """Committed as a whole or not at all."""
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str) -> None:
    """A text column ``content`` in files partitioned by ``name``."""
    df.select("name", "content").write.mode("overwrite").partitionBy("name").text(path)


def dependency_graph(components: DataFrame, deps: DataFrame) -> DataFrame:
    """One JSON text for each component: its fields and sorted depends_on."""
    lists = deps.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    rows = components.join(lists, "id", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
    return rows.select("id", F.to_json(F.struct("*")).alias("component"))


def metadata(components: DataFrame, leaves: DataFrame, modules: DataFrame, docs: DataFrame, info: dict[str, str]) -> DataFrame:
    """The one row of a run's metadata."""
    one = lambda df, c: df.agg(c).withColumn("one", F.lit(1))
    row = one(components, F.count("*").cast("int").alias("total_components")).join(one(leaves, F.count("*").cast("int").alias("leaf_nodes")), "one")
    row = row.join(one(modules, F.coalesce(F.max("depth") + 1, F.lit(0)).cast("int").alias("max_depth")), "one")
    row = row.join(one(docs, F.array_sort(F.collect_set("filename")).alias("files_generated")), "one")
    generation = F.struct(*[F.lit(info.get(k)).cast("string").alias(k) for k in ("timestamp", "main_model", "generator_version", "repo_path", "commit_id")])
    return row.select(generation.alias("generation_info"), F.struct("total_components", "leaf_nodes", "max_depth").alias("statistics"), "files_generated")


def filled(template: DataFrame, values: dict[str, str]) -> DataFrame:
    """``template`` (content) with each {{NAME}} replaced, in order."""
    content = F.col("content")
    for name, value in values.items():
        content = F.replace(content, F.lit("{{" + name + "}}"), F.lit(value))
    return template.withColumn("content", content)
