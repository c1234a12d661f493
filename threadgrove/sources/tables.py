"""Reading and writing the tables of a curation project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from threadgrove import schemas
from threadgrove.functions.text import fraction_of

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A table with an explicit schema.

    CSV texts may contain line breaks, so one CSV file is one task; use many files, or parquet, which
    splits and prunes columns. An empty CSV field reads as NULL.
    """
    reader = spark.read.schema(schema)
    return reader.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, when the input has fewer partitions than there are cores.

    A few large files that cannot be split would otherwise leave most of the cluster idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("quoteAll", "true").csv(path)


def read_threads(spark: SparkSession, posts: str, comments: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(posts, comments); ids are strings whatever they look like."""
    return read_table(spark, posts, schemas.POSTS, fmt), read_table(spark, comments, schemas.COMMENTS, fmt)


def read_labelled(spark: SparkSession, train: str, test: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(train, test) tables of labelled texts."""
    return read_table(spark, train, schemas.LABELLED, fmt), read_table(spark, test, schemas.LABELLED, fmt)


# ---- pairs ----------------------------------------------------------------------------------------

# fixed values: accepted column names, in order of preference
ANCHOR_NAMES = ["anchor_content", "anchor_text", "anchor_texts", "anchor", "text", "input_text", "content"]
POSITIVE_NAMES = ["positive_content", "positive_text_ds1", "positive_text", "positive_texts", "positive", "target_text"]
LIST_NAMES = ["positive_content_list", "positive_content_lists_ds2", "positive_content_lists"]


def pair_format(df: DataFrame) -> str:
    """'with_metadata' for documents with a `samples` array, 'rows' for one row per pair."""
    return "with_metadata" if "samples" in df.columns else "rows"


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pairs as rows, from either format. Metadata belongs in the `round_info` table."""
    df = spark.read.format(fmt).load(path)
    if pair_format(df) == "with_metadata":
        df = df.select(F.explode("samples").alias("_s")).select("_s.*")
    if not set(df.columns) & set(ANCHOR_NAMES):
        raise ValueError(f"no pair columns in {df.columns}")
    return df


def _first_of(df: DataFrame, names: list[str]) -> Column:
    found = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalise_pairs(df: DataFrame) -> DataFrame:
    """sample_index, anchor_content, positive_content, dataset_type, subtree_size from any known layout.

    The type follows `pair_type`: parent/child pairs are dataset1, node/centre pairs dataset2 (their
    text list is joined by blanks), single texts are simcse (anchor = positive). Without the column
    the layout decides. Rows without both texts are dropped; `unreadable_pairs` counts them. Node/centre pairs that
    name their centre by key have (post_id, root_id) instead of a positive text and keep these columns.
    """
    kind = F.col("pair_type") if "pair_type" in df.columns else F.lit(None).cast("string")
    anchor, positive, texts = _first_of(df, ANCHOR_NAMES), _first_of(df, POSITIVE_NAMES), _first_of(df, LIST_NAMES)
    has_list = any(c in df.columns for c in LIST_NAMES)
    joined = F.array_join(F.filter(texts, lambda x: x != ""), " ") if has_list else F.lit(None).cast("string")
    size = F.size(texts).cast("bigint") if has_list else F.lit(None).cast("bigint")
    single = F.coalesce(F.col("content"), F.lit("")) if "content" in df.columns else anchor
    by_layout = (F.when(positive.isNotNull(), "dataset1").when(joined.isNotNull(), "dataset2")
                 .when(F.lit("content" in df.columns) & single.isNotNull(), "simcse").otherwise("unknown"))
    dtype = (F.when(kind == "parent_child", "dataset1").when(kind == "node_center", "dataset2")
             .when(kind == "simcse_single_text", "simcse").when(kind == "enhanced_pair", "dataset1").otherwise(by_layout))
    by_key = "root_id" in df.columns
    if by_key:
        size = F.coalesce(size, F.col("subtree_size").cast("bigint"))
    center = F.lit(by_key) & (dtype == "dataset2") & (F.col("root_id") if by_key else F.lit(None)).isNotNull()
    both = df.select(
        *(["post_id", "root_id"] if by_key else []), center.alias("_center"),
        F.col("sample_index").cast("bigint").alias("sample_index"), dtype.alias("dataset_type"),
        F.when(dtype == "simcse", single).otherwise(anchor).alias("anchor_content"),
        F.when(dtype == "simcse", single).when(dtype == "dataset2", joined).otherwise(positive).alias("positive_content"),
        F.when(dtype == "dataset2", size).alias("subtree_size"))
    blank = r"(?U)\A\s*\z"
    text = F.col("positive_content").isNotNull() & ~((F.col("dataset_type") == "dataset2") & F.col("positive_content").rlike(blank))
    return both.filter(F.col("anchor_content").isNotNull() & (F.col("_center") | text)
                       & ~((F.col("dataset_type") == "simcse") & (F.col("anchor_content") == ""))).drop("_center")


def unreadable_pairs(df: DataFrame) -> DataFrame:
    """One row: pairs in all, and those that `normalise_pairs` drops."""
    kept = normalise_pairs(df).select(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(F.count(F.lit(1)).alias("pairs")).select("pairs", (F.col("pairs") - kept).alias("dropped"))


def write_pairs(df: DataFrame, path: str, strategy: str, threshold: float) -> None:
    """Write the pairs of one (strategy, threshold) partition; rerunning replaces only it."""
    (df.withColumn("strategy", F.lit(strategy)).withColumn("threshold", F.lit(float(threshold))).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "threshold").parquet(path))


# ---- runs -----------------------------------------------------------------------------------------

def read_runs(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """One row per run from JSON maps of `<model>_frac<fraction>` to a list of runs.

    Every line is a map, or with `whole_file` every file (an indented document).
    """
    doc = spark.read.option("wholetext", whole_file).text(path).select(F.from_json("value", schemas.RUN_RESULTS).alias("m"))
    rows = doc.select(F.explode("m").alias("model_fraction", "_runs")).select("model_fraction", F.explode("_runs").alias("_r"))
    return rows.select("model_fraction", F.split("model_fraction", "_frac")[0].alias("model_name"),
                       fraction_of("model_fraction").alias("data_fraction"), "_r.*")


def write_runs(runs: DataFrame, path: str) -> None:
    """JSON maps, one per line, each with a list of the runs of one key with neighbouring run indexes.

    A list covers 1000 run indexes, so no line grows with the table.
    """
    fields = [f.name for f in schemas.RUN.fields]
    lists = runs.groupBy("model_fraction", F.floor(F.col("run_idx") / 1000).alias("_part")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_l"))
    lists.select(F.to_json(F.create_map("model_fraction", "_l")).alias("value")).write.mode("overwrite").text(path)


# ---- reports --------------------------------------------------------------------------------------

def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> None:
    """Write a result table as CSV or JSON. `single_file` is for tables that fit in one task."""
    out = df.coalesce(1) if single_file else df
    if fmt == "csv":
        write_csv(out, path)
    else:
        out.write.mode("overwrite").format(fmt).save(path)
