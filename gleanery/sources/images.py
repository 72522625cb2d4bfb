"""Image folders as tables, result tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IMAGE_ENDINGS

_IMAGE = rf"(?i)\.({'|'.join(IMAGE_ENDINGS)})$"


def is_image(name: Column) -> Column:
    return name.rlike(_IMAGE)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder itself (not below it), without hidden ones: path, filename, length.

    Spark's readers also pass over names that start with an underscore.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")
    files = files.withColumn("filename", file_name(F.col("path")))
    return files.where(is_image(F.col("filename")) & ~F.col("filename").startswith("."))


def image_id(job_ref: Column, path: Column) -> Column:
    """16 hex digits that differ by job."""
    return F.substring(F.md5(F.concat(job_ref, F.lit(":"), F.regexp_replace(path, "^file:/*", "/"))), 1, 16)


def readable(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the `image` source that could be decoded, and the paths of the others."""
    return images.where("image.height > 0"), images.where("image.height <= 0").select(F.col("image.origin").alias("path"))


def read_report(images: DataFrame) -> DataFrame:
    """(job_ref, n_images, read_errors, error) of rows of the `image` source: images that can't be decoded are left out, a job without any other fails."""
    bad = F.coalesce(F.col("image.height") <= 0, F.lit(True))
    d = images.groupBy("job_ref").agg(F.count("*").alias("n_images"), F.count_if(bad).alias("read_errors"))
    return d.withColumn("error", F.when(F.col("read_errors") == F.col("n_images"), "no readable images"))


def sub_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path) of the folders right below some roots, as the file system lists them; those without files are among them."""
    found = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        found += [x.getPath().toUri().getPath() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if x.isDirectory()]
    return spark.createDataFrame([(x,) for x in sorted(set(found))], "path string")


def dataset_catalog(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(name, path, root, n_images) of the sub-folders that hold files (path), and of `folders` (path), by name.

    Folders that start with _ or . or end with _rejected are passed over; hidden files count.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    d = files.select(folder.alias("folder"), file_name(F.col("path")).alias("file"))
    if folders is not None:
        d = d.union(folders.select("path", F.lit("")))
    d = d.groupBy("folder").agg(F.count_if(is_image(F.col("file"))).alias("n_images"))
    name = file_name(F.col("folder"))
    d = d.select(name.alias("name"), F.col("folder").alias("path"), F.regexp_replace("folder", "/[^/]*$", "").alias("root"), "n_images")
    return d.where(~F.col("name").rlike(r"^[_.]|_rejected$")).orderBy("name", "path")


def read_results(results: DataFrame, job_ref: str) -> DataFrame:
    """Rows of one job by filename; broken JSON in `vl` is an empty object, in `reasons` an empty list."""
    rows = results.where(F.col("job_ref") == job_ref)
    vl, reasons = F.try_parse_json("vl"), F.from_json("reasons", "array<string>")
    return rows.withColumn("vl", F.coalesce(vl, F.parse_json(F.lit("{}")))).withColumn("reasons", F.coalesce(reasons, F.array().cast("array<string>"))).orderBy("filename")


def write_results(results: DataFrame, path: str) -> None:
    """Replaces the rows of the jobs that `results` holds; of rows with one id the latest stays (updated_at)."""
    last = Window.partitionBy("job_ref", "image_id").orderBy(F.desc("updated_at"))
    rows = results.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_ref").parquet(path)


def delete_jobs(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of a table that has job_ref, without those of deleted jobs."""
    return table.join(deleted.select("job_ref").distinct(), "job_ref", "left_anti")


def write_report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """Summary and records as JSON lines."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")


def write_split(images: DataFrame, path: str) -> None:
    """Kept and rejected rows as separate partitions of `decision`."""
    images.write.mode("overwrite").partitionBy("decision").parquet(path)
