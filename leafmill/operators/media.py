"""Images and their resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_images(images: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds src: the image's bytes as a data URI if a resource (path, mime, data) has its url, else the url."""
    found = resources.select(F.col("path").alias("url"), F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("data")).alias("_uri"))
    return images.join(found, "url", "left").withColumn("src", F.coalesce("_uri", "url")).drop("_uri")


def image_resources(images: DataFrame, files: DataFrame) -> DataFrame:
    """The different urls of each document that a file (path, data) answers; bytes are joined last."""
    return images.select("doc_id", "url").distinct().join(files.withColumnRenamed("path", "url"), "url")
