"""Where rows come from and go to: Parquet tables, raw pages, and sinks that take each batch once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a page that become elements.
BLOCK = r"(?is)<(h[1-6]|p|li|figcaption|td|th)\b[^>]*>(.*?)</(?:h[1-6]|p|li|figcaption|td|th)>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1000) -> DataFrame:
    """The files of a table as a stream, ``files`` of them in a batch at most. The path is a pattern, as a table may be a single file."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def plain_text(html: Column) -> Column:
    """Text without tags, the usual entities read, white space made single."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_elements(pages: DataFrame) -> DataFrame:
    """page_id, place, element_type, level, text of the blocks of raw pages (page_id, html), in their order; empty ones are left out."""
    tags, bodies = F.regexp_extract_all("html", F.lit(BLOCK), 1), F.regexp_extract_all("html", F.lit(BLOCK), 2)
    blocks = pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), bodies.alias("body"))).alias("place", "b"))
    tag = F.lower("b.tag")
    kind = F.when(tag.rlike("^h[1-6]$"), "HEADING").when(tag == "li", "LIST").when(tag == "figcaption", "CAPTION").when(tag.isin("td", "th"), "TABLE").otherwise("PARAGRAPH")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return blocks.select("page_id", "place", kind.alias("element_type"), level.alias("level"), plain_text(F.col("b.body")).alias("text")).where("text <> ''")
