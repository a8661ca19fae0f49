"""Content and workspace sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpencil.functions import text as tx

PRIMARY_CARD = "artboard_caption"

WORKSPACE_SCHEMA = """
  id string, name string, kind string, created_at string, updated_at string,
  caption struct<id:string,platform:string,text:string>,
  artboards array<struct<id:string,format:string,kind:string,label:string,width:double,height:double,text:string,
    layers:array<struct<id:string,asset_id:string,slot_id:string,x:double,y:double,width:double,height:double,fit_mode:string>>>>,
  assets array<struct<id:string,filename:string,width:int,height:int,hash:string,url:string,ocr_status:string,
    ocr_boxes:array<struct<box_id:string,text:string,confidence:double,bbox:array<double>>>>>
"""

CARD_KIND = ("coalesce(kind, case format when 'caption' then 'caption' when 'note' then 'note' else 'visual' end)")


def read_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """S3: workspace documents with an explicit schema and inferred kind."""
    ws = spark.read.schema(WORKSPACE_SCHEMA).json(path, multiLine=True)
    check = "trim(coalesce(name, '')) rlike '(?i)^check\\\\b' or coalesce(id, '') rlike '(?i)^check_'"
    return ws.withColumn("kind", F.expr(f"coalesce(kind, if({check}, 'check', 'project'))"))


def write_workspaces(ws: DataFrame, path: str) -> None:
    """One directory per workspace; a later write replaces those it holds and leaves the others."""
    (ws.withColumn("workspace_id", F.col("id")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").json(path))


def artboards(ws: DataFrame) -> DataFrame:
    a = ws.select(F.col("id").alias("workspace_id"), F.posexplode("artboards").alias("ord", "a"))
    return a.select("workspace_id", "ord", F.col("a.id").alias("artboard_id"), "a.format", "a.kind", "a.label",
                    "a.width", "a.height", "a.text", "a.layers").withColumn("kind", F.expr(CARD_KIND))


def layers(ws: DataFrame) -> DataFrame:
    return (artboards(ws).select("workspace_id", "artboard_id", "ord", F.explode("layers").alias("l"))
            .select("workspace_id", "artboard_id", "ord", F.col("l.id").alias("layer_id"), "l.asset_id", "l.slot_id",
                    "l.x", "l.y", "l.width", "l.height", "l.fit_mode"))


def content(ws: DataFrame) -> DataFrame:
    """The primary caption and all caption cards but its placeholder."""
    primary = ws.select(F.col("id").alias("workspace_id"), F.lit("caption").alias("source_type"),
                        F.col("caption.id").alias("source_id"), F.lit(None).cast("string").alias("artboard_id"),
                        F.lit(-1).alias("ord"), F.col("caption.text").alias("text"))
    cards = (artboards(ws).where(f"kind = 'caption' and artboard_id <> '{PRIMARY_CARD}'")
             .select("workspace_id", F.lit("caption").alias("source_type"), F.col("artboard_id").alias("source_id"),
                     "artboard_id", "ord", F.coalesce("text", F.lit("")).alias("text")))
    return clean(primary.unionByName(cards))


def clean(df: DataFrame) -> DataFrame:
    """Ingest step for any text table: keep the engine's sentinels out."""
    return df.withColumn("text", F.expr(tx.strip_reserved("text")))


def scoped(df: DataFrame, artboard_id: str | None) -> DataFrame:
    """One card only."""
    if artboard_id is None:
        return df
    return df.where(F.col("artboard_id").isNull() if artboard_id == PRIMARY_CARD
                    else F.col("artboard_id") == artboard_id)


def boxes(ws: DataFrame, artboard_id: str | None = None) -> DataFrame:
    """Text boxes of all assets, or of those used by one card."""
    a = ws.select(F.col("id").alias("workspace_id"), F.explode("assets").alias("a"))
    if artboard_id is not None:
        used = layers(ws).where(F.col("artboard_id") == artboard_id).select("workspace_id", F.col("asset_id").alias("_u"))
        a = a.join(used, (a["workspace_id"] == used["workspace_id"]) & (F.col("a.id") == F.col("_u")), "left_semi")
    b = a.select("workspace_id", F.col("a.id").alias("asset_id"), F.posexplode("a.ocr_boxes").alias("ord", "b"))
    return b.select(
        "workspace_id", "asset_id", F.col("ord").cast("bigint").alias("ord"), "b.box_id", "b.text", "b.confidence",
        F.struct(*[F.col("b.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).alias("bbox"))


# Upload limits of one file and of one batch.
MAX_FILE, MAX_BATCH = 10 * 1024 * 1024, 40 * 1024 * 1024


def upload_filter(files: DataFrame, max_file: int = MAX_FILE, max_batch: int = MAX_BATCH) -> DataFrame:
    """Images up to ``max_file`` bytes, in batches up to ``max_batch``.

    ``files``: (batch_id, path, length).  A batch with any bad file is refused.
    Batches are summed up before anything is shuffled, then met by their id.
    """
    bad = F.expr(f"not lower(path) rlike '[.](png|jpe?g|webp)$' or length > {max_file}")
    good = (files.groupBy("batch_id").agg(F.max(bad.cast("int")).alias("_bad"), F.sum("length").alias("_sum"))
            .where(f"_bad = 0 and _sum <= {max_batch}").select("batch_id"))
    return files.join(good, "batch_id", "left_semi").select(*files.columns)


def ingest_assets(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One asset per distinct content; already known hashes are skipped.

    ``files``: (path, content BINARY) as read by the binaryFile source.
    """
    hashed = files.select("path", F.sha2("content", 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("path").alias("path"))
    if known is not None:
        first = first.join(known.select("hash"), "hash", "left_anti")
    return first.select(F.concat(F.lit("asset_"), F.substring("hash", 1, 12)).alias("asset_id"), "hash",
                        F.substring_index("path", "/", -1).alias("filename"), F.lit("pending").alias("ocr_status"))
