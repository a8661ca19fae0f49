"""Sources and sinks: what is written is read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import table
from checks.tables import _workspaces
from redpencil.session import shared_folder
from redpencil.sources import content as src
from redpencil.sources import lexicons as lx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn
    return add


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FIRST = "select conv_id, arg_min(text, turn) as text, arg_min(role, turn) as role, count(*) as turns from conversations group by conv_id"


@register("workspace_round_trip", f"""select cast(conv_id as varchar) as id, case when turns > 2 then concat('Second ', text) when role = 'user' then concat('Check ', text) else text end as name,
  case when turns <= 2 and role = 'user' then 'check' else 'project' end as kind, text as caption, turns as cards from ({_FIRST})""")
def _(spark, d):
    """All workspaces are written, those with several cards once more under another name; all are read back, kinds inferred."""
    ws = _workspaces(spark, d).withColumn("created_at", F.lit("2024")).withColumn("updated_at", F.lit("2024"))
    named = ws.withColumn("name", F.expr("if(artboards[0].label = 'user', concat('Check ', caption.text), caption.text)"))
    path = _folder(spark, "workspaces")
    src.write_workspaces(named, path)
    src.write_workspaces(ws.where("size(artboards) > 2").withColumn("name", F.expr("concat('Second ', caption.text)")), path)
    return src.read_workspaces(spark, f"{path}/*").select(
        "id", "name", "kind", F.col("caption.text").alias("caption"), F.size("artboards").cast("long").alias("cards"))


@register("box_scan", """select cast(conv_id as varchar) as workspace_id, concat('as', conv_id, '-', turn) as asset_id, i as ord, concat('b', i) as box_id,
  piece as text, cast(i as double) as x0, cast(i + 9 as double) as x1 from (select conv_id, turn, unnest(string_split(text, ' ')) as piece,
  unnest(range(len(string_split(text, ' ')))) as i from conversations)""")
def _(spark, d):
    """Every word of every turn is a box of the turn's image; the scan unnests them with their places."""
    x, i = "x", "i"
    asset = F.struct(F.concat(F.lit("as"), "conv_id", F.lit("-"), "turn").alias("id"), F.expr(
        f"transform(split(text, ' '), ({x}, {i}) -> named_struct('box_id', concat('b', {i}), 'text', {x}, 'confidence', 0.9D, "
        f"'bbox', array(cast({i} as double), 0D, cast({i} + 9 as double), 9D)))").alias("ocr_boxes"))
    ws = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.collect_list(asset).alias("assets"))
    return src.boxes(ws).select("workspace_id", "asset_id", "ord", "box_id", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"))


_PAIR = "select concat(p_name, ', \"', p_partkey, '\"') as wrong, p_brand as right from part"


@register("terminology_round_trip", f"{_PAIR} union all select p_type, p_name from part where p_type <> ''")
def _(spark, d):
    """Pairs with commas and quotes go to CSV and come back; comments and the header do not."""
    p = table(spark, d, "part")
    quoted = p.select(F.expr("concat(p_name, ', \"', p_partkey, '\"')").alias("wrong"), F.col("p_brand").alias("right"))
    plain = p.select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("wrong"), F.col("p_name").alias("right"))
    # lines that others wrote by hand: comments, blank lines, a side left out
    by_hand = p.select(F.explode(F.array(F.concat(F.lit("# "), "p_name", F.lit(",x")), F.lit(""), F.concat("p_name", F.lit(",")))).alias("value"))
    path, more = _folder(spark, "terms"), _folder(spark, "terms-by-hand")
    lx.write_pairs_csv(quoted.unionByName(plain), path)
    by_hand.write.text(more)
    return lx.read_terminology_csv(spark, [path, more]).select("wrong", "right")


@register("style_notes", "select md5(concat(text, chr(10))) as notes, length(text) + 1 as n from benchmark")
def _(spark, d):
    """One file for each text, read whole."""
    path = _folder(spark, "notes")
    table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return lx.read_style_notes(spark, path).select(F.md5("notes").alias("notes"), F.length("notes").cast("long").alias("n"))
