"""Decisions, scopes and invalidation over issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.lexicon import MAP_LISTS
from redpencil.sources.lexicons import layered

NARROW = ["workspace_id", "source_type", "source_id", "original", "suggestion"]
WIDE = ["workspace_id", "source_type", "source_id", "artboard_id", "box_id", "original", "suggestion"]


def latest_decisions(decisions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """C4: one status per key, the latest by time (map-side combined)."""
    key = key or NARROW
    return decisions.groupBy(*key).agg(F.max_by("status", "ts").alias("status"))


def carry_over(issues: DataFrame, decisions: DataFrame, statuses=("accepted", "ignored"),
               key: list[str] | None = None) -> DataFrame:
    """Re-apply earlier human decisions to fresh issues."""
    key = key or NARROW
    prior = latest_decisions(decisions, key).where(F.col("status").isin(*statuses))
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    j = issues.alias("i").join(prior.alias("d"), same, "left")
    return j.select(*[F.coalesce("d.status", "i.status").alias("status") if c == "status" else F.col(f"i.{c}")
                      for c in issues.columns])


def replace_scope(old: DataFrame, new: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Keep rows outside the targets, take the new rows inside them."""
    t = targets.select(*key).distinct()
    return old.join(t, key, "left_anti").unionByName(new.join(t, key, "left_semi"))


def replace_by_id(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Field-wise upsert."""
    others = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in others])


def fingerprint(*columns: str) -> Column:
    """Content identity."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def split_stale(results: DataFrame, current: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Results whose fingerprint still holds, and the rejected rest."""
    now = current.select(*key, F.col("fingerprint").alias("_now"))
    j = results.join(now, key, "left")
    fresh = j.where("fingerprint <=> _now").drop("_now")
    return fresh, j.where("not (fingerprint <=> _now)").drop("_now")


def cache_key(role: str, version: str, content: str, lexicon: str) -> Column:
    """J21."""
    return F.sha2(F.to_json(F.struct(
        F.lit("1").alias("version"), F.lit(role).alias("role"), F.lit(version).alias("prompt"),
        F.col(content).alias("content"), F.col(lexicon).alias("lexicon"))), 256)


def cache_misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work that has no cached result yet; equal keys are computed once."""
    return work.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def add_terms(issues: DataFrame, terms: DataFrame) -> DataFrame:
    """Issues equal to a dictionary decision become ignored."""
    t = terms.select("original", "suggestion").distinct().withColumn("_hit", F.lit(True))
    j = issues.join(t, ["original", "suggestion"], "left")
    return j.withColumn("status", F.when(F.col("_hit"), "ignored").otherwise(F.col("status"))).select(*issues.columns)


# Lists of pairs; the others hold single terms.
PAIR_LISTS = (*MAP_LISTS, "legacy_names", "risky_words")


def append_terms(lexicon: DataFrame, additions: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The lexicon with new terms, and the additions that lack a side, with ``reject_reason``.

    A pair replaces the right side of an equal wrong side in its place; a term that its list holds is
    not added again; new entries follow the last of their list in their own order.
    ``lexicon``: list, wrong, right, priority, ord; ``additions``: list, wrong, right, ord.
    """
    by = by or []
    pair = F.col("list").isin(*PAIR_LISTS)
    good = "coalesce(trim(right), '') <> '' and (not _pair or coalesce(trim(wrong), '') <> '')"
    new = additions.withColumn("_pair", pair)
    rejects = new.where(f"not ({good})").drop("_pair").withColumn("reject_reason", F.lit("missing_side"))
    new = new.where(good).select(
        *by, "list", F.expr("if(_pair, trim(wrong), null)").alias("wrong"), F.expr("trim(right)").alias("right"),
        F.expr("if(list = 'risky_words', 'medium', null)").alias("priority"), F.lit(1).alias("layer_ord"),
        F.col("ord").cast("bigint").alias("ord"))
    old = lexicon.select(*by, "list", "wrong", "right", "priority", F.lit(0).alias("layer_ord"), F.col("ord").cast("bigint").alias("ord"))
    last = old.groupBy(*by, "list").agg(F.max("ord").alias("_last"))
    both = layered(old.unionByName(new), by).join(F.broadcast(last) if not by else last, [*by, "list"], "left")
    return both.select(*by, "list", "wrong", "right", "priority",
                       F.expr("if(layer_ord = 0, ord, coalesce(_last, -1) + 1 + ord)").alias("ord")), rejects


def first_artboard(layers: DataFrame, artboards: DataFrame) -> DataFrame:
    """The first artboard that uses an asset."""
    j = layers.select("asset_id", "artboard_id").join(artboards.select("artboard_id", "ord"), "artboard_id")
    return j.groupBy("asset_id").agg(F.min_by("artboard_id", "ord").alias("artboard_id"))


def panel_scope(issues: DataFrame, artboards: DataFrame, layers: DataFrame) -> DataFrame:
    """Issues whose artboard or asset belongs to the project."""
    boards = artboards.select(F.col("artboard_id").alias("_a")).distinct()
    used = (layers.join(artboards.where("kind = 'visual'").select("artboard_id"), "artboard_id", "left_semi")
            .select(F.col("asset_id").alias("_s")).distinct())
    j = (issues.join(boards.withColumn("_in_board", F.lit(True)), F.col("artboard_id") == F.col("_a"), "left")
         .join(used.withColumn("_in_asset", F.lit(True)), F.col("source_id") == F.col("_s"), "left"))
    keep = ("case source_type when 'caption' then artboard_id is null or _in_board is not null "
            "when 'image' then _in_board is not null or _in_asset is not null "
            "else _in_board is not null end")
    return j.where(keep).select(*issues.columns)


def invalidate(issues: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """Edited content loses its issues, except the ignored ones."""
    hit = changed.select(*key).distinct().withColumn("_changed", F.lit(True))
    return issues.join(hit, key, "left").where("_changed is null or status = 'ignored'").select(*issues.columns)


def drop_assets(issues: DataFrame, deleted: DataFrame) -> DataFrame:
    """Issues of deleted images go."""
    gone = deleted.select(F.lit("image").alias("source_type"), F.col("asset_id").alias("source_id"))
    return issues.join(gone, ["source_type", "source_id"], "left_anti")


def drop_cards(issues: DataFrame, deleted: DataFrame) -> DataFrame:
    """Open issues of deleted cards go."""
    gone = deleted.select("artboard_id").distinct().withColumn("_gone", F.lit(True))
    return (issues.join(gone, "artboard_id", "left").where("_gone is null or status <> 'open'")
            .select(*issues.columns))


def card_labels(issues: DataFrame, artboards: DataFrame, layers: DataFrame) -> DataFrame:
    """Card key, title and position of every issue; a key is good within its workspace."""
    own = artboards.select(F.col("artboard_id").alias("_a"), F.col("label").alias("_al"), F.col("ord").alias("_ao"))
    via = (first_artboard(layers, artboards).select(F.col("asset_id").alias("_s"), F.col("artboard_id").alias("_va"))
           .join(artboards.select(F.col("artboard_id").alias("_va"), F.col("label").alias("_vl"),
                                  F.col("ord").alias("_vo")), "_va"))
    j = (issues.join(own, F.col("artboard_id") == F.col("_a"), "left")
         .join(via, (F.col("source_type") == "image") & F.col("artboard_id").isNull()
               & (F.col("source_id") == F.col("_s")), "left"))
    return j.select(
        *issues.columns,
        F.expr("case source_type when 'caption' then concat('caption:', coalesce(artboard_id, 'primary')) "
               "when 'image' then coalesce(concat('artboard:', coalesce(_a, _va)), 'image-check') "
               "else coalesce(concat('layout:', _a), 'layout') end").alias("card_key"),
        F.expr("case source_type when 'caption' then coalesce(_al, 'Caption Input 1') "
               "when 'image' then coalesce(_al, _vl, 'Visual Text Scanner') "
               "else coalesce(_al, 'Layout') end").alias("card_title"),
        F.expr("case source_type when 'caption' then if(artboard_id is null, -10, coalesce(_ao, 1000)) "
               "when 'image' then coalesce(_ao, _vo, 900) else coalesce(_ao, 950) end").alias("card_order"))
