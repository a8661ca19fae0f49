"""Lexicon sources (S9-S16) and layering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import lit
from redpencil.lexicon import MAP_LISTS, TERM_LISTS

PAIR_SCHEMA = "wrong string, right string"
KIT_SCHEMA = ", ".join(
    [f"{n} array<string>" for n in (*TERM_LISTS, "do_not_translate")]
    + [f"{n} map<string,string>" for n in MAP_LISTS]
    + ["risky_words map<string,struct<priority:string,suggestion:string>>"])


def read_terminology_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Wrong,right pairs; comments, blanks and the header are dropped."""
    df = spark.read.csv(path, schema=PAIR_SCHEMA, comment="#", ignoreLeadingWhiteSpace=True,
                        ignoreTrailingWhiteSpace=True)
    return df.where("wrong <> '' and right <> '' and lower(wrong) <> 'wrong'")


def kit_rows(kits: DataFrame, json_column: str = "json") -> DataFrame:
    """Brand-kit JSON documents -> lexicon rows; bad entries are dropped."""
    carry = [c for c in kits.columns if c != json_column]
    k = kits.select(*carry, F.from_json(json_column, KIT_SCHEMA).alias("k"))
    out = None
    for name in TERM_LISTS:
        src = F.col(f"k.{name}") if name != "do_not_change" else F.coalesce("k.do_not_change", "k.do_not_translate")
        part = k.select(*carry, F.lit(name).alias("list"), F.posexplode(src).alias("ord", "right")).select(
            *carry, "list", F.lit(None).cast("string").alias("wrong"), "right",
            F.lit(None).cast("string").alias("priority"), "ord")
        out = part if out is None else out.unionByName(part)
    for name in MAP_LISTS:
        out = out.unionByName(
            k.select(*carry, F.lit(name).alias("list"), F.posexplode(f"k.{name}").alias("ord", "wrong", "right"))
            .select(*carry, "list", "wrong", "right", F.lit(None).cast("string").alias("priority"), "ord"))
    risky = k.select(*carry, F.posexplode("k.risky_words").alias("ord", "wrong", "v")).select(
        *carry, F.lit("risky_words").alias("list"), "wrong", F.col("v.suggestion").alias("right"),
        F.expr("if(v.priority in ('high', 'low'), v.priority, 'medium')").alias("priority"), "ord")
    return out.unionByName(risky).where("trim(right) <> '' and (wrong is null or trim(wrong) <> '')")


def read_brand_kit(spark: SparkSession, path: str) -> DataFrame:
    return kit_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def read_style_notes(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """Style guides, whole or up to ``max_chars`` characters each."""
    notes = spark.read.text(path, wholetext=True).select(F.col("value").alias("notes"))
    return notes if max_chars is None else notes.select(F.substring("notes", 1, max_chars).alias("notes"))


def clean_document(x: str, max_chars: int | None = None) -> str:
    """Line ends, trailing blanks, blank-line runs; whole or up to ``max_chars`` characters."""
    x = f"regexp_replace({x}, {lit(chr(92) + 'r' + chr(92) + 'n?')}, '\\n')"
    x = f"regexp_replace({x}, {lit('[ ' + chr(92) + 't]+' + chr(92) + 'n')}, '\\n')"
    x = f"regexp_replace({x}, {lit(chr(92) + 'n{4,}')}, '\\n\\n\\n')"
    return tx.trim_ws(x) if max_chars is None else f"substring({tx.trim_ws(x)}, 1, {max_chars})"


def pairs_from_text(docs: DataFrame, id_col: str, max_chars: int | None = None) -> DataFrame:
    """Lines like ``wrong -> right`` (bullets and comments aside), with sides of any length or up to ``max_chars``."""
    line = docs.select(id_col, F.posexplode(F.split("text", "\r?\n")).alias("ord", "line"))
    line = line.withColumn("line", F.expr(f"regexp_replace({tx.trim_ws('line')}, {lit(f'^[-*•]{tx.WS}+')}, '')"))
    many = "+" if max_chars is None else f"{{1,{max_chars}}}"
    arrow = rf"^([^\n]{many}?){tx.WS}*(?:→|->|=>|>>){tx.WS}*([^\n]{many})$"
    got = line.where(f"line <> '' and not startswith(line, '#') and line rlike {lit(arrow)}")
    return got.select(id_col, "ord", F.expr(f"regexp_extract(line, {lit(arrow)}, 1)").alias("wrong"),
                      F.expr(f"regexp_extract(line, {lit(arrow)}, 2)").alias("right"))


# Header words of a glossary sheet.
WRONG_HEADER = "wrong|incorrect|current|before|source|sai|lỗi|bản hiện tại|từ sai"
RIGHT_HEADER = "correct|preferred|after|target|suggestion|update|đúng|sửa|bản update|từ đúng"
DICTIONARY_SHEET = "term|terminology|dictionary|từ điển|glossary|spelling|brand"


def glossary_pairs(rows: DataFrame) -> DataFrame:
    """Sheets (sheet, ord, cells ARRAY<STRING>) -> wrong/right pairs.

    A header row names the columns; without one, two-column sheets that look
    like a dictionary are taken as they are.
    """
    head = rows.where("cells is not null").groupBy("sheet").agg(F.min_by("cells", "ord").alias("h"), F.min("ord").alias("h_ord"))
    norm = f"transform(h, c -> lower({tx.collapse_ws('trim(c)')}))"
    word = lambda p: lit(rf"(?iu)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])")
    at = lambda p: f"array_position(transform({norm}, c -> c rlike {word(p)}), true)"
    head = head.select("sheet", "h_ord", F.expr(at(WRONG_HEADER)).alias("wi"), F.expr(at(RIGHT_HEADER)).alias("ri"))
    j = rows.join(head, "sheet").withColumn("_named", F.expr("wi > 0 and ri > 0 and wi <> ri"))
    named = "_named and ord > h_ord"
    plain = f"not _named and size(cells) = 2 and sheet rlike {lit('(?iu)' + DICTIONARY_SHEET)}"
    return (j.where(f"({named}) or ({plain})")
            .select("sheet", "ord", F.expr("coalesce(get(cells, if(_named, wi - 1, 0)), '')").alias("wrong"),
                    F.expr("coalesce(get(cells, if(_named, ri - 1, 1)), '')").alias("right")))


def split_pairs(pairs: DataFrame, ord_col: str = "ord", max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """First pair per case-insensitive key, without equal or empty ones; and the pairs with a side
    over ``max_chars`` characters, with ``reject_reason``."""
    p = pairs.withColumn("wrong", F.expr(tx.trim_ws("wrong"))).withColumn("right", F.expr(tx.trim_ws("right")))
    p = p.where("wrong <> '' and right <> '' and wrong <> right")
    long = "false" if max_chars is None else f"length(wrong) > {max_chars} or length(right) > {max_chars}"
    g = p.where(f"not ({long})").groupBy(F.lower("wrong"), F.lower("right")).agg(
        F.min_by(F.struct("wrong", "right"), ord_col).alias("p"), F.min(ord_col).alias(ord_col))
    return (g.select(ord_col, "p.wrong", "p.right"),
            p.where(long).select(ord_col, "wrong", "right", F.lit("over_limit").alias("reject_reason")))


def dedupe_pairs(pairs: DataFrame, ord_col: str = "ord", max_chars: int | None = None) -> DataFrame:
    """First pair per case-insensitive key, of any length or up to ``max_chars`` characters a side."""
    return split_pairs(pairs, ord_col, max_chars)[0]


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """S15."""
    pairs.select("wrong", F.col("right").alias("correct")).write.mode("overwrite").csv(path, header=True)


def layered(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maps take the highest layer's entry, term lists their distinct union.

    ``rows``: lexicon rows plus ``layer_ord``; ``by`` adds grouping columns
    (one lexicon per workspace).
    """
    by = by or []
    rank = F.struct("layer_ord", "ord")
    maps = rows.where("wrong is not null").groupBy(*by, "list", "wrong").agg(
        F.max_by("right", rank).alias("right"), F.max_by("priority", rank).alias("priority"), F.min(rank).alias("_at"))
    terms = rows.where("wrong is null").groupBy(*by, "list", "right").agg(F.min(rank).alias("_at"))
    both = maps.unionByName(terms.withColumn("wrong", F.lit(None).cast("string")).withColumn("priority", F.lit(None).cast("string")))
    # the place of an entry is its first layer and its order there, told apart however large they are
    return both.select(*by, "list", "wrong", "right", "priority", F.col("_at.layer_ord").alias("layer_ord"), F.col("_at.ord").alias("ord"))
