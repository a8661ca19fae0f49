"""Replies of external reviewers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.functions.exprs import fresh, lit

CANDIDATE_SCHEMA = (
    "array<struct<type:string,severity:string,original:string,suggestion:string,reason:string,confidence:double,"
    "is_definite_error:boolean,context_before:string,context_after:string,box_id:string,"
    "self_check:struct<exact_substring:boolean,visible_or_in_ocr:boolean,not_ocr_uncertainty:boolean,"
    "not_protected_term:boolean>>>")


def first_json(x: str) -> str:
    """The first fragment that parses: code fences are stripped, then starts are
    tried left to right and ends right to left."""
    fence = lit(r"(?s)```(?:json)?\s*(.*?)```")
    body = f"if({x} rlike {fence}, regexp_extract({x}, {fence}, 1), {x})"
    s, e, m, n, b = (fresh(v) for v in "semnb")
    at = lambda cls: f"filter(sequence(1, greatest(length({b}), 1)), {n} -> substring({b}, {n}, 1) in {cls})"
    ok = lambda f: f"try_parse_json({f}) is not null"
    found = (f"aggregate({at(chr(40) + lit('{') + ', ' + lit('[') + chr(41))}, cast(null as string), ({m}, {s}) -> "
             f"if({m} is not null, {m}, aggregate(reverse({at(chr(40) + lit('}') + ', ' + lit(']') + chr(41))}), "
             f"cast(null as string), ({m}q, {e}) -> case when {m}q is not null or {e} < {s} then {m}q "
             f"when {ok(f'substring({b}, {s}, {e} - {s} + 1)')} then substring({b}, {s}, {e} - {s} + 1) end)))")
    direct = f"if({ok(f'trim({b})')} and trim({b}) rlike {lit(r'^[\[{]')}, trim({b}), {found})"
    return f"transform(array({body}), {b} -> {direct})[0]"


def candidates(replies: DataFrame, id_cols: list[str]) -> DataFrame:
    """Reply text -> candidate rows, with ``rejected`` replies kept apart
    by :func:`rejects`."""
    j = replies.select(*id_cols, F.expr(first_json("reply")).alias("j"))
    rows = F.coalesce(F.from_json("j", CANDIDATE_SCHEMA),
                      F.from_json("j", f"struct<issues:{CANDIDATE_SCHEMA}>")["issues"])
    return (j.select(*id_cols, F.posexplode(rows).alias("ord", "c")).select(*id_cols, "ord", "c.*")
            .withColumnRenamed("is_definite_error", "is_definite"))


def rejects(replies: DataFrame) -> DataFrame:
    return replies.where(F.expr(first_json("reply")).isNull())


def verdicts(replies: DataFrame, id_cols: list[str]) -> DataFrame:
    """Per answered source the issue ids it keeps, from any of the accepted reply shapes.

    A reply that keeps nothing gives an empty list, which is not the same as no reply.
    """
    j = replies.select(*id_cols, F.expr(first_json("reply")).alias("j")).where("j is not null")
    names = ["verified_issue_ids", "kept_issue_ids", "kept", "issues"]
    flat = [F.from_json("j", "array<string>"), *[F.from_json("j", f"struct<{n}:array<string>>")[n] for n in names]]

    def ids(a):
        as_id = F.transform(a, lambda v: F.coalesce(F.get_json_object(v, "$.issue_id"), F.when(~v.startswith("{"), v)))
        return F.filter(as_id, lambda v: v.isNotNull() & (v != ""))

    listed = [ids(a) for a in flat]
    full = F.coalesce(*[F.when(F.size(a) > 0, a) for a in listed], *listed)
    return j.select(*id_cols, full.alias("kept")).where("kept is not null")


def verified_ids(replies: DataFrame, id_cols: list[str]) -> DataFrame:
    """S18 row by row: the ids that are kept."""
    return verdicts(replies, id_cols).select(*id_cols, F.explode("kept").alias("issue_id"))
