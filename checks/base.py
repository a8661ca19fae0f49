"""Shared pieces of the registered queries: inputs, derived views, oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redpencil.functions.exprs import CLOSE, MID, OPEN, SEP
from redpencil.lexicon import Lexicon

IDS = ["doc_id"]


def lexicon() -> Lexicon:
    lex = Lexicon.default()
    lex.brand_terms = ["NovaNode", "AI Agent", "AI-native"]
    lex.product_terms = {"nova node": "NovaNode"}
    lex.legacy_names = {"acme": "Acme Group"}
    lex.preferred_wording = {**lex.preferred_wording, "the of": "of the", "les de": "de ces"}
    return lex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A derived view, written once in SQL that both engines accept."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


_H = "lpad(cast(n_chars % 26 as string), 2, '0')"
_M = "lpad(cast(n_chars % 70 as string), 2, '0')"
_LINES = [
    "'  thụt đầu dòng  '", "'---'", "'Dòng này lặp lại nhiều'", "'Dòng này lặp lại nhiều'",
    "concat('tuyệt vời tuyệt vời quá ', n_chars % 7)", "'🔍Tìm'", "'-gạch'", "'4.Bốn'",
    "'1. Một'", "'2) Hai'", "'03. Ba'", "'- Một'", "'• Hai'",
    "'SIÊU SALE mùa hè RỰC RỠ MIỀN TRUNG'", "'CTY tuyển nv mới của công ty cho nhân viên'",
    f"concat('Thời gian : ', {_H}, ':', {_M})", "'Địa điểm, Online tầng 5'", "'Hình thức tham gia| Cá nhân'",
    f"concat('Thời gian ', {_H}, ':00')", "'Lưu ý;x'", "'Yêu cầu; abc'",
    "'Xem [link](https://a.example.com/x) và **đậm** với `mã` &amp; &nbsp; xong'",
    "concat('#tag', n_chars % 5, ' #Tag', n_chars % 3, ' #a-b cùng#hash @ ten_', n_chars % 9, ' mail ab @cd.com và ef@ gh.org')",
    "'Vào https:// acme.io hoặc https://acme.io/p. nhé'",
    "concat('Giảm ', n_chars % 100, ' % còn ', n_chars % 1000, ' k dung lượng ', n_chars % 50, 'gb giá ', n_chars % 9 + 1, ',000,000 đồng')",
    f"concat('Từ ', {_H}, ':', {_M}, '-11:30 ngày ', n_chars % 33, '/', n_chars % 14, '/2026 và ', n_chars % 31 + 1, '.', n_chars % 12 + 1, '.2025 rồi 3/7')",
    "concat('Thứ ', n_chars % 6 + 2, ', ', n_chars % 28 + 1, '/', n_chars % 12 + 1, '/2026 hôm nay gọi 0', 1234567 + n_chars)",
    "'Chào GenZ Top10 PM và BU (đơn vị) PM'", "'O Hình thức tham gia mới'",
    "'a  b , d ;e:f xong🔥 . . . và .... rồi!! ( x ) [y '",
    "concat('ngoặc (mở', case when n_chars % 2 = 0 then ')' else '' end, ' và ', chr(34), 'trích', case when n_chars % 3 = 0 then chr(34) else '' end)",
    "'AIAgent và APIGateway của Nova Node nhắn @Nova Node là AI -native'", "'Acme Corp và #Acme_Corp ở vn tại tphcm'",
    "'ko dc trãi nghiệm su kien chia sẽ xịn sò toang. Xịn sò thế'",
    f"concat({_H}, 'h', {_M}, ' rồi ', {_H}, 'h và ', {_H}, ' giờ ', {_M}, ' hoặc ', {_H}, ' giờ nhé')",
    "'cà phê'", "concat('kết thúc', case n_chars % 3 when 0 then ',' when 1 then '.' else '' end)",
]
POSTS = (
    "select doc_id, source, lang, n_chars, concat(case when n_chars % 4 = 0 then '  ' else '' end, text, chr(10), "
    + ", chr(10), ".join(_LINES) + ", case when n_chars % 5 = 0 then ' ' else '' end) as text from documents"
)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each followed by announcement lines built from its columns."""
    return view(spark, sf_dir, POSTS, "documents")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# -- oracle helpers -------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def w(o: str = r"\0", g: str = "") -> str:
    return f"{OPEN}{o}{MID}{g}{CLOSE}"


def f(n: int) -> str:
    return f"split_part(g, '{SEP}', {n})"


def packed(*groups: str) -> str:
    return SEP.join(groups)


PRE, POST = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def spans_cte(name: str, pattern: str, template: str, src: str = "posts", key: str = "doc_id",
              flags: str = "g", text: str = "text") -> str:
    """CTE of (key, s, e, o, g): matches found by splitting marked text."""
    return f"""{name}_p as (select {key}, unnest(string_split(regexp_replace({text}, {q(pattern)}, {q(template)}, '{flags}'), '{OPEN}')) as piece,
    generate_subscripts(string_split(regexp_replace({text}, {q(pattern)}, {q(template)}, '{flags}'), '{OPEN}'), 1) as i from {src}),
  {name}_q as (select {key}, i, case when i = 1 then '' else split_part(piece, '{MID}', 1) end as o,
    case when i = 1 then '' else split_part(split_part(piece, '{CLOSE}', 1), '{MID}', 2) end as g,
    case when i = 1 then piece else split_part(piece, '{CLOSE}', 2) end as gap,
    case when i = 1 then length(piece) else length(split_part(piece, '{CLOSE}', 2)) end as rest from {name}_p),
  {name} as (select * exclude (rest, n), n - rest - length(o) as s, n - rest as e from
    (select *, sum(length(o) + rest) over (partition by {key} order by i) as n from {name}_q) where i > 1)"""


def spans_sql(pattern: str, template: str, suggestion: str = "g", where: str = "true", flags: str = "g",
              src_sql: str = POSTS) -> str:
    return (f"with posts as ({src_sql}), {spans_cte('m', pattern, template, flags=flags)} "
            f"select doc_id, cast(s as int) as span_start, cast(e as int) as span_end, o as original, "
            f"{suggestion} as suggestion from m where {where}")
