"""Lexicon: the terminology a checker run uses.

A lexicon is a table ``(list, wrong, right, priority, ord)``.  House rules that a program holds
are folded into the plan as literals (``Lexicon``), so that checking stays one narrow projection.
A table of any size goes to ``check(..., table=...)``, which joins it to the words of the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("list", T.StringType()),
    T.StructField("wrong", T.StringType()),
    T.StructField("right", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("ord", T.IntegerType()),
])

TERM_LISTS = ("brand_terms", "protected_terms", "do_not_change")
MAP_LISTS = ("preferred_spellings", "product_terms", "preferred_wording", "missing_tone_map",
             "wrong_tone_map")

# Spelling dictionary every run starts from (brand look-alikes belong to user lexicons).
BUILTIN_SPELLINGS = {
    "mạnh mẻ": "mạnh mẽ", "mỡ ra": "mở ra", "khỏi động": "khởi động", "sẻ phát triển": "sẽ phát triển",
    "chỉnh chu": "chỉn chu", "xuất xắc": "xuất sắc", "khuyến mải": "khuyến mãi", "ưu đải": "ưu đãi",
    "trãi nghiệm": "trải nghiệm", "trãi qua": "trải qua", "registeration": "registration",
    "sucess": "success", "offical": "official", "đốitượng": "đối tượng", "hìnhthức": "hình thức",
    "thờigian": "thời gian", "địađiểm": "địa điểm", "thamgia": "tham gia", "đăngký": "đăng ký",
}
# Default house dictionaries.
DEFAULT_SPELLINGS = {"ko": "không", "k": "không", "dc": "được", "mik": "mình", "bn": "bạn",
                     "hok": "không", "thui": "thôi"}
# Preferred wording.
DEFAULT_WORDING = {
    "xịn sò": "nổi bật", "siêu xịn": "ấn tượng", "lụm ngay": "khám phá ngay", "đỉnh của chóp": "ấn tượng",
    "hết nước chấm": "rất ấn tượng", "chất lừ": "chất lượng cao", "thần thánh": "xuất sắc",
    "bá đạo": "vượt trội", "cực phẩm": "sản phẩm cao cấp", "quá đỉnh": "rất ấn tượng",
    "ngon lành": "tuyệt vời", "mlem mlem": "hấp dẫn", "oke lá cờ": "đồng ý", "chắc kèo": "chắc chắn",
    "auto đăng ký": "đăng ký ngay", "xịn xò": "nổi bật",
}
# Words written without their tone marks.
DEFAULT_MISSING_TONES = {
    "khong": "không", "duoc": "được", "nguoi dung": "người dùng", "cong nghe": "công nghệ",
    "trai nghiem": "trải nghiệm", "san pham": "sản phẩm", "ket noi": "kết nối", "dong hanh": "đồng hành",
    "no luc": "nỗ lực", "phat trien": "phát triển", "luon luon": "luôn luôn", "thong tin": "thông tin",
    "giai phap": "giải pháp", "tinh nang": "tính năng", "nang cao": "nâng cao", "ho tro": "hỗ trợ",
    "tuong lai": "tương lai", "cuoc song": "cuộc sống", "mang lai": "mang lại", "hop tac": "hợp tác",
    "chinh sach": "chính sách", "dich vu": "dịch vụ", "ung dung": "ứng dụng", "su kien": "sự kiện",
    "khach hang": "khách hàng", "cong dong": "cộng đồng", "bao mat": "bảo mật", "toc do": "tốc độ",
    "hieu qua": "hiệu quả", "thuc hien": "thực hiện",
}
# Words written with wrong tone marks.
DEFAULT_WRONG_TONES = {
    "hổ trợ": "hỗ trợ", "trãi nghiệm": "trải nghiệm", "chia sẽ": "chia sẻ", "sữa lỗi": "sửa lỗi",
    "xữ lý": "xử lý", "dử liệu": "dữ liệu", "nổ lực": "nỗ lực", "xãy ra": "xảy ra", "phãi": "phải",
    "chĩnh": "chỉnh", "sẵn sàn": "sẵn sàng", "khoẻ mạnh": "khỏe mạnh", "mạnh mẻ": "mạnh mẽ",
    "thỏa mãng": "thỏa mãn", "nổi bậc": "nổi bật", "hưỡng dẫn": "hướng dẫn", "tuỡng": "tưởng",
    "chuẫn": "chuẩn",
}
# Risky words and their priority.
DEFAULT_RISKY = {
    "lừa đảo": "high", "sập app": "high", "lỗi hệ thống": "high", "bug đầy": "medium", "toang": "medium",
    "tệ quá": "medium", "dở hơi": "high", "vô dụng": "high", "thất bại": "medium", "phá sản": "high",
}
# Words that look like glued acronyms on purpose.
INTENTIONAL_CAMEL = ["iphone", "ipad", "macos", "tiktok", "youtube", "linkedin", "wordpress",
                     "javascript", "typescript", "powerpoint", "openai"]
# Acronyms that are often glued to the next word.
ACRONYMS = ["HTTPS", "HTTP", "JSON", "API", "CSV", "URL", "OCR", "LLM", "QR", "UI", "UX", "AI"]


def normalise_term(term: str) -> str:
    return re.sub(r"\s+", " ", term.strip())


@dataclass
class Lexicon:
    """The entries a program holds itself."""

    brand_terms: list[str] = field(default_factory=list)
    protected_terms: list[str] = field(default_factory=list)
    do_not_change: list[str] = field(default_factory=list)
    preferred_spellings: dict[str, str] = field(default_factory=dict)
    product_terms: dict[str, str] = field(default_factory=dict)
    preferred_wording: dict[str, str] = field(default_factory=dict)
    missing_tone_map: dict[str, str] = field(default_factory=dict)
    wrong_tone_map: dict[str, str] = field(default_factory=dict)
    risky_words: dict[str, tuple[str, str]] = field(default_factory=dict)
    # Former company names: root word -> current name ("acme" also covers "Acme Corp(oration)").
    legacy_names: dict[str, str] = field(default_factory=dict)
    # Extensions of the fixed lists above.
    acronyms: list[str] = field(default_factory=list)
    value_words: list[str] = field(default_factory=list)

    @staticmethod
    def default() -> "Lexicon":
        return Lexicon(
            preferred_spellings=dict(DEFAULT_SPELLINGS),
            preferred_wording=dict(DEFAULT_WORDING),
            missing_tone_map=dict(DEFAULT_MISSING_TONES),
            wrong_tone_map=dict(DEFAULT_WRONG_TONES),
            risky_words={w: (priority, "") for w, priority in DEFAULT_RISKY.items()},
        )

    def protected(self) -> list[str]:
        """Distinct union of the five protecting lists."""
        terms = [*self.brand_terms, *self.protected_terms, *self.do_not_change,
                 *self.product_terms.values(), *self.preferred_spellings.values()]
        return list(dict.fromkeys(t for t in map(normalise_term, terms) if t))

    def canonical(self) -> list[str]:
        terms = [*self.brand_terms, *self.protected_terms, *self.do_not_change,
                 *self.product_terms.values()]
        return list(dict.fromkeys(t.strip() for t in terms if t.strip()))

    def rows(self) -> list[tuple]:
        out: list[tuple] = []
        for name in (*TERM_LISTS, "acronyms", "value_words"):
            out += [(name, None, t, None, i) for i, t in enumerate(getattr(self, name))]
        for name in (*MAP_LISTS, "legacy_names"):
            out += [(name, w, r, None, i) for i, (w, r) in enumerate(getattr(self, name).items())]
        out += [("risky_words", w, s, p, i) for i, (w, (p, s)) in enumerate(self.risky_words.items())]
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)


def protected_terms(lexicon: DataFrame) -> DataFrame:
    """J2 on a lexicon table of any size."""
    kept = [*TERM_LISTS, "product_terms", "preferred_spellings"]
    term = F.trim(F.regexp_replace("right", r"\s+", " "))
    return (lexicon.where(F.col("list").isin(kept)).select(term.alias("term"))
            .where("term <> ''").distinct())
