"""The catalog of fields and accounting rules; everything else is compiled from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    """A line item: its label, where it stands, and how it is found in text."""

    key: str
    label: str
    form: str
    code: str
    negative: bool = False
    required: bool = False
    aliases: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    between: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return self.aliases or (self.label,)


@dataclass(frozen=True)
class Ordering:
    smaller: str
    larger: str
    message: str


@dataclass(frozen=True)
class Identity:
    parts: tuple[str, ...]
    total: str
    message: str


@dataclass(frozen=True)
class RatioBound:
    part: str
    base: str
    least: float
    most: float
    message: str


# Keys, labels, forms, line codes, names from specific to general, phrases that exclude.
FIELDS = (
    Field("tai_san_ngan_han", "Tài sản ngắn hạn", "B01a", "100", between=("khác",)),
    Field("hang_ton_kho", "Hàng tồn kho", "B01a", "140", before=("giảm giá", "dự phòng")),
    Field("tai_san_dai_han", "Tài sản dài hạn", "B01a", "200", between=("khác",)),
    Field("tong_tai_san", "Tổng tài sản", "B01a", "280", required=True, aliases=("Tổng cộng tài sản", "Tổng tài sản")),
    Field("no_phai_tra", "Nợ phải trả", "B01a", "300", between=("người bán", "người lao")),
    Field("von_chu_so_huu", "Vốn chủ sở hữu", "B01a", "400", negative=True),
    Field("doanh_thu_thuan", "Doanh thu thuần", "B02a", "10", required=True, aliases=("Doanh thu thuần về bán hàng và cung cấp dịch vụ", "Doanh thu thuần về bán", "Doanh thu thuần")),
    Field("gia_von_hang_ban", "Giá vốn hàng bán", "B02a", "11", aliases=("Giá vốn hàng bán và dịch vụ cung cấp", "Giá vốn hàng bán")),
    Field("loi_nhuan_gop", "Lợi nhuận gộp", "B02a", "20", negative=True, aliases=("Lợi nhuận gộp về bán hàng và cung cấp dịch vụ", "Lợi nhuận gộp")),
    Field("loi_nhuan_truoc_thue", "Lợi nhuận trước thuế", "B02a", "50", negative=True, aliases=("Lợi nhuận kế toán trước thuế", "Lợi nhuận trước thuế")),
    Field("loi_nhuan_sau_thue", "Lợi nhuận sau thuế", "B02a", "60", negative=True, required=True, aliases=("Lợi nhuận sau thuế thu nhập doanh nghiệp", "Lợi nhuận sau thuế TNDN", "Lợi nhuận sau thuế"), between=("chưa phân", "được trích chia")),
)

# Rules and the texts of their warnings.
ORDERINGS = (
    Ordering("tai_san_ngan_han", "tong_tai_san", "Tài sản ngắn hạn không thể lớn hơn Tổng tài sản"),
    Ordering("tai_san_dai_han", "tong_tai_san", "Tài sản dài hạn không thể lớn hơn Tổng tài sản"),
    Ordering("hang_ton_kho", "tai_san_ngan_han", "Hàng tồn kho không thể lớn hơn Tài sản ngắn hạn"),
    Ordering("no_phai_tra", "tong_tai_san", "Nợ phải trả không thể lớn hơn Tổng tài sản"),
    Ordering("gia_von_hang_ban", "doanh_thu_thuan", "Giá vốn hàng bán không thể lớn hơn Doanh thu thuần"),
    Ordering("loi_nhuan_sau_thue", "loi_nhuan_truoc_thue", "Lợi nhuận sau thuế không thể lớn hơn Lợi nhuận trước thuế"),
)
IDENTITIES = (
    Identity(("tai_san_ngan_han", "tai_san_dai_han"), "tong_tai_san", "Tài sản ngắn hạn + Tài sản dài hạn phải bằng Tổng tài sản"),
    Identity(("no_phai_tra", "von_chu_so_huu"), "tong_tai_san", "Nợ phải trả + Vốn chủ sở hữu phải bằng Tổng tài sản"),
    Identity(("gia_von_hang_ban", "loi_nhuan_gop"), "doanh_thu_thuan", "Giá vốn hàng bán + Lợi nhuận gộp phải bằng Doanh thu thuần"),
)
IDENTITY_TOLERANCE = 1e-7
RATIO_BOUNDS = (RatioBound("hang_ton_kho", "tai_san_ngan_han", 0.01, 1.0, "Hàng tồn kho chiếm tỷ trọng bất thường trong Tài sản ngắn hạn"),)
REVENUE, ASSETS, REVENUE_LIMIT = "doanh_thu_thuan", "tong_tai_san", 10
MESSAGES = {
    "unreadable": "{label}: không đọc được giá trị {value} thành số",
    "negative": "{label} có giá trị âm bất thường: {value}",
    "revenue": f"Doanh thu thuần lớn bất thường so với Tổng tài sản (gấp hơn {REVENUE_LIMIT} lần)",
    "required": "Thiếu chỉ tiêu bắt buộc: ",
}

# Form markers, tolerant of letters that OCR takes for digits, and the forms' names.
MARKERS = {
    "B01a": r"B\s*[O0o]\s*[1lI|]\s*a",
    "B02a": r"B\s*[O0o]\s*2\s*a",
    "B03a": r"B\s*[O0o]\s*3\s*a",
}
FORM_NAMES = {
    "B01a": "Báo cáo tình hình tài chính (bảng cân đối kế toán)",
    "B02a": "Báo cáo kết quả hoạt động kinh doanh",
    "B03a": "Báo cáo lưu chuyển tiền tệ",
}

KEYS = tuple(f.key for f in FIELDS)
BY_KEY = {f.key: f for f in FIELDS}
REQUIRED = tuple(f.key for f in FIELDS if f.required)


def label_of(key: str) -> str:
    return BY_KEY[key].label if key in BY_KEY else key


@dataclass(frozen=True)
class Catalog:
    """Fields and rules as small tables of a size that the catalog fixes, fit to be broadcast."""

    spark: SparkSession
    fields: tuple[Field, ...] = field(default=FIELDS)

    def sides(self) -> DataFrame:
        """(test, rule, side, field, n_parts, least, most): a row for each field that stands on a side of a rule."""
        rows = [("negative", f"negative:{f.key}", "left", f.key) for f in self.fields if not f.negative]
        rows += [("ordering", f"ordering:{i}", side, key) for i, o in enumerate(ORDERINGS) for side, key in (("left", o.smaller), ("right", o.larger))]
        rows += [("identity", f"identity:{i}", side, key) for i, n in enumerate(IDENTITIES) for side, key in (*(("left", part) for part in n.parts), ("right", n.total))]
        rows += [("ratio", f"ratio:{i}", side, key) for i, r in enumerate(RATIO_BOUNDS) for side, key in (("left", r.part), ("right", r.base))]
        rows += [("revenue", "revenue", side, key) for side, key in (("left", REVENUE), ("right", ASSETS))]
        rows += [("required", "required", "left", f.key) for f in self.fields if f.required]
        bounds = {f"ratio:{i}": (r.least, r.most) for i, r in enumerate(RATIO_BOUNDS)}
        n_parts = {f"identity:{i}": len(n.parts) for i, n in enumerate(IDENTITIES)}
        full = [(*row, n_parts.get(row[1]), *bounds.get(row[1], (None, None))) for row in rows]
        return self.spark.createDataFrame(full, "test string, rule string, side string, field string, n_parts int, least double, most double")


def check() -> None:
    """Every rule names known fields, and every field's form has a marker."""
    named = {k for o in ORDERINGS for k in (o.smaller, o.larger)} | {k for i in IDENTITIES for k in (*i.parts, i.total)} | {k for r in RATIO_BOUNDS for k in (r.part, r.base)}
    unknown = named - set(KEYS)
    if unknown or len(set(KEYS)) != len(KEYS):
        raise ValueError(f"unknown or repeated fields: {sorted(unknown)}")
    if lost := [f.key for f in FIELDS if f.form not in MARKERS]:
        raise ValueError(f"fields of forms without a marker: {lost}")
