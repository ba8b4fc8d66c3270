"""Expressions on cases, uploads and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wording, bounds, signatures and keys.
WORDING = {"verified": "Đã xác định", "out_of_scope": "Ngoài phạm vi CA/BQP", "need_review": "Chưa có kết luận"}
FAILED, RUNNING, OPEN = "Không xử lý được", "Đang xử lý", "Chưa có kết luận"
EARLIEST, FUTURE_DAYS = "1945-09-02", 366
SIGNATURES = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "xls": "D0CF11E0A1B11AE1"}
ZIP = "504B0304"
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".xls": "xls", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".txt": "text", ".csv": "text"}
SECRET_KEYS = ("password", "token", "secret", "authorization", "api_key")
SNIFFED = 4096


def display_status(category: Column, workflow: Column) -> Column:
    """What an operator reads: a failed case, its conclusion, or whether it is still worked on."""
    out = F.when(workflow == "FAILED", FAILED)
    for name, words in WORDING.items():
        out = out.when(category == name, words)
    return out.when(~workflow.eqNullSafe("COMPLETED"), RUNNING).otherwise(OPEN)


def search_fragment(value: Column) -> Column:
    """What to look for in ids: the last part of a displayed case code, or the text as it is, without outer blanks."""
    c = F.trim(value)
    shown = r"(?i)^#?HS-\d{4}-(.+)$"
    return F.when(c.rlike(shown), F.trim(F.regexp_extract(c, shown, 1))).otherwise(c)


def business_date(day: Column, today: Column | None = None) -> Column:
    """Whether a day is neither before the earliest business date nor more than a year ahead; null passes."""
    today = F.current_date() if today is None else today
    return day.isNull() | ((day >= F.lit(EARLIEST).cast("date")) & (day <= F.date_add(today, FUTURE_DAYS)))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a url's host is one of ``hosts`` or under one."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


def file_kind(content: Column) -> Column:
    """pdf, png, jpeg, xls, docx, xlsx, zip, text or unknown, by the first bytes; a zip's kind by the names in it."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for kind, signature in SIGNATURES.items():
        out = F.when(head.startswith(signature), kind) if out is None else out.when(head.startswith(signature), kind)
    names = F.hex(content)
    part = lambda name: F.contains(names, F.lit(name.encode().hex().upper()))
    first = F.substring(content, 1, SNIFFED)
    plain = ~F.regexp_replace(F.hex(first), "(..)", "$1 ").contains("00 ") & F.is_valid_utf8(first.cast("string"))
    return (
        out.when(head.startswith(ZIP) & part("word/document.xml"), "docx").when(head.startswith(ZIP) & part("xl/workbook.xml"), "xlsx").when(head.startswith(ZIP), "zip")
        .when(plain, "text").otherwise("unknown")
    )


def upload_error(name: Column, content: Column) -> Column:
    """Why an upload is refused: its extension is not allowed, or its content is of another kind; null if neither."""
    ext = F.lower(F.regexp_extract(name, r"\.[A-Za-z0-9]+$", 0))
    expected = F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p])[ext]
    return F.when(expected.isNull(), "UNSUPPORTED_EXTENSION").when(file_kind(content) != expected, "SIGNATURE_MISMATCH")


def redacted(value: Column, kind: T.DataType) -> Column:
    """``value`` of type ``kind`` with what stands under a secret key, at any depth, as ***; text under such keys alone is replaced."""
    secret = lambda k: F.lower(k).isin(*SECRET_KEYS)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        inner = lambda v: redacted(v, kind.valueType)
        hidden = F.lit("***") if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(value, lambda k, v: F.when(secret(k), hidden).otherwise(inner(v)))
    if isinstance(kind, T.StructType):
        one = lambda f: (F.lit("***") if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)) if f.name.lower() in SECRET_KEYS else redacted(value[f.name], f.dataType)
        return F.when(value.isNotNull(), F.struct(*[one(f).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: redacted(v, kind.elementType))
    return value
