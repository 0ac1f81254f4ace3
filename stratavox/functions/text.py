"""Text and protocol scalars as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def valid_bucket(c: Column) -> Column:
    """3 to 63 lower-case letters, digits, dots and dashes, letters or digits at the ends, no two dots in a row."""
    return c.rlike(r"\A[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]\z") & ~c.contains("..")


def xml_escape(c: Column) -> Column:
    for plain, entity in XML_ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    for code in (*range(0x01, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20)):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"&#x{code:X};"))
    return c


def xml_unescape(c: Column) -> Column:
    for plain, entity in (*XML_ENTITIES[1:], XML_ENTITIES[0]):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def xml_elements(c: Column, name: str) -> Column:
    """The unescaped texts of all elements of a flat document."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), xml_unescape)


def uri_encode(c: Column, keep_slash: bool = False) -> Column:
    """Percent-encodes every byte but letters, digits and unreserved ones."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    plain = f"[A-Za-z0-9{'/' if keep_slash else ''}_.~-]"

    def one(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        return F.when((code < 128) & F.char(code).rlike(plain), F.char(code)).otherwise(F.concat(F.lit("%"), h))

    return F.array_join(F.transform(pairs, one), "")


def uri_decode(c: Column) -> Column:
    """Percent-decodes; a plus stays a plus, and a percent sign that starts no escape stays itself."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def _split_pair(p: Column) -> tuple[Column, Column]:
    at = F.locate("=", p)
    return F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p), F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))


def canonical_query(c: Column, leave_out: str = "X-Amz-Signature") -> Column:
    """Query parameters decoded, encoded again, sorted and joined, without the signature."""

    def pair(p: Column) -> Column:
        k, v = _split_pair(p)
        return F.struct(uri_encode(uri_decode(k)).alias("k"), uri_encode(uri_decode(v)).alias("v"))

    pairs = F.transform(F.filter(F.split(c, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda x: x["k"] != leave_out))
    return F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")


def target(path: Column) -> Column:
    """struct<kind, bucket, key> of a request path: service, bucket or object."""
    trimmed = F.regexp_replace(path, r"\A/", "")
    at = F.locate("/", trimmed)
    bucket = uri_decode(F.when(at > 0, F.substring(trimmed, F.lit(1), at - 1)).otherwise(trimmed))
    rest = F.when(at > 0, F.substring(trimmed, at + 1, F.length(trimmed))).otherwise(F.lit(""))
    kind = F.when(trimmed == "", "service").when(rest == "", "bucket").otherwise("object")
    return F.struct(kind.alias("kind"), F.when(kind != "service", bucket).alias("bucket"), F.when(kind == "object", uri_decode(rest)).alias("key"))


def parse_range(spec: Column, size: Column) -> Column:
    """struct<first, last> of a Range header for an object of so many bytes; null if it can't be met."""
    spec = F.trim(spec)
    first = F.nullif(F.trim(F.regexp_extract(spec, r"\Abytes=([^-,]*)-([^,]*)\z", 1)), F.lit(""))
    last = F.nullif(F.trim(F.regexp_extract(spec, r"\Abytes=([^-,]*)-([^,]*)\z", 2)), F.lit(""))
    number = lambda c: F.when(c.rlike(r"\A\+?[0-9]+\z"), c.try_cast("bigint"))
    a, b, end = number(first), number(last), F.greatest(size - 1, F.lit(0))
    start = F.when(first.isNull(), F.when(b > 0, F.greatest(size - b, F.lit(0)))).otherwise(a)
    stop = F.when(first.isNull() | last.isNull(), end).otherwise(F.least(b, end))
    ok = spec.rlike(r"\Abytes=[^-,]*-[^,]*\z") & (size > 0) & (start <= stop) & (start < size) & (last.isNull() | b.isNotNull())
    return F.when(ok, F.struct(start.alias("first"), stop.alias("last")))


def safe_relative(name: Column) -> Column:
    """A member's path without empty and dot parts; null if it leaves the folder, names a drive or is empty."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    bad = F.exists(kept, lambda p: (p == "..") | p.contains(":"))
    return F.when(~bad & (F.size(kept) > 0), F.array_join(kept, "/"))


def unhex_text(c: Column) -> Column:
    """The text of an even number of hex digits that are valid UTF-8; else null."""
    raw = F.when(c.rlike(r"\A([0-9A-Fa-f]{2})*\z"), F.unhex(c))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def amz_date(c: Column) -> Column:
    """Epoch seconds of YYYYMMDDTHHMMSSZ, by calendar arithmetic; second 60 and day 31 of any month are taken as they come."""
    ok = c.rlike(r"\A[0-9]{8}T[0-9]{6}Z\z")
    n = lambda i, k: F.substring(c, i, k).try_cast("int")
    year, month, day, hour, minute, second = n(1, 4), n(5, 2), n(7, 2), n(10, 2), n(12, 2), n(14, 2)
    good = ok & month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second <= 60)
    start = F.make_date(year, F.when(good, month), F.lit(1))
    days = F.date_diff(start, F.lit("1970-01-01").cast("date")).cast("bigint") + day - 1
    return F.when(good, days * 86400 + hour * 3600 + minute * 60 + second)


def attribute_text(c: Column) -> Column:
    """A text value without trailing NULs and spaces and leading spaces; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "[\\x00 ]+\\z", ""), r"\A +", ""), F.lit(""))


def attribute_texts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, "[\\x00 ]+\\z", ""), r"\\"), lambda p: F.trim(p)), lambda p: p != "")


def attribute_integer(c: Column) -> Column:
    first = F.regexp_replace(F.element_at(F.split(c, r"\\"), 1), "\\A[\\x00 ]+|[\\x00 ]+\\z", "")
    return F.when(first.rlike(r"\A[+-]?[0-9]+\z"), first.try_cast("bigint"))


def attribute_decimals(c: Column, n: int) -> Column:
    """The first n decimals; null unless there are as many and all are finite."""
    parts = F.slice(F.split(F.regexp_replace(c, "[\\x00 ]+\\z", ""), r"\\"), 1, n)
    values = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    ok = (F.size(parts) == n) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(ok, values)


def http_date(seconds: Column) -> Column:
    """The date of an HTTP header, in GMT whatever the session's time zone; times before 1970 are its start."""
    t = F.greatest(seconds, F.lit(0)).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86400).cast("int"))
    rest = F.pmod(t, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d GMT", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat_ws(" ", F.date_format(day, "EEE, dd MMM yyyy"), clock)
