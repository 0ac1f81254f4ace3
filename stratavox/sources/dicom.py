"""DICOM files as rows: identity, geometry, layout and where the pixel data lies.

Files may lack the preamble or all file meta elements; the encoding is then told
from the first data element. Everything that can't be followed is a reason, not
an exception.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Transfer syntaxes (fixed values).
IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
#: Value representations with a 4-byte length in explicit encodings (fixed values).
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
PIXELS, FLOATS = 0x7FE00010, (0x7FE00008, 0x7FE00009)
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
#: Attributes by tag: name and kind (fixed values).
ATTRIBUTES = {
    0x00080008: ("image_type", "texts"), 0x00080016: ("sop_class", "text"), 0x0020000D: ("study", "text"), 0x00200012: ("acquisition_number", "integer"), 0x00180086: ("echo_number", "integer"), 0x00200100: ("temporal_position", "integer"),
    0x00280030: ("pixel_spacing", "decimals"), 0x00180050: ("slice_thickness", "decimal"), 0x00180088: ("slice_spacing", "decimal"), 0x00280004: ("photometric", "text"), 0x00280006: ("planar", "unsigned"), 0x00281052: ("rescale_intercept", "decimal"), 0x00281053: ("rescale_slope", "decimal"),
    0x00080018: ("sop_uid", "text"), 0x00080060: ("modality", "text"), 0x0020000E: ("series", "text"), 0x00200013: ("instance_number", "integer"), 0x00200032: ("position", "decimals"), 0x00200037: ("orientation", "decimals"),
    0x00280002: ("samples_per_pixel", "unsigned"), 0x00280008: ("frames", "integer"), 0x00280010: ("rows", "unsigned"), 0x00280011: ("columns", "unsigned"), 0x00280100: ("bits_allocated", "unsigned"), 0x00280101: ("bits_stored", "unsigned"), 0x00280102: ("high_bit", "unsigned"), 0x00280103: ("pixel_representation", "unsigned"),
}
PARSED = "path string, error string, deflated boolean, float_pixels boolean, has_pixels boolean, encapsulated boolean, big_endian boolean, value_start bigint, value_end bigint, sop_uid string, modality string, series string, instance_number bigint, position array<double>, orientation array<double>, samples_per_pixel int, frames bigint, rows int, columns int, bits_allocated int, bits_stored int, high_bit int, pixel_representation int, syntax string, image_type array<string>, sop_class string, study string, acquisition_number bigint, echo_number bigint, temporal_position bigint, pixel_spacing array<double>, slice_thickness double, slice_spacing double, photometric string, planar int, rescale_intercept double, rescale_slope double"
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in PARSED.split(", ")])
MAX_DEPTH = 32
UNDEFINED = 0xFFFFFFFF


#: An element's first 8 bytes, and a length of 4.
_FORMS = {"little": (struct.Struct("<HH2sH"), struct.Struct("<I")), "big": (struct.Struct(">HH2sH"), struct.Struct(">I"))}
_SHORT = {"little": struct.Struct("<H").unpack_from, "big": struct.Struct(">H").unpack_from}


class _Reader:
    def __init__(self, raw: bytes, pos: int, explicit: bool, order: str):
        self.raw, self.pos, self.explicit, self.order = raw, pos, explicit, order

    def header(self) -> tuple[int, bytes, int, int]:
        """Tag, representation, length and start of the value of the next element."""
        raw, p, (short, number) = self.raw, self.pos, _FORMS[self.order]
        try:
            group, element, kind, size = short.unpack_from(raw, p)
            tag = group << 16 | element
            if not self.explicit or group == 0xFFFE:
                return tag, b"", number.unpack_from(raw, p + 4)[0], p + 8
            if kind in LONG:
                return tag, kind, number.unpack_from(raw, p + 8)[0], p + 12
        except struct.error:
            raise ValueError("truncated element header") from None
        if not (kind.isalpha() and kind.isupper()):
            raise ValueError(f"no value representation at {p + 4}")
        return tag, kind, size, p + 8

    def skip_items(self, depth: int) -> None:
        """Moves behind a sequence of undefined length."""
        if depth > MAX_DEPTH:
            raise ValueError("sequences nested too deeply")
        while True:
            tag, _, length, value = self.header()
            self.pos = value
            if tag == SEQUENCE_END:
                return
            if tag != ITEM:
                raise ValueError("no item in a sequence")
            if length != UNDEFINED:
                self.pos = value + length
            else:
                self.skip_item(depth)

    def skip_item(self, depth: int) -> None:
        while True:
            tag, kind, length, value = self.header()
            self.pos = value
            if tag == ITEM_END:
                return
            if tag >> 16 == ITEM >> 16:
                raise ValueError("delimiter outside a sequence")
            if length != UNDEFINED:
                self.pos = value + length
            else:
                self.skip_undefined(kind, depth + 1)

    def skip_undefined(self, kind: bytes, depth: int) -> None:
        """Moves behind a value of undefined length; one of unknown representation is implicit."""
        inner = _Reader(self.raw, self.pos, False, "little") if kind == b"UN" else self
        inner.skip_items(depth)
        self.pos = inner.pos

    def skip_fragments(self) -> int:
        """Moves behind encapsulated pixel data and returns where its last fragment ends."""
        while True:
            end = self.pos
            tag, _, length, value = self.header()
            if tag == SEQUENCE_END:
                self.pos = value
                return end
            if tag != ITEM or length == UNDEFINED or value + length > len(self.raw):
                raise ValueError("broken fragments of pixel data")
            self.pos = value + length


@lru_cache(1 << 14)
def _repeated(raw: bytes, kind: str, order: str) -> object:
    """_value() of short values, which slices of a series have in common."""
    return _value(raw, kind, order)


#: Plain elements by their first 8 bytes, which files have in common: tag, length and ATTRIBUTES; by encoding.
_SEEN: dict[tuple[bool, str], dict[bytes, tuple[int, int, str | None, str]]] = {(explicit, order): {} for explicit in (True, False) for order in _FORMS}
_MOST_SEEN = 1 << 14


def _remember(head: bytes, explicit: bool, order: str, tag: int, kind: bytes, length: int) -> None:
    """Keeps an element that parse() may step over by its first 8 bytes alone."""
    plain = kind not in LONG and length != UNDEFINED and tag not in (PIXELS, *FLOATS) and tag >> 16 != ITEM >> 16
    if plain and len(seen := _SEEN[explicit, order]) < _MOST_SEEN:
        seen[head] = tag, length, *ATTRIBUTES.get(tag, (None, ""))


def _value(raw: bytes, kind: str, order: str) -> object:
    try:
        if kind == "unsigned":
            return int.from_bytes(raw[:2], order) if len(raw) >= 2 else None
        text = raw.decode("utf-8").rstrip("\0 ")
        if kind == "integer":
            return int(text.split("\\")[0].strip("\0 "))
        if kind == "texts":
            return [x.strip(" ") for x in text.split("\\")]
        values = [float(x) for x in text.split("\\")]
        if kind == "decimal":
            return values[0] if abs(values[0]) < float("inf") else None
        return values if all(abs(v) < float("inf") for v in values) else None
    except ValueError:
        return None


def parse(raw: bytes) -> dict:
    """What the index needs of a file; raises ValueError where it can't be followed."""
    end_of_file, pos, syntax, seen = len(raw), 132 if raw[128:132] == b"DICM" else 0, None, _SEEN[True, "little"]
    while raw[pos : pos + 2] == b"\2\0":
        head = raw[pos : pos + 8]
        if known := seen.get(head):
            tag, length, _, _ = known
            value = pos + 8
        else:
            tag, kind, length, value = _Reader(raw, pos, True, "little").header()
            _remember(head, True, "little", tag, kind, length)
        pos = value + length
        if pos > end_of_file:
            raise ValueError("element beyond the end of the file")
        if tag == 0x00020010:
            syntax = raw[value:pos].decode("ascii", "replace").strip("\0 ")
    if syntax is None:
        kind = raw[pos + 4 : pos + 6]
        syntax = EXPLICIT if kind.isalpha() and kind.isupper() else IMPLICIT
    out: dict = {"syntax": syntax, "deflated": syntax == DEFLATED, "big_endian": syntax == BIG, "float_pixels": False, "has_pixels": False, "encapsulated": False, "value_start": None, "value_end": None}
    if out["deflated"]:
        return out
    explicit, order = syntax != IMPLICIT, "big" if syntax == BIG else "little"
    seen, data, short = _SEEN[explicit, order], _Reader(raw, pos, explicit, order), _SHORT[order]
    while pos < end_of_file:
        head = raw[pos : pos + 8]
        if known := seen.get(head):
            _, length, name, how = known
            value = pos + 8
        else:
            data.pos = pos
            tag, kind, length, value = data.header()
            if tag == PIXELS:
                data.pos = value
                end = data.skip_fragments() if length == UNDEFINED else value + length
                if end > end_of_file:
                    raise ValueError("pixel data beyond the end of the file")
                out |= {"has_pixels": True, "encapsulated": length == UNDEFINED, "value_start": value, "value_end": end}
                pos = max(data.pos, end)
                continue
            if tag >> 16 == ITEM >> 16:
                raise ValueError("delimiter outside a sequence")
            if length == UNDEFINED:
                data.pos = value
                data.skip_undefined(kind, 1)
                pos = data.pos
                continue
            out["float_pixels"] |= tag in FLOATS and value + length <= end_of_file
            _remember(head, explicit, order, tag, kind, length)
            name, how = ATTRIBUTES.get(tag, (None, ""))
        pos = value + length
        if pos > end_of_file:
            raise ValueError("element beyond the end of the file")
        if name is None:
            continue
        if how == "unsigned" and length >= 2:
            out[name] = short(raw, value)[0]
        elif how == "text":
            out[name] = str(raw[value:pos], "utf-8", "replace").rstrip("\0 ").lstrip(" ") or None
        else:
            out[name] = (_value if how == "texts" or length > 64 else _repeated)(raw[value:pos], how, order)
    for name, n in (("position", 3), ("orientation", 6), ("pixel_spacing", 2)):
        if out.get(name) is not None:
            out[name] = out[name][:n] if len(out[name]) >= n else None
    return out


def parsed(files: DataFrame, content: bool = False) -> DataFrame:
    """One row per file of (path, content): PARSED, with the error of files that can't be followed, and the content if asked for."""
    schema = _SCHEMA.append(pa.field("content", pa.binary())) if content else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    row = parse(raw.as_py() or b"")
                except ValueError as e:
                    row = {"error": str(e), "deflated": False, "float_pixels": False, "has_pixels": False, "encapsulated": False, "big_endian": False}
                row["path"] = path
                rows.append(row)
            some = set().union(*rows)
            columns = [pa.array([r.get(c.name) for r in rows], c.type) if c.name in some else pa.nulls(len(rows), c.type) for c in _SCHEMA]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("content").fill_null(b"")] * content, schema=schema)

    return files.select("path", "content").mapInArrow(run, PARSED + ", content binary" * content)


def element(tag: int, kind: bytes, value: bytes, explicit: bool = True, order: str = "little") -> bytes:
    """One data element, padded to an even length; kind is left out of implicit encodings."""
    value += (b" " if kind in (b"UI", b"CS", b"IS", b"DS", b"LO") and kind != b"UI" else b"\0") * (len(value) % 2)
    head = (tag >> 16).to_bytes(2, order) + (tag & 0xFFFF).to_bytes(2, order)
    if not explicit:
        return head + len(value).to_bytes(4, order) + value
    if kind in LONG:
        return head + kind + b"\0\0" + len(value).to_bytes(4, order) + value
    return head + kind + len(value).to_bytes(2, order) + value


def write(attributes: list[tuple[int, bytes, bytes]], syntax: str = EXPLICIT) -> bytes:
    """A file of the elements (tag, representation, value) given, for synthetic data and tests."""
    explicit, order = syntax != IMPLICIT, "big" if syntax == BIG else "little"
    body = b"".join(element(t, k, v, explicit, order) for t, k, v in sorted(attributes))
    return bytes(128) + b"DICM" + element(0x00020010, b"UI", syntax.encode()) + body
