"""File names of exported frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image formats, file suffixes and the characters not allowed in file names.
EXTENSIONS = {"png": "png", "jpeg": "jpg", "webp": "webp", "bmp": "bmp", "tiff": "tiff"}
SUFFIXES = {
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "bmp": "bmp", "tif": "tiff", "tiff": "tiff",
}
ILLEGAL = r'[<>:/\\|?*"\x00-\x1f]'
MAX_NAME = 96


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def sanitize_base_name(name: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")
    filled = F.when(trimmed == "", F.lit("frame")).otherwise(trimmed)
    cleaned = F.regexp_replace(F.regexp_replace(filled, ILLEGAL, "_"), r"[. ]+$", "")
    return F.when(cleaned == "", F.lit("frame")).otherwise(F.left(cleaned, F.lit(MAX_NAME)))


def extension(fmt: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, fmt), F.lit("png"))


def format_of_path(path: Column) -> Column:
    """Image format by file suffix, null when the suffix is not known."""
    suffix = F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))
    return _lookup(SUFFIXES, suffix)


def _padded(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def frame_file_name(base: Column, seq: Column, index: Column, pt_ns: Column, fmt: Column) -> Column:
    by_index = F.concat(F.lit("f"), _padded(index, 8))
    by_time = F.concat(F.lit("t"), _padded(F.greatest(pt_ns, F.lit(0)), 19))
    identity = F.when(index >= 0, by_index).otherwise(by_time)
    return F.concat_ws(
        "_", sanitize_base_name(base), _padded(seq, 6), F.concat(identity, F.lit("."), extension(fmt))
    )
