"""Expressions over file paths, sizes and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellumine.functions import fixed
from vellumine.functions.bands import half_even, literal_map

KB, MB, GB = 1024, 1024**2, 1024**3


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name, without the dot; '' when none.

    A leading dot does not start an extension.
    """
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)


def is_supported(path: Column) -> Column:
    return F.lower(extension(path)).isin(fixed.SUPPORTED_EXTENSIONS)


def mime_type(path: Column) -> Column:
    found = F.try_element_at(literal_map(fixed.MIME_TYPES), F.lower(extension(path)))
    return F.coalesce(found, F.lit("Unknown"))


def human_size(n: Column) -> Column:
    """``B`` below 1 KiB, then KB with one decimal, MB and GB with two."""
    x = n.cast("double")
    return (
        F.when(n < KB, F.format_string("%d B", n.cast("long")))
        .when(n < MB, F.format_string("%.1f KB", half_even(x / KB, 1)))
        .when(n < GB, F.format_string("%.2f MB", half_even(x / MB, 2)))
        .otherwise(F.format_string("%.2f GB", half_even(x / GB, 2)))
    )


def exact_size(n: Column) -> Column:
    """Size with the exact byte count in brackets, thousands separated."""
    x = n.cast("double")
    exact = F.format_string(" (%,d bytes)", n.cast("long"))
    return (
        F.when(n >= MB, F.concat(F.format_string("%.2f MB", half_even(x / MB, 2)), exact))
        .when(n >= KB, F.concat(F.format_string("%.2f KB", half_even(x / KB, 2)), exact))
        .otherwise(F.format_string("%d bytes", n.cast("long")))
    )


def _hex_at(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def magic_hex(content: Column) -> Column:
    """First 8 bytes as upper-case hex."""
    return F.coalesce(_hex_at(content, 1, 8), F.lit(""))


def container_type(content: Column) -> Column:
    """Container recognised from the leading bytes, never from the name."""
    head = magic_hex(content)
    out = None
    for prefix, label in fixed.SIGNATURES:
        hit = head.startswith(prefix)
        if label == "WEBP":
            hit = hit & (_hex_at(content, 9, 4) == F.lit("57454250"))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(content.isNull(), F.lit("MISSING_FILE")).otherwise(out.otherwise("UNKNOWN"))


def expected_container(ext_upper: Column) -> Column:
    """Container an extension stands for; an unmapped one stands for itself."""
    return F.coalesce(F.try_element_at(literal_map(fixed.EXTENSION_FORMATS), ext_upper), ext_upper)


def latin1(content: Column) -> Column:
    """Bytes as text, one character per byte, for pattern search."""
    return F.decode(content, "ISO-8859-1")
