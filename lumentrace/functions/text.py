"""Text, path and time expressions of measurement lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumentrace.functions.arrays import col

# Texts that count as true, and clock offsets of foreign time formats.
TRUE_TEXTS = ("TRUE", "True", "true", "1", "1.0", "yes", "Yes", "YES")
_FILETIME_UNIX = 116444736000000000  # 1970-01-01 in 100 ns ticks since 1601
_EXCEL_UNIX_DAYS = 25569  # 1970-01-01 in days since 1899-12-30


def truth(c: Column | str) -> Column:
    """Boolean spelling of a cell."""
    return F.coalesce(col(c).cast("string").isin(*TRUE_TEXTS), F.lit(False))


def number(c: str) -> Column:
    """M2: the cell as a number, null when it is not one."""
    return F.expr(f"try_cast({c} AS DOUBLE)")


def slashes(c: Column | str) -> Column:
    """One kind of path separator."""
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def age_range(c: Column | str) -> tuple[Column, Column]:
    """``a-b`` or ``a;b`` as youngest and oldest."""
    parts = F.split(col(c), "[-;]")
    return F.get(parts, F.lit(0)), F.element_at(parts, -1)


def frequency(cycle_ms: Column | str) -> Column:
    """1000 / period."""
    return F.try_divide(F.lit(1000.0), col(cycle_ms))


def timing_period(timing: Column | str) -> Column:
    """(last - first) / (n - 1) of a blank-separated list; null if that fails."""
    parts = F.transform(F.split(F.trim(col(timing)), " "), lambda v: v.try_cast("double"))
    good = F.forall(parts, lambda v: v.isNotNull())
    return F.when(
        good, F.try_divide(F.element_at(parts, -1) - F.get(parts, F.lit(0)), (F.size(parts) - 1).cast("double"))
    )


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS of a non-negative time in seconds."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def odour_from_label(label: Column | str) -> tuple[Column, Column]:
    """``..._odour_-conc``: the part after the only minus is the concentration, the
    last part before it the odour."""
    pieces = F.split(col(label), "-")
    conc = F.when(F.size(pieces) == 2, F.concat(F.lit("-"), F.get(pieces, F.lit(1)))).otherwise("0")
    words = F.split(F.regexp_replace(F.get(pieces, F.lit(0)), "_$", ""), "_")
    return F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise("unknown"), conc


def animal_of_path(path: Column | str) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(slashes(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def relative_path(path: Column | str, root: str) -> Column:
    """Path below the data folder, without extension; other paths stay whole."""
    clean = slashes(path)
    prefix = root.rstrip("/") + "/"
    inside = F.when(F.startswith(clean, F.lit(prefix)), F.substring(clean, F.lit(len(prefix) + 1), F.length(clean)))
    return F.regexp_replace(F.coalesce(inside, clean), r"\.[^./]*$", "")


def excel_seconds(serial: Column | str) -> Column:
    """Excel serial day to POSIX seconds."""
    return (col(serial) - _EXCEL_UNIX_DAYS) * 86400


def filetime_seconds(hex_text: Column | str) -> Column:
    """Hexadecimal FILETIME to POSIX seconds."""
    return (F.conv(col(hex_text), 16, 10).cast("long") - _FILETIME_UNIX) / F.lit(10000000.0)


def iso_seconds(text: Column | str, offset_s: Column | float = 0.0) -> Column:
    """ISO text plus an offset in seconds to POSIX seconds (UTC)."""
    moment = F.to_timestamp(F.concat(F.replace(col(text), F.lit("T"), F.lit(" ")), F.lit("+00:00")))
    return F.unix_micros(moment) / F.lit(1000000.0) + offset_s
