"""Tags hidden in texts: comments, file names and column headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag keys of a recording comment and of a recording's file name, in file-name order.
COMMENT_KEYS = ("brand", "model", "vehicle_key", "from_city", "to_city", "condition", "experiment_id")
FILENAME_KEYS = ("date", "brand", "model", "from_city", "to_city", "condition")

MISSING = "NA"


def comment_tags(comment: Column, keys: Sequence[str] = COMMENT_KEYS) -> Column:
    """A struct with one string per key from a dict text, bare or inside ``<TX>...</TX>``; ``NA`` where absent."""
    inner = F.regexp_extract(comment, r"(?s)<TX>(.*?)</TX>", 1)
    text = F.when(inner != "", inner).otherwise(comment)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    parsed = F.from_json(text, schema, {"allowSingleQuotes": "true"})
    return F.struct(*[F.coalesce(parsed[k], F.lit(MISSING)).alias(k) for k in keys])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def without_scheme(path: Column, scheme: str) -> Column:
    """Drop a leading storage scheme such as ``file:`` from a path."""
    return F.regexp_replace(path, f"^{scheme}:", "")


def filename_tags(name: Column, keys: Sequence[str] = FILENAME_KEYS, sep: str = "_") -> Column:
    """A struct of the leading parts of a file name; NULL where the name has too few parts."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), sep)
    return F.struct(*[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(keys)])


def signal_name(header: Column) -> Column:
    """``Speed`` from ``Speed [km/h]``; the whole header if it has no unit."""
    return F.regexp_replace(header, r" \[.*$", "")


def signal_unit(header: Column) -> Column:
    """The last bracketed part of a header, with the degree sign (also when badly decoded) written as ``C``."""
    unit = F.element_at(
        F.concat(F.array(F.lit("")), F.regexp_extract_all(header, F.lit(r"\[([^\]]+)\]"), 1)), -1
    )
    return F.when(unit.isin("°C", "Â°C"), F.lit("C")).otherwise(unit)
