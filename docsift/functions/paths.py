"""Parts of a file path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; empty for none. A leading dot is no extension."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def document_filename(doc_id: Column) -> Column:
    """File name of a numbered document: five digits at least, never cut."""
    return F.format_string("%05d.txt", doc_id)
