"""Texts from file contents by a chain of extractors, each tried only where those before it found too little."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ..config import MIN_EXTRACTED_CHARS
from ..session import materialize

#: Makes an extractor. Called in a task when its first row needs it, so that a heavy model is not loaded for nothing.
ExtractorFactory = Callable[[], Callable[[bytes], str]]

#: Characters of text that a task holds before it hands rows on.
OUTPUT_CHARS = 8 << 20

ADDED = StructType().add("extractor", StringType()).add("text", StringType()).add("error", StringType())


class Chain:
    """The extractors of one task, in order."""

    def __init__(self, extractors: Sequence[tuple[str, ExtractorFactory]], min_chars: int, on_error: str):
        self.extractors, self.min_chars, self.on_error = extractors, min_chars, on_error
        self.made: dict[str, Callable[[bytes], str]] = {}

    def attempts(self, content: bytes) -> Iterator[tuple[str, str, str | None]]:
        """``name, text, error`` of one extractor after the other; the next is called when it is asked for."""
        for name, factory in self.extractors:
            try:
                if name not in self.made:
                    self.made[name] = factory()
                yield name, self.made[name](content) or "", None
            except Exception as error:  # of this row alone
                yield name, "", f"{type(error).__name__}: {error}"

    def __call__(self, content: bytes | None) -> tuple[str | None, str, str | None]:
        last: tuple[str | None, str, str | None] = (None, "", None)
        for last in self.attempts(content or b""):
            name, text, error = last
            if error is not None and self.on_error == "stop":
                return name, "", error
            if error is None and len(text.strip()) >= self.min_chars:
                return last
        return last


def extract(
    files: DataFrame,
    extractors: Sequence[tuple[str, ExtractorFactory]],
    min_chars: int = MIN_EXTRACTED_CHARS,
    content: str = "content",
    on_error: str = "stop",
) -> DataFrame:
    """``files`` with ``extractor, text, error`` in place of ``content``.

    An extractor's text counts if it has ``min_chars`` characters without the white space at its ends; else the
    next one is called, and the last one's text is taken as it is. An error gives the row an empty text and its
    message; with ``on_error="next"`` the next extractor is tried first. Other rows are not touched by it. A null
    content is an empty one. Rows are worked on one by one as they stream through the scan's tasks: no shuffle, and
    memory beyond Arrow's batch for one file and ``OUTPUT_CHARS`` of text.
    """
    if on_error not in ("stop", "next"):
        raise ValueError(f"unknown way to treat errors {on_error!r}; choose stop or next")
    if len({name for name, _ in extractors}) != len(extractors) or not extractors:
        raise ValueError("extractors need names, each of its own")
    keep = [f for f in files.schema.fields if f.name != content]
    clash = {f.name for f in keep} & set(ADDED.fieldNames())
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    schema = StructType([*keep, *ADDED.fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(extractors, min_chars, on_error)
        for batch in batches:
            contents = batch.column(batch.schema.get_field_index(content))
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            start, found, size = 0, [], 0
            for at in range(batch.num_rows):
                found.append(chain(contents[at].as_py()))
                size += len(found[-1][1])
                if size >= OUTPUT_CHARS or at + 1 == batch.num_rows:
                    columns = [c.slice(start, len(found)) for c in rest] + [pa.array(c, pa.string()) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)
                    start, found, size = at + 1, [], 0

    return files.mapInArrow(run, schema)


def extract_new(
    files: DataFrame, cache: DataFrame, extractors: Sequence[tuple[str, ExtractorFactory]], key: str = "doc_id", **options
) -> tuple[DataFrame, DataFrame]:
    """Texts of all files as ``key, text``, and the newly extracted ones to append to ``cache(key, text)``.

    Files whose cached text is not blank are not read: only their ids meet the cache. Empty extractions are
    not for the cache, so they are tried again next time.
    """
    filled = cache.filter(F.trim(F.regexp_replace("text", r"\s", " ")) != "").select(key, "text").dropDuplicates([key])
    known = files.select(key).join(filled, key)
    missing = files.join(filled.select(key), key, "left_anti")
    texts = materialize(extract(missing, extractors, **options).select(key, "text"), "extracted")  # once, for both
    return known.unionByName(texts), texts.filter("text != ''")


def plain_text() -> Callable[[bytes], str]:
    """UTF-8, else Latin-1, with line ends as newlines, as ``files.decode_text`` has it."""

    def decode(content: bytes) -> str:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError:
            text = content.decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    return decode


def strict_text(encoding: str) -> ExtractorFactory:
    """Text of one encoding; contents in another one are an error."""

    def make() -> Callable[[bytes], str]:
        return lambda content: content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")

    return make

