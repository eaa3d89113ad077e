"""Documents with phrases that the cleaning rules are about, so that each rule meets rows of every table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One for each remainder of a document's id; it stands after the first characters of the text.
PHRASES = (
    "",
    "Education at the University, studying for a DIPLOMA",
    "AUTHOR contributions: all of it",
    "see Fig 12, fig3 and figure 4",
    "in Table 7, table9 or tables 5",
    "as shown [12], [3] and [x]",
    "in 3d, 12B and 4gx",
    "the Authors   Contribution follows",
    "authors contributionx, author, education",
    "https://a.b/c?d=1 x@y.z 1.5 and 17",
    "PhD Bachelor masters Graduated",
)
PLACE = 40


def phrased(docs: DataFrame) -> DataFrame:
    """``docs`` with the phrase of their id put into ``text``."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    text = F.concat_ws(" ", F.substring("text", 1, PLACE), phrase, F.substring("text", PLACE + 1, 1 << 30))
    return docs.withColumn("text", text)


def phrased_sql(text: str = "text") -> str:
    listed = ", ".join("'" + p + "'" for p in PHRASES)
    return f"concat_ws(' ', substring({text}, 1, {PLACE}), [{listed}][doc_id % {len(PHRASES)} + 1], substring({text}, {PLACE + 1}))"
