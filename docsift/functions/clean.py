"""Text cleaning as one chain of native regular expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_letters, ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are deleted wherever they stand as whole words.
NOISE_WORDS = [
    "education", "studying", "diploma", "degree",
    "university", "institute", "college", "school",
    "received", "obtained", "graduated", "phd", "bachelor", "master",
]

# Words whose disappearance the comparison report lists.
REPORTED_KEYWORDS = ["education", "university", "studying", "author"]

# Java's \b, \d and \s follow other Unicode rules than the cleaning rules need,
# so word edges, digits and white space are spelt out.
WORD = r"\p{L}\p{N}_"
START, END = rf"(?<![{WORD}])", rf"(?![{WORD}])"
DIGIT = r"\p{Nd}"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


# White space other than a lone blank, so that ordinary text has few matches.
UNEVEN_SPACE = rf"[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]{SPACE}*+| {SPACE}++"


def _not_plain(letters: str) -> str:
    # Listed characters compile to one bit table. A union of ranges is several
    # times slower here, the more so the more threads run it.
    return f"[^{letters} ][^{letters}]*| [^{letters}]+"


def _drop(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _where(marks: tuple[str, ...], text: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` for texts that hold one of ``marks``, as each of its matches does; others need no search.

    The lambda names the text, so that the steps before stand in the plan once.
    """
    held = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])
    return F.transform(F.array(text), lambda t: F.when(held(t), step(t)).otherwise(t))[0]


def _any_case(pattern: str, lowered: bool) -> str:
    """Case-insensitive form of a lower-case pattern.

    On lowered text only the dotless i and the long s still differ from the
    letters they fold to; naming them is faster than a case-insensitive match.
    """
    if not lowered:
        return "(?iu)" + pattern
    return pattern.replace("a-z", "a-zıſ").replace("i", "[iı]").replace("s", "[sſ]")


def clean_text(text: Column | str, lowercase: bool = True, remove_special_chars: bool = True) -> Column:
    """Cleaned form of a text column; null gives the empty string.

    Every white space is a plain blank after the first step, which lets the
    later patterns test for a blank only. Patterns are possessive where they
    could backtrack, so a long run without blanks costs linear time.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    t = F.regexp_replace(t, UNEVEN_SPACE, " ")
    if lowercase:
        t = F.lower(t)
    rest = ("(?s)" + _any_case("(?=a)", lowercase) + START
            + _any_case("authors? +contributions?", lowercase) + END + ".*")
    if lowercase:
        t = _where(("author",), t, lambda x: _drop(x, rest))
    else:
        t = F.when(F.contains(t, F.lit("author")) & F.contains(t, F.lit("contribution")), _drop(t, rest)).otherwise(t)
    # Noise words and digit-letter tokens are disjoint whole words: one pass.
    words = _any_case(f"(?:{'|'.join(NOISE_WORDS)}|", lowercase) + DIGIT + "++" + _any_case("[a-z])", lowercase)
    t = _drop(t, START + words + END)
    fig = _any_case("(?=f)", lowercase) + START + _any_case("fig *", lowercase) + DIGIT + "++" + END
    table = _any_case("(?=t)", lowercase) + START + _any_case("table *", lowercase) + DIGIT + "++" + END
    if lowercase:
        t = _where(("fig", "fıg"), t, lambda x: _drop(x, fig))
        t = _where(("table",), t, lambda x: _drop(x, table))
    else:  # too many spellings to name
        t = _drop(_drop(t, fig), table)
    t = _where(("[",), t, lambda x: _drop(x, rf"\[{DIGIT}++\]"))
    t = _where(("://",), t, lambda x: _drop(x, r"https?://[^ ]++"))
    t = _where(("@",), t, lambda x: _drop(x, r"(?<![^ ])[^ ][^ @]*+@[^ ]++"))
    t = _drop(t, rf"(?={DIGIT}){START}{DIGIT}++{END}(?!\.{DIGIT})")
    if not remove_special_chars:
        separators = "  +"
    else:  # lowered text holds no capitals
        letters = ascii_lowercase if lowercase else ascii_letters
        separators = _not_plain(letters + digits)
    t = F.regexp_replace(t, separators, " ")
    return F.trim(t)


def reduction_percent(raw: Column, clean: Column) -> Column:
    """Share of characters removed, in percent; 0 for an empty text."""
    n_raw = F.length(raw)
    return F.when(n_raw > 0, (1 - F.length(clean) / n_raw) * 100).otherwise(F.lit(0.0))


def removed_keywords(raw: Column, clean: Column) -> Column:
    """Reported keywords present in the raw and absent from the cleaned text."""
    low_raw, low_clean = F.lower(raw), F.lower(clean)
    return F.filter(
        F.array(*[F.lit(w) for w in REPORTED_KEYWORDS]),
        lambda w: F.contains(low_raw, w) & ~F.contains(low_clean, w),
    )


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~F.rlike(text, F.lit(rf"[^\s\x1c-\x1f\x85\p{{Z}}]")), F.lit(True))


def stripped_length(text: Column) -> Column:
    """Length without leading and trailing white space (any Unicode kind)."""
    stripped = F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")
    return F.coalesce(F.length(stripped), F.lit(0))
