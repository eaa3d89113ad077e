"""DuckDB SQL of the cleaning and TF-IDF rules, for the side-by-side check."""

from __future__ import annotations

from ..functions.clean import NOISE_WORDS, REPORTED_KEYWORDS
from ..functions.stopwords import ENGLISH

OTHER = r"[^\p{L}\p{N}_]"
MARK = "ꙮ"  # a letter that no document contains


def _sub(text: str, pattern: str, by: str = "", times: int = 1) -> str:
    for _ in range(times):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def _drop_word(text: str, word: str, fold: str) -> str:
    # No look-around in this dialect: edges are consumed and put back, and a
    # second pass catches words that shared an edge.
    return _sub(text, rf"{fold}(^|{OTHER}){word}($|{OTHER})", r"\1\2", 2)


def clean_sql(text: str, lower: bool = True, special: bool = True) -> str:
    fold = "" if lower else "(?i)"
    t = _sub(f"coalesce({text}, '')", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+", " ")
    if lower:
        t = f"lower({t})"
    cut = _sub(t, rf"(?s){fold}(^|{OTHER})authors? +contributions?($|{OTHER}.*)", r"\1")
    t = cut if lower else f"CASE WHEN contains({t}, 'author') AND contains({t}, 'contribution') THEN {cut} ELSE {t} END"
    t = _drop_word(t, rf"(?:{'|'.join(NOISE_WORDS)}|\p{{Nd}}+[a-z])", fold)
    t = _drop_word(t, r"fig *\p{Nd}+", fold)
    t = _drop_word(t, r"table *\p{Nd}+", fold)
    t = _sub(t, r"\[\p{Nd}+\]")
    t = _sub(t, r"https?://[^ ]+")
    t = _sub(t, r"[^ ]+@[^ ]+")
    t = _sub(t, r"(\p{Nd})\.(\p{Nd})", rf"\1{MARK}.\2", 2)
    t = _drop_word(t, r"\p{Nd}+", "")
    t = f"replace({t}, '{MARK}', '')"
    t = _sub(t, "[^a-zA-Z0-9]+" if special else " +", " ")
    return f"trim({t})"


SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def stripped_sql(text: str) -> str:
    return _sub(text, rf"^{SPACES}+|{SPACES}+$")


FILENAME = "printf('%05d.txt', doc_id)"

CLEANED = f"""cleaned AS MATERIALIZED (
  SELECT doc_id, {FILENAME} AS filename, text, {clean_sql('text')} AS clean FROM documents)"""


def removed_sql(raw: str, clean: str) -> str:
    words = [
        f"CASE WHEN contains(lower({raw}), '{w}') AND NOT contains(lower({clean}), '{w}') THEN '{w}' END"
        for w in REPORTED_KEYWORDS
    ]
    return f"concat_ws(', ', {', '.join(words)})"


def terms_ctes(source: str, prefix: str = "") -> str:
    """CTEs from ``source(doc_id, clean)`` to ``{prefix}tf(doc_id, term, tf)``."""
    stop = ", ".join(f"'{w}'" for w in ENGLISH)
    return f"""{prefix}words AS MATERIALIZED (
  SELECT doc_id, [x for x in regexp_extract_all(clean, '[a-z0-9]+')
                  if regexp_full_match(x, '[a-z]{{2,}}') and x not in ({stop})] AS l FROM {source}),
{prefix}token AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM {prefix}words),
{prefix}gram AS (
  SELECT doc_id, w AS term FROM {prefix}token
  UNION ALL
  SELECT a.doc_id, a.w || ' ' || b.w FROM {prefix}token a JOIN {prefix}token b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
{prefix}tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM {prefix}gram GROUP BY doc_id, term)"""


VOCAB = """stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY term HAVING count(*) >= 5),
top AS (SELECT * FROM stats ORDER BY ctf DESC, term LIMIT 2000),
vocab AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS feature_index, term AS feature_name, df, ctf,
         ln((1 + (SELECT count(*) FROM train)) / (1 + df)) + 1 AS idf FROM top)"""


def weights_cte(name: str, tf: str) -> str:
    return f"""{name}_raw AS (
  SELECT doc_id, feature_index, tf * idf AS w FROM {tf} JOIN vocab ON term = feature_name),
{name} AS MATERIALIZED (
  SELECT doc_id, feature_index, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM {name}_raw)"""


TRAIN = "train AS (SELECT doc_id, clean, quality AS y FROM cleaned JOIN labels USING (doc_id))"
FITTED = ",\n".join([CLEANED, TRAIN, terms_ctes("train"), VOCAB, weights_cte("weight", "tf")])

CLASS_SUMS = """size AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM train),
sums AS (
  SELECT feature_index, feature_name,
         coalesce(sum(tfidf) FILTER (y = 1), 0) AS s1, coalesce(sum(tfidf) FILTER (y = 0), 0) AS s0
  FROM vocab LEFT JOIN weight USING (feature_index) LEFT JOIN train USING (doc_id)
  GROUP BY feature_index, feature_name)"""
MEANS = f"""{CLASS_SUMS},
means AS MATERIALIZED (
  SELECT feature_index, feature_name, s1 / n1 AS useful_mean_tfidf, s0 / n0 AS not_useful_mean_tfidf,
         s1 / n1 - s0 / n0 AS difference FROM sums, size)"""
CHI2 = f"""{CLASS_SUMS},
expected AS (
  SELECT *, (n1 / (n1 + n0)) * (s1 + s0) AS e1, (n0 / (n1 + n0)) * (s1 + s0) AS e0 FROM sums, size),
chi2 AS MATERIALIZED (
  SELECT feature_index, feature_name, (s1 - e1) ** 2 / e1 + (s0 - e0) ** 2 / e0 AS chi2 FROM expected)"""
