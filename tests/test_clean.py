import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from docsift.functions.clean import clean_text, is_blank, stripped_length
from docsift.functions.stopwords import ENGLISH, combine, read_stop_words
from docsift.functions.tokens import terms, tokens
from docsift.operators.documents import clean_documents, cleaning_stats, comparison_report, keyword_report

GOLDEN = [
    (None, ""),
    ("", ""),
    ("       ", ""),
    ("Please contact admin@site.org or visit https://github.com for more information",
     "please contact or visit for more information"),
    ("12.5 1.2.3 10.5", "12 1 2 10"),
    ("v79 3.14, 42.", "v79 3"),
    ("10(-7) tesla", "tesla"),
    ("see Fig 3, fig12, Table  4 and panel 2b [7] [8,9]", "see and panel"),
    ("PhD degrees; master's degree", "degrees s"),
    ("authors contribution degree", ""),
    ("degree authors degree contribution", "authors contribution"),
    ("body text Author Contributions: A.B. wrote it", "body text"),
    ("fig_3 a_b 1,000 1st 3a4", "fig 3 a b 1st 3a4"),
    ("mail:x@y.z,next", ""),
    ("café réeducation éducation 5² ① ١٢", "caf r education ducation 5"),
    ("a\u001cb\u0085c d", "a b c d"),
    ("@start end@ a@b @@c", "start end"),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("raw,want", GOLDEN)
def test_golden(spark, raw, want):
    assert one(spark, raw, clean_text("t")) == want


def test_letters_that_fold_to_ascii(spark):
    # The long s and the dotless i match s and i when case is ignored.
    assert one(spark, "a maſter dıploma b", clean_text("t")) == "a b"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("The AUTHOR Contribution of HTTP://A.b PhD Fig 2", "The AUTHOR Contribution of HTTP A b"),
        ("The author and contribution: Author Contributions x", "The author and contribution"),
    ],
)
def test_keep_case(spark, raw, want):
    assert one(spark, raw, clean_text("t", lowercase=False)) == want


def test_keep_specials(spark):
    assert one(spark, "A-b, c. 12.5 (x) 7", clean_text("t", remove_special_chars=False)) == "a-b, c. 12. (x)"


def test_long_run_is_linear(spark):
    run = "x" * 2_000_000
    assert one(spark, f"a {run} b 3 @", F.length(clean_text("t"))) == len(run) + 4


def test_blank_and_length(spark):
    rows = [(None,), ("",), ("  \n",), ("  a b  ",)]
    out = spark.createDataFrame(rows, "t string").select(is_blank(F.col("t")), stripped_length(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [(True, 0), (True, 0), (True, 0), (False, 3)]


def test_tokens_and_terms(spark):
    assert one(spark, "the V79 cells x grew fast", tokens("t")) == ["cells", "grew", "fast"]
    grams = one(spark, "cells of mice grew", terms(tokens("t"), (1, 2)))
    assert grams == ["cells", "mice", "grew", "cells mice", "mice grew"]
    assert one(spark, "alone", terms(tokens("t"), (1, 2))) == ["alone"]
    assert one(spark, "", terms(tokens("t"), (1, 2))) == []


def test_stop_words(spark, tmp_path):
    public = StopWordsRemover.loadDefaultStopWords("english")
    assert ENGLISH == [w for w in public if w.isascii() and w.isalpha() and len(w) > 1]
    (tmp_path / "own.txt").write_text("cells\nunited kingdom\n\n mice \n")
    own = read_stop_words(spark, str(tmp_path / "own.txt"))
    assert own == ("cells", "mice", "united kingdom")
    assert one(spark, "cells of mice grew", tokens("t", combine(ENGLISH, own))) == ["grew"]
    assert one(spark, "cells of mice", tokens("t", ())) == ["cells", "of", "mice"]


def test_reports(spark):
    docs = spark.createDataFrame(
        [("b.txt", "My University education 3"), ("a.txt", None), ("c.txt", "plain")], "filename string, text string"
    )
    cleaned = clean_documents(docs)
    assert {r.filename: r.removed for r in keyword_report(cleaned).collect()} == {"b.txt": "education, university"}
    first = comparison_report(docs, n=2).collect()
    assert [r.filename for r in first] == ["a.txt", "b.txt"] and first[0].reduction == 0
    stats = cleaning_stats(cleaned).first()
    assert (stats.n_docs, stats.raw_chars, stats.clean_chars) == (3, 30, 7)
    assert cleaning_stats(clean_documents(docs.limit(0))).first().reduction == 0


def test_other_filters_and_pruning_pass_the_cleaning(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(path)
    kept = clean_documents(spark.read.parquet(path)).filter("doc_id = 5").select("doc_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint>" in plan


def test_steps_without_their_marks(spark):
    """Texts without the marks of a step are left as they are; every spelling of a match has one."""
    texts = ["FİG 3 fıg 12 fig7 table 4 x", "tables 4 [12] [x] a[3]", "a@b c http://x.y/z d https://q", "no marks at all 5a 77",
             "ok Author contributions: all", "authorſ contrıbutıonſ gone", "@ [ :// author fig table", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in docs.select("i", clean_text("t").alias("c")).orderBy("i").collect()]
    assert got[2:] == ["c d", "no marks at all", "ok", "", "author fig table", "", ""]
    assert got[1].split() == ["tables", "x", "a"] and "12" not in got[0] and "table" not in got[0] and got[0].endswith("x")
