"""Every registered query against its SQL, at the smallest scale that has all cases."""

import os

import pytest

import __spark_entry__ as registry
from oracle import same

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n in registry.oracle_sql() if not n.startswith("op"))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), SF, registry.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert {r.verdict for r in rows} >= {"ok", "notInText", "currencyMismatch"}


def test_odd_texts_are_normalized_as_the_sql_says(spark, tmp_path):
    """Line breaks among the first characters, and texts that have hidden characters, hard spaces and ligatures by themselves."""
    texts = ["A.\nB.", "a\r\nb", "\n\n\n\n", "ab c", "abc", "abcd", "", None, "~", "~C2A0;", "ﬁ fi x", "­", "f­i", "a~ b~41;", "x\u0001y\u0085 fi", "  ~", "🙂🙂🙂🙂", "🙂‍🙂ﬀ"]
    rows = [(i, t, f"l{i}", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(registry.queries()["p1_normalize_pages"](spark, str(tmp_path)), str(tmp_path), registry.oracle_sql()["p1_normalize_pages"]) == len(texts)
