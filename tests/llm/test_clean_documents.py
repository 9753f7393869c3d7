"""What decontamination reads as words, and what it moves."""

import re

from pyspark.sql import functions as F
from helpers import docs_table

from panelcheck.llm import decontaminate

ITEMS = "item_id bigint, text string, key int, body string"


def test_words_are_cut_at_gaps(spark):
    """Nulls, empty texts, gaps at either end and letters of other scripts."""
    texts = [None, "", " - ", "A", "Ab-cD", "--a--", "Éİx \x7f\x80y", "a\x00b\nC", "😀z Z😀", "ß`_{|}~1 2"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", decontaminate.words(F.col("text")).alias("w"))
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    assert {r.i: r.w for r in table.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_texts_stay_where_they_are_when_few_are_dropped(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 1, "b")], ITEMS)
    texts = [None, "x ONE two three four five six seven eight nine ten y", "one two", "ten nine"] * 2
    docs = [(i, t, "en", "a") for i, t in enumerate(texts)]
    kept = decontaminate.clean_documents(docs_table(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6, 7]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
