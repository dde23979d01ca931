"""Words of a text are found once, whatever is asked of them."""

import pytest
from pyspark.sql import functions as F

from heliograph import catalog
from heliograph.functions import text as T


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "Der Hund und the cat"), (2, "le chat, les DES"), (3, "nothing here"), (4, ""), (5, None), (6, "und la el")], "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_languages_find_words_once(docs):
    from heliograph.catalog_media import _STOPS

    df = docs.select("doc_id", T.language_by_words(T.terms(F.col("text")), _STOPS).alias("lang"))
    assert plan(df).count("regexp_extract_all") == 1
    assert dict(df.collect()) == {1: "de", 2: "fr", 3: None, 4: None, 5: None, 6: "de"}
