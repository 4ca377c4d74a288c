"""Pairs of words are features: classes that only the order of words tells apart."""

from pyspark.ml import Pipeline

from loomtrace.plans import review_queries


def test_order_of_words_tells_classes_apart(spark):
    rows = [(t, float(k)) for k, t in ((0, "red green blue"), (1, "blue green red")) for _ in range(10)]
    df = spark.createDataFrame(rows, "text string, label double")
    got = Pipeline(stages=review_queries.tfidf_stages()).fit(df).transform(df)
    assert got.where("prediction = label").count() == 20
