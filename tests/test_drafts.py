"""Drafts of several outputs, published at once or not at all."""

import pytest

from loomtrace.sources import drafts


def test_a_stopped_draft_goes_on_and_readers_see_one_whole(spark, tmp_path):
    path, made = f"file://{tmp_path}/d", []

    def rows(name, n):
        def make():
            made.append(name)
            return spark.range(n)

        return make

    def stopped():
        raise KeyboardInterrupt

    assert drafts.current(spark, path) == (0, None)
    assert drafts.publish(spark, path, "a", {"texts": rows("texts", 3), "findings": rows("findings", 0)}, 0) == 1
    made.clear()
    with pytest.raises(KeyboardInterrupt):
        drafts.publish(spark, path, "b", {"texts": rows("texts", 5), "findings": stopped}, 1)
    assert drafts.current(spark, path) == (1, "a") and drafts.read(spark, path, "texts").count() == 3
    assert drafts.publish(spark, path, "b", {"texts": rows("texts", 5), "findings": rows("findings", 2)}, 1) == 2
    assert made == ["texts", "findings"]  # what had a receipt wasn't made again
    assert [drafts.read(spark, path, o).count() for o in ("texts", "findings")] == [5, 2] and drafts.read(spark, path, "texts", 1).count() == 3
    assert drafts.altered(spark, path) == []
    spark.range(9).write.mode("overwrite").parquet(f"{path}/drafts/b/findings")
    assert drafts.altered(spark, path) == ["findings"]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    drafts.publish(spark, path, "a", {"x": lambda: spark.range(1)}, 0)

    def other_first():
        drafts.publish(spark, path, "other", {"x": lambda: spark.range(2)}, 1)
        return spark.range(3)

    with pytest.raises(drafts.Stale):
        drafts.publish(spark, path, "late", {"x": other_first}, 1)
    with pytest.raises(drafts.Stale):
        drafts.publish(spark, path, "stale", {"x": lambda: spark.range(4)}, 0)
    assert drafts.current(spark, path) == (2, "other") and drafts.read(spark, path, "x").count() == 2
    # a revision file whose name isn't written yet is no revision
    (tmp_path / "d" / "revisions" / "000000000003").write_text("")
    assert drafts.current(spark, path) == (2, "other")
