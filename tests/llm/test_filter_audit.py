import os
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from loomtrace.llm import filter_audit
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)))
    return {x for x, failed in zip("ABCD", tests) if failed}


def plain(docs, labels):
    """(part, order, step) -> the seven counts, by going through the rows of each part in each order."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = [(s or "", fails(t or "") | ({"E"} if i is not None and least[t or ""] < i else set()), i) for i, t, s in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {p for p, *_ in rows}:
        of_part = [(f, i) for p, f, i in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = of_part
            for k, letter in enumerate(order):
                gone = [(f, i) for f, i in left if letter in f]
                left = [(f, i) for f, i in left if letter not in f]
                earlier = sum(letter in f and bool(f & set(order[:k])) for f, _ in of_part)
                out[part, order, k + 1] = [len(left), len(gone), earlier, sum(f == {letter} for f, _ in of_part), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                shapley[part, letter] += len(gone)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def got(spark_rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in spark_rows.collect()}


TEXTS = [None, "", " \n", "a b c d", "a " * 300, " ".join(f"w{i}" for i in range(250)), "A B C " + "x " * 200, "# " + " ".join(f"é{i}" for i in range(220)), "$ A A A", "long " * 30_000]
DOCS = [(i % 37 if i % 11 else None, TEXTS[i * i % 10], ["s", None, "", "t"][i % 4]) for i in range(120)]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (4, 0, 0), (5, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_against_going_through_the_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", broadcast)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'x' AS part", "2L AS h", "3 AS n").repartition(3)
    marks = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good")
    assert got(filter_audit.audit(docs, marks)) == plain(DOCS, LABELS)


def test_odd_and_empty_tables(spark, odd, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(odd, marks)) == plain([(i, t, s) for i, t, _, s in ROWS], [])
    assert filter_audit.audit(none, marks).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_op13(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    assert got(filter_audit.op13_filter_audit(spark, SF)) == plain(docs, labels)
