"""Near copies against brute force over all pairs of shingle sets."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from loomtrace.llm import near_copies


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(words, n):
    words = list(words)
    for k in random.sample(range(len(words)), n):
        words[k] = f"new{random.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_against_brute_force(spark, odd):
    random.seed(4)
    rows = []
    for _ in range(30):
        base = [f"w{random.randrange(5000)}" for _ in range(random.choice((3, 60, 150, 300)))]
        rows += [(100 + len(rows) + k, edited(base, min(len(base), k))) for k in range(6)]
    crowd = [f"c{random.randrange(5000)}" for _ in range(200)]
    rows += [(1000 + k, edited(crowd, 1 + k % 3)) for k in range(80)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = docs.collect()
    roots = components([shingles(r.text) for r in texts])
    least = {}
    for r, x in zip(texts, roots):
        if r.doc_id is not None:
            least[x] = min(r.doc_id, least.get(x, r.doc_id))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    got = [(r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()]
    assert sorted(got, key=key) == sorted(((r.doc_id, least.get(x)) for r, x in zip(texts, roots)), key=key)


def test_a_crowd_of_unlike_texts_with_one_template(spark):
    """1,600 texts of which any two are 0.78 alike but for 800 pairs of 0.82: every pair is linked, and nothing else."""
    random.seed(6)
    template = [f"t{k}" for k in range(500)]
    rows = []
    for pair in range(800):
        own = [f"p{pair}x{k}" for k in range(14)]
        rows += [(2 * pair + side, " ".join(template + own + [f"s{pair}y{side}z{k}" for k in range(50)])) for side in (0, 1)]
    sets = [shingles(t) for _, t in rows[:4]]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[0], sets[1]) > 0.8 > alike(sets[0], sets[2]) > 0.75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_no_rows(none):
    assert near_copies.near_copies(none).count() == 0


def test_stage_drops_a_copy_with_one_changed_word(spark):
    """Its fingerprint differs in more than two bits, its shingles in a tenth."""
    random.seed(5)
    base = [f"w{random.randrange(5000)}" for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:50], "other", *base[51:]])), (3, edited(base, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert sorted(r.doc_id for r in P.copies_out(spark, docs, "").collect()) == [1, 3]
