import random

import xxhash
from pyspark.sql import functions as F

from loomtrace.llm import line_dedup, simhash
from loomtrace.operators.graph import components


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, j) for j in range(5001, 5100)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    of = {}

    def root(x):
        of.setdefault(x, x)
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            of[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == root(x) for x in of)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, odd):
    random.seed(2)
    base = [random.choice("abcdefghij") * 3 for _ in range(400)]
    rows = [(100 + i, " ".join(base[: 380 + i % 20])) for i in range(40)]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)))
    got = simhash.near_duplicates(docs).collect()
    texts = docs.collect()
    assert len(got) == len(texts)
    of = {(r.doc_id, r.text): fingerprint(r.text) for r in texts}
    prints = sorted(set(of.values()))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (i, _), p in of.items():
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    want = sorted((i is not None, i or 0, p, least.get(find(p))) for (i, _), p in ((k, of[k]) for k in ((r.doc_id, r.text) for r in texts)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in got) == want


def test_masks_cover_every_pair_of_bits():
    for a in range(64):
        for b in range(a + 1):
            assert any(not (m >> a & 1) and not (m >> b & 1) for m in simhash.masks())


def test_links_in_a_crowded_bucket(spark):
    """Hundreds of fingerprints around one: found without pairs, as brute force finds them."""
    random.seed(3)
    prints = {0x0123456789ABCDEF} | {0x0123456789ABCDEF ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(150)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = {r.node % 2**64: r.component % 2**64 for r in components(simhash.links(df)).collect()}
    group = {p: found.get(p, p) for p in prints}
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                assert group[a] == group[b]
    seen, todo = {0x0123456789ABCDEF}, [0x0123456789ABCDEF]
    while todo:
        a = todo.pop()
        new = {b for b in prints - seen if bin(a ^ b).count("1") <= 2}
        seen |= new
        todo += new
    assert {p for p in prints if group[p] == group[0x0123456789ABCDEF]} == seen


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


def brute(texts, least):
    docs = [[tuple(line.encode().split()) for line in (t or "").split("\n") if line.encode().split()] for t in texts]

    def windows(lines):
        for i in range(len(lines)):
            n = 0
            for e in range(i, len(lines)):
                n += len(lines[e])
                if n >= least:
                    yield i, e, tuple(lines[i : e + 1])
                    break

    first, cut = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for i, e, w in windows(lines):
            first.setdefault(w, (d, i, e))
    for d, lines in enumerate(docs):
        for i, e, w in windows(lines):
            a, p, q = first[w]
            if (a, p) == (d, i):
                continue
            own_end, b, x = q, i, e
            while b and p and lines[b - 1] == docs[a][p - 1]:
                b, p = b - 1, p - 1
            while x + 1 < len(lines) and q + 1 < len(docs[a]) and lines[x + 1] == docs[a][q + 1]:
                x, q = x + 1, q + 1
            cut[d] |= set(range(max(b, own_end + 1) if a == d else b, x + 1))
    return [[line for k, line in enumerate(lines) if k not in c] for lines, c in zip(docs, cut)]


def test_line_dedup_against_brute_force(spark):
    random.seed(4)
    pool = [" ".join(random.choice("abcdefg") * random.randint(1, 4) for _ in range(random.randint(1, 9))) for _ in range(40)]
    passages = [[random.choice(pool) for _ in range(random.randint(3, 8))] for _ in range(6)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(random.randint(0, 4)):
            lines += random.choice(passages) if random.random() < 0.5 else [random.choice(pool) for _ in range(3)]
            lines += ["  "] * random.randint(0, 1)
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs, 12).collect()}
    want = brute(texts, 12)
    for i, text in enumerate(texts):
        assert [tuple(x.encode().split()) for x in got[i].clean_text.split("\n") if x.split()] == want[i]
        assert got[i].n_lines - got[i].n_removed == len(want[i])
        if not got[i].n_removed:
            assert got[i].clean_text == text
    assert sum(r.n_removed for r in got.values()) > 50


def test_line_dedup_of_odd_rows(odd, none):
    rows = line_dedup.deduplicated(odd, 5).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].clean_text is None and by[3].clean_text == "" and by[4].n_lines == 0
    assert by[1].n_removed == 0 and by[5].n_removed == 2 and by[5].clean_text == ""
    assert by[9].n_removed == 53  # a window of its own repeats stays
    assert line_dedup.deduplicated(none).count() == 0
