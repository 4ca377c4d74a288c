import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomtrace.llm import chat, decontaminate, language, quality, toxicity, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(text, items, width):
    words = ALNUM.findall((text or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    hit, found = [0] * len(words), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if x := windows.get(tuple(words[k : k + n])):
                found |= x
                hit[k : k + n] = [1] * n
    return len(words), sum(hit), sorted(found - {None})  # an item without an id hits, but has none to list


def test_decontamination_against_brute_force(spark, monkeypatch):
    random.seed(5)
    word = lambda: random.choice(["ab", "b", "Cé", "d9", "e", "zz"])
    texts = [" ".join(word() + random.choice(["", ".", ",", "-"]) for _ in range(random.randint(0, 60))) for _ in range(50)] + [None, "", " ab " * 400]
    items = [(k, " ".join(word() for _ in range(random.choice([0, 2, 3, 5, 9])))) for k in range(25)] + [(3, "ab b e zz"), (90, None), (None, "ab b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench = bench.unionByName(bench)  # repeats are one
    monkeypatch.setattr(decontaminate, "PART_WORDS", 3)
    for block_chars in (10**6, 60):  # one block of phrases, and several
        got = {r.doc_id: r for r in decontaminate.decontaminated(docs, bench, 4, block_chars, clean=True).collect()}
        for i, t in enumerate(texts):
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == leaks(t, items, 4)
            left = len(ALNUM.findall((got[i].clean_text or "").translate(LOW)))
            assert left == got[i].n_words - got[i].n_hit
    assert decontaminate.decontaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_fm_index_locates_every_occurrence():
    random.seed(6)
    text = np.array([random.choice([0, 1, 2, 3]) for _ in range(500)] + [1, 2] * 200 + [0])
    index = decontaminate.FMIndex(text, 3)
    for n in (1, 2, 3, 7):
        phrases = np.array([[random.choice([1, 2, 3]) for _ in range(n)] for _ in range(20)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_one_shard_is_held_at_a_time(monkeypatch):
    """Three shards in turn take at most 16 bytes a byte of one shard's text: narrow ranks, and no index kept beside the next."""
    random.seed(7)
    texts = [" ".join(f"w{random.randrange(5000)}" for _ in range(300)) for _ in range(600)]
    most = len("".join(texts)) // 3 + 2000
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", most)
    block = SimpleNamespace(value=decontaminate.Phrases([(1, texts[0][:200])], 10))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        rows = [out.num_rows for out in decontaminate._search([block], [], False)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows) == 3 and sum(rows) == 600
    assert peak < 16 * most


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_counts(odd, none):
    for r, d in zip(sorted(quality.line_first(odd).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)), sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(d.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.line_first(none).count() == 0


def test_quality_lines(spark):
    prose = " ".join(f"Sentence{i} number{i} has{i} seven{i} words{i} here." for i in range(12))
    nav = "\n".join(" | ".join(f"menu{i}{j}" for j in range(6)) for i in range(12))
    loud = "\n".join(f"BUY NOW!! CHEAP!! ITEM!! NUMBER{i}!! TODAY!! OFFER{i}!! ENDS!!" for i in range(12))
    rows = [(1, prose), (2, prose + "\nLicensed under the Apache License, Version 2.0."), (3, nav), (4, loud), (5, prose[: len(prose) // 3] + "\n" + nav)]
    got = {r.doc_id: r for r in quality.line_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, True, False, False, False]
    assert got[2].clean_text == prose and got[5].n_lines_removed == 12


NOTICES = ("all rights reserved", "click here", "cookie policy", "licensed under", "mit license", "read more")


def why(line):
    """The line rules once more, by plain counting; words of ASCII only."""
    words = line.split()
    text = " " + " ".join(words) + " "
    notice = sum(line.lower().count(p) * len(p.split()) for p in NOTICES)
    if notice * 4 >= len(words):
        return "boilerplate"
    if len(words) >= 3:
        if sum(text.count(f" {x} ") for x in ("|", "/", ">>", "<<", "::")) >= max(2, len(words) / 5):
            return "navigation"
        if sum(map(line.count, "#*$%&|<>{}[]~^=\\_@+")) + line.count("!!") + line.count("??") >= 0.3 * len(words):
            return "symbols"
        upper, letters = sum(c.isupper() for c in line), sum(c.isalpha() for c in line)
        if upper > 8 and upper > 0.6 * letters:
            return "shouting"
    end = line.rstrip().rstrip("\"')]}")
    if len(words) < 8 and end[-1:] not in tuple(".!?:;"):
        return "punctuation"
    return None


def test_quality_verdict_against_brute_force(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    kinds = [lambda: plain(12) + ".", lambda: plain(4), lambda: plain(5) + ".", lambda: " | ".join(plain(1) for _ in range(6)), lambda: plain(9) + " " + rng.choice("#$%=") * rng.randrange(9), lambda: plain(10).upper() + " AND ABCDEFGHIJKLMNOP", lambda: rng.choice(NOTICES) + " " + plain(rng.randrange(9)), lambda: plain(20) + " (read more)", lambda: "", lambda: "  "]
    texts = []
    for k in range(300):
        weights = [rng.random() ** 4 for _ in kinds]
        texts.append("\n".join(rng.choices(kinds, weights)[0]() for _ in range(rng.randrange(1, 25))))
    texts += ["\n".join(f"Click here, read more of w{k}, all rights reserved." for k in range(400)) + "\n" + plain(60) + ".", "\n".join(f"{plain(24)} cookie." for _ in range(400))]
    got = {r.doc_id: r for r in quality.line_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    verdicts = Counter()
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.split()]
        left = [x for x in lines if why(x) is None]
        chars = lambda rows: sum(len(w) for x in rows for w in x.split())
        n, *_, again = base(t)
        failed = n < 50 or 2 * again > n
        keep = not failed and 2 * chars(left) >= chars(lines) and sum(len(x.split()) for x in left) >= 25
        verdicts[keep] += 1
        assert (got[i].base_failed, got[i].kept, got[i].n_lines_removed) == (failed, keep, len(lines) - len(left)), t
        assert [x for x in got[i].clean_text.split("\n") if x.split()] == left
    assert min(verdicts.values()) > 30
    assert not got[300].kept and got[301].kept and got[301].n_lines_removed == 0


def test_language(spark, odd, none):
    docs = [(i, " ".join(random.Random(i).choices(["haus", "straße", "nicht", "und"] if i % 2 else ["house", "street", "not", "and"], k=20)), "de" if i % 2 else "en") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit(df, steps=120)
    got = {r.doc_id: r for r in language.identified(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in docs)
    rest = language.identified(odd, model).collect()
    assert {r.doc_id: r.lang_pred for r in rest if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert language.identified(none, model).count() == 0
    untaught = language.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language.identified(df, untaught).collect()} == {("und", 0.0)}


def test_network_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language.initial(3, rng).items()}
    x, label = rng.integers(97, 102, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    g, _ = language.gradients(p, x, label)

    def loss():
        y = language.log_probabilities(p, x)
        return -y[:, label, np.arange(5)].mean()

    for k in p:
        for at in list(np.ndindex(p[k].shape))[:: max(1, p[k].size // 7)] + ([(98, 5)] if k.endswith("x") else []):
            p[k][at] += 1e-3
            up = loss()
            p[k][at] -= 2e-3
            down = loss()
            p[k][at] += 1e-3
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4, (k, at)


def test_toxicity(spark, odd, none):
    rng = random.Random(7)
    words = ["tree", "house", "river", "green", "walk", "stone", "bird", "light"]
    rows = [(i, " ".join(rng.choices(words, k=15) + (["vilest", "fool"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9, None), (10**6, 5)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    assert 0 < len(model) < 200  # sparse
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, _, y in rows:
        if zlib.crc32(str(i).encode()) % 3 == 1:
            assert (got[i] >= toxicity.THRESHOLD) == bool(y)
    rest = toxicity.score(odd, model)
    assert set(rest.columns) == set(odd.columns) and all(0 <= r.score <= 1 for r in rest.collect())
    assert toxicity.score(none, model).count() == 0
    assert len(toxicity.fit(toxicity.labelled_sample(docs, labels.where("false")))) == 0


def test_features_are_words_pairs_skips_and_stems():
    doc, bucket = (np.concatenate(x) for x in zip(*toxicity.features(pa.array(["a b c", None, "a", "longer"]))))
    assert Counter(doc.tolist()) == {0: 3 + 2 + 1, 2: 1, 3: 2}
    _, same = (np.concatenate(x) for x in zip(*toxicity.features(pa.array(["A, B! c"]))))
    assert sorted(same.tolist()) == sorted(bucket[doc == 0].tolist())


def test_urls(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://a.example.org/es/1?q", None), (2, "https://X.Example.ORG/en/15", ""), (3, "http://b.org", "x"), (4, "nonsense", None), (5, None, None),
        (6, "http://d.net/alias", link.format("https://e.example.org/es/9")), (7, "http://f.net/x", link.format("http://d.net/alias")),
        (8, "http://g.com/fr/1", link.format("http://d.net/alias")), (9, "http://h.com/de/5#f", None), (10, "http://c.net/y", '<meta http-equiv=refresh content="0; url=/z">'), (10, "http://c.net/y", None),
    ]
    got = {r.page_id: r for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("b.org", "", None, "allow")
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (4, 5))
    assert (got[6].rule, got[6].verdict, got[7].verdict, got[7].by_alias) == (None, "block", "block", True)
    assert (got[8].rule, got[8].verdict, got[8].by_alias) == ("com/fr/", "allow", False)
    assert got[9].verdict == "block" and got[10].verdict == "allow"
    redirects = spark.createDataFrame([("http://c.net/y", "http://h.com/de/1"), (None, "x")], "from_url string, to_url string")
    again = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES, redirects).collect()}
    assert again[10] == "block"
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string, html string"), urls.RULES).count() == 0


def some_model():
    rng = random.Random(2)
    total = None
    for _ in range(60):
        turns = [("user", rng.choice(["User: ", "[User] ", "### Human\n", ""]) + "hi there?"), ("assistant", rng.choice(["Assistant: ", "**AI:** ", ""]) + "Well, " + "this is it. " * rng.randrange(9) + "\nmore of it")] * 2
        turns = ([("system", "System: rules")] if rng.random() < 0.2 else []) + turns
        counts = chat.counts_of(turns, True)
        total = counts if total is None else {k: total[k] + v for k, v in counts.items()}
    return chat.log_model(total)


MODEL = some_model()


def test_transcripts():
    assert chat.parse(MODEL, "User: hi there?\nmore\n\n[Assistant] Hello.\nIt is.\n\n### Human\nBye") == [("user", "hi there?\nmore"), ("assistant", "Hello.\nIt is."), ("user", "Bye")]
    assert chat.parse(MODEL, None) == [] and chat.parse(MODEL, " \n ") == []
    assert chat.rendered([("user", "x")]) == "<|user|>\nx\n<|end|>"
    assert len(chat.parse(MODEL, "word " * 50_000)) == 1


def test_viterbi_finds_the_likeliest_path():
    rows = np.array([[2, 1, 1, 0], [0, 1, 0, 1], [3, 0, 0, 2], [0, 0, 1, 0]])
    best, score = None, -np.inf
    for path in np.ndindex(*[chat.N_STATES] * 4):
        s = MODEL["start"][path[0]] + sum(MODEL["move"][a, b] for a, b in zip(path, path[1:])) + sum(MODEL["emit"][(k, *r)] for k, r in zip(path, rows.tolist()))
        if s > score:
            best, score = list(path), s
    assert chat.viterbi(MODEL, rows) == best


def test_chat_over_a_table(spark):
    turns = [(1, 0, "user", "What is it?"), (1, 1, "assistant", "A thing.\nWith lines."), (1, 1, "assistant", "A thing.\nWith lines."), (2, None, None, "x"), (3, 0, "BOSS", None), (4, 100, "System", "Be kind.")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = chat.transcripts(df.selectExpr("*", "1 AS place", "2 AS part"), unmarked=0)
    got = chat.formatted_parts(parts, chat.fit(parts)).collect()
    assert {(r.conv_id, r.part): r.parsed_roles for r in got} == {(1, 0): ["user", "assistant", "assistant"], (2, 0): ["user"], (3, 0): [], (4, 0): ["system"]}
    assert all([x.role for x in r.turns] == r.parsed_roles for r in got)
    none = chat.transcripts(df.where("false"))
    assert chat.formatted_parts(none, chat.fit(none)).count() == 0


def test_parts_are_parsed_as_one_chain(spark):
    rng = random.Random(5)
    lines = [rng.choice(["User: what?", "plain text", "[Assistant] well", "", "x" * 100, "is it?", "### System"]) for _ in range(400)]
    whole = chat.viterbi(MODEL, chat.observed(lines)[0])
    cuts, parts, at = [37, 120, 121, 260, 400], [], 0
    for c in cuts:
        parts.append(lines[at:c])
        at = c
    rows = [chat.observed(p)[0] for p in parts]
    for k, r in enumerate(rows[1:], 1):  # what a part can't see: whether a blank line came before it
        if len(r):
            last = next(x for x in reversed(lines[: cuts[k - 1]]) if True)
            r[0, 1] = int(not last.strip())
            r[0, 1] |= int(not parts[k][0].strip())
    ends = chat.boundaries([chat.transfer(MODEL, r) for r in rows])
    states = [s for r, (a, b) in zip(rows, ends) for s in chat.viterbi(MODEL, r, a, b)]
    score = lambda path: MODEL["start"][path[0]] + sum(MODEL["move"][a, b] for a, b in zip(path, path[1:]))
    assert len(states) == len(whole) and all(b == c for (_, b), (c, _) in zip(ends, ends[1:]))
    emitted = chat._emitted(MODEL, chat.observed(lines)[0])
    total = lambda path: score(path) + sum(e[s] for e, s in zip(emitted, path))
    assert abs(total(states) - total(whole)) < 1e-9


def test_a_long_conversation(spark):
    rng = random.Random(6)
    turns = [(7, i, ("user", "assistant")[i % 2], " ".join(rng.choices(["how", "is", "it", "then"], k=5)) + ("?" if i % 2 == 0 else ".\nAnd so on, with more words.")) for i in range(300)] + [(8, None, "user", f"null turn {i}") for i in range(100)]
    parts = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = chat.formatted_parts(parts, chat.fit(parts)).collect()
    assert max(len(r.turns) for r in got) <= chat.PART and sum(len(r.turns) for r in got) == 400
    assert sum([x.role for x in r.turns] == r.parsed_roles for r in got if r.conv_id == 7) >= 3


def test_hash_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_buckets_are_packed_and_unpacked():
    for at in ([], [0], [5, 65_540, 131_075, 1_048_575], [65_535], [131_070, 131_071], list(range(0, 1 << 20, 777))):
        assert toxicity.unpacked(toxicity.packed(np.array(at, np.int32))).tolist() == at


def test_ftrl_training_against_a_plain_version(spark, monkeypatch):
    """Shards, rounds and the mean over the shards that met a coordinate, one coordinate at a time in plain floats."""
    import math

    random.seed(8)
    words = [["kind", "sun", "sky", "calm"], ["vile", "rot", "sky", "mud"]]
    rows = [(i, " ".join(random.choice(words[i % 2]) for _ in range(6)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 80)
    sample = toxicity.labelled_sample(docs, labels).cache()
    assert sample.select("shard").distinct().count() > 1
    got = toxicity.fit(sample, rounds=3)

    def buckets(text):
        return np.unique([toxicity.BIAS, *(b for _, bs in toxicity.features(pa.array([text])) for b in bs.tolist())]).astype(np.int32)

    import xxhash

    shards = {}
    for r in sample.collect():
        shards.setdefault(r.shard, []).append((r.label, xxhash.xxh64_intdigest(toxicity.packed(buckets(r.text))), buckets(r.text).tolist()))
    z, n = Counter(), Counter()
    weight = lambda zi, ni: 0.0 if abs(zi) <= toxicity.L1 else -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2)
    for _ in range(3):
        moved = {}
        for k, part in shards.items():
            part, zs, ns = sorted(part), dict(z), dict(n)
            for at in np.random.default_rng(len(part) + k).permutation(len(part)):
                y, _, bs = part[at]
                w = {b: weight(zs.get(b, 0.0), ns.get(b, 0.0)) for b in bs}
                g = 1 / (1 + math.exp(-sum(w.values()))) - y
                for b in bs:
                    before = ns.get(b, 0.0)
                    ns[b] = before + g * g
                    zs[b] = zs.get(b, 0.0) + g - (math.sqrt(ns[b]) - math.sqrt(before)) / toxicity.ALPHA * w[b]
            for b in ns:
                if ns[b] != n[b]:
                    moved.setdefault(b, []).append((zs[b] - z[b], ns[b] - n[b]))
        for b, changes in moved.items():
            z[b] += sum(c for c, _ in changes) / len(changes)
            n[b] += sum(c for _, c in changes) / len(changes)
    want = {b: weight(z[b], n[b]) for b in z if abs(z[b]) > toxicity.L1 * (1 + 1e-4)}
    found = dict(zip(got["bucket"].tolist(), got["weight"].tolist()))
    assert want and all(abs(found[b] - w) < 1e-3 for b, w in want.items()) and len(found) <= len(want) + 2


def test_a_conversation_of_blank_turns_has_a_row(spark):
    rows = [("a", 1, "user", " "), ("a", 2, "assistant", None), ("b", 1, "user", "hi there"), ("b", 2, "user", ""), ("b", 2, "user", "")]
    parts = chat.transcripts(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    got = {r.conv_id: r for r in chat.formatted_parts(parts, chat.fit(parts)).collect()}
    assert got["a"].transcript == "" and got["a"].turns == [] == got["a"].parsed_roles and got["a"].chat == ""
    assert [x.role for x in got["b"].turns] == got["b"].parsed_roles == ["user"]
