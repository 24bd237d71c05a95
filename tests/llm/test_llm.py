import collections
import itertools
import random
import re

import numpy as np
import pytest

llm = pytest.importorskip("fathomlake.llm")
from fathomlake.llm import fmindex, htmltext, licenses, mixing, neardup, packing, quality, repeats, suffixarray, topk, urls  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, extra string"


def corpus(seed=0, n=60):
    """Random documents with copies, near copies, shared passages, degenerate runs, nulls, blanks and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéßñ") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = []
    for i in range(n):
        kind = i % 6
        t = text(rng.randint(0, 150))
        if kind == 1:
            t = t[: len(t) // 2] + " " + passage + "\n" + t[len(t) // 2 :]
        if kind == 2 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
        if kind == 3 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(min(2, len(w))):
                w[rng.randrange(len(w))] = "zzz"
            t = " ".join(w)
        rows.append((i * 3 - 30, t, "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n\t ", None), (1003, "a" * 400, "x"), (1004, "b " * 300, "x"), (1005, "a" * 200 + " tail", "x"), (1006, text(3000) + passage, "x"), (1007, "b " * 100, "x")]
    return rows


def removed(rows, units, length):
    seen, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        u = units(t or "")
        starts = [(s, u[s : s + length]) for s in range(len(u) - length + 1)]
        gone = {k for s, w in starts if (w if isinstance(w, bytes) else tuple(w)) in seen for k in range(s, s + length)}
        out[i] = (len(u), len(gone), [x for k, x in enumerate(u) if k not in gone])
        seen |= {(w if isinstance(w, bytes) else tuple(w)): i for _, w in starts}
    return out


def dedup_in_process(rows, unit, plan):
    """The rounds of remove_repeats without Spark: one process, a few batches."""
    import pyarrow as pa

    parts = [rows[k::3] for k in range(3)]
    batches = [repeats.Batch(pa.table({"doc_id": pa.array([r[0] for r in x], pa.int64()), "text": pa.array([r[1] for r in x], pa.string())}), "doc_id", "text", unit) for x in parts]
    by = lambda table, c, v: table.filter(pa.compute.equal(table.column(c), v))
    buckets = range(plan.buckets)
    counted = pa.concat_tables([repeats.count_anchors(b, k, plan) for k, b in enumerate(batches)])
    bits = pa.concat_tables([repeats.census(by(counted, "bucket", v)) for v in buckets])
    listed = pa.concat_tables([repeats.list_contexts(b, k, by(bits, "batch", k), plan) for k, b in enumerate(batches)])
    asked = pa.concat_tables([repeats.ask(by(listed, "bucket", v)) for v in buckets])
    contents = pa.concat_tables([repeats.send(b, k, by(asked, "batch", k), plan) for k, b in enumerate(batches)])
    found = pa.concat_tables([repeats.compare(by(listed, "bucket", v), by(contents, "bucket", v), plan) for v in buckets])
    kept = pa.string() if unit == "word" else pa.binary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", kept)])
    return {r["doc_id"]: (r["n_units"], r["n_removed"], r["kept"]) for k, b in enumerate(batches) for r in repeats.cut(b, by(found, "batch", k), ["doc_id"], schema, plan).to_pylist()}


@pytest.mark.parametrize(("chunk", "hot", "shard"), [(1 << 16, 1024, 1 << 17), (97, 3, 200), (97, 1, 1)])
def test_rounds_of_dedup_equal_brute_force(monkeypatch, chunk, hot, shard):
    """Also where texts are hashed in pieces, anchors are hot, and indexes are small."""
    for name, value in (("CHUNK", chunk), ("HOT", hot), ("SHARD", shard)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    got = dedup_in_process(rows, "byte", repeats.Plan("byte", 50, 16, 3, suffixarray.held_before))
    assert got == {i: (n, g, bytes(k)) for i, (n, g, k) in removed(rows, lambda t: t.encode(), 50).items()}
    got = dedup_in_process(rows, "word", repeats.Plan("word", 13, 7, 3, fmindex.held_before))
    assert got == {i: (n, g, " ".join(k)) for i, (n, g, k) in removed(rows, WORD.findall, 13).items()}


def test_a_hot_anchor_does_not_fill_its_bucket(monkeypatch):
    """Documents that share seven words amid others: the bucket's lists and contents stay as even as without them."""
    import pyarrow as pa

    rng = random.Random(5)
    phrase = " ".join(f"hot{k}" for k in range(7))
    monkeypatch.setattr(repeats, "HOT", 64)
    plan = repeats.Plan("word", 13, 7, 32, fmindex.held_before)
    table = pa.table({"doc_id": list(range(2000)), "text": [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) + f" {phrase} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(2000)]})
    b = repeats.Batch(table, "doc_id", "text", "word")
    listed = repeats.list_contexts(b, 0, pa.concat_tables([repeats.census(pa.Table.from_pylist([r], schema=repeats.BLOB)) for r in repeats.count_anchors(b, 0, plan).to_pylist()]), plan)
    sizes = sorted(len(r["blob"]) for r in listed.to_pylist() if r["kind"] == repeats.LISTED)
    assert len(sizes) == 32 and sizes[-1] < 2 * sizes[16]


@pytest.mark.parametrize("held_before", [fmindex.held_before, suffixarray.held_before])
def test_indexes_equal_all_windows(held_before):
    rng = np.random.default_rng(0)
    for _ in range(40):
        length, m = int(rng.integers(1, 14)), int(rng.integers(1, 25))
        size, ids = rng.integers(1, 40, m), rng.integers(-5, 20, m)
        text = rng.integers(0, int(rng.integers(1, 5)), size.sum()).astype(np.uint8 if held_before is suffixarray.held_before else np.int64)
        entries = [text[e - s : e].tolist() for e, s in zip(np.cumsum(size), size, strict=True)]
        windows = [(i, k, tuple(x[k : k + length])) for i, x in enumerate(entries) for k in range(len(x) - length + 1)]
        least = {}
        for i, _, w in windows:
            least[w] = min(least.get(w, 99), ids[i])
        want = {(i, k + j) for i, k, w in windows if least[w] < ids[i] for j in range(length)}
        assert {(e, j) for e, a, z in zip(*(x.tolist() for x in held_before(text, size, ids, length)), strict=True) for j in range(a, z)} == want


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        size, ids = rng.integers(1, 30, 12), rng.integers(0, 6, 12)
        text = rng.integers(0, 3, size.sum())
        entries = [text[e - s : e].tolist() for e, s in zip(np.cumsum(size), size, strict=True)]
        index = fmindex.FMIndex(text, size, ids, 3, 7)
        want = []
        for i, x in enumerate(entries):
            smaller = {tuple(y[a : a + n]) for j, y in enumerate(entries) if ids[j] < ids[i] for n in range(8) for a in range(len(y) - n + 1)}
            want += [max(n for n in range(min(7, len(x) - k) + 1) if n == 0 or tuple(x[k : k + n]) in smaller) for k in range(len(x))]
        assert fmindex.matching_statistics(index, text, size, ids, 7).tolist() == want


def test_buckets_are_refined_to_the_suffix_order():
    rng = np.random.default_rng(2)
    for _ in range(10):
        size = rng.integers(1, 80, 30)
        text = rng.integers(97, 99, size.sum()).astype(np.uint8)
        order, left, _ = suffixarray.suffix_array(text, size, 50)
        suffix = [bytes(text[i : i + min(50, left[i])]) for i in order]
        assert suffix == sorted(suffix) and sorted(order.tolist()) == list(range(len(text)))


def test_substring_and_suffix_array_dedup_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = fmindex.substring_dedup(docs, batch_bytes=2000)
    assert out.columns == ["doc_id", "text", "extra", "n_units", "n_removed", "spans", "kept"]
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["kept"]) for r in out.collect()}
    assert got == {i: (n, g, " ".join(k)) for i, (n, g, k) in removed(rows, WORD.findall, 13).items()}
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in suffixarray.suffix_array_dedup(docs, batch_bytes=2000).collect()}
    assert got == {i: (n, g, bytes(k), g) for i, (n, g, k) in removed(rows, lambda t: t.encode(), 50).items()}


@pytest.mark.parametrize(("gb", "pairs"), [(0.2, 3_500), (0.9, 17_000), (10, 410_000), (50, 10_000_000)])
def test_batches_of_suffix_array_dedup_grow_with_the_input(spark, monkeypatch, gb, pairs):
    """A round has up to batches x buckets messages; neither batches nor buckets pass MOST_BYTES."""
    sizes = {}

    class Dealt(Exception):
        pass

    def dealt(*args, real=repeats.dealt):
        sizes["n"] = real(args[0], int(gb * 1e9), *args[2:])
        raise Dealt

    monkeypatch.setattr(repeats, "dealt", dealt)
    with pytest.raises(Dealt):
        suffixarray.suffix_array_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    batches, buckets = sizes["n"]
    assert batches * buckets <= pairs
    assert min(batches, buckets) * suffixarray.MOST_BYTES >= gb * 1e9


def test_suffix_array_dedup_of_grown_batches_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROW", 4)
    rows, seen = corpus(), []
    monkeypatch.setattr(repeats, "dealt", lambda *a, real=repeats.dealt: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"])) for r in suffixarray.suffix_array_dedup(docs, batch_bytes=500).collect()}
    assert got == {i: (n, g, bytes(k)) for i, (n, g, k) in removed(rows, lambda t: t.encode(), 50).items()}
    assert seen[0][0] < sum(len((t or "").encode()) for _, t, _ in rows) // 500


def test_dedup_of_null_and_repeated_ids_and_of_nothing(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t + " more")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in fmindex.substring_dedup(docs).collect())
    assert got == {(None, 0): 1, (5, 0): 2, (7, 14): 1}
    assert fmindex.substring_dedup(docs.limit(0)).collect() == []
    clash = docs.withColumn("kept", docs.doc_id)
    assert fmindex.substring_dedup(clash).columns == ["doc_id", "text", "n_units", "n_removed", "spans", "kept"]
    clash = docs.selectExpr("doc_id AS __batch0", "text", "doc_id AS batch", "text AS n_units")
    for f in (fmindex.substring_dedup, suffixarray.suffix_array_dedup):
        assert sorted((r["__batch0"] or 0, r["batch"] or 0, r["n_removed"] > 0) for r in f(clash, id_col="__batch0").collect()) == [(0, 0, False), (5, 5, False), (5, 5, False), (7, 7, True)]
        assert f(docs.where("doc_id is null")).count() == 1 and f(docs.limit(0)).collect() == []


def jaccard_classes(rows, threshold=0.8, width=5):
    sets, df = {}, collections.Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        s = collections.Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else collections.Counter()
        sets[i] = s
        df.update(set(s))
    weight = lambda i: {g: c * neardup.inverse_frequency(np.array([df[g]]), len(rows))[0] for g, c in sets[i].items()}
    weights = {i: weight(i) for i in sets}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        both = sum(min(x, weights[b].get(g, 0)) for g, x in weights[a].items())
        if both >= threshold * (sum(weights[a].values()) + sum(weights[b].values()) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(3, 90)
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    for k in range(25):
        w = list(base)
        w[rng.randrange(300)] = "changed"
        rows.append((5000 + k, " ".join(w), "x"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, batch_bytes=5000).collect()}
    assert got == jaccard_classes(rows)
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_weighted_samples_agree_as_the_jaccard_similarity():
    rng = np.random.default_rng(0)
    gram = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    s = neardup.samples(np.concatenate([gram, gram]), np.concatenate([a, b]), np.array([0, 300, 600]), 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_near_duplicate_blocks_meet_again(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        w = list(base)
        w[rng.randrange(400)] = f"c{k}"
        rows.append((k, " ".join(w), "x"))
    got = {r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_linked_only_to_distant_partners_meet(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):  # a chain: each changes a little of the one before
        base = list(base)
        for _ in range(2 + k % 5):
            base[rng.randrange(300)] = f"c{rng.randrange(10_000)}"
        rows.append((k, " ".join(base), "x"))
    order = rows[::3] + rows[1::3] + rows[2::3]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(order, SCHEMA)).collect()}
    assert got == jaccard_classes(rows)


def beside_a_group(c=10, u=9, pairs=50, n=90, words=1200):
    """A large group, and pairs of documents just over the threshold with each other and just under it with the group."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        w[5 * rng.randrange(words // 5)] = f"g{k}"
        rows.append((k, " ".join(w), "x"))
    for k in range(pairs):
        at = rng.sample(range(0, words, 5), c + 2 * u)
        for side in range(2):
            w = list(base)
            for x in at[:c]:
                w[x] = f"p{k}-{x}"
            for x in at[c + side * u : c + side * u + u]:
                w[x] = f"q{k}-{x}"
            rows.append((1000 + k + 100 * side, " ".join(w), "x"))
    return rows


def test_near_duplicates_beside_a_large_group_meet(spark, monkeypatch):
    """Pairs that reach the threshold only with each other, in buckets that a large group makes large."""
    monkeypatch.setattr(neardup, "BLOCK", 70)
    monkeypatch.setattr(neardup, "MEET", 64)
    rows = beside_a_group()
    want = jaccard_classes(rows)
    assert len(set(want.values())) > 40
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_proposals_connect_all_candidates():
    rng = np.random.default_rng(1)
    for n in (2, 9, 70):
        centre = rng.integers(0, 2**60, (3, 64)).astype(np.uint64)
        s = centre[rng.integers(0, 3, n)]
        s = np.where(rng.random(s.shape) < 0.2, rng.integers(0, 2**60, s.shape).astype(np.uint64), s)
        s = (s & np.uint64(255)).astype(np.uint8)
        i, j = np.nonzero(np.triu(neardup.agreement(s, s) >= neardup.CANDIDATE * 64, 1))
        a, b = neardup.propose(s)
        assert neardup.joined(np.arange(n), a, b).tolist() == neardup.joined(np.arange(n), i, j).tolist()


def test_blocks_are_settled_as_by_all_pairs():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    base = np.arange(1, 101).astype(np.uint64)
    sets = [np.sort(np.where(rng.random(100) < 0.11, rng.integers(1000, 2**40, 100).astype(np.uint64), base)) for _ in range(40)]
    ones = np.ones(100, np.uint64)
    rows = [{"doc": i, "sample": np.arange(64).astype(np.uint8).tobytes(), "shingles": neardup.pack(g, ones), "root": i - i % 2} for i, g in enumerate(sets)]
    out = neardup.settle_block(pa.Table.from_pylist(rows), 0.8)
    ok = [(i, j) for i, j in itertools.combinations(range(40), 2) if neardup.similarity([sets[i], ones], [sets[j], ones]) >= 0.8]
    start = np.arange(40) // 2 * 2
    label = lambda ps: neardup.joined(start.copy(), *(np.array([p[x] for p in ps], np.int64) for x in (0, 1))).tolist()
    assert label(list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))) == label(ok)


def test_quality_rules_equal_brute_force(spark):
    rows = corpus(5) + [(2000, "the of and to is " * 3 + " ".join(f"word{k}" for k in range(60)), None), (2001, "# ## ### " * 40, None), (2002, "line a\nline a\n\nline b\nline a", None), (2003, "x y z x y z x y", None)]
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = collections.Counter(g)
        covered = {k + j for k, x in enumerate(g) if many[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert out[2000]["kept"] and not out[2001]["kept"]


def test_url_rules(spark):
    asked = [(1, "https://Example.ORG/en/12?x"), (2, "http://a.example.org/en/2"), (3, "http://x.com/de/"), (4, "http://x.com"), (5, None), (6, "no scheme.org/"), (7, "http://com/fr/x#y"), (8, "http://notexample.org/es/"), (8, "http://notexample.org/es/"), (9, "x://y.org/a://b.com/de/"), (10, "")]
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(asked, "page_id long, url string"), urls.rule_table(spark)).collect())
    assert got == {
        (1, "example.org", "/en/12", "example.org/en/1", "block"): 1,
        (2, "a.example.org", "/en/2", "org/", "allow"): 1,
        (3, "x.com", "/de/", "com/de/", "block"): 1,
        (4, "x.com", "", None, "allow"): 1,
        (5, "", "", None, "allow"): 1,
        (6, "", "", None, "allow"): 1,
        (7, "com", "/fr/x", "com/fr/", "allow"): 1,
        (8, "notexample.org", "/es/", "org/", "allow"): 2,
        (9, "y.org", "/a://b.com/de/", "org/", "allow"): 1,
        (10, "", "", None, "allow"): 1,
    }
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.rule_table(spark)).collect() == []
    table = spark.createDataFrame([(*x, "a", "b", "c") for x in asked] + [(11, "http://x.org/" + "y/" * 50_000, "a", "b", "c")], "page_id long, url string, host string, r_key string, __digest string")
    crowded = urls.rule_table(spark, [*urls.RULES, *((f"h{k}.net", f"/p{k % 7}/", "block") for k in range(300))])
    short = collections.Counter((r["page_id"], r["host"], len(r["path"]), r["rule"]) for r in urls.judge_urls(table, crowded, hash_chars=1).collect())  # every prefix collides
    assert short == collections.Counter({(i, h, len(p), r): n for (i, h, p, r, _), n in got.items()}) + collections.Counter({(11, "x.org", 100_001, "org/"): 1})
    assert urls.judge_urls(spark.createDataFrame(asked, "page_id long, url string"), urls.rule_table(spark, [])).where("rule is not null").collect() == []


def test_license_scan(spark):
    filler = " ".join(f"w{k}" for k in range(300))
    long = licenses.TEMPLATES["MIT-grant"]
    rows = [(1, filler + " Licensed under the Apache License, Version 2.0.\n" + filler), (2, None), (3, ""), (4, long.upper()), (5, filler), (6, "Released under the MIT"), (7, "x Released under the MIT License. y"), (7, "x Released under the MIT License. y")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "Apache-2.0"), (4, "MIT-grant"), (7, "MIT"), (7, "MIT")]
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {"short": "four words are few"})


def test_mixing_meets_targets(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        rows.append((i, " ".join(rng.choice(["good", "text", "fine", "words"] if not junk else ["bad###", "junk###", "spam###"]) for _ in range(rng.randint(5, 60)))))
        if i % 3 == 0:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(900, None), (901, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"clean": 0.6, "junk": 0.4}
    out = mixing.mixing_rates(docs, known, targets, keep_all=False).collect()
    assert len(out) == len(rows) and min(r["rate"] for r in out) >= 0 and max(r["gap"] for r in out) < 1e-3
    total = sum(r["rate"] * r["n_tokens"] for r in out)
    for d, share in targets.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r["posteriors"][d] for r in out) / total - share) < 1e-3
    right = [(r["posteriors"]["junk"] > 0.5) == (r["doc_id"] % 4 == 0) for r in out if r["doc_id"] < 400 and r["doc_id"] % 3]
    assert np.mean(right) > 0.95  # held out: these have no label
    kept = mixing.mixing_rates(docs, known, targets).collect()
    total = sum(r["rate"] * r["n_tokens"] for r in kept)
    assert min(r["copies"] for r in kept) >= 1 and all(abs(r["copies"] - r["rate"]) < 1 for r in kept)
    for d, share in targets.items():  # no document goes, and the targets hold
        assert abs(sum(r["rate"] * r["n_tokens"] * r["posteriors"][d] for r in kept) / total - share) < 1e-3
    assert abs(sum(r["copies"] * r["n_tokens"] for r in kept) / total - 1) < 0.05
    assert mixing.mixing_rates(docs.limit(0), known, targets).collect() == []


@pytest.mark.parametrize(("least", "most"), [(0.0, 4.0), (1.0, 3.0), (0.0, 1.2)])
def test_rates_equal_the_least_squares_solution(spark, least, most):
    """Against projected gradient steps by document, with the projection taken at once, in numpy."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 80)
    n = rng.integers(0, 500, 80)
    now = n @ p
    targets = now.sum() * np.array([0.3, 0.4, 0.3]) * (1.4 if least else 1)
    scored = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p, strict=True)], "x_n long, x_0 double, x_1 double, x_2 double")
    v, totals = mixing.fit_rates(scored, targets.tolist(), "x_", least=least, most=most, steps=300)
    x = np.ones(80)
    for _ in range(60_000):
        x = np.clip(x - p @ ((n * x) @ p - targets) / now.max(), least, most)
    best = (n * x) @ p
    assert np.allclose(np.clip(1 + p @ v, least, most) @ (n[:, None] * p), totals)
    loss = lambda t: np.square(np.asarray(t) - targets).sum() / targets.sum() ** 2
    assert loss(totals) <= loss(best) + 1e-4


def test_mixing_of_clashing_columns_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c", 1.5, "k"), (1, "a b", 2.5, "l"), (1, "a b", 2.5, "l"), (2, None, 0.5, "m")], "doc_id long, text string, rate double, __id string")
    out = mixing.mixing_rates(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out.columns == ["doc_id", "text", "__id", "n_tokens", "posteriors", "rate", "copies", "gap"]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["copies"] >= 1) for r in out.collect()) == [(0, 3, True), (1, 2, True), (1, 2, True), (2, 0, True)]


def test_mixing_rare_domain_draws_few(spark):
    """With two labelled documents of a domain, rare words alone don't put the rest in it."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(50, 400)))) for i in range(200)]
    labels = [(i, 0 if i in (3, 6) else 1, 0) for i in range(0, 200, 3)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(docs, known, {"clean": 0.95, "junk": 0.05}).collect()
    tokens = sum(r["n_tokens"] for r in out)
    assert sum(r["n_tokens"] * r["posteriors"]["junk"] for r in out) < 0.3 * tokens
    assert sum(r["n_tokens"] * r["rate"] for r in out) < 2 * tokens


@pytest.mark.parametrize("absent", ["clean", "junk"])
def test_mixing_without_a_domains_labels(spark, absent):
    """A domain without labels takes no part; also where it is the first."""
    rows = [(i, " ".join(["x", "y"] if i % 2 else ["z", "u", "v"])) for i in range(60)]
    quality, toxic = (0, 1) if absent == "clean" else (1, 1)
    labels = [(i, quality, 0 if i % 2 else toxic) for i in range(60)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(docs, known, {"clean": 0.4, "junk": 0.2, "toxic": 0.4}).collect()
    assert max(r["posteriors"][absent] for r in out) == 0
    total = sum(r["rate"] * r["n_tokens"] for r in out)
    share = 0.4 / (0.6 if absent == "clean" else 0.8)
    assert abs(sum(r["rate"] * r["n_tokens"] * r["posteriors"]["toxic"] for r in out) / total - share) < 1e-3


def test_mixing_finds_telling_words_among_many(spark):
    """Rare telling words of a domain, in long texts of many words; more of them than 256."""
    rng = random.Random(3)
    telling = [f"t{i}" for i in range(450)]
    rows = []
    for i in range(240):
        words = [f"w{rng.randrange(20_000)}" for _ in range(900)]
        if i % 4 == 0:
            words[:120] = rng.sample(telling, 120)
        rows.append((i, " ".join(words)))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    _, table = mixing.fit_classifier(docs, known, ["clean", "toxic"], id_col="doc_id", text_col="text", buckets=1 << 18, max_rows=1000)
    assert sum(f < 1 << 18 for f in table) > 256
    out = mixing.mixing_rates(docs, known, {"clean": 0.7, "toxic": 0.3}).collect()
    assert all(r["posteriors"]["toxic"] > 0.5 for r in out if r["doc_id"] >= 120 and r["doc_id"] % 4 == 0)


def test_mixing_uses_the_labels_of_its_documents(spark):
    """Labels of other documents don't take the places of those at hand, and a rare domain is not sampled away."""
    rows = [(i, " ".join(["bad", "worse"] if i % 30 == 0 else ["fine", "good"])) for i in range(120)]
    labels = [(i, 1, int(i % 30 == 0)) for i in range(120)] + [(i, 1, 0) for i in range(1000, 6000)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(docs, known, {"clean": 0.9, "toxic": 0.1}, max_fit_rows=20).collect()
    assert all((r["posteriors"]["toxic"] > 0.5) == (r["doc_id"] % 30 == 0) for r in out)
    assert mixing.quotas({"a": 3, "b": 500, "c": 40}, 30) == {"a": 3, "c": 13, "b": 14}


def test_packing(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.randint(0, 3000))) for i in range(300)] + [(900, " ".join(["w"] * 10_000)), (901, None), (901, "a b"), (901, "a b")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=100_000).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len((t or "").split()) for _, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["bin_id"]].append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r["bin_offset"])
        assert all(a["bin_offset"] + a["n_tokens"] == b["bin_offset"] for a, b in itertools.pairwise(pieces))
        used = pieces[-1]["bin_offset"] + pieces[-1]["n_tokens"]
        assert {p["bin_capacity"] for p in pieces} == {min(c for c in packing.CAPACITIES if c >= used)}
    assert sum(r["n_tokens"] for r in out) > 0.9 * sum(p[0]["bin_capacity"] for p in by.values())
    assert packing.pack_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_shards_split_a_repeated_document(spark):
    docs = spark.createDataFrame([(None, "w " * 90, 1, "x")] * 300, "doc_id long, text string, bin_id int, __row string")
    out = packing.pack_documents(docs, shard_tokens=3000).collect()
    assert len({r["bin_id"] >> 32 for r in out}) > 5 and sum(r["n_tokens"] for r in out) == 27_000
    assert packing.pack_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("capacities", [(512, 700, 1000), (64,), (16, 64, 256)])
def test_best_fit_equals_a_search_of_all_bins(capacities):
    rng = random.Random(9)
    for n in (0, 1, 40, 200):
        sizes = np.array([rng.randint(1, capacities[-1]) for _ in range(n)], np.int64)
        rooms, fills, left = [], [], int(sizes.sum())
        for s in sorted(sizes.tolist(), reverse=True):
            left -= s
            if fit := [b for b in range(len(rooms)) if rooms[b] >= s]:
                b = min(fit, key=lambda b: rooms[b])
            else:
                b = len(rooms)
                fills.append(0)
                # least cost a token if all that is free beside it were filled by what is still to come
                rooms.append(min((c for c in capacities if c >= s), key=lambda c: ((c + 32) / (s + min(c - s, left)), c)))
            rooms[b], fills[b] = rooms[b] - s, fills[b] + s
        bins, offsets, room = packing.best_fit(sizes, capacities, 32)
        got = [int(sizes[bins == b].sum()) for b in range(len(room))]
        assert sorted(got) == sorted(fills) and room.tolist() == [min(c for c in capacities if c >= f) for f in got]
        for b in range(len(room)):  # no two items share a place
            assert sorted((int(o), int(o + s)) for o, s in zip(offsets[bins == b], sizes[bins == b], strict=True)) == list(itertools.pairwise([0, *np.cumsum(sizes[bins == b][np.argsort(offsets[bins == b])]).tolist()]))


def test_best_fit_takes_the_bin_with_least_room():
    bins, offsets, room = packing.best_fit(np.array([880, 600, 110]), (512, 700, 1000), 0)
    assert bins.tolist() == [0, 1, 0] and offsets.tolist() == [0, 0, 880] and room.tolist() == [1000, 700]


def test_exact_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)], "x") for i in range(150)]
    rows[7] = (7, rows[8][1], "x")
    rows += [(200, None, "x"), (201, [float("nan")] * 12, "x"), (220, [1.0] * 5, "x"), (240, [], "x"), (260, [1.0, None] * 6, "x"), (None, [1.0] * 12, "x")]
    v = {i: np.floor(np.array(x, float) * 64).astype(int) for i, x, _ in rows[:150]}
    want = []
    for q in range(0, 150, 20):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:20]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect())
    assert got == sorted(want)
    twice = spark.createDataFrame([(20, [1.0, 2.0]), (20, [0.5, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.exact_top_k(twice).collect()] == [(20, 1, 3, 32 * 64 + 128 * 64), (20, 2, 3, 32 * 64 + 128 * 64)]
    assert topk.exact_top_k(twice.limit(0)).collect() == []
    large = topk.best(np.array([[1e9] * 2]), np.array([0]), np.array([[1e9, 1e9 + 1], [1, 2]]), np.array([1, 2]), 1)
    assert [x.tolist() for x in large[:2]] == [[0], [1]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for you, dear reader.</div><!-- <p>no</p> -->
<div id="content"><h1>The &amp; title</h1><p>A first  paragraph\nwith <b>bold</b> words, here it is.<p>Short.<div class="ad">Buy this great product now, it is good.</div><ul><li>Item one</ul></div>
<section class="comments"><p>Great article, I liked it a lot. Thanks for writing it.</p></section><form><label>Name</label><button>Send</button></form>
<aside class=sidebar><p>Related stuff that is long enough to look like content.</p></aside><footer>&copy; 2020 Example.</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "The & title\nA first paragraph with bold words, here it is.\nShort.\nItem one"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<div>") == ""
    assert htmltext.main_text("<article><p>" + "Long text here. " * 20000 + "</article>").count("Long") == 20000
    assert htmltext.main_text("<article>" + "<div>" * 3000 + "Deep text is here, too.").startswith("Deep")


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        price = lambda l, costs=costs, edges=edges: sum(abs(c) for c, x in zip(costs, l, strict=True) if (c > 0) != x) + sum(w for i, j, w in edges if l[i] != l[j])
        assert price(htmltext.max_flow_labels(costs, edges)) == pytest.approx(min(price(l) for l in itertools.product([False, True], repeat=n)))


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "a"), (2, None, None, "b"), (2, None, None, "b")], "page_id long, url string, html string, text string")
    out = htmltext.extract_text(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["n_chars"]) for r in out] == [(1, len(htmltext.main_text(PAGE))), (2, 0), (2, 0)]
    assert out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and {r["bin_capacity"] for r in out} <= set(packing.CAPACITIES)
    assert len({(r["bin_id"], r["bin_offset"]) for r in out}) == len(out)


def pipeline_rows(seed=4):
    """Documents for each stage's decisions: clean ones, some that the rules reject, copies and near copies, shared passages, nulls and repeats."""
    rng = random.Random(seed)
    stop = quality.STOP_WORDS["en"].split()
    vocabulary = [f"{a}{b}ing" for a in ("gar", "mel", "tor", "wis", "bel", "con") for b in ("ap", "or", "ul", "ent", "isk", "om", "ad")]
    text = lambda k: " ".join(rng.choice(vocabulary if rng.random() < 0.8 else stop) for _ in range(k))
    passage, rows = text(30), []
    for i in range(60):
        t = text(rng.randint(80, 300))
        if i % 5 == 1:
            t = t + "\n" + passage + " " + text(10)
        if i % 5 == 2:
            t = rows[rng.randrange(len(rows))][1]
        if i % 5 == 3:
            w = rows[rng.randrange(len(rows))][1].split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i * 2 + 1, t))
    rows += [(500, None), (501, ""), (502, text(20)), (503, "# " * 60 + text(60)), (504, "gar mel tor " * 40), (505, text(6000)), (9, rows[4][1])]
    return [(i, t, "en", "web", len(t or "")) for i, t in rows]


def passes_rules(text):
    t = text or ""
    w = WORD.findall(t)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = collections.Counter(g)
    repeated = len({k + j for k, x in enumerate(g) if many[x] > 1 for j in range(3)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    stop = set(quality.stop_words())
    return (
        len(w) >= 50 and 2 * repeated <= len(w) and 2 * len(w) <= sum(map(len, w)) <= 15 * len(w)
        and 10 * sum(c in "#*$%&|<>" for c in t) <= len(w) and 25 * sum(x in stop for x in w) >= len(w) and 5 * (len(lines) - len(set(lines))) <= 2 * len(lines)
    )


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, folder = pipeline_rows(), str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(k % 4 > 0), int(k % 7 == 0)) for k, r in enumerate(rows[:40])], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        assert name == "packing" or after.columns == docs.columns
        docs = after
        kept.append([tuple(r) for r in after.collect()])
    ruled, single, cut, mixed, packed = kept

    assert sorted(ruled) == sorted(r for r in rows if passes_rules(r[1]))  # repeats stay, and columns
    classes = jaccard_classes([r[:2] for r in ruled])
    assert len(set(classes.values())) < len(classes)
    # rows that share the id of a class's first document are all kept
    assert sorted(single) == sorted(r for r in ruled if classes[r[0]] == r[0])
    gone = removed(sorted({r[:2] for r in single}), WORD.findall, 13)  # a repeated row holds what its twin does
    texts = {i: " ".join(k) for i, (_, _, k) in gone.items()}
    assert any(n for _, n, _ in gone.values())
    assert sorted(cut) == sorted((i, texts[i], a, b, len(texts[i])) for i, _, a, b, _ in single if texts[i])
    copies = collections.Counter(mixed)
    assert set(copies) == set(cut) and sum(copies.values()) > len(cut)  # every document at least once, none changed
    rates = mixing.mixing_rates(spark.read.parquet(f"{folder}/substring dedup"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    equal = collections.Counter(cut)  # rows that are repeated are copied each
    assert all(abs(copies[t] / equal[t] - r["rate"]) < 1 for r in rates for t in [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars"))])
    most = packing.CAPACITIES[-1]
    pieces = collections.Counter((i, k // most, k, min(most, n - k)) for i, t, *_ in mixed for n in [len(WORD.findall(t))] for k in range(0, n, most))
    assert collections.Counter(r[:4] for r in packed) == pieces and max(p[1] for p in pieces) > 0
    used = collections.defaultdict(list)
    for *_, n, bin_id, capacity, offset in packed:
        used[bin_id, capacity].append((offset, n))
    for (_, capacity), spans in used.items():
        spans.sort()
        assert [o for o, _ in spans] == list(itertools.accumulate([0, *(n for _, n in spans[:-1])]))
        assert capacity == min(c for c in packing.CAPACITIES if c >= sum(n for _, n in spans))


def test_names_count_within_their_names():
    text = "A long sentence of the article that tells about the price of shares today. And more of it, at length, for readers."
    assert htmltext.main_text(f"<div class='share-price'><p>{text}</p><p>{text}</p></div><p class='tags-and-text'>{text}</p>").count("price") == 3
    assert [htmltext.name_cost(x) for x in ("share", "share-buttons", "share-price", "cookie-notice", "siteNav nav", "lead", "")] == [-6.0, -6.0, -1.5, -8.0, -6.0, 0.0, 0.0]


def test_classifier_is_fitted_on_sure_blocks(spark):
    """Pages whose menus are long and articles short and linked: what the fixed weights don't expect. Held out: pages without telling elements."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    plain = lambda k: " ".join(word() for _ in range(k))
    menu = [plain(25) for _ in range(3000)]
    prose = [f"<a>{plain(2)}</a>" for _ in range(3000)]
    rows = [(i, "<nav>" + "".join(f"<p>{m}</p>" for m in menu[i * 5 : i * 5 + 5]) + "</nav><article>" + "".join(f"<p>{x}</p>" for x in prose[i * 5 : i * 5 + 5]) + "</article>") for i in range(300)]
    pages = spark.createDataFrame(rows + rows[:100] + [(1000, None), (1001, "")], "page_id long, html string")
    weights = htmltext.fit_weights(pages)
    assert weights != htmltext.WEIGHTS and weights == pytest.approx(htmltext.fit_weights(spark.createDataFrame(rows, pages.schema)))  # copies count once
    counts = collections.Counter(e for _, x in rows for e in htmltext.examples_of(x))
    assert sum(counts.values()) == 3000 and weights == pytest.approx(htmltext.logistic(counts))
    right = [htmltext.main_text(f"<div><div><p>{m}</p></div></div>", weights) == "" and htmltext.main_text(f"<div><div><p>{x}</p></div></div>", weights) != "" for m, x in ((plain(25), f"<a>{plain(2)}</a>") for _ in range(100))]
    assert sum(right) == 100
    assert htmltext.fit_weights(pages.limit(0)) == htmltext.fit_weights(pages.where("page_id > 999")) == htmltext.WEIGHTS
    assert htmltext.extract_text(pages.limit(0)).collect() == []
    assert len(htmltext.examples_of("".join(f"<div class=ad>x{k}" for k in range(20_000)))) == 20_000  # deep pages take time in proportion


def test_logistic_is_the_least_loss():
    rng = np.random.default_rng(0)
    counts = collections.Counter((int(rng.random() < 1 / (1 + np.exp(2 - 0.6 * a + b))), int(a), int(b), int(c), int(d)) for a, b, c, d in rng.integers(0, [10, 6, 2, 2], (4000, 4)))

    def loss(w):
        mass = collections.Counter()
        for k, n in counts.items():
            mass[k[0]] += n
        s = [(k, n, sum(x * v for x, v in zip((1, k[1] / 2, k[2] / 5, k[3], k[4]), w, strict=True))) for k, n in counts.items()]
        return sum(n / mass[k[0]] / 2 * np.logaddexp(0, -z if k[0] else z) for k, n, z in s) + 5e-4 * np.square(w).sum()

    best = np.array(htmltext.logistic(counts))
    assert all(loss(best) <= loss(best + d) for _ in range(50) for d in [rng.normal(0, 0.02, 5)])
