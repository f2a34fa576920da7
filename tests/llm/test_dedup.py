"""Exact, near and passage dedup, and embeddings, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from plotweave.llm import embedding_dedup, exact_dedup, minhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, keep_id string, kept string, shard string"  # clashing names beside


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(90)) for _ in range(n)]


def corpus(seed=0):
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.choice([1, 3, 5, 40, 120]))) for _ in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    for k in range(30, 90):  # copies, near copies, shared passages
        t = rng.choice(base).split(" ")
        if k % 3 == 0:
            for _ in range(max(1, len(t) // 30)):
                t[rng.randrange(len(t))] = f"new{k}"
        elif k % 3 == 1:
            t = words(rng, 20) + rng.choice(base).split(" ")[:15] + words(rng, 20)
        out.append((k, " ".join(t)))
    return out + [(100, None), (101, ""), (102, "   "), (103, "É" * 70), (104, "É" * 70), (105, "a" * 200), (106, "a" * 120), (107, "x"), (108, "X")]


def test_exact(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()}
    norm = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}) for i, t in rows}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    kept = exact_dedup.keep_exact(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "kept", "shard"] and kept.count() == len(set(norm.values()))


def test_exact_repeated_rows(spark):
    rows = [(1, "a"), (1, "A"), (1, "b"), (None, "a")]
    got = sorted((r["doc_id"] or -1, r["group_size"]) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect())
    assert got == [(-1, 3), (1, 1), (1, 3), (1, 3)]


def odd_ids(seed):
    """Rows with null ids, ids with several texts, and whole repeated rows; texts of one number are near copies."""
    rng = random.Random(seed)
    t = {}
    for k in "abcdefg":
        base = words(rng, 120)
        t[k], t[k + "2"] = " ".join(base), " ".join(base[:-1] + ["other"])
    return t, [(None, t["a"]), (None, t["b"]), (None, t["b"]), (1, t["c"]), (1, t["d"]), (2, t["d"]), (3, t["e"]), (3, t["e"]), (3, t["e"].upper()), (None, t["f"]), (4, t["f"])]


def test_keep_exact_null_and_repeated_ids(spark):
    t, rows = odd_ids(5)
    kept = sorted(((r["doc_id"] or -1, r["text"].lower()) for r in exact_dedup.keep_exact(docs_of(spark, rows)).collect()))
    assert kept == sorted([(-1, t["a"]), (-1, t["b"]), (1, t["c"]), (2, t["d"]), (3, t["e"]), (4, t["f"])])
    got = exact_dedup.exact_dedup(docs_of(spark, rows)).where("doc_id is null").select("kept", "keep_id", "group_size").collect()
    assert sorted(tuple(r[:1]) + (r[1] or -1, r[2]) for r in got) == [(False, 4, 2), (True, -1, 1), (True, -1, 2), (True, -1, 2)]


def test_keep_one_null_and_repeated_ids(spark):
    t, rows = odd_ids(6)
    rows += [(None, t["a2"]), (7, t["g"]), (7, t["g2"]), (8, t["g2"]), (None, None), (None, None), (9, t["c2"]), (5, t["d2"])]
    kept = [(r["doc_id"] or -1, (r["text"] or "").lower()) for r in minhash_dedup.keep_one(docs_of(spark, rows)).collect()]
    of = lambda k: [(i, u) for i, u in kept if u in (t[k], t[k + "2"])]
    assert [len(of(k)) for k in "abcdefg"] == [1] * 7 and kept.count((-1, "")) == 2 and len(kept) == 9
    assert [of(k)[0][0] for k in "abcdefg"] == [-1, -1, 1, 1, 3, 4, 7]
    got = minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert all(r["kept"] is not None for r in got) and sum(r["doc_id"] == 1 and r["kept"] for r in got) == 2


def near_classes(rows):
    sets = {i: set(minhash_dedup.shingles(t)[0].tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near(spark):
    rows = corpus(1)
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == near_classes(rows)


def test_near_large_group_and_empty(spark):
    rng = random.Random(2)
    base = words(rng, 150)
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        t = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            t[rng.randrange(150)] = f"w{k}"
        rows.append((k, " ".join(t)))
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == near_classes(rows)
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block, elements", [(1024, 1_000_000), (4, 1_000_000), (1024, 700)])
def test_near_blocks_of_one_bucket(spark, monkeypatch, block, elements):
    """All of one bucket are apart at first; links of all blocks together join what brute force joins."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "ELEMENTS", elements)
    rng = random.Random(3)
    texts = [words(rng, 50)]
    for size in (40, 90, 90, 900):
        base = words(rng, size)
        for k in range(7):
            texts.append([f"w{k}" if i == 11 * k % size else w for i, w in enumerate(base)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, hashlib.sha256(t.encode()).digest(), t) for i, t in rows], "doc_id long, key binary, text string")
    signed = docs.mapInArrow(minhash_dedup._signed, "node long, key binary, digest binary, size long, keys array<long>, sketch array<tinyint>")
    nodes = signed.toDF("node", "key", "digest", "size", "keys", "sketch").select("node", "size", "sketch")
    live = spark.createDataFrame([(7, i, i, 0, 0) for i, _ in rows], "bucket long, node long, home long, head long, head_home long")
    heads = docs.selectExpr("doc_id node", "doc_id head_id", "key head_key")
    links = minhash_dedup._rest_links(live, nodes, docs, heads, 0.8, minhash_dedup.Scratch(spark, "test")).collect()
    want, got = near_classes(rows), {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert got == want and len(set(want.values())) < len(rows) - 15


@pytest.mark.parametrize("times", [30, 1000])
def test_near_with_a_repeated_line(spark, times):
    rng = random.Random(times)
    rows = []
    for k in range(12):
        base, line = words(rng, 104), words(rng, 12)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + line * times))]
    want = near_classes(rows)
    assert all(want[2 * k + 1] == 2 * k for k in range(12))
    assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()} == want


def test_probability_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 63, 500, np.uint64)
    a, b = pool[:400], pool[100:]
    sig = [minhash_dedup.signatures(x, np.ones(len(x)), np.zeros(len(x), int), 1, 4096)[0] for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.04


def brute_cut(rows):
    seen, out = {}, {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            seen.setdefault(data[i][k : k + 50], i)
    for i, b in data.items():
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_suffix(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == brute_cut(rows)


def test_suffix_empty_and_bytes(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    rows = [(1, "p" * 10 + "0123456789" * 6), (2, "q" + "0123456789" * 6 + "r")]
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs_of(spark, rows), with_bytes=True).collect()}
    assert kept == {1: rows[0][1].encode(), 2: b"qr"}


def test_suffix_sort_orders_and_collisions_are_verified(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts, group = rng.integers(0, 350, 200), rng.integers(0, 3, 200)
    order = suffix_dedup.suffix_sort(suffix_dedup.Hashed(data), starts, group)
    keys = [(group[i], data[starts[i] : starts[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys)
    monkeypatch.setattr(suffix_dedup, "_BYTES", np.ones(256, np.uint64))  # all strings of a length collide
    start, one = np.array([0, 100, 200]), np.ones(3, np.int64)
    data[200:250] = data[0:50]
    entry, left = suffix_dedup.settle_windows(data, start, 0 * one, one, np.array([1, 2, 3]), 0 * one)
    assert entry.tolist() == [2] and left.tolist() == [0]


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        if i % 3 and rows:
            old = np.array(rows[rng.integers(len(rows))][1])
            v = old + rng.normal(size=16) * (np.linalg.norm(old) / 4 * rng.uniform(0, 0.6)) if i % 3 == 1 else old
        rows.append((i, [float(x) for x in v], int(rng.integers(2)), "x"))
    odd = [(900, None, 1, "x"), (901, [0.0] * 16, 1, "x"), (902, [None] * 16, 1, "x"), (903, [float("nan")] * 16, 1, "x"), (904, rows[0][1], None, "x"), (905, [], 1, "x"), (906, [1.0], 1, "x"), (907, [2.0], 1, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    use = [r for r in rows + odd if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and np.linalg.norm(r[1])]
    links = {i: set() for i in got}
    for a, b in itertools.combinations(use, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
            links[a[0]].add(b[0])
            links[b[0]].add(a[0])
    for i in got:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), i == min(seen)), i


def test_lattice_decoding():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    z = embedding_dedup.decode(y)
    assert (np.abs(z.sum(1) % 2) == 0).all() and ((z * 2) % 1 == 0).all()
    d = ((y - z) ** 2).sum(1)
    for r in embedding_dedup.ROOTS:  # no neighbour is nearer
        assert (d <= ((y - z - r) ** 2).sum(1) + 1e-9).all()


def test_embeddings_with_null_and_repeated_ids(spark):
    near = lambda k: [1.0, 0.001 * k, 0.0]
    rows = [(1, near(0)), (1, near(1)), (2, near(2)), (None, near(3)), (5, [0.0, 1e200, 0.0]), (6, [0.0, 2e200, 0.0]), (7, [0.0, 0.0, 1e-200]), (None, [0.0, 0.0, 3e-200]), (None, [0.0, -1.0, 0.0]), (None, [0.0, -1.0, 0.0]), (None, None), (8, [])]
    df = spark.createDataFrame([(i, e, 4) for i, e in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    want = [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("None", 3, "1", False), ("5", 1, "5", True), ("6", 1, "5", False), ("7", 1, "7", True), ("None", 1, "7", False)]
    assert got == sorted(want + [("None", 1, "None", True)] * 2 + [("None", 0, "None", True), ("8", 0, "8", True)])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [exact_dedup.BROADCAST, 0])
def test_exact_copies_are_combined_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, "hot text") for i in range(4000)] + [(i, f"own {i}") for i in range(4000, 4400)] + [(5000, "x" * 300_000), (5001, "X" * 300_000), (5002, "x" * 299_999)]
        docs = docs_of(spark, rows).repartition(8)
        norm = exact_dedup.normalised(docs)
        repeated, few = exact_dedup.repeated_digests(norm, exact_dedup.Scratch(spark, "test"))
        own = norm.join(exact_dedup.F.broadcast(repeated), "digest", "left_semi") if few else norm
        hot = exact_dedup.salted(own, 16).where("norm = 'hot text'")
        assert few == (most > 0) and hot.count() == 8 and hot.agg({"n": "sum"}).first()[0] == 4000
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
        assert got[0] == (3999, 4000, False) and got[3999] == (3999, 4000, True) and got[4000] == (4000, 1, True) and len(got) == len(rows)
        assert got[5000] == (5001, 2, False) and got[5001] == (5001, 2, True) and got[5002] == (5002, 1, True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_suffix_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c, shared = (" ".join(words(rng, 20)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, b + " " + shared), (None, c + " " + shared), (5, c), (5, c), (7, shared), (8, None), (8, None)]
    rng.shuffle(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute_cut([(k, t) for k, (_, t) in enumerate(order)])
    got = suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:5]) for r in got) == sorted((str(i), *want[k]) for k, (i, _) in enumerate(order))
    kept = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in got}
    assert kept[2, len(a)] == len(a) and kept[2, len(b)] == 0
