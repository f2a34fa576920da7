"""Periodic runs against a search over all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np

from plotweave.llm import periodic_runs


def brute(words):
    """All maximal stretches by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def texts(seed=0):
    rng = random.Random(seed)
    out = [None, "", "   \n\t", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "é ü " * 9, "a\x0bb\x0ca\rb a\nb\ta b", "a a " * 7]
    for _ in range(120):
        words = [rng.choice("abc") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (p * 9)[: rng.randrange(1, 9 * len(p))]
        out.append(" ".join(words))
    out += ["x y z " * 3000, " ".join(rng.choice("ab") for _ in range(4000)), "w " * 5000 + "v " * 5000]
    return out


def test_runs_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "q " * 8, "x"), (3, "a " * 6, "y"), (3, "a " * 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.find_runs(docs).collect()
    want = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words) if len(words) < 12000 else None
        if runs is None:
            runs = [(0, 5000, 1), (5000, 5000, 1)]
        want.append((str(i), len(words), runs, collapsed(words, runs)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)


def test_levels_and_agreement():
    rng = np.random.default_rng(1)
    first = np.concatenate([rng.integers(0, 2, 300), 2 + rng.integers(0, 2, 100), np.full(64, 4)])
    ends = np.repeat([300, 400, 464], [300, 100, 64])
    levels = periodic_runs.name_levels(first, ends)
    for l, names in enumerate(levels):
        seen = {}
        for i, v in enumerate(names[:-1]):
            window = tuple(first[i : i + (1 << l)]) if i + (1 << l) <= ends[i] else (-1, i)
            assert seen.setdefault(window, v) == v
        assert len(set(seen.values())) == len(seen)
    x = rng.integers(0, 463, 400)
    y = np.minimum(x + 1 + rng.integers(0, 30, 400), 463)
    ok = (x < y) & (ends[x] == ends[y])
    x, y = x[ok], y[ok]

    def plain(i, j, step):
        k = 0
        while 0 <= min(i, j) and max(i, j) < 464 and ends[i] == ends[x0] and ends[j] == ends[x0] and first[i] == first[j]:
            k, i, j = k + 1, i + step, j + step
        return k

    ahead, back = periodic_runs.agreement(levels, x, y), periodic_runs.agreement(levels, x, y, backwards=True)
    for x0, y0, f, b in zip(x, y, ahead, back):
        assert plain(x0, y0, 1) == f and plain(x0 - 1, y0 - 1, -1) == b


def test_query_digests(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90)))) for i in range(150)] + [(None, "a " * 7), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs))).collect()}
    planted = 0
    for i, t in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], planted + 1
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *top, 1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_planting_needs_no_python(spark):
    odd = ["", " \t\n", " \x0b lead é ü\u00a0x \u2003y  tail ", "one", "a\rb\x0cc d\x1ce \x85f g\x00h", "w " * 400, None]
    rows = [(i, odd[i % len(odd)]) for i in range(-300, 300)] + [(None, "a b c")]
    planted = periodic_runs.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    changed = 0
    for r, (i, t) in zip(planted.collect(), rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n, text = zlib.crc32(str(i).encode()), len(words), r["text"]
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            t, changed = " ".join(words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)), changed + 1
        assert (r["doc_id"], text if isinstance(text, str | None) else bytes(text).decode()) == (i, t)
    assert changed > 20
    plan = periodic_runs.digests(periodic_runs.find_runs(planted))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow", plan)) == 1  # each such step holds batches of texts in the executor and a worker of its own
