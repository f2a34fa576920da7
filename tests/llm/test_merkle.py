"""The Merkle manifest against plain hashing, its proofs and changed rows."""

import hashlib
import random
import zlib

import pytest

from plotweave.llm import merkle, queries
from tests.conftest import same_rows

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """All levels of nodes over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = ""
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out += "".join(run[: at % 16] + run[at % 16 + 1 :])
        at //= 16
    return out


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, H([field(v) for v in r])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    inner = {s: up([d for _, d in groups[s]]) for s in names}
    outer = up([inner[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (r, d) in enumerate(groups[s]):
            proof = siblings(inner[s], at) + siblings(outer, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            whole = not hit or r[4] is None or not any("A" <= c <= "Z" for c in r[4])
            out.append((str(r[0]), d, inner[s][-1][0], outer[-1][0], H([proof]), whole))
    return sorted(out)


def corpus(n, seed=1):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "z" * 30] + [f"s{k}" for k in range(30)]
    pick = lambda: "hot" if rng.random() < 0.5 else rng.choice(sources)
    rows = [(i, pick(), rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Äb C", "lower", "Up" * 50])) for i in range(n)]
    return rows + [(None, "hot", None, None, "x"), (None, "hot", None, None, "x"), (None, None, None, None, None), (3, "hot", "en", 1, "A"), (3, "hot", "en", 1, "A"), (3, "hot", "en", 1, "B")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [0, 700, 9000])
def test_manifest_equals_plain_hashing(spark, n):
    rows = corpus(n)
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, proof string").repartition(5)
    found = merkle.verified(merkle.document_manifest(docs)).collect()
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in found)
    assert got == brute(rows)
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in found)


def test_small_manifests(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.document_manifest(docs).count() == 0
    row = (5, None, None, None, None)
    r = merkle.verified(merkle.document_manifest(spark.createDataFrame([row], SCHEMA))).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == H([field(v) for v in row]) and r["proof_sha256"] == H([])


def test_walk_appends_siblings():
    nodes = [f"{k:064x}" for k in range(300)]
    root, paths = merkle.walk(nodes, 3)
    levels = up(nodes)
    assert root == levels[3][0]
    for at, path in enumerate(paths):
        assert "".join(s["left"] + s["right"] for s in path) == siblings(levels, at)


def test_sql(spark, duck):
    from tests.conftest import DATA

    same_rows(queries.op13_merkle_manifest(spark, DATA).toPandas(), duck.execute(queries.SQL["op13_merkle_manifest"]).df())
