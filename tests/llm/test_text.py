"""Language, tokens, chat, mixing, quality, sharding and the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotweave.llm import chat, langid, mixing, queries, quality, sentencepiece_codec as sp, sharding
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df())


def brute_phrases(text, train):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("window", [1, 2, 7, 64, langid.WINDOW])
def test_cross_parsing_counts(window):
    """Phrases of whole texts, also where they cross windows, in texts of short periods and in other scripts."""
    rng = random.Random(0)
    train = {k: "".join(rng.choice(a) for _ in range(800)) for k, a in (("x", "abcd "), ("y", "cdef "), ("z", "漢字仮名交文 "))}
    train = {k: langid.letters(t) + "q" * 7 for k, t in train.items()}
    model = langid.Model(train)
    texts = ["", *("".join(rng.choice("abcdefgh 漢字") for _ in range(n)) for n in (1, 5, 300, 2000)), "q" * 200, "ab" * 100, train["x"], train["x"] * 3, "", train["z"][:90] + train["z"][3:99], "Ж" * 40]
    rows = [langid.letters(t) for t in texts]
    symbols = model.symbol[np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)]
    offsets = np.cumsum([0, *map(len, rows)])
    for k, automaton in zip(model.langs, model.automata):
        assert automaton.phrases(symbols, offsets, window).tolist() == [brute_phrases(t, train[k]) for t in rows]


@pytest.mark.parametrize("table", [0, langid.TABLE])
@pytest.mark.parametrize("few", [0, 2, 64])
def test_cross_parsing_takes_a_step_a_place(table, few, monkeypatch):
    """Tables over all symbols and hash tables give the same phrases; what is left of few windows costs no step of all."""
    monkeypatch.setattr(langid, "TABLE", table)
    monkeypatch.setattr(langid, "FEW", few)
    rng = random.Random(4)
    train = {k: "".join(rng.choice(a) for _ in range(700)) for k, a in (("x", "abcd "), ("z", "".join(map(chr, range(0x4E00, 0x4F90)))))}
    texts = [train["x"] * 4, train["z"][5:] + train["z"], "abc" * 500, "Ж", "", *("".join(rng.choice(train["xz"[n % 2]]) for _ in range(n)) for n in range(1, 400, 7))]
    model = langid.Model(train)
    symbols, offsets = model.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)], np.cumsum([0, *map(len, texts)])
    steps, moves = [], langid.Automaton.moves
    monkeypatch.setattr(langid.Automaton, "moves", lambda self, *a: steps.append(1) or moves(self, *a))
    for lang, automaton in zip(model.langs, model.automata):
        steps.clear()
        assert automaton.phrases(symbols, offsets, 50).tolist() == [brute_phrases(t, train[lang]) for t in texts]
        assert few < 64 or len(steps) < 100  # 50 in the windows; 1,000 to 2,000 if each step of one window were one of all


def test_language_decision_is_the_fewest_normalised_phrases(spark):
    train = {"en": "the cat sat on the mat and the dog", "fr": "le chat est sur le tapis et le chien"}
    texts = ["The cat, and the dog!", "le chien est le chat", "dog", "zzz", "Le 3e chat: sur the mat", "é"]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang_pred string, score double")
    rows = langid.identify(docs, train).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        t = langid.letters(texts[r["doc_id"]])
        rate = {k: brute_phrases(t, v) * np.log2(len(v)) / len(t) for k, v in train.items()}
        one, two = sorted(rate.values())
        assert r["lang_pred"] == min(train, key=lambda k: (rate[k], k)) and r["score"] == pytest.approx(1 - one / two)


def test_language_sample_is_drawn_from_whole_texts(spark):
    text = "".join(chr(97 + k // 26) + chr(97 + k % 26) + " " for k in range(676)) * 20
    docs = spark.createDataFrame([(i, text, "xx") for i in range(1, 30)] + [(None, "no id", "yy"), (40, "", "yy"), (41, None, "yy"), (42, "no label", None)], "doc_id long, text string, lang string")
    found = langid.learn(docs, passages_per_lang=10, passage=50)
    assert set(found) == {"xx"}
    places = [langid.letters(text).find(found["xx"][k : k + 12]) for k in range(0, len(found["xx"]) - 12, 50)]
    assert max(places) > 600 and len(found["xx"]) <= 10 * 51
    whole = langid.learn(docs.where("doc_id is null or doc_id > 39"), 10, 50)
    assert whole == {}


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, good = got.count(), got.where("lang = lang_pred").count()
    assert good >= 0.97 * n
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (5, "x" * 100000, "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, {"en": "the cat sat on the mat", "fr": "le chat xxx"}).collect()} == {1: "und", 2: "und", 3: "und", 5: "fr"}
    assert langid.identify(odd.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model")
@pytest.mark.parametrize("kind", [sp.BPE, sp.UNIGRAM])
def test_tokens_equal_the_library(kind):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(sp.MODEL, "rb").read())
    model.trainer_spec.model_type = kind
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = sp.Codec(sp.read_pieces()._replace(kind=kind))
    texts = ["", "  a  b ", "héllo wörld 漢字 😀😀 x", "\n\n tab\tx", "a" * 300, "   ", None, "==== ---- 12345 3.14159", "ＦＵＬＬ ﷺ", "The quick brown fox jumps over the lazy dogs' international representation"]
    ids, at = codec.encode(texts)
    raw, of = codec.decode(ids, at)
    for k, t in enumerate(texts):
        own, want = ids[at[k] : at[k + 1]].tolist(), lib.encode(t or "")
        if kind == sp.BPE:
            assert own == want, t
        else:  # equal sums may be cut otherwise
            score = lambda xs: sum(model.pieces[i].score for i in xs if model.pieces[i].type == 1)
            assert score(own) == pytest.approx(score(want)), t
        assert raw[of[k] : of[k + 1]].tobytes().decode() == (t or "")


@pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model")
@pytest.mark.parametrize("fallback", [True, False])
def test_parts_of_words_recur(fallback, monkeypatch):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    monkeypatch.setattr(sp, "MAX_WORDS", 300)
    model = proto.ModelProto()
    model.ParseFromString(open(sp.MODEL, "rb").read())
    model.trainer_spec.byte_fallback = fallback
    if not fallback:
        for p in model.pieces:
            p.type = proto.ModelProto.SentencePiece.Type.UNUSED if p.type == 6 else p.type
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = sp.Codec(sp.read_pieces()._replace(fallback=fallback))
    rng = np.random.default_rng(5)
    stems = ["Haus", "représentation", "Ähre", "qüx", "漢字漢", "😀😀", "naïve\n", "x\x00y", "ﷺ", "Œuvre", "12.5", "a" * 40, "ñandú"]
    odd = [" ", "  ", ".", ",", "\n", "!?", "😀", "é", "(", "***", "\x00", "z", ")."]
    for _ in range(25):
        texts = ["".join(rng.choice(stems) + rng.choice(odd) + rng.choice(odd) for _ in range(rng.integers(30))) for _ in range(20)]
        ids, at = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [lib.encode(t) for t in texts]
    assert codec.pairs.nbytes == 8 << sp._PAIRS  # doesn't grow with what has been read
    seen, segmented = [], codec._segmented
    codec._segmented = lambda parts: seen.extend(parts) or segmented(parts)
    codec.encode([f"Weltraumschiff{mark}" for mark in (".", ",", ";", "!", "?", "\n", "”")] + ["(Weltraumschiff"])
    assert sum("eltraumschiff" in p for p in seen) <= 2  # with the blank before it, and without


def test_token_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", "x"), (2, None, "x"), (2, "", "x"), (3, "▁ é", "x")], "doc_id long, text string, ids string")
    rows = sp.encode_documents(docs)
    assert {(r["doc_id"], r["round_trip"]) for r in rows.collect()} == {(1, True), (2, True), (3, False)}  # the mark reads back as a blank
    assert sorted((r["doc_id"], r["text"]) for r in sp.decode_documents(rows).collect()) == [(1, "some words here"), (2, ""), (2, ""), (3, "  é")]


HARD = ["", "</s>", "\\</s>", "\\\\", "a\\", "[INST]x[/INST]\n", "</s>\n<s>[INST]user[/INST]\nhi", "\\\\[/INST]\\", "plain \\n text", "é😀"]


def test_chat_turns_round_trip():
    for role in ("user", "assistant", "[/INST]", "a\\"):
        for text in HARD:
            out = chat.render(role, text)
            assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2
    assert chat.render("user", "plain \\n text") == "<s>[INST]user[/INST]\nplain \\n text</s>\n"
    with pytest.raises(chat.Malformed):
        chat.parse("<s>[INST]user[/INST]\nhi")


def test_chat_rows(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", t, "z") for k, t in enumerate(HARD)] + [(2, None, None, None, "z"), (2, 0, "user", "b", "z"), (2, 0, "user", "b", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    loss = "".join(HARD[1::2])
    assert all(r["round_trip"] for r in got.values())
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(HARD), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["n_turns"] == 3
    assert chat.digests(df.limit(0)).count() == 0


def test_raking_meets_targets(spark):
    rng = np.random.default_rng(0)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    targets = [mixing.tempered(rng.random(n), 1.0) for n in (4, 3, 2)]
    fitted = mixing.rake(codes, rng.random(len(codes)) + 0.1, targets)
    for k, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, k], fitted), t, atol=1e-8)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", float(a + b + c + 1)) for a, b, c in codes.tolist()], "source string, lang string, topic string, weight double")
    here = {tuple(r)[:3]: r["fitted"] for r in mixing._rake_here(cells, mixing.MARGINS, 0.5).collect()}
    there = {tuple(r)[:3]: r["fitted"] for r in mixing._rake_spark(cells, mixing.MARGINS, 0.5).collect()}
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-8 for k in here)


def brute_mix(rows, targets):
    """Probabilities by plain loops; ``rows``: (source, lang, topic, tokens)."""
    cells = {}
    for *cell, n in rows:
        cells[tuple(cell)] = cells.get(tuple(cell), 0.0) + n
    total, want = sum(cells.values()), []
    for k, m in enumerate(mixing.MARGINS):
        share = {}
        for cell, n in cells.items():
            share[cell[k]] = share.get(cell[k], 0.0) + n / total
        given = {v: w for v, w in targets.get(m, {}).items() if v in share}
        rest = sum(x**mixing.TEMPERATURE for v, x in share.items() if v not in given)
        want.append({v: given[v] if v in given else x**mixing.TEMPERATURE / rest * (1 - sum(given.values())) for v, x in share.items()})
    fit = {cell: n / total for cell, n in cells.items()}
    for _ in range(300):
        for k in range(3):
            now = {}
            for cell, x in fit.items():
                now[cell[k]] = now.get(cell[k], 0.0) + x
            fit = {cell: x * want[k][cell[k]] / now[cell[k]] for cell, x in fit.items()}
    ratio = {cell: fit[cell] / cells[cell] for cell in cells}
    each = sorted(x for cell, x in ratio.items() for _ in range(int(cells[cell])))
    at = (len(each) - 1) * (1 - mixing.WHOLE)
    top = each[int(at)] + (at - int(at)) * (each[min(int(at) + 1, len(each) - 1)] - each[int(at)])
    return want, {cell: min(1.0, x / top) for cell, x in ratio.items()}


@pytest.mark.parametrize("targets", [{}, {"lang": {"en": 0.5}, "source": {"s0": 0.2, "none such": 0.1}}])
def test_mixing_equals_brute_force(spark, targets):
    words = ["a b c", "the license of it", "write to a@b", "x | y | z"]
    docs = spark.createDataFrame([(i, words[i * 7 % 4] + " w" * (i % 11), f"s{i * i % 5}", ("en", "de", "fr")[i % 3]) for i in range(3000)], "doc_id long, text string, source string, lang string")
    got = mixing.mix(docs, targets=targets).cache()
    rows = got.collect()
    want, p = brute_mix([(r["source"], r["lang"], r["topic"], r["tokens"]) for r in rows], targets)
    assert all(r["tokens"] == docs_tokens for r, docs_tokens in ((r, 1 + (words[r["doc_id"] * 7 % 4] + " w" * (r["doc_id"] % 11)).count(" ")) for r in rows))
    for r in rows:
        assert r["probability"] == pytest.approx(p[(r["source"], r["lang"], r["topic"])], rel=1e-6)
    report = {(r["margin"], r["value"]): r for r in mixing.marginals(got, targets=targets).collect()}
    kept = sum(r["tokens"] for r in rows if r["sampled"])
    for k, m in enumerate(mixing.MARGINS):
        for v, t in want[k].items():
            r = report[(m, v)]
            assert r["target"] == pytest.approx(t, abs=1e-9)
            assert r["achieved"] == pytest.approx(sum(x["tokens"] for x in rows if x["sampled"] and x[m] == v) / kept)
            assert abs(r["expected"] - t) < 0.05 and abs(r["achieved"] - r["expected"]) < 0.05  # clipped cells miss a little


def test_targets_alike_on_both_paths(spark):
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", float(a + b + c + 1)) for a in range(4) for b in range(3) for c in range(2)], "source string, lang string, topic string, weight double")
    targets = {"source": {"s1": 0.5}, "topic": {"t0": 0.3, "t1": 0.3}}
    here = {tuple(r)[:3]: r["fitted"] for r in mixing._rake_here(cells, mixing.MARGINS, 0.9, targets).collect()}
    there = {tuple(r)[:3]: r["fitted"] for r in mixing._rake_spark(cells, mixing.MARGINS, 0.9, targets).collect()}
    assert all(abs(here[k] - there[k]) < 1e-8 for k in here)
    assert sum(x for k, x in here.items() if k[0] == "s1") == pytest.approx(0.5) and sum(x for k, x in here.items() if k[2] == "t0") == pytest.approx(0.5)
    with pytest.raises(ValueError):
        mixing._rake_here(cells, mixing.MARGINS, 0.9, {"lang": {"l0": 0.8, "l1": 0.4}})


def test_mixing_columns_and_clashes(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en", "x", 3.0, 1), (1, "a", "s", "en", "x", 3.0, 1), (None, None, None, None, None, None, 2), (4, "y " * 200000, "s", "de", "y", 0.0, 3)], "doc_id long, text string, source string, lang string, topic string, p double, row int")
    rows = mixing.mix(docs, topic_col="topic", tokens_col="p").collect()
    assert sorted((r["topic"], r["tokens"]) for r in rows) == [("", 0.0), ("x", 3.0), ("x", 3.0), ("y", 0.0)]
    kept = mixing.keep_sampled(docs)
    assert kept.columns == docs.columns and kept.count() <= 4
    nothing = mixing.mix(docs, tokens_col="row", topic_col="topic", targets={"source": {"other": 1.0}}).collect()
    assert len(nothing) == 4


def test_mixing_rows(spark):
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else "a b " * (i % 7), None if i % 4 == 0 else f"s{i % 3}", "en" if i % 2 else None, 0.5) for i in range(200)], "doc_id long, text string, source string, lang string, probability double")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 200 and all(0 <= r["probability"] <= 1 for r in rows) and any(r["sampled"] for r in rows)
    kept = mixing.keep_sampled(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["sampled"])
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 200000, 1)], "doc_id long, text string, score int")
    got = quality.score_documents(odd, labels.limit(0)).collect()
    assert [r["score"] for r in got] == [0.5] * 3
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_and_shards(spark):
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 2000)
    for n in (1, 2, 40, 41):
        assert sharding.jump(keys.view(np.uint64), n).tolist() == [jump_one(int(k) % 2**64, n) for k in keys]
    a, b = sharding.jump(keys.view(np.uint64), 40), sharding.jump(keys.view(np.uint64), 41)
    assert ((a == b) | (b == 40)).all() and 0 < (a != b).mean() < 0.06
    docs = spark.createDataFrame([(i % 700, None if i % 9 == 0 else f"é{i}", "x") for i in range(900)] + [(None, "n", "x")], "doc_id long, text string, slot string")
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == 901
    for r in rows:
        if r["doc_id"] is not None:
            assert r["shard"] == jump_one(r["doc_id"], 40) and r["grown_shard"] == jump_one(r["doc_id"], 41)
    for k in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    one = next(r for r in rows if r["doc_id"] == 1)
    assert (one["size"], one["text_crc32"]) in {(len(f"é{i}".encode()) + 16, zlib.crc32(f"é{i}".encode())) for i in (1, 701)}
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = c.run(spark, DATA).collect()
    good = {r["doc_id"] for r in quality.score_documents(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    norm = {i: text[i].translate({k: k + 32 for k in range(65, 91)}) for i in good}
    last = {}
    for i in sorted(good):
        last[norm[i]] = i
    from tests.llm.test_dedup import near_classes

    left = near_classes([(i, text[i]) for i in last.values()])
    kept = {i for i, k in left.items() if i == k}
    sampled = {r["doc_id"] for r in mixing.mix(docs.where(F.col("doc_id").isin([int(i) for i in kept]))).where("sampled").collect()}
    assert {r["doc_id"] for r in rows} == sampled and all(r["round_trip"] for r in rows)
    codec = sp.Codec(sp.read_pieces())
    for r in rows[:20]:
        assert codec.decode(np.array(r["ids"]), np.array([0, len(r["ids"])]))[0].tobytes().decode() == text[r["doc_id"]]


def test_chat_is_linear_in_backslashes():
    import time

    text = "\\" * 1_000_000 + "x" + "\\" * 300_000 + "</s>" + "\\" * 1_000_000
    begin = time.perf_counter()
    turns = chat.parse(chat.render("user", text))
    assert [t[:2] for t in turns] == [("user", text)] and time.perf_counter() - begin < 2
