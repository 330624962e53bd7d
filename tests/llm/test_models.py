import math
import random
import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgermatch.llm import langid, lm_score
from ledgermatch.llm.common import crc_fold
from tests.llm.helpers import odd_documents, texts_frame


def tongue(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


TONGUES = {"aa": ["la", "mo", "ri", "te"], "bb": ["sch", "ung", "ö", "keit"], "cc": ["ção", "que", "ê", "x"]}


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(list(TONGUES))
        rows.append((i, tongue(rng, TONGUES[name], rng.randint(4, 80)), name, "s"))
    return rows


def numeric(loss, w, i, step=1e-5):
    old = w[i]
    w[i] = old + step
    up = loss()
    w[i] = old - step
    down = loss()
    w[i] = old
    return (up - down) / (2 * step)


def test_language_network_gradients():
    rng = np.random.default_rng(1)
    net = langid._fresh(["a", "b", "c"], 4, rng)
    for d in (net.left, net.right):
        d.by_byte, d.by_state, d.out = (x.astype("f8") for x in (d.by_byte, d.by_state, d.out))
    net.bias = net.bias.astype("f8")
    block, labels = rng.integers(97, 100, (7, 5)).astype("u1"), rng.integers(3, size=5)
    _, grads = langid.loss_and_gradients(net, block, labels)
    for w, g in zip(langid._weights(net), langid._weights(grads)):
        for _ in range(6):
            i = tuple(int(rng.integers(97, 100)) if s == 256 else int(rng.integers(s)) for s in w.shape)
            assert abs(numeric(lambda: langid.loss_and_gradients(net, block, labels)[0], w, i) - g[i]) < 1e-7


def test_windows_label_every_byte_like_one_pass(monkeypatch):
    rng = np.random.default_rng(2)
    net = langid._fresh(["a", "b"], 4, rng)
    texts = [bytes(rng.integers(97, 120, n).astype("u1")) for n in (1, 5, 300, 900, 40)]
    whole = langid.classify(net, texts)
    one = [langid.label_positions(net, [np.frombuffer(t, "u1")])[0].mean(1) for t in texts]
    assert np.allclose(whole, one, atol=0.02) and np.allclose(whole.sum(1), 1, atol=1e-4)
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 2)
    assert np.allclose(whole, langid.classify(net, texts), atol=1e-5)


def test_languages_of_held_out_documents(spark):
    rows = corpus()
    docs = texts_frame(spark, rows).withColumn("held_out", crc_fold(4) == 2)
    net = langid.fit(docs.where("NOT held_out"), steps=120)
    got = langid.predict(docs, net).where("held_out").collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows) > 30
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_on_odd_input(spark):
    docs = odd_documents(spark)
    net = langid.fit(docs, steps=5)
    rows = langid.predict(docs, net).collect()
    assert len(rows) == docs.count() and langid.predict(docs, net).columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 4) or r["text"] is None) and r["lang_pred"] in ("und", "en", "de", "fr")
    assert len({(r["lang_pred"], round(r["score"], 5)) for r in rows if r["text"] == "the same text of six words"}) == 1
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    figures = lm_score.Corpus(1000, 100, rng.integers(0, 50, lm_score.SHORT_LIST).astype(float), np.ones(32) * 5, rng.random(lm_score._CLASSES + 33) * 9)
    net = lm_score.Network(figures, 5)
    net.weights = {k: w.astype("f8") + rng.normal(0, 0.1, w.shape) for k, w in net.weights.items()}
    inputs, targets = (rng.integers(0, lm_score.SHORT_LIST + lm_score._TAIL, (6, 4)) for _ in range(2))
    weight, state = rng.random((6, 4)), rng.normal(size=(5, 4))
    go = lambda: net.window_gradients(inputs, targets, lm_score.TRAINED_CLASS[targets], weight, state)
    _, grads, _ = go()
    short = targets[targets < lm_score.SHORT_LIST]
    for k, w in net.weights.items():
        for _ in range(6):
            i = [int(rng.integers(s)) for s in w.shape]
            if k == "token":
                i[1] = int(rng.choice(inputs.ravel()))
            if k.startswith("word"):
                i[:2] = divmod(int(rng.choice(short)), lm_score.CLASS_WORDS)
            assert abs(numeric(lambda: go()[0], w, tuple(i)) - grads[k][tuple(i)]) < 1e-7


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(3)
    short, mass = np.arange(lm_score.SHORT_LIST, 0, -1.0), np.zeros(32)
    tail = [1, 1, 1, 2, 3, 3, 5, 9]
    for c in tail:
        mass[int(math.log2(c))] += c
    net = lm_score.Network(lm_score.Corpus(10**6, 3000, short, mass, rng.random(lm_score._CLASSES + 33)))
    states = rng.normal(size=(lm_score.HIDDEN, 1)).astype("f4")
    codes = np.arange(lm_score.SHORT_LIST)
    total = np.exp(net.output(np.repeat(states, len(codes), 1), codes, lm_score.SCORED_CLASS[codes])).sum()
    for c in tail:
        code = np.array([lm_score.SHORT_LIST + 2 * int(math.log2(c))])
        total += np.exp(net.output(states, code, lm_score.SCORED_CLASS[code]))[0] * c / mass[int(math.log2(c))]
    for power in range(32):  # classes without a word keep a little probability
        if not mass[power]:
            code = np.array([lm_score.SHORT_LIST + 2 * power])
            total += np.exp(net.output(states, code, lm_score.SCORED_CLASS[code]))[0]
    code = np.array([lm_score._UNSEEN])
    assert abs(total + np.exp(net.output(states, code, lm_score.SCORED_CLASS[code]))[0] - 1) < 1e-3


def test_state_is_carried_across_windows_and_groups(monkeypatch):
    rng = np.random.default_rng(4)
    net = lm_score.Network(lm_score.Corpus(1000, 100, np.ones(lm_score.SHORT_LIST), np.ones(32), np.ones(lm_score._CLASSES + 33)))
    net.weights["class"] += rng.normal(0, 0.3, net.weights["class"].shape).astype("f4")
    docs = [rng.integers(0, lm_score.SHORT_LIST + lm_score._TAIL, n).astype("u2") for n in (1, 30, 7, 200, 24, 25)]
    whole = lm_score.score_documents(net, docs)
    monkeypatch.setattr(lm_score, "WINDOW", 500)
    monkeypatch.setattr(lm_score, "SIDE_BY_SIDE", 1)
    assert np.allclose(whole, lm_score.score_documents(net, docs), rtol=1e-4)


def brute_base(rows, held):
    counts, total = {}, 0
    split = lambda t: [*(t or "").encode().lower().split(), None]
    for i, text, *_ in rows:
        if not held(i):
            for w in split(text):
                counts[w] = counts.get(w, 0) + 1
                total += 1
    base = {}
    for n, (i, text, *_) in enumerate(rows):
        w = split(text)
        base[n] = (i, len(w), sum(counts.get(x, 0) > 0 for x in w), total,
                   sum(math.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w))
    return base


def test_counts_and_base_score_equal_brute_force_and_the_model_beats_them(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHORT_LIST", lm_score.SHORT_LIST)
    rows = corpus(5, 300) + [(1000, None, "x", "s"), (1001, "", "x", "s"), (1002, "LA Mo unseenword", "x", "s")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = lm_score.score_corpus(texts_frame(spark, rows).repartition(3), F.coalesce(crc_fold(7) == 2, F.lit(False))).collect()
    want = {i: (n, k, t, round(b, 6)) for i, n, k, t, b in brute_base(rows, held).values()}
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got} == want
    new = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in new} == {i for i in want if held(i)}
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new) and all(r["score"] < 0 for r in got)


def test_every_training_document_is_trained_on_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm_score, "TASK_TOKENS", 100)
    monkeypatch.setattr(lm_score, "DEAL_TOKENS", 1000)

    def record(net, docs, folder=str(tmp_path)):
        with open(f"{folder}/{uuid.uuid4()}", "w") as out:
            out.write(" ".join(str(len(d)) for d in docs))
        return net

    monkeypatch.setattr(lm_score, "train_documents", record)
    code = lambda n: np.zeros(n, "u2").tobytes()
    sizes = [10 + i % 37 for i in range(400)]
    frame = spark.createDataFrame([(i, i % 7 == 2, bytearray(code(n))) for i, n in enumerate(sizes)], "doc_id long, held_out boolean, codes binary").coalesce(1)
    figures = lm_score.Corpus(sum(sizes), 1, np.ones(lm_score.SHORT_LIST), np.ones(32), np.ones(lm_score._CLASSES + 33))
    lm_score._train(frame, figures)
    pieces = [[int(x) for x in f.read_text().split()] for f in tmp_path.iterdir()]
    assert sorted(n for piece in pieces for n in piece) == sorted(n for i, n in enumerate(sizes) if i % 7 != 2)
    assert all(sum(piece) < 100 + max(sizes) for piece in pieces)


def test_language_model_on_odd_input(spark):
    docs = odd_documents(spark)
    rows = lm_score.score_corpus(docs, F.coalesce(crc_fold(7) == 2, F.lit(False))).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["n_tokens"] == of[2]["n_tokens"] == of[3]["n_tokens"] == 1 and of[5]["n_tokens"] == 6002
    nothing = lm_score.score_corpus(docs, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in nothing} == {(0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in nothing)
    assert lm_score.score_corpus(docs.limit(0), F.lit(False)).count() == 0


def test_numerals_are_no_letters(spark):
    rows = [(i, f"wort{i} und satz", "de", "s") for i in range(8)] + [(50, "½ ² Ⅷ", "de", "s"), (51, "٣", None, "s"), (52, "é", None, "s")]
    docs = texts_frame(spark, rows)
    told = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs), into=("lang_pred", "score")).collect()}
    assert told[50] == told[51] == langid.UNDETERMINED and told[52] == "de"
