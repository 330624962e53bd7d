import random

import numpy as np
import pytest

from ledgermatch.llm import packing, sentencepiece
from tests.llm.helpers import LONG, odd_documents

STRINGS = ["", " ", "a  b", "  a  b\tc\n\nÄx 漢字🙂 ", "ab" * 500 + "theinganderonst" * 40, "日本語のテキスト" * 30, "▁a ▁▁", "x" * 700, "\x00\x01a", LONG]


@pytest.fixture(scope="module")
def data():
    with open(sentencepiece.MODEL_FILE, "rb") as f:
        return f.read()


def random_texts(seed, n=150):
    rng = random.Random(seed)
    return ["".join(rng.choice(["th", "e", "in", "er ", " ", "\n", "é", "ß", "q", "7", "onst", "字"]) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_ids_equal_the_merge_procedure_of_the_library(data):
    import sentencepiece as library
    model, expected = sentencepiece.PieceModel(data), library.SentencePieceProcessor(model_proto=data)
    for text in STRINGS + random_texts(1):
        ids = model.encode(text)
        assert ids == expected.encode(text)
        assert list(model.search(model.normalise(text))) == ids
        assert ("▁" in text) or model.decode(ids) == text


def test_unigram_search_finds_the_best_score(data):
    import sentencepiece as library
    bpe = b"\x18\x02 \x80\xfa\x01"  # model type of the trainer's settings, then the vocabulary size
    assert data.count(bpe) == 1
    data = data.replace(bpe, b"\x18\x01" + bpe[2:])
    model, expected = sentencepiece.PieceModel(data), library.SentencePieceProcessor(model_proto=data)
    for text in random_texts(2, 80):
        ids, best = list(model.search(model.normalise(text))), expected.encode(text)
        total = lambda x: sum(model.scores[i] for i in x if model.types[i] == 1)
        assert abs(total(ids) - total(best)) <= 1e-3 * abs(total(best)) + 1e-6 and model.decode(ids) == text


def test_search_keeps_a_bounded_window(data):
    model, seen = sentencepiece.PieceModel(data), []

    def characters():
        for i in range(4000):
            seen.append(i)
            yield "aeinorst"[i * i % 8]

    found = model.search(characters())
    next(found)
    assert len(seen) < 400  # the first id is final long before the text ends


def test_encode_column_on_odd_input(spark):
    docs = odd_documents(spark)
    rows = sentencepiece.encode_column(docs).select("doc_id", "text", "ids", "ids_exact").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["ids_exact"] is None
        else:
            assert r["ids_exact"] == ("▁" not in r["text"]) and (r["ids"] == []) == (r["text"] == "")
    back = sentencepiece.decode_column(sentencepiece.encode_column(docs).select("doc_id", "ids"))
    assert {r["text"] for r in back.collect() if r["text"]} == {r["text"].replace("▁", " ") for r in rows if r["text"]}
    assert sentencepiece.encode_column(docs.limit(0)).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        width = rng.randint(1, 40)
        sizes = np.array([rng.randint(1, width) for _ in range(rng.randint(1, 150))])
        rows = packing.best_fit_decreasing(sizes, width)
        assert sorted(sum(rows, [])) == list(range(len(sizes))) and all(sizes[r].sum() <= width for r in rows)
        free = []
        for size in sorted(sizes, reverse=True):
            fitting = [f for f in free if f >= size]
            if fitting:
                free.remove(min(fitting))
            free.append((min(fitting) if fitting else width) - size)
        assert len(free) == len(rows)


def test_stretches_encode_like_the_whole_text():
    with open(packing.RANKS_FILE, "rb") as f:
        encoder = packing._Encoder(f.read())
    for text in STRINGS + random_texts(4) + [" a", "a\n b", "a \nb", "a\xa0b c", "a 　b", "it's 12 3a"]:
        assert encoder.encode(text).tolist() == encoder.encoding.encode_ordinary(text)


def test_packed_matrices_hold_every_document_once(spark, tmp_path):
    docs = odd_documents(spark)
    packing.write_packed(docs.coalesce(1), str(tmp_path / "packed"), width=64, matrix_rows=4)
    packed = spark.read.parquet(str(tmp_path / "packed"))
    for r in packed.collect():
        assert len(r["ids"]) == 4 * r["n_rows"] * r["width"] and r["n_rows"] <= 4
        assert all(c[0] == 0 and c[-1] <= 64 and c[:-1] == s and c == sorted(c) for c, s in zip(r["cu_seqlens"], r["resets"]))
    with open(packing.RANKS_FILE, "rb") as f:
        encoder = packing._Encoder(f.read())
    pieces = sorted((r["doc_id"] or -1, r["offset"], bytes(r["ids"])) for r in packing.segments(packed).collect())
    whole = {}
    for doc_id, offset, ids in pieces:
        whole.setdefault(doc_id, []).append(np.frombuffer(ids, np.int32))
    for row in docs.where("doc_id IN (4, 5, 6, 8, 9, 10)").collect():
        ids = np.concatenate(whole[row["doc_id"]])
        assert ids[-1] == encoder.end and encoder.encoding.decode(ids[:-1].tolist()) == row["text"]
    assert 1 not in whole and 2 not in whole and len([p for p in pieces if p[0] == 7]) == 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_a_search_for_a_new_word_looks_at_few_pairs_of_pieces(data):
    import sentencepiece as library
    model, expected, asked = sentencepiece.PieceModel(data), library.SentencePieceProcessor(model_proto=data), []

    class Counted(dict):
        def __missing__(self, pair):
            asked.append(pair)
            return model_apart[pair]

    model_apart, model._apart = model._apart, Counted()
    words = ["".join(x) for x in zip(*(random.Random(i).choices(["th", "ing", "onst", "é", "ber", "ß", "q7"], k=400) for i in range(6)))]
    assert [model.encode(w) for w in words] == [expected.encode(w) for w in words]
    assert len(asked) < 2 * sum(map(len, words))  # longest pieces first; shortest first asks for 2.5 a character and more
    lines = "\n".join(words[:50]) + "\n\n" + words[0] + "\n"
    held = len(model._words)
    assert model.encode(lines) == expected.encode(lines) and len(model._words) == held  # a line's parts are held, not the lines
