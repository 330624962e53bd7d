import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgermatch.llm import byte_bpe
from tests.llm.helpers import odd_documents
from tests.llm.test_encoding import STRINGS, random_texts


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path(byte_bpe.RANKS_NAME), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tokenizer):
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ids, special_tokens={})


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def mixed_texts(seed, n=150):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(9, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F300, 0x1F600)]))
    return ["".join(pick() for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def plain_merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The procedure itself: one leftmost pair of the smallest rank at a time."""
    if word in table:
        return [table[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((table.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [table[p] for p in parts]


def test_ids_equal_the_library(tokenizer, library):
    rng = random.Random(8)
    runs = ["a" * n for n in range(1, 600, 43)] + [c * 900 for c in "= \n."] + ["".join(rng.choice(some) for _ in range(3000)) for some in ("ab", "acgt", "abcdefghij", "é字")]
    texts = STRINGS + random_texts(6) + mixed_texts(7) + runs
    for text, found in zip(texts, tokenizer.encode(texts)):
        assert ids(found) == library.encode_ordinary(text)
        assert tokenizer.decode(found) == text.encode()


def test_pattern_takes_every_kind_of_character_like_the_library(tokenizer, library):
    some = [*range(0, 0x3100), *range(0xFE00, 0x10000), 0x1680, 0x180E, 0x1F600, 0x10FFFF]
    texts = [f"a{chr(c)}1 {chr(c)}" for c in some if not 0xD800 <= c <= 0xDFFF]
    assert [ids(x) for x in tokenizer.encode(texts)] == library.encode_ordinary_batch(texts, num_threads=2)


def test_merges_follow_the_procedure_for_any_ranks():
    """Rank files whose merges are not nested as in a trained one, so that a merge can put a smaller rank beside it."""
    rng = random.Random(9)
    for _ in range(40):
        parts = [bytes([i]) for i in range(256)]
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(60)}
        rng.shuffle(order := sorted(more))
        table = {p: i for i, p in enumerate(parts + order)}
        file = b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for p, i in table.items())
        tokenizer = byte_bpe.ByteBpe(file, r"\S+|\s+")
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        for word, found in zip(words, tokenizer.merged(words)):
            assert ids(found) == plain_merge(word, table)
        for word in words:
            if word not in table:
                long = byte_bpe.merge_long(tokenizer.byte_ids[np.frombuffer(word, np.uint8)], tokenizer.pairs)
                assert long.tolist() == plain_merge(word, table)


def test_lookup_finds_all_pairs_and_no_others(tokenizer):
    rng = np.random.default_rng(3)
    left, right = rng.integers(-1, 50256, 4000).astype(np.int32), rng.integers(-1, 300, 4000).astype(np.int32)
    want = [tokenizer.ids.get(tokenizer.parts[a] + tokenizer.parts[b], byte_bpe._NEVER) if min(a, b) >= 0 else byte_bpe._NEVER
            for a, b in zip(left.tolist(), right.tolist())]
    assert tokenizer.pairs.look_up(left, right).tolist() == want


def test_word_cache_forgets_and_long_texts_are_split_piece_by_piece(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_CACHED_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "_WORDS_AT_ONCE", 7)
    tokenizer = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    texts = random_texts(11, 40)
    assert [ids(x) for x in tokenizer.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(tokenizer.young) <= 5 and len(tokenizer.old) <= 5


def test_query_on_odd_input(spark, tmp_path, library):
    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = byte_bpe.op11_byte_bpe(spark, str(tmp_path)).collect()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        found = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(found), digest(np.array(found, "<u4").tobytes()), digest((r["text"] or "").encode())))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_columns_stay_and_clashing_names_are_replaced(spark):
    docs = odd_documents(spark)  # has a column named ids
    encoded = byte_bpe.encode_column(docs)
    assert sorted(encoded.columns) == sorted(docs.columns) and dict(encoded.dtypes)["ids"] == "binary"
    back = byte_bpe.decode_column(encoded.withColumn("ids", F.expr("CASE WHEN doc_id = 4 THEN NULL ELSE ids END")), into="text")
    texts = {r["doc_id"]: r["text"] for r in back.where("doc_id IN (4, 5)").collect()}
    assert texts[4] is None and bytes(texts[5]).startswith(b"wordword")
    assert byte_bpe.encode_column(docs.limit(0)).count() == 0
