import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import exact_dedup, line_dedup, ngram_join, substring_dedup
from ledgermatch.llm.common import possible
from ledgermatch.llm.components import connected_components
from tests.llm.helpers import odd_documents, prose, texts_frame


# --- exact ----------------------------------------------------------------------------------------

def test_exact_dedup_on_odd_input(spark, tmp_path):
    docs = odd_documents(spark)
    rows = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)).collect()
    verdict = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    assert len(verdict) == len(rows) == docs.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
    six = hashlib.sha256(b"the same text of six words").hexdigest()
    assert {(k[0], r["keep_id"], r["group_size"], r["kept"]) for k, r in verdict.items() if k[1] == six} == {
        (6, 12, 4, False), (7, 12, 4, False), (12, 12, 4, True)}
    empty = hashlib.sha256(b"").hexdigest()
    assert {(k[0], r["keep_id"], r["kept"]) for k, r in verdict.items() if k[1] == empty} == {(1, 2, False), (2, 2, True), (None, 2, False)}
    nameless = [r for r in rows if r["doc_id"] is None and r["text_sha256"] != empty]
    assert [(r["keep_id"], r["kept"]) for r in nameless] == [(None, True)]
    kept = exact_dedup.keep_first_copies(docs, exact_dedup.DigestIndex(spark, str(tmp_path / "other"), 3))
    assert kept.columns == docs.columns and kept.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup.exact_dedup(docs.limit(0), exact_dedup.DigestIndex(spark, str(tmp_path / "none"), 3)).count() == 0


def test_index_persists_and_replays_add_nothing(spark, tmp_path):
    first = texts_frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "a", "en", "s")])
    second = texts_frame(spark, [(9, "a", "en", "s"), (10, "c", "en", "s")])
    where = str(tmp_path / "index")
    for _ in range(2):
        index = exact_dedup.DigestIndex(spark, where, 3)
        rows = exact_dedup.exact_dedup(first, index).collect()
        assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows} == {(1, 3, False), (2, 2, True), (3, 3, True)}
        assert index.rows().count() == 2
        index.close()
    index = exact_dedup.DigestIndex(spark, where, 3)
    rows = exact_dedup.exact_dedup(second, index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows} == {(9, 3, False), (10, 10, True)}
    assert index.rows().count() == 3


# --- near -----------------------------------------------------------------------------------------

def brute_classes(rows, n, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(rng, size, words=120, changes=6):
    base = prose(rng, words).split()
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        if rng.random() < 0.3:
            copy.insert(rng.randrange(len(copy)), "inserted")
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block,leaders", [(1_500_000, 8), (900, 2)])
def test_ngram_classes_equal_brute_force(spark, monkeypatch, block, leaders):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "_HUB_FROM", 3)
    rng = random.Random(block)
    passage = prose(rng, 60)
    texts = [t for size in (40, 25, 2, 3, 5) for t in family(rng, size)]
    texts += [prose(rng, rng.randrange(1, 90)) + " " + passage for _ in range(40)]
    texts += [prose(rng, rng.randrange(1, 12)) for _ in range(60)] + ["One two", "one TWO", "one", "ONE", "", "  ", "É one", "é one"]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(len(texts), None, "en", "s")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(texts_frame(spark, rows), n=4, percent=85).collect()}
    assert got == brute_classes(rows, 4, 85)


def test_t_occurrence_search_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = [rng.choice(4000, rng.integers(20, 90), replace=False) for _ in range(6)]
        keys = []
        for _ in range(int(rng.integers(2, 60))):
            k = base[rng.integers(6)].copy()
            changed = rng.integers(0, 1 + len(k) // 8)
            k[:changed] = rng.integers(5000, 9000, changed)
            keys.append(np.unique(k.astype(np.uint64)))
        classes = ngram_join._Classes(list(range(len(keys))))
        for i, j in ngram_join.t_occurrence_links(keys, list(range(len(keys))), None, 80):
            assert ngram_join._linked(len(np.intersect1d(keys[i], keys[j])), len(keys[i]), len(keys[j]), 80)
            classes.join(i, j)
        for i in range(len(keys)):
            for j in range(i):
                if ngram_join._linked(len(np.intersect1d(keys[i], keys[j])), len(keys[i]), len(keys[j]), 80):
                    assert classes.root(i) == classes.root(j)


def test_ngram_classes_on_odd_input(spark):
    docs = odd_documents(spark)
    rows = ngram_join.ngram_classes(docs).collect()
    assert len(rows) == docs.count()
    of = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert of[1] == (0, 1) and of[2] == (0, 2) and of[6] == of[7] == of[12] == (2, 6) and of[10] == of[11] == (1, 10)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert ngram_join.ngram_classes(docs.limit(0)).count() == 0


def test_classes_of_a_large_cell_meet_by_their_first_ngrams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    rng = np.random.default_rng(32)
    parts = [rng.choice(10**6, 20) for _ in range(31)]
    sets = []
    for a, b in zip(parts, parts[1:]):  # each family shares half with the next
        for _ in range(3):
            kept = np.concatenate([a, b])
            kept[:rng.integers(4)] = rng.integers(10**6, 2 * 10**6)
            sets.append(np.unique(kept))
    rows = [(0, i, i // 3 * 3 if i % 3 == 1 else i, x.astype(np.int64).tobytes()) for i, x in enumerate(sets)]
    search, dealt = ngram_join._search, []

    def counted(frame, group, percent):
        dealt.append(frame.count())
        return search(frame, group, percent)

    monkeypatch.setattr(ngram_join, "_search", counted)
    links = ngram_join._between_classes(spark.createDataFrame(rows, "cell long, node long, label long, keys binary"), 85).collect()
    classes, want = ngram_join._Classes([r[2] for r in rows]), ngram_join._Classes([r[2] for r in rows])
    linked = lambda i, j: ngram_join._linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)
    for r in links:
        assert linked(r["a"], r["b"])
        classes.join(r["a"], r["b"])
    for i in range(len(sets)):
        for j in range(i):
            if linked(i, j):
                want.join(i, j)
    assert all((classes.root(i) == classes.root(j)) == (want.root(i) == want.root(j)) for i in range(len(sets)) for j in range(i))
    assert 0 < sum(dealt) < 6 * len(rows)  # block against block each row would be dealt more than ten times


def test_only_documents_with_enough_ngrams_of_other_classes_are_searched_on(spark):
    keys = lambda *x: np.array(x, np.int64).tobytes()
    rows = [(1, 10, 7, keys(1, 2, 3, 4)), (1, 11, 7, keys(1, 2, 3, 5)), (1, 12, 8, keys(1, 2, 3, 9)), (1, 13, 9, keys(1, 20, 21, 22)),
            (2, 14, 7, keys(1, 2, 3, 4)), (2, 15, 7, keys(1, 2, 3, 4))]
    frame = spark.createDataFrame(rows, "cell long, node long, label long, keys binary")
    assert {r["node"] for r in ngram_join._able(frame, 75).collect()} == {10, 11, 12}
    assert ngram_join._able(frame, 80).count() == 0


def test_rows_with_few_possible_partners_are_told_without_losing_one(spark):
    ids = spark.range(0, 20000, 20).withColumnRenamed("id", "node")
    rows = spark.range(0, 20000).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    marked = possible(rows, "doc_id", ids).collect()
    assert len(marked) == 20001 and all(r["possible"] for r in marked if r["doc_id"] is not None and r["doc_id"] % 20 == 0)
    assert 1000 <= sum(r["possible"] for r in marked) < 3000 and not any(r["possible"] for r in marked if r["doc_id"] is None)
    assert not any(r["possible"] for r in possible(rows, "doc_id", ids.limit(0)).collect())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(300, 200), (250, 300), (250, 400)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, **{i: 200 for i in (200, 250, 300, 400)}}


# --- substrings -----------------------------------------------------------------------------------

def test_chunks_tile_the_text_and_fall_back_into_step():
    rng = random.Random(2)
    for text in [prose(rng, 300), "é" * 500, "x", "ab" * 400, "字" * 300]:
        data = np.frombuffer(text.encode(), np.uint8)
        ends, _ = substring_dedup.cut(data)
        sizes = np.diff(ends, prepend=0)
        assert ends[-1] == len(data) and (sizes > 0).all() and sizes.max() <= substring_dedup.MAX_CHUNK
        assert all((data[e] & 0xC0) != 0x80 for e in ends[:-1])
    text = prose(rng, 400).encode()
    a = substring_dedup.cut(np.frombuffer(text, np.uint8))[0]
    b = substring_dedup.cut(np.frombuffer(b"something new in front " + text, np.uint8))[0] - len(b"something new in front ")
    assert len(set(a) & set(b)) > 0.9 * len(a)


def test_digests_alone_are_those_of_the_chunks(spark):
    rng = random.Random(8)
    rows = [(1, prose(rng, 300), "en", "s"), (2, None, "en", "s"), (None, "é" * 700 + prose(rng, 90), "en", "s"), (3, "", "en", "s"), (4, "one word " * 200, "en", "s")]
    docs = texts_frame(spark, rows)
    expected = substring_dedup.chunks(docs).select("doc_id", "digest").distinct()
    got = substring_dedup.chunk_digests(docs)
    order = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert order(got) == order(expected)


def test_passages_of_51_words_go_whole_and_clean_documents_stay(spark):
    rng = random.Random(3)
    rows, passages = [], {}
    for k in range(500):
        passage = prose(rng, 51)
        for i in (2 * k, 2 * k + 1):
            before, after = prose(rng, rng.randrange(20, 80)), prose(rng, rng.randrange(20, 80))
            rows.append((i, f"{before}x {passage} y{after}", "en", "s"))
            passages[i] = passage
    short = prose(rng, 40)  # repeats of fewer words are left alone
    rows += [(2000 + i, f"{prose(rng, 30)}q {short} {i}{prose(rng, 60)}", "en", "s") for i in range(30)]
    kept = left = 0
    for r in substring_dedup.dedup_substrings(texts_frame(spark, rows)).collect():
        i = r["doc_id"]
        if i >= 2000:
            assert r["spans"] == [] and r["removed_bytes"] == 0
            continue
        (s,) = r["spans"]
        raw = rows[i][1].encode()
        assert s["removed"] == bool(i % 2) and s["first_doc_id"] == i - i % 2 and s["words"] >= 51
        assert passages[i] in raw[s["begin"]:s["end"]].decode() and s["end"] - s["begin"] <= len(passages[i].encode()) + 30
        assert r["text"].encode() == (raw[:s["begin"]] + raw[s["end"]:] if i % 2 else raw)
        kept, left = kept + i % 2, left + (passages[i] in r["text"] if i % 2 else 0)
    assert kept == 500 and left == 0


def brute_spans(rows, min_words):
    """doc_id -> bytes that lie in an equal passage of a document with a smaller id, of min_words whole words there."""
    lost = {}
    for i, text, *_ in rows:
        words = text.split(" ")
        begins = np.cumsum([0] + [len(w.encode()) + 1 for w in words])
        gone = np.zeros(len(text.encode()), bool)
        for j, other, *_ in rows:
            if j >= i:
                continue
            others = other.split(" ")
            seen = {tuple(others[k:k + min_words]) for k in range(len(others) - min_words + 1)}
            for k in range(len(words) - min_words + 1):
                if tuple(words[k:k + min_words]) in seen:
                    gone[begins[k]:begins[k + min_words] - 1] = True
        lost[i] = gone
    return lost


def test_spans_equal_brute_force_across_edited_copies_and_several_sources(spark):
    rng = random.Random(7)
    base = [prose(rng, 400).split(" ") for _ in range(4)]
    rows = []
    for i in range(40):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"edit{i}"
        other = rng.choice(base)
        at = rng.randrange(300)
        rows.append((i, " ".join(words[rng.randrange(100):] + [f"mark{i}"] + other[at:at + rng.randrange(30, 100)]), "en", "s"))
    rows += [(100 + i, " ".join(["again"] * (1500 + i)), "en", "s") for i in range(3)]  # equal at any distance
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(texts_frame(spark, rows)).collect()}
    want = brute_spans(rows, substring_dedup.MIN_WORDS)
    asked = left = 0
    for i, text, *_ in rows:
        mine = np.zeros(len(text.encode()), bool)
        for span in got[i]["spans"]:
            mine[span["begin"]:span["end"]] |= span["removed"]
        assert got[i]["removed_bytes"] == mine.sum() and len(got[i]["text"].encode()) == len(mine) - mine.sum()
        assert not (mine & ~want[i]).any()  # nothing goes that is no repeated passage of one source
        # Of what a later document shares beyond the first one, fewer words than a span and two chunks may stay.
        turns = np.flatnonzero(np.diff(np.concatenate([[0], (want[i] & ~mine).astype(int), [0]])))
        assert all(len(text.encode()[a:b].split()) < substring_dedup.MIN_WORDS + 20 for a, b in zip(turns[::2], turns[1::2]))
        asked, left = asked + want[i].sum(), left + (want[i] & ~mine).sum()
    assert left <= 0.02 * asked


def test_texts_under_one_id_and_repeated_rows_remove_nothing_from_each_other(spark):
    rng = random.Random(8)
    p = prose(rng, 90)
    rows = [(1, p + " one", "en", "s"), (1, "two " + p, "en", "s"), (None, p + " three", "en", "s"), (None, p + " three", "en", "s")]
    got = substring_dedup.dedup_substrings(texts_frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, " three")] * 2 + [(1, p + " one"), (1, "two " + p)]
    alone = substring_dedup.dedup_substrings(texts_frame(spark, rows[:2])).collect()
    assert all(r["spans"] == [] for r in alone)


def test_a_passage_that_repeats_often_within_a_document_is_removed_throughout(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(20)]
    line = " ".join(words) + " "
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(texts_frame(spark, [(1, line * 3, "en", "s"), (2, line * 15, "en", "s")])).collect()}
    assert got[1]["text"] == line * 3 and got[2]["text"].strip() == ""


def test_substring_dedup_on_odd_input(spark):
    docs = odd_documents(spark)
    rows = substring_dedup.dedup_substrings(docs, min_words=3).collect()
    assert len(rows) == docs.count()
    of = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert of[1]["text"] is None and of[2]["text"] == "" and of[6]["text"] == "the same text of six words"
    assert of[7]["text"] == "" and of[12]["removed_bytes"] == 26 and of[6]["spans"][0]["removed"] is False
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


# --- lines ----------------------------------------------------------------------------------------

def test_recurring_templates_go_with_their_variable_fields(spark):
    rng = random.Random(4)
    names = [prose(rng, 1) + "q" for _ in range(40)]
    rows = []
    for i in range(40):
        own = prose(rng, 12)
        rows.append((i, f"{own}\nPage {i} of 40 printed for {names[i]} by the clerk\nshort line\n\n{own} again", "en", "s"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(texts_frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        lines = text.split("\n")
        assert got[i]["n_lines"] == 5 and got[i]["n_dropped"] == 1 and got[i]["text"] == "\n".join(lines[:1] + lines[2:])


def test_line_dedup_on_odd_input(spark):
    docs = odd_documents(spark)
    rows = line_dedup.dedup_lines(docs, min_docs=3).collect()
    assert len(rows) == docs.count()
    of = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in rows if r["doc_id"]}
    assert of[1] == (0, 0, None) and of[2] == (1, 0, "") and of[6] == of[7] == of[12] == (1, 1, "") and of[10] == (1, 0, "x")
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_a_template_recurs_at_the_same_number_in_any_table(spark):
    rng = random.Random(12)
    for size in (60, 1200):
        rows = [(i, f"{prose(rng, 9)}\nshare this page with {i} of your friends now", "en", "s") for i in range(50)]
        rows += [(100 + i, prose(rng, 12), "en", "s") for i in range(size)]
        got = line_dedup.dedup_lines(texts_frame(spark, rows)).where("n_dropped > 0").collect()
        assert sorted(r["doc_id"] for r in got) == list(range(50)) and all("share" not in r["text"] for r in got)


def test_any_fifty_words_hold_a_chunk_that_is_cut_alike_everywhere():
    """Also words of one letter, where a passage has 99 bytes and the hash alone often chose no two places."""
    rng = np.random.default_rng(3)
    for letters in ("0123456789", "ab", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(300):
            def words(n):
                return " ".join(rng.choice(list(letters), n))
            passage = words(50)
            cuts = []
            for _ in range(2):
                head = words(int(rng.integers(0, 60)))
                text = f"{head} {passage} {words(int(rng.integers(0, 60)))}".encode()
                begin = len(head) + 1
                ends = substring_dedup.cut(np.frombuffer(text, np.uint8))[0] - begin
                inside = [int(e) for e in ends if 0 <= e <= len(passage)]
                cuts.append(set(zip(inside, inside[1:])))
            assert cuts[0] & cuts[1]
