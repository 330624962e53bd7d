import math
import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline
from ledgermatch.llm import mixing, quality
from tests.llm.helpers import odd_documents, prose, texts_frame
from tests.llm.test_dedup import brute_classes
from tests.llm.test_models import TONGUES, tongue


# --- mixing ---------------------------------------------------------------------------------------

def test_schedule_deviates_by_less_than_one_block():
    rng = random.Random(1)
    for _ in range(120):
        blocks = {str(i): rng.randint(1, 50) for i in range(rng.randint(1, 7))}
        weights = {s: Fraction(rng.randint(1, 20)) for s in blocks} if rng.random() < 0.5 else mixing.capped_weights(blocks)
        total, got = sum(weights.values()), Counter()
        schedule = mixing.pfair_schedule(weights, blocks)
        for t, (source, block, release, deadline, slot) in enumerate(schedule):
            got[source] += 1
            assert slot == t and block == got[source] and release <= t < deadline
            assert all(abs(got[s] - weights[s] / total * (t + 1)) < 1 for s in blocks)
        assert any(got[s] == blocks[s] for s in blocks)


def test_capped_weights():
    weights = mixing.capped_weights({"a": 70, "b": 20, "c": 10})
    assert weights == {"a": Fraction(1, 3), "b": Fraction(1, 3), "c": Fraction(1, 3)}
    assert sum(weights.values()) == 1 and max(weights.values()) <= Fraction(1, 3)
    assert mixing.capped_weights({"a": 3}) == {"a": 1}
    assert mixing.capped_weights({"a": 70, "b": 20, "c": 10}, Fraction(1, 2)) == {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}


def test_mix_keeps_target_weights_in_every_prefix(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 10 < 6 else f"s{i % 10}" if i % 10 < 9 else None) for i in range(1000)]
    mixed = mixing.mix_sources(texts_frame(spark, rows), {"big": 2, "s6": 1, "s7": 1, None: 1}, max_slots=100, whole=False).collect()
    assert len(mixed) == 1000
    used = [r for r in mixed if r["mix_slot"] is not None]
    assert {r["source"] for r in used} == {"big", "s6", "s7", None}
    per_slot = Counter((r["mix_slot"], r["source"], r["mix_block"]) for r in used)
    slots = sorted(per_slot)
    assert [s for s, *_ in slots] == list(range(len(slots))) and max(per_slot.values()) == 10 and 50 <= len(slots) < 55
    got = Counter()
    for t, (_, source, block) in enumerate(slots):
        got[source] += 1
        assert block == got[source] and all(abs(got[s] - w * (t + 1) / 5) < 1 for s, w in {"big": 2, "s6": 1, "s7": 1, None: 1}.items())


def plain_schedule(weights, sizes):
    """Every slot by looking at all blocks left: of the released ones the earliest deadline, restarted where a source ends."""
    used, found = dict.fromkeys(sizes, 0), []
    key = lambda s: (s is None, s or "")
    while any(used[s] < sizes[s] for s in sizes):
        left = {s: Fraction(weights[s]) for s in sizes if used[s] < sizes[s]}
        share = {s: w / sum(left.values()) for s, w in left.items()}
        start, before = len(found), dict(used)
        while True:
            t = len(found) - start
            ready = [(-(-(used[s] - before[s] + 1) // share[s]), key(s), s) for s in left if (used[s] - before[s]) // share[s] <= t]
            source = min(ready)[2]
            if used[source] == sizes[source]:
                break
            used[source] += 1
            found.append((source, used[source]))
    return found


def test_query_equals_a_schedule_over_all_blocks(spark, tmp_path):
    rows = [(i, f"text {i}", "en", rng_source) for i, rng_source in enumerate(["web"] * 120 + ["books"] * 31 + [None] * 9 + ["code"])]
    texts_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op8_mixing(spark, str(tmp_path)).collect()
    want = plain_schedule({"web": 1, "books": 1, None: 1, "code": 1}, {"web": 120, "books": 31, None: 9, "code": 1})
    assert [(r["source"], r["mix_block"]) for r in sorted(got, key=lambda r: r["mix_slot"])] == want and len({r["doc_id"] for r in got}) == 161
    # Inside a source the blocks stand in the order of a hash of id and text.
    hashed = {r[0]: r[1] for r in texts_frame(spark, rows).select("doc_id", F.xxhash64("doc_id", "text")).collect()}
    buckets = 1 + math.isqrt(120)
    for source in ("web", "books", None):
        mine = [r["doc_id"] for r in sorted((r for r in got if r["source"] == source), key=lambda r: r["mix_block"])]
        assert mine == sorted(mine, key=lambda i: (hashed[i] % buckets, hashed[i]))


def test_mixing_on_odd_input(spark):
    docs = odd_documents(spark)
    mixed = mixing.mix_sources(docs)
    assert mixed.count() == docs.count() and mixed.columns == [c for c in docs.columns if c != "mix_slot"] + [f"mix_{x}" for x in mixing._MIX]
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and 0 < taken.count() <= docs.count()
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0


def test_own_shares_and_given_weights_keep_every_document(spark):
    rows = [(i, f"text {i}", "web" if i < 700 else "books" if i < 899 else None if i == 899 else "code") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for blocks in ({"a": 70, "b": 20, "c": 10}, {"web": 900, "books": 100, None: 1}, {"a": 1000, "b": 1}, {"a": 60, "b": 10, "c": 10, "d": 10, "e": 10}):
        slots = mixing.pfair_schedule(blocks, blocks)
        assert Counter(s for s, *_ in slots) == blocks and max(deadline for *_, deadline, _ in slots) == len(slots)
        slots = mixing.whole_schedule({s: k + 1 for k, s in enumerate(blocks)}, blocks)
        assert Counter(s for s, *_ in slots) == blocks and len({(s, b) for s, b, *_ in slots}) == len(slots)
        assert all(slot == t and release <= t < deadline for t, (_, _, release, deadline, slot) in enumerate(slots))
    for max_slots in (50, 1 << 16):
        assert mixing.mix_sources(docs, max_slots=max_slots).where("mix_slot IS NULL").isEmpty()
        assert mixing.take_mix(docs, max_slots=max_slots).count() == 1000
        assert mixing.take_mix(docs, weights={"web": 1, "books": 1, "code": 1, None: 1}, max_slots=max_slots).count() == 1000
    assert mixing.take_mix(docs, weights={"web": 1, "books": 0}).count() == 700


# --- quality --------------------------------------------------------------------------------------

def brute_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(["a", "b#", "ccé", "🙂", "d|"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    texts += [None, "", " \x0b ", "a b c a b c a b", "a b c d a b c", "x y z", "q " * 3000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = quality.measures(texts_frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got} == {
        i: brute_measures(t) for i, t, *_ in rows}


def test_thresholds_adapt_to_the_group_and_sketches_merge(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        short = i % 2 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4) if short else rng.randint(9, 12))) for _ in range(80)]
        rows.append((i, " ".join(words), "xx" if short else "yy", "s"))
    rows.append((600, " ".join("".join(rng.choice("abcdefgh") for _ in range(11)) for _ in range(80)), "xx", "s"))   # yy's length in xx
    rows.append((601, " ".join(f"w{k}##" for k in range(80)), "yy", "s"))
    rows.append((602, rows[0][1], "xx", "tiny"))                                                                 # small group: its language's sketch
    rows.append((603, rows[0][1], "zz", None))                                                                   # small language: everything's
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(texts_frame(spark, rows)).collect()}
    assert all(got[i] for i in range(600)) and not got[600] and not got[601] and got[602]
    measured = quality.measures(texts_frame(spark, rows))
    names = list(quality.LEAST)
    halves = quality.sketch(measured.where("doc_id % 2 = 0"), names).union(quality.sketch(measured.where("doc_id % 2 = 1"), names))
    by = ["lang", "source"]
    assert sorted(map(str, quality.merge(halves, by).collect())) == sorted(map(str, quality.merge(quality.sketch(measured, names), by).collect()))
    exact = sorted(r["mean_word"] for r in measured.where("lang = 'xx' AND source = 's'").collect())
    fence = quality.fences(quality.merge(halves, by), by, {n: 0 for n in names}, 0).where("lang = 'xx' AND source = 's' AND measure = 'mean_word'").first()
    middle = exact[(len(exact) - 1) // 2]
    assert middle * 31 / 32 <= fence["low"] == fence["high"] <= middle


def test_quality_uses_no_python(spark):
    plan = quality.quality_rules(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_quality_on_odd_input(spark):
    docs = odd_documents(spark)
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == docs.count() and {r["doc_id"] for r in rows if r["kept"]} <= {5}
    assert quality.quality_rules(docs.limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------

def pipeline_rows():
    rng = random.Random(8)
    rows = []
    for i in range(160):
        name = rng.choice(list(TONGUES))
        rows.append([i, tongue(rng, TONGUES[name], 60), name, "big" if i % 2 else f"s{i % 6}"])
    for i in range(160, 180):
        rows.append([i, rows[i - 160][1], "aa", "s0"])                    # exact copies
    for i in range(180, 200):
        rows.append([i, rows[i - 140][1] + " end", "aa", "s2"])           # near copies
    rows += [[200, None, "aa", "s0"], [201, "", None, None], [202, "1234 !", "aa", "s4"], [203, rows[5][1], None, None]]
    return [tuple(r) for r in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = pipeline_rows()
    docs = texts_frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d, kept, out = str(tmp_path), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, d)
        if name != "encode":
            assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        out[name] = {r["doc_id"] for r in kept.collect()}
    want = {r[0]: r for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert out["language"] == set(want)
    latest = {}
    for i, r in want.items():
        latest[r[1]] = max(i, latest.get(r[1], -1))
    assert out["exact"] == set(latest.values())
    classes = brute_classes([want[i] for i in out["exact"]], 5, 80)
    assert out["near"] == {c for _, c in classes.values()}
    assert out["mix"] == out["near"]  # every document has a slot
    sizes = Counter(want[i][3] for i in out["near"])
    order = [r["source"] for part in sorted((tmp_path / "mix").glob("part-*")) for r in spark.read.parquet(str(part)).collect()]
    got = Counter()
    for t, source in enumerate(order, 1):  # equal weights hold in every prefix, until one source has no document left
        got[source] += 1
        assert all(abs(got[s] - t / len(sizes)) < 1 for s in sizes)
        if got[source] == sizes[source]:
            break
    assert len(order) == len(out["near"]) and t >= len(sizes) * (min(sizes.values()) - 1)
    assert out["encode"] == out["mix"] and all(r["exact"] and len(r["ids"]) == r["n_ids"] for r in kept.collect())
    assert corpus_pipeline.run(spark, d).count() == len(out["encode"])


def test_encode_returns_the_places_of_the_mix(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 7), "aa", "big" if i % 3 else "small") for i in range(90)]
    corpus_pipeline.mix(spark, texts_frame(spark, rows), "").write.option("maxRecordsPerFile", 11).parquet(str(tmp_path / "mix"))
    found = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "mix")), "").collect()
    assert sorted(r["slot"] for r in found) == list(range(90)) and {r["doc_id"] for r in found} == set(range(90))
    order = [r["source"] for r in sorted(found, key=lambda r: r["slot"])]
    assert all(order[t] != order[t + 1] for t in range(0, 58, 2)) and order[60:] == ["big"] * 30
    again = corpus_pipeline.encode(spark, texts_frame(spark, rows), "").collect()  # rows that no file holds yet
    assert sorted(r["slot"] for r in again) == list(range(90))


def test_unlabelled_documents_with_a_letter_stay(spark):
    rows = [(1, "some words", None, "s"), (2, "12 34", None, "s"), (3, None, None, "s"), (4, "é", None, None)]
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, texts_frame(spark, rows), "").collect()} == {1, 4}


def test_pipeline_stages_on_odd_and_empty_input(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, "")
            assert result.count() <= docs.count()
            assert name == "encode" or result.columns == docs.columns
