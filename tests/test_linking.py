"""Golden link cases and the joins against brute force."""

import datetime as dt
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.names import jaro_winkler
from ledgermatch.operators import candidates as C
from ledgermatch.operators import keys as K
from ledgermatch.operators import passes as P
from ledgermatch.operators import subset
from ledgermatch.operators.subset import combinations_near_dates, combinations_to_target
from ledgermatch.operators.vendors import similar_name_pairs
from ledgermatch.plans.link import link_book

ENTITY = ("client_book_id string, id string, entity_type string, entity_subtype string, amount_cents long, "
          "transaction_date date, counterparty string")
KINDS = {"i": "invoice_line_item", "b": "bank_transaction", "g": "gl_entry"}
DAY = dt.date(2026, 7, 6)


def entity(book, id_, cents, name="Acme Corp", day=DAY, subtype="standard"):
    return (book, id_, KINDS[id_[0]], subtype, cents, day, name)


# book -> (tolerance, entities)
CASES = {
    "exact": (1, [("i1", 10000), ("b1", 10000), ("g1", 10000)]),
    "three": (1, [("i1", 30000), ("i2", 40000), ("i3", 50000), ("b1", 120000), ("g1", 120000)]),
    "parts": (1, [("i1", 150000), ("b1", 75000), ("b2", 75000), ("g1", 150000)]),
    "none": (1, [("i1", 12345), ("b1", 99999), ("g1", 11111)]),
    "alias": (1, [("i1", 10000, "Acme Corp"), ("b1", 10000, "Acme Corporation"), ("g1", 10000, "Acme Corp")]),
    "early": (1, [("i1", 5000, "Acme", DAY - dt.timedelta(9)), ("b1", 5000, "Acme"), ("g1", 5000, "Acme")]),
    "late": (1, [("i1", 5000, "Acme", DAY - dt.timedelta(19)), ("b1", 5000, "Acme"), ("g1", 5000, "Acme")]),
    "credit": (1, [("i1", 100000), ("i2", -10000), ("b1", 90000), ("g1", 90000)]),
    "void": (1, [("i1", 7000), ("b1", 7000), ("g1", 7000), ("g2", 7000, "Acme Corp", DAY, "void")]),
    "sum": (100, [("i1", 34250, "Riverside Design Co"), ("i2", 12875, "Riverside Design Co"),
                  ("b1", -47125, "RIVERSIDE DESIGN CO"), ("g1", 47125, "Riverside Design Co")]),
    "gap": (100, [("i1", 89900, "BRIGHT CLOUD HOSTING INC"), ("b1", -89900, "BRIGHT CLOUD HOSTING INC"),
                  ("g1", 89400, "Bright Cloud Hosting Inc.")]),
    "far": (100, [("i1", 55555, "Someone Else"), ("b1", -99999), ("g1", 11111)]),
    "nogl": (1, [("i1", 10000), ("b1", 10000)]),
    "noname": (1, [("i1", 10000, None), ("b1", 10000, "Any"), ("g1", 10000, "Other", None)]),
}


@pytest.fixture(scope="module")
def linked(spark):
    rows = [entity(book, *e) for book, (_, es) in CASES.items() for e in es]
    books = spark.createDataFrame([(b, t, 0.85, 0.5) for b, (t, _) in CASES.items()],
                                  "id string, tolerance_cents long, auto_link_threshold double, review_floor double")
    # ids are unique across books only together with the book; prefix them
    entities = spark.createDataFrame(rows, ENTITY).withColumn("id", F.concat("client_book_id", F.lit("-"), "id"))
    groups = link_book(entities, books)
    left = C.unmatched_entities(entities, C.member_rows(groups, "id"))
    by_book = {}
    for g in groups.collect():
        by_book.setdefault(g["client_book_id"], []).append(g)
    unmatched = {}
    for e in left.collect():
        unmatched.setdefault(e["client_book_id"], []).append(e["id"].split("-")[1])
    return by_book, {b: sorted(v) for b, v in unmatched.items()}


@pytest.mark.parametrize("book,invoices,banks", [
    ("exact", 1, 1), ("three", 3, 1), ("parts", 1, 2), ("alias", 1, 1), ("early", 1, 1), ("credit", 2, 1), ("sum", 2, 1)])
def test_auto_linked(linked, book, invoices, banks):
    groups, unmatched = linked
    full = [g for g in groups[book] if len(g["invoice_ids"]) == invoices and len(g["bank_ids"]) == banks]
    assert len(full) == 1 and full[0]["status"] == "auto_linked" and full[0]["link_confidence"] == 1.0
    assert book not in unmatched


def test_nothing_links(linked):
    groups, unmatched = linked
    assert "none" not in groups and unmatched["none"] == ["b1", "g1", "i1"]
    assert "far" not in groups and unmatched["far"] == ["b1", "g1", "i1"]
    assert "nogl" not in groups


def test_invoice_too_old(linked):
    groups, unmatched = linked
    assert unmatched["late"] == ["i1"] and [g["invoice_ids"] for g in groups["late"]] == [[]]


def test_void_never_links(linked):
    groups, unmatched = linked
    assert unmatched["void"] == ["g2"]


def test_discrepancy_goes_to_review(linked):
    g, = linked[0]["gap"]
    assert g["mismatch"] and g["status"] == "needs_review" and len(g["invoice_ids"]) == 1
    assert g["link_confidence"] == 0.4984


def test_missing_name_and_date_match_everything(linked):
    assert [g["status"] for g in linked[0]["noname"]] == ["auto_linked"]


def test_similarity_values():
    s = jaro_winkler(["martha", "dixon", "", "abc", "a"], ["marhta", "dicksonx", "x", "abc", "b"])
    assert [round(x, 4) for x in s] == [0.9611, 0.8133, 0.0, 1.0, 0.0]


def test_name_pairs_equal_brute_force(spark):
    rnd = random.Random(7)
    words = ["acme", "global", "tech", "sunrise", "landscape", "maint", "data", "works", "fleet", "lease"]
    names = set()
    while len(names) < 150:
        name = " ".join(rnd.sample(words, rnd.randint(1, 3)))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(name))
            name = name[:i] + rnd.choice("abcdefgh.") + name[i + rnd.randint(0, 1):]
        names.add(name)
    rows = spark.createDataFrame([("b", n) for n in names], "client_book_id string, counterparty string")
    got = {(r["name_a"], r["name_b"]) for r in similar_name_pairs(rows).collect()}
    pairs = list(itertools.product(sorted(names), repeat=2))
    want = {p for p, s in zip(pairs, jaro_winkler([a for a, _ in pairs], [b for _, b in pairs])) if s >= 0.9}
    assert got == want


def _random_legs(seed, n=60):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        day = None if rnd.random() < 0.1 else DAY + dt.timedelta(rnd.randint(0, 40))
        name = None if rnd.random() < 0.1 else rnd.choice(["Acme Corp", "Acme Corporation", "Globex", "Initech"])
        rows.append(("b", 5, f"{i:03d}", rnd.choice([-1, 1]) * rnd.randint(1, 120), day, name))
    return rows


def test_pair_join_equals_brute_force(spark):
    schema = "client_book_id string, tol long, id string, amount long, date date, name string"
    a, b = _random_legs(1), _random_legs(2)
    got = P.equal_amount_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "x", "y")
    got = sorted((r["x_id"], r["y_id"]) for r in got.collect())

    def ok(x, y):
        close = abs(abs(x[3]) - abs(y[3])) <= 5
        dated = x[4] is None or y[4] is None or 0 <= (y[4] - x[4]).days <= 14
        named = x[5] is None or y[5] is None or jaro_winkler([x[5].lower()], [y[5].lower()])[0] >= 0.9
        return close and dated and named

    assert got == sorted((x[2], y[2]) for x in a for y in b if ok(x, y)) and got


@pytest.mark.parametrize("target,tol,few", [(90, 2, 6), (-40, 0, 3), (3, 10, 6)])
def test_subset_sums_equal_brute_force(spark, monkeypatch, target, tol, few):
    monkeypatch.setattr(subset, "FEW", few)
    rnd = random.Random(target)
    amounts = {f"m{i:02d}": rnd.choice([-1, 1, 1]) * rnd.randint(1, 60) for i in range(11)}
    rows = [("b", tol, "a", target, k, v) for k, v in amounts.items()]
    df = spark.createDataFrame(rows, "client_book_id string, tol long, anchor string, anchor_amount long, id string, amount long")
    got = sorted(tuple(r["ids"]) for r in combinations_to_target(df).collect())
    want = sorted(x for n in (2, 3, 4, 5) for x in itertools.combinations(sorted(amounts), n)
                  if abs(abs(sum(amounts[k] for k in x)) - abs(target)) <= tol)
    assert got == want and want


@pytest.mark.parametrize("few", [1, 4, 6])
def test_combinations_in_date_windows_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(subset, "FEW", few)
    rng = random.Random(7)
    start = dt.date(2024, 1, 1)

    def member(i):
        day = None if rng.random() < 0.15 else start + dt.timedelta(days=rng.randrange(12))
        return f"b{i:02d}", rng.randrange(-30, 90), day

    own, nameless = [member(i) for i in range(14)], [member(i) for i in range(20, 25)]
    asked = [(f"i{k}", x) for k, x in enumerate((60, 61, -45, 120, 3))]
    got = combinations_near_dates(
        spark.createDataFrame([("k", "n", 1, *r) for r in own], "client_book_id string, wanted string, tol long, id string, amount long, date date"),
        spark.createDataFrame([("k", 1, *r) for r in nameless], "client_book_id string, tol long, id string, amount long, date date"),
        spark.createDataFrame([("k", "n", *r) for r in asked], "client_book_id string, wanted string, inv_id string, inv_amount long")).collect()
    want, mine = [], {r[0] for r in own}
    for size in range(2, 6):
        for combo in itertools.combinations(sorted(own + nameless, key=lambda r: r[0]), size):
            days = [r[2] for r in combo if r[2]]
            if (not days or (max(days) - min(days)).days <= 3) and mine & {r[0] for r in combo}:
                total = sum(r[1] for r in combo)
                want += [(i, tuple(r[0] for r in combo), total) for i, x in asked if abs(abs(total) - abs(x)) <= 1]
    assert sorted((r["inv_id"], tuple(r["ids"]), r["total"]) for r in got) == sorted(want) and len(want) > 20


@pytest.mark.parametrize("n_targets,tol", [(1, 40), (5, 3), (60, 0)])
def test_windows_searched_together_equal_brute_force(n_targets, tol):
    rng = np.random.default_rng(n_targets)
    sizes = [4, 0, 7, 1]
    amount, loose = rng.integers(-60, 200, sum(sizes)), rng.integers(-60, 200, 6)
    window = np.repeat(np.arange(len(sizes)), sizes)
    mark = np.concatenate([np.where(np.arange(n) < 2, 3, rng.choice([0, 2], n)) for n in sizes])  # the first two begin their window
    of_loose, size = rng.choice([0, 2], 6), np.sort(rng.integers(0, 500, n_targets))
    got = []
    for t, places, own, total in subset.window_sets(np.searchsorted(window, window, "right"), amount, mark, subset.loose_sums(loose, of_loose, 4), size, tol, 5):
        for k, line, s in zip(t, places, total):
            got.append((int(k), tuple(sorted(line[:own].tolist())), tuple(sorted(line[own:].tolist())), int(s)))
    want = []
    for w in range(len(sizes)):
        mine = np.flatnonzero(window == w).tolist()
        for n in range(2, 6):
            for combo in itertools.combinations([(0, i) for i in mine] + [(1, i) for i in range(6)], n):
                own, more = [i for kind, i in combo if kind == 0], [i for kind, i in combo if kind == 1]
                if np.bitwise_or.reduce([*mark[own], *of_loose[more]]) == 3:
                    total = int(amount[own].sum() + loose[more].sum())
                    want += [(k, tuple(own), tuple(more), total) for k, x in enumerate(size) if abs(abs(total) - x) <= tol]
    assert sorted(got) == sorted(want) and want


def _members(spark, rows):
    return spark.createDataFrame(rows, "anchor long, tol long, id string, amount long, mark int")


def _targets(spark, rows):
    return spark.createDataFrame(rows, "anchor long, target string, target_amount long")


@pytest.mark.parametrize("largest,block", [(5, 3), (5, 1 << 16), (4, 7), (3, 5), (2, 5)])
def test_sets_of_many_anchors_equal_brute_force(spark, monkeypatch, largest, block):
    """Small blocks: the pairs of an anchor lie in many, and sets are made across them."""
    monkeypatch.setattr(subset, "BLOCK", block)
    monkeypatch.setattr(subset, "_TARGETS", 2)
    monkeypatch.setattr(subset, "_MEMBERS", 3)
    monkeypatch.setattr(subset, "_LOOKUPS", 5 * block)
    rng = random.Random(largest + block)
    members = [(a, a % 3, f"m{i:02d}", rng.randint(-9, 25), rng.choice([0, 1, 2, 3, 3])) for a in range(6) for i in range(rng.choice([1, 9, 10]))]
    targets = [(a, f"t{k}", rng.randint(-30, 60)) for a in range(6) for k in range(rng.randint(0, 4))]
    got = sorted((r["anchor"], r["target"], tuple(r["ids"]), r["total"]) for r in subset.sets_to_targets(_members(spark, members), _targets(spark, targets), largest).collect())
    want = []
    for a, t, x in targets:
        own = sorted(m for m in members if m[0] == a)
        for size in range(2, largest + 1):
            for combo in itertools.combinations(own, size):
                total = sum(m[3] for m in combo)
                marks = 0
                for m in combo:
                    marks |= m[4]
                if marks == 3 and abs(abs(total) - abs(x)) <= a % 3:
                    want.append((a, t, tuple(m[2] for m in combo), total))
    assert got == sorted(want) and want


def test_a_window_of_three_thousand_payments(spark):
    """4.5 million pairs in about seventy blocks; sets of up to four are found without their triples."""
    rng = random.Random(5)
    amounts = [rng.randrange(10**13, 10**14) for _ in range(3000)]
    planted = {"two": [5, 2900], "three": [7, 1500, 2999], "four": [0, 900, 901, 2500]}
    members = [(1, 0, f"p{i:04d}", x, 3) for i, x in enumerate(amounts)]
    targets = [(1, name, sum(amounts[i] for i in places)) for name, places in planted.items()] + [(1, "none", 10**13)]
    got = {(r["target"], tuple(r["ids"])) for r in subset.sets_to_targets(_members(spark, members), _targets(spark, targets), 4).collect()}
    assert got == {(name, tuple(f"p{i:04d}" for i in places)) for name, places in planted.items()}


def test_medium_anchors_with_many_targets_are_grown_without_pairs(spark, monkeypatch):
    """36 members and 60 targets: every set, though the search by pairs gets no such anchor."""
    monkeypatch.setattr(subset, "_sets_of_large", _large_of(subset._sets_of_large, seen := []))
    monkeypatch.setattr(subset, "_GROWN", 1 << 12)
    rng = random.Random(5)
    members = [(1, 2, f"m{i:02d}", rng.choice([-1] * 9 + [1]) * rng.randint(10**5, 5 * 10**7), rng.choice([2, 2, 2, 3])) for i in range(36)]
    targets = [(1, f"t{k}", rng.randint(10**5, 5 * 10**7)) for k in range(58)]
    targets += [(1, "planted", -sum(m[3] for m in members[3:8])), (1, "no number", None)]
    members[3] = (*members[3][:4], 3)
    got = sorted((r["target"], tuple(r["ids"]), r["total"]) for r in subset.sets_to_targets(_members(spark, members), _targets(spark, targets)).collect())
    amounts, marks, want = np.array([m[3] for m in members]), np.array([m[4] for m in members]), []
    for size in range(2, 6):
        combos = np.array(list(itertools.combinations(range(36), size)))
        totals, marked = amounts[combos].sum(axis=1), np.bitwise_or.reduce(marks[combos], axis=1) == 3
        want += [(t, tuple(members[i][2] for i in combos[k]), int(totals[k])) for _, t, x in targets if x is not None
                 for k in np.flatnonzero(marked & (np.abs(np.abs(totals) - abs(x)) <= 2))]
    assert got == sorted(want) and "planted" in {t for t, _, _ in want} and seen == [0]


def _large_of(search, seen):
    def counting(members, asked, largest):
        seen.append(members.count())
        return search(members, asked, largest)
    return counting


@pytest.mark.parametrize("medium", [0, 8, 1 << 7])
def test_grown_and_searched_sets_are_the_same(spark, monkeypatch, medium):
    monkeypatch.setattr(subset, "MEDIUM", medium)
    monkeypatch.setattr(subset, "BLOCK", 7)
    rng = random.Random(3)
    members = [(a, 2, f"m{i:02d}", rng.randint(-20, 40), rng.choice([1, 2, 3, 3])) for a in range(4) for i in range(5 + 2 * a)]
    targets = [(a, f"t{k}", rng.randint(-50, 90)) for a in range(4) for k in range(3)]
    got = sorted((r["anchor"], r["target"], tuple(r["ids"]), r["total"]) for r in subset.sets_to_targets(_members(spark, members), _targets(spark, targets)).collect())
    want = sorted((a, t, tuple(m[2] for m in combo), sum(m[3] for m in combo)) for a, t, x in targets for size in range(2, 6)
                  for combo in itertools.combinations([m for m in members if m[0] == a], size)
                  if any(m[4] & 1 for m in combo) and any(m[4] & 2 for m in combo) and abs(abs(sum(m[3] for m in combo)) - abs(x)) <= 2)
    assert got == want and want


def test_a_couple_of_blocks_never_holds_its_products():
    rng = np.random.default_rng(1)
    amounts = rng.integers(10**9, 10**12, 400)
    i, j = np.triu_indices(400, 1)
    order = np.argsort(amounts[i] + amounts[j])
    block = {"total": (amounts[i] + amounts[j])[order], "i": i[order], "j": j[order], "mark": np.full(len(order), 3)}
    some = [3, 50, 70, 120, 199]
    lacking = amounts[some].sum() - amounts
    wanted = {"low": lacking, "high": lacking, "x": np.arange(400), "mark": np.full(400, 3)}
    tracemalloc.start()
    found = [places for _, places, _ in subset.couple_sets(block, block, wanted, True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [some] and peak < 120e6  # the products of the pairs and the wanted sums are 32 million


def test_one_long_name_costs_its_own_pair_only():
    import time
    names = [f"vendor {i}" for i in range(2000)]
    begin = time.time()
    assert jaro_winkler([*names, "ab" * 1500], [*names, "ab" * 1499])[-1] > 0.99
    assert time.time() - begin < 5


def test_unequal_pairs_equal_brute_force_and_few_rows_are_dealt(spark):
    """A payment is dealt once per similar name that ledger entries have, not nine times per similar name."""
    rng = random.Random(5)
    names = ["acme supplies", "acme supplies.", "acme supplies inc", "bolt", None, ""]
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(0, 40, 3)] + [None]

    def rows(kind, n):
        return [(rng.choice("ab"), 100, f"{kind}{i}", rng.choice([0, 90, 100, 210, 400, -800, 1500, 70_000, 100_000]), rng.choice(days), rng.choice(names))
                for i in range(n)]

    banks, gls = rows("k", 60), rows("g", 60)
    gls[0] = ("b", 100, "g0", 400, dt.date(2026, 1, 1), "bolt")
    gls = [g if g[0] == "a" or g[4] else (*g[:4], dt.date(2026, 1, 4), g[5]) for g in gls]  # no undated entry in book b
    frame = lambda x: spark.createDataFrame(x, "client_book_id string, tol long, id string, amount long, date date, name string")
    known = [n for n in names if n]
    alike = [(b, x, y) for b in "ab" for x in known for y in known if jaro_winkler([x], [y])[0] >= 0.9]
    pairs = spark.createDataFrame(alike, "client_book_id string, name_a string, name_b string")
    want = sorted((k[2], g[2]) for k in banks for g in gls if k[0] == g[0] and k[3] and g[3] and abs(abs(k[3]) - abs(g[3])) > 100
                  and (not k[4] or not g[4] or 0 <= (g[4] - k[4]).days <= 14)
                  and (k[5] is None or g[5] is None or (k[0], k[5], g[5]) in alike)
                  and 2 * abs(abs(k[3]) - abs(g[3])) <= max(abs(k[3]), abs(g[3])))
    found = P.unequal_pairs(P.Legs(None, frame(banks), frame(gls)), pairs)
    assert sorted((r["bank_id"], r["gl_id"]) for r in found.select("bank_id", "gl_id").collect()) == want
    wide = (dt.date(2026, 1, 1), dt.date(2026, 2, 28))
    day = spark.createDataFrame([(wide[0] + dt.timedelta(days=i),) for i in range(58)] + [(None,)], "d date")
    met = (day.select(F.col("d").alias("x"), F.explode(K.later_date_keys(F.col("d"))).alias("w"))
           .join(day.select(F.col("d").alias("y"), F.explode(K.preceding_date_keys(F.col("d"))).alias("w")), "w").groupBy("x", "y").count())
    times = {(r["x"], r["y"]): r["count"] for r in met.collect()}
    everyone = [wide[0] + dt.timedelta(days=i) for i in range(58)] + [None]
    assert all(times.get((x, y)) == 1 for x in everyone for y in everyone if not x or not y or 0 <= (y - x).days <= 14)
    assert set(times.values()) == {1}
