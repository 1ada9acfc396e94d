"""Groups of near copies: components equal those of all pairs, and work grows with the members, not with their pairs."""

import random

import pytest

from panelwise.llm import bottom_k, copies
from panelwise.llm.components import components


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def plain(sets, num, den):
    n = len(sets)
    return union_find(n, [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j])])


def found(spark, sets, num, den, few=copies.FEW):
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "cls bigint, items array<bigint>").repartition(4)
    sure, asked = copies.links(rows.selectExpr("1L AS g", "cls"), rows, num, den, few)
    sure = [tuple(r) for r in sure.collect()]
    asked = {tuple(r) for r in asked.collect()}
    assert all(len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b]) for a, b in sure)
    proven = [(a, b) for a, b in asked if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])]
    return union_find(len(sets), sure + proven), len(sure), len(asked)


def families(rng, templates, members, size, edits):
    """Sets of windows over numbered words: copies of templates with some words replaced."""
    out = []
    for t in range(templates):
        base = [(t, i) for i in range(size)]
        for m in range(members):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(size)] = (t, m, rng.random())
            out.append({hash(tuple(w[i:i + 4])) for i in range(size - 3)})
    return out


@pytest.mark.parametrize("seed,templates,members,size,edits,num,few", [
    (1, 1, 200, 60, 1, 85, 16), (2, 1, 250, 60, 4, 80, 4), (3, 5, 60, 40, 3, 80, 2), (4, 30, 8, 30, 2, 80, 16), (5, 2, 150, 90, 6, 80, 1)])
def test_components_equal_all_pairs(spark, seed, templates, members, size, edits, num, few):
    sets = families(random.Random(seed), templates, members, size, edits)
    assert found(spark, sets, num, 100, few)[0] == plain(sets, num, 100)


def one_word_changed(n):
    """Each with one other word, and the template itself is not there."""
    rng = random.Random(n)
    out = []
    for m in range(n):
        w = list(range(90))
        w[rng.randrange(90)] = 1000 + m
        out.append({hash(tuple(w[i:i + 5])) for i in range(86)})
    return out


def test_work_grows_with_members(spark):
    work = [sum(found(spark, one_word_changed(n), 80, 100)[1:]) for n in (300, 1200)]
    assert work[1] <= 5 * work[0] and work[1] <= 20 * 1200


def test_same_when_everything_differs_alike(spark):
    """Members with many scattered changes, none linked: no pair is listed."""
    rng = random.Random(8)
    sets = []
    for m in range(400):
        w = list(range(120))
        for i in rng.sample(range(120), 12):
            w[i] = 1000 + 200 * m + i
        sets.append({hash(tuple(w[i:i + 4])) for i in range(117)})
    labels, sure, asked = found(spark, sets, 80, 100)
    assert labels == plain(sets, 80, 100) and asked < 2000


def test_unlike_members_do_not_come_again(spark, monkeypatch):
    """Families that share a passage, and the passage alone: its large slack doesn't bring the families' members into more rounds."""
    rng = random.Random(10)
    passage = set(range(10))
    sets = [passage]
    for t in range(6):
        for m in range(40):
            gone = set(rng.sample(range(60), 8 if m else 4))
            sets.append(passage | {1000 * t + 100 + i for i in range(60) if i not in gone} | {100_000 + 1000 * t + 20 * m + i for i in range(len(gone))})
    sets += [s - {min(s - passage)} for s in sets[1:200:40]]
    seen, plainly = [], copies._differences
    monkeypatch.setattr(copies, "_differences", lambda members, rows: seen.append(members.count()) or plainly(members, rows))
    assert found(spark, sets, 80, 100)[0] == plain(sets, 80, 100)
    assert seen[0] == len(sets) and sum(seen[1:]) <= len(sets)


def test_common_elements_are_not_looked_up(spark):
    """Only elements that few of a large group hold are joined one by one; what most hold stays in the reference row."""
    rng = random.Random(9)
    sets = [set(range(200)) - {rng.randrange(200)} | {1000 + m // 2, 5000 + m} for m in range(120)]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "cls bigint, items array<bigint>").repartition(4)
    groups = rows.selectExpr("1L AS g", "cls")
    refs, rarer = copies._shared(groups, rows)
    assert sorted(refs.first().e) == list(range(200)) and {r.e for r in rarer.collect()} == set(range(1000, 1060))
    for r in copies._differences(groups, rows).collect():
        lacking = set(range(200)) - sets[r["cls"]]
        wanted = {1000 + r["cls"] // 2} | {x for x in lacking if sum(x not in s for s in sets) > 1}
        assert (r["n"], r["d"]) == (201, 3) and set(r["diff"]) == wanted
    assert found(spark, sets, 98, 100)[0] == plain(sets, 98, 100)


def texts(rng):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(120):
        base = rng.choices(words, k=rng.choice([3, 10, 60, 200]))
        for c in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(4) * len(w) // 80):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(w).upper() if c % 2 else "\t".join(w)))
    family = rng.choices(words, k=80)
    for m in range(90):
        w = list(family)
        for _ in range(m % 4):
            w[rng.randrange(80)] = f"x{m}"
        rows.append((len(rows) * 3, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "ONE"), (None, "one"), rows[0], rows[-1],
             (rows[1][0], "another text of this id"), (6000, "long " * 30000), (6001, " ".join(map(str, range(30000))))]
    return rows


def test_bottom_k_equals_brute_force(spark):
    rows = texts(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cls", "3 AS value", "4 AS g").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in bottom_k.near_duplicates(df).collect())
    seen = sorted(set((d, t) for d, t in rows if d is not None), key=lambda x: (x[0], x[1] or ""))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [shingles(t) for _, t in seen]
    filled = [i for i, s in enumerate(sets) if s]
    labels = plain([sets[i] for i in filled], 80, 100)
    least = {}
    for i, c in zip(filled, labels):
        least[c] = min(least.get(c, 1 << 60), seen[i][0])
    component = {i: least[c] for i, c in zip(filled, labels)}
    assert got == sorted((d, len(sets[i]), component.get(i, d)) for i, (d, _) in enumerate(seen))


def test_bottom_k_empty(spark):
    assert bottom_k.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_common():
    assert bottom_k.least_common(64, 80, 100) in range(28, 36) and bottom_k.least_common(64, 1, 1) == 64


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_elements_of_one_member_alone_are_not_looked_up(spark, monkeypatch):
    rng, tables, real = random.Random(6), [], copies.stored
    sets = [set(range(200)) | {rng.randrange(-1 << 62, 1 << 62) for _ in range(30)} for _ in range(100)]
    sets[0].add(-77)
    sets[1].add(-77)
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "cls bigint, items array<bigint>")
    monkeypatch.setattr(copies, "stored", lambda df: tables.append(real(df)) or tables[-1])
    out = {r["cls"]: r for r in copies._differences(rows.selectExpr("1L AS g", "cls"), rows).collect()}
    assert {c: r["diff"] for c, r in out.items() if r["diff"]} == {0: [-77], 1: [-77]}
    assert {c: r["d"] for c, r in out.items()} == {c: len(s) - 200 for c, s in enumerate(sets)}
    looked_up = next(t for t in tables if "rare" in t.columns).selectExpr("sum(size(rare))").first()[0]
    assert 2 <= looked_up < 20  # 3,002 elements are in the reference of none


def test_later_rounds_look_through_differences_only(spark, monkeypatch):
    """One family without a template, few words changed in each: lists with many left over don't unfold whole sets again."""
    rng, sets = random.Random(11), []
    for m in range(200):
        w = list(range(60))
        for i in rng.sample(range(60), 2 + m % 2):
            w[i] = 1000 * (m // 2) + 100 + i
        sets.append({hash(tuple(w[i:i + 4])) for i in range(57)})
    sizes, plainly = [], copies._differences

    def counted(members, rows):
        both = members.join(rows, [c for c in members.columns if c in rows.columns])
        sizes.append(tuple(both.selectExpr("count(1)", "sum(size(items))").first()))
        return plainly(members, rows)

    monkeypatch.setattr(copies, "_differences", counted)
    assert found(spark, sets, 80, 100, 2)[0] == plain(sets, 80, 100)
    again, elements = (sum(x[i] for x in sizes[1:]) for i in (0, 1))
    assert again > len(sets) and 2 * elements < 57 * again, sizes
