"""The similarity join and components against brute force."""

import random
import tracemalloc

import pyarrow as pa

from panelwise.llm import ngram_join as nj
from panelwise.llm.components import components
from panelwise.llm.shingles import shingle_sets


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return sorted((i, len(sets[i]), root[i]) for i in ids)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and at < len(w):
                w[at] = f"n{rng.randrange(10 ** 6)}"
            else:
                w.insert(at, f"n{rng.randrange(10 ** 6)}")
        rows.append((i, "  ".join(w).replace("v1", "V1")))
    common = " ".join(f"p{i}" for i in range(60))
    rows += [(300 + i, common + f" q{i} r{i} s{i} t{i} u{i} " + " ".join(f"z{i}y{j}" for j in range(i))) for i in range(40)]
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, "ONE"), (405, "One two"), (400, None), (406, "w " * 30000)]


def run(spark, rows, *args):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, n int")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, *args).collect())


def test_join_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows + [(None, "one")], 4, 85, 100) == brute(rows, 4, 85, 100)
    rows = corpus(2)
    assert run(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_join_of_empty_table_and_repeated_ids(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, "a b c d e"), (3, "a b c d e"), (5, "other"), (5, "other")]) == [(3, 2, 3), (5, 1, 5), (5, 2, 3)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 + i, 901 + i) for i in range(40)] + [(700, x) for x in range(600, 650)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])


def test_shingle_hashes():
    texts = [b"a b c", b"A  b\nc d", None, b"", b"x", b"a b c d a b c", b"\xc3\xa9 b c d", b"y" * 3_000_000 + b" z"]
    for t, s in zip(texts, shingle_sets(texts, 3)):
        assert len(s) == len(shingles((t or b"").decode(), 3)) and (s[1:] > s[:-1]).all()
    a, b = shingle_sets([b"q a b c", b"a b c"], 3)
    assert b[0] in a


def test_shingles_of_a_large_batch_take_little_memory():
    texts = [" ".join(f"w{(i * j) % 9973}" for j in range(1, 401)) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        assert sum(len(s) > 0 for s in nj._sets(batch, "text", 4)) == 4000
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 36e6, most
