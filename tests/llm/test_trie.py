"""Prefix trie against a plain recursive build, on small and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest

from panelwise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members}

    def total(p):
        saved = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        leaves = 0 if kids[p] else 1
        for q in kids[p]:
            n, s = total(q)
            leaves, saved = leaves + n, saved + s
        return leaves, saved

    out = set()
    for p, m in members.items():
        leaves, saved = total(p)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                 "ends_sha256")) for r in df.collect()}


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["a b", "a  b c", "", None, "A b", "x\ty\nz", "ä ö"]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "bot", None]), rng.choice(texts[:4 if c < 60 else 7]))
            for c in range(-3, 90) if c % 7 for t in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(41, t, "user", f"long {t % 3}") for t in range(70)] + rows[:5] + [(None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS node", "2 AS depth")
    got = prefix_trie.trie(df)
    assert rows_of(got) == plain(rows)
    assert got.count() == len(plain(rows))


@pytest.mark.parametrize("rows", [[], [(7, 0, "u", "x")], [(c, 0, None, None) for c in range(25)]])
def test_few_rows(spark, rows):
    """No rows, a turnless conversation (its only turn is replaced by a missing base), and many equal ones."""
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == (plain(rows) if rows else set())
