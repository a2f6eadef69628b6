"""Collocations against brute force: ties, repeated rows, nulls, empty tables, ranks beyond the head, tiles and coordinates that overflow."""

import random
import re
from collections import Counter, defaultdict

import pytest

from querytide.llm import collocations

LETTERS = {c: c + 32 for c in range(65, 91)}


def rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(8)] + ["The", "THE", "don't", "naïve", "日本", "x y"]
    fixed = ["new york city hall", "alpha beta", "Beta GAMMA delta", "one two three four five"]
    out = [(0, None, "en"), (1, "", "en"), (2, " \t\n", None), (3, "the the the the the " * 20, "en"), (4, "a,a.a;a:a!a?a\x0ba\x0ca\ra\na", "de")]
    for i in range(5, 700):
        parts = [rng.choice(words[: rng.choice([3, 14])]) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(1, 90))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "! "]) for p in parts)
        out.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return out + out[20:24] * 9


def by_hand(data, least=30, longest=4, first=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in data:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LETTERS)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        known = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in known.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items())
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def found(spark, data, **settings):
    df = spark.createDataFrame([(*r, 1, "z", 3) for r in data], "doc_id long, text string, lang string, f int, phrase string, code int").repartition(5)
    return sorted(tuple(r) for r in collocations.first_collocations(df, **settings).collect())


def test_equals_brute_force(spark):
    data = rows()
    want = by_hand(data)
    assert len(want) > 80 and {r[0] for r in want} == {"en", "de", "und"}
    assert found(spark, data) == want
    assert found(spark, data, first=3) == by_hand(data, first=3)


@pytest.mark.parametrize("head", [1, 7, 30])
def test_beyond_the_head(spark, monkeypatch, head):
    """Whatever part of the phrases has ranks, the counts are the same."""
    monkeypatch.setattr(collocations, "HEAD", head)
    assert found(spark, rows()) == by_hand(rows())


def test_tiles_and_coordinates(spark):
    """Dense and sparse tiles, and what is sent on early."""
    import numpy as np

    rng = np.random.default_rng(2)
    old = collocations.DENSE, collocations.HELD_TILES, collocations.HELD_PAIRS
    try:
        collocations.DENSE, collocations.HELD_TILES, collocations.HELD_PAIRS = 50, 3, 400
        counts, want, got = collocations.TileCounts(), Counter(), Counter()
        for _ in range(30):
            first, last = (np.minimum(rng.geometric(0.002, 900), (1 << 20) - 1) for _ in range(2))
            want.update(zip(first.tolist(), last.tolist()))
            counts.add(first, last)
            for codes, n in counts.ready():
                got.update(dict(zip(codes.tolist(), n.tolist())))
        for codes, n in counts.ready(last=True):
            got.update(dict(zip(codes.tolist(), n.tolist())))
    finally:
        collocations.DENSE, collocations.HELD_TILES, collocations.HELD_PAIRS = old
    assert {(c >> 20, c & (1 << 20) - 1): n for c, n in got.items()} == dict(want)


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None), (2, "", "en")]) == []
    assert found(spark, [(1, "a b " * 29, "en")]) == by_hand([(1, "a b " * 29, "en")]) == []
    long = [(1, "a b c d e " * 90000, "en")]
    assert found(spark, long) == by_hand(long)
    full = [(i, "Up down", "xx") for i in range(30)]
    assert found(spark, full) == [("xx", 1, "up down", 30, 30, 30, 60, 1000000)]


def test_copies_of_the_counts_are_not_broadcast(spark):
    """Their rows are many times those that the planner sees, so they are joined by a shuffle however small they seem."""
    counts = spark.createDataFrame([("en", w, len(w.split()), f) for w, f in (("a", 90), ("b", 80), ("c", 70), ("a b", 60), ("a b c", 40))], "lang string, phrase string, words int, f long")
    kept = collocations._kept(counts)
    assert {r.phrase for r in kept.collect()} == {"a b", "a b c"}
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
