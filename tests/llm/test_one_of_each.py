"""Which row of a group of near-duplicates stays, also where ids and rows repeat."""

import random

import pytest

from brindle.llm import minhash
from brindle.llm.minhash import shingles, similar

DOCS = "doc_id long, text string, digest string, found long, chosen long"
WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "lnrst"]


def text(seed, n=40):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def kept(spark, rows):
    return sorted(((r["doc_id"], r["text"]) for r in minhash.one_of_each(spark.createDataFrame([(*r, "x", 0, 0) for r in rows], DOCS)).collect()), key=repr)


def test_repeated_ids_and_rows(spark):
    a, b, c = text(1), text(2), text(3)
    assert kept(spark, [(1, a), (5, a), (5, b), (7, c), (7, c)]) == sorted([(1, a), (5, b), (7, c)], key=repr)
    # one id, two texts that aren't alike: both stay
    assert kept(spark, [(5, a), (5, b)]) == sorted([(5, a), (5, b)], key=repr)
    # one id, two texts that are: one stays
    assert len(kept(spark, [(5, a), (5, a + " end")])) == 1


def test_rows_that_are_no_nodes_stay(spark):
    a = text(4)
    rows = [(1, None), (1, None), (2, ""), (3, " \n"), (None, a), (None, a), (4, a), (4, a)]
    assert kept(spark, rows) == sorted([*rows[:6], (4, a)], key=repr)
    assert kept(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for g in range(12):
        words = text(100 * seed + g, rng.choice([3, 12, 60])).split()
        for _ in range(rng.randrange(1, 6)):
            own = list(words)
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            texts.append(" ".join(own))
    rows = [(rng.randrange(15), rng.choice(texts)) for _ in range(90)]
    every = sorted(set(rows))
    sets = {t: shingles(t) for _, t in every}
    group = {t: t for _, t in every}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for x in sets:
        for y in sets:
            if similar(sets[x], sets[y], 80):
                group[root(x)] = root(y)
    got = kept(spark, rows)
    assert sorted(root(t) for _, t in got) == sorted({root(t) for t in group})  # one row of each group
    for doc_id, t in got:
        assert doc_id == min(i for i, other in every if root(other) == root(t))
