import random

import pytest

from lodestrand.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, n_shingles string"


def brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            for a in sets[ids[x]]:
                for b in sets[ids[y]]:
                    if a and b and 100 * len(a & b) >= percent * len(a | b):
                        u, v = sorted((find(ids[x]), find(ids[y])))
                        parent[v] = u
    return {i: find(i) for i in sets}


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, k = [], 0
    for _ in range(14):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = word()
            rows.append((k, rng.choice([" ", "\n", "\t "]).join(t)))
            k += 1
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    rows = texts(words) + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, " \n ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = near_dedup_rows(docs, words)
    want = brute(rows, words)
    assert {i: c for i, _, c, _ in got} == want
    assert all(kept == (i == c) for i, _, c, kept in got)
    assert {i: n for i, n, _, _ in got}[900] == 0 and {i: n for i, n, _, _ in got}[902] == 1


def near_dedup_rows(docs, words):
    return [tuple(r)[:4] for r in nd.near_duplicates(docs, nd.Params(words=words)).collect()]


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert {i: c for i, _, c, _ in near_dedup_rows(docs, 2)} == brute(rows, 2)


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "x"), (2, "a b c", None)], SCHEMA)
    got = sorted(near_dedup_rows(docs, 2), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)
    assert near_dedup_rows(docs.filter("doc_id = 77"), 2) == []


@pytest.mark.parametrize("words", [2, 5])
def test_clusters_in_small_blocks(spark, words):
    rows = texts(words + 20)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    tight = nd.Params(words=words, pivots=1, block=2, stream=3, salts=2)
    assert {r[0]: r[2] for r in nd.near_duplicates(docs, tight).collect()} == brute(rows, words)


def test_chains_of_texts_that_do_not_link(spark):
    rng = random.Random(8)
    common = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 90, 9)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = nd.near_duplicates(docs, nd.Params(words=2, pivots=4, block=5, stream=20)).collect()
    assert {r[0]: r[2] for r in got} == brute(rows, 2)
