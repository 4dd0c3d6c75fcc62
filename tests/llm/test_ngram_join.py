"""N-gram join against all pairs."""
import random
import re

import numpy as np
import pytest

from gatherlens.llm import ngram_join as J
from tests.llm import brute as B


def check(df, texts, ids):
    got = {}
    for r in J.join_groups(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    sets = [B.shingles(t) for t in texts]
    root = B.groups(sets)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    for i, d in enumerate(ids):
        want = (len(sets[i]), least[root[i]])
        assert want in [(r["n_shingles"], r["component_id"]) for r in got[d]], (d, texts[i][:60] if texts[i] else None)
    assert sum(map(len, got.values())) == len(texts)


def test_components_equal_all_pairs(spark, documents):
    base = [f"t{i}" for i in range(60)]
    core = [f"c{i}" for i in range(40)]
    texts = B.near_copies(1) + B.EDGES + B.EDGES[3:8] + ["same text of more than five words"] * 30
    # A chain: neighbours link, its ends do not.
    texts += [" ".join(base[:k] + [f"u{i}" for i in range(k, 60)]) for k in range(30, 61)]
    # Two dense groups that share prefix shingles without links between them.
    texts += [" ".join(core + [f"a{i}" for i in range(30)] + [f"x{k}"]) for k in range(15)]
    texts += [" ".join(core + [f"b{i}" for i in range(30)] + [f"y{k}"]) for k in range(15)]
    ids = [int(i) * 7 for i in np.random.RandomState(1).permutation(len(texts))]
    check(documents(texts, ids), texts, ids)


def test_bound_never_rules_out_a_link():
    rng = random.Random(4)
    bound = re.sub(r"coalesce\((.*), true\)", r"\1", J.NEAR).replace("least", "min")
    seen = 0
    for _ in range(4000):
        n = rng.randrange(5, 60)
        hub = set(range(n))
        sets = [{t for t in hub if rng.random() > 0.12} | {rng.randrange(100, 110) for _ in range(rng.randrange(4))} | {f"{k}"}
                for k in range(2)]
        x, y = sets
        if 100 * len(x & y) >= 80 * len(x | y):
            seen += 1
            alone = [len([t for t in s if t not in hub and t not in o]) for s, o in ((x, y), (y, x))]
            assert eval(bound, {}, {"differ": len(x ^ hub), "alone": alone[0], "x_differ": len(y ^ hub), "x_alone": alone[1],
                                    "n": len(x), "x_n": len(y), "min": min})
    assert seen > 100


def test_repeated_rows_null_ids_and_empty_tables(spark, documents):
    df = spark.createDataFrame([(None, "some words that are the same here"), (4, "some words that are the same here"),
                                (4, "some words that are the same here"), (None, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["n_copies"]) for r in J.join_groups(df).collect()), key=str)
    assert rows == [(4, 4, 3), (4, 4, 3), (None, 4, 3), (None, None, 1)]
    assert J.join_groups(documents(["x"]).limit(0)).count() == 0


def test_components_of_long_paths(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (5000, 5000)], "a long, b long")
    got = {r["sid"]: r["label"] for r in J.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_blocks_pack_and_unpack():
    rng = np.random.RandomState(0)
    codes = np.sort(rng.randint(0, 1 << 62, 1000).astype(np.uint64))
    sids = rng.randint(-5, 5, 1000)
    a, b = J.unpack(*J.pack(codes, sids))
    assert (a == codes).all() and (b == sids).all()


@pytest.mark.parametrize("block_sets,block_shingles", [(J.BLOCK_SETS, J.BLOCK_SHINGLES), (4, 1 << 18), (256, 300)])
def test_all_links_are_counted(spark, documents, monkeypatch, block_sets, block_shingles):
    monkeypatch.setattr(J, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", block_shingles)
    base = [f"t{i}" for i in range(60)]
    texts = B.near_copies(1) + B.EDGES + ["same text of more than five words"] * 9
    texts += [" ".join(base[:k] + [f"u{i}" for i in range(k, 60)]) for k in range(30, 61)] * 2
    texts += [" ".join(f"g{i}" for i in range(k)) for k in range(40, 90)]
    sets = [B.shingles(t) for t in texts]
    want = [sum(100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets) if y and j != i) if x else 0 for i, x in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in J.join_groups(documents(texts), n_links=True).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_only_paired_sets_are_sent(spark, documents, monkeypatch):
    """The sets' table is cut to the sets in pairs before either join moves it."""
    plans, staged = [], J.staged

    def noted(df, name):
        if name in ("pivot-links", "across-links"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, name)
    monkeypatch.setattr(J, "staged", noted)
    texts = B.near_copies(1)
    check(documents(texts, list(range(len(texts)))), texts, list(range(len(texts))))
    assert len(plans) > 1 and all(p.count("LeftSemi") == 2 for p in plans)
