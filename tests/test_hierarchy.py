import random

import pytest

from actloom.operators.hierarchy import descendants, hierarchy


def by_hand(parents):
    parents = {k: (v if v in parents else None) for k, v in parents.items()}
    out, below = {}, dict.fromkeys(parents, 0)
    for k in parents:
        seen, x = [], k
        while x is not None and x not in seen:
            seen.append(x)
            x = parents[x]
        for a in seen[1:]:
            below[a] += 1
        if x is None:
            out[k] = (seen[-1], len(seen) - 1, False, True, seen[::-1])
        else:
            loop = seen[seen.index(x) :]
            out[k] = (min(loop), None, k in loop, False, None)
    return out, below


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rnd = random.Random(seed)
    parents = {}
    for i in range(150):
        r = rnd.random()
        parents[f"n{i:03}"] = None if r < 0.04 or i == 0 else f"n{rnd.randrange(max(0, i - 2), i):03}" if r < 0.8 else f"n{rnd.randrange(150):03}" if r < 0.97 else f"gone{i}"
    parents["n007"] = "n007"
    rows = list(parents.items())
    found = hierarchy(spark.createDataFrame(rows + rows[:9] + [(None, "n001")], "id string, parent string"), "id", "parent", paths=True)
    expected, below = by_hand(parents)
    got = {r["id"]: r for r in found.collect()}
    assert set(got) == set(parents)
    for k, (root, depth, on_loop, has_root, path) in expected.items():
        r = got[k]
        assert (r["root_id"], r["depth"], r["on_loop"], r["has_root"], r["path"]) == (root, depth, on_loop, has_root, path), k
        if has_root:
            assert r["n_descendants"] == below[k]


def test_one_parent_of_most_nodes_and_a_long_chain(spark):
    rows = [("hub", None)] + [(f"leaf{i}", "hub") for i in range(400)] + [("c0", "hub")] + [(f"c{i}", f"c{i - 1}") for i in range(1, 60)]
    got = {r["id"]: r for r in hierarchy(spark.createDataFrame(rows, "id string, parent string"), "id", "parent").collect()}
    assert got["hub"]["n_descendants"] == 460 and got["c59"]["depth"] == 60 and got["c10"]["n_descendants"] == 49


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "id string, parent string"), "id", "parent").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_descendants_of_trees_and_loops(spark, seed):
    rnd = random.Random(seed)
    parents = {f"n{i:02}": f"n{rnd.randrange(80):02}" if rnd.random() < 0.93 else None for i in range(80)}
    parents |= {f"l{i}": f"l{(i + 1) % 5}" for i in range(5)} | {"t1": "l3", "t2": "t1", "s": "s", "u": "s", "o": "gone"}
    expected = set()
    for k in parents:
        seen, x = [k], parents[k]
        while x in parents and x not in seen:
            expected.add((x, k, len(seen)))
            seen.append(x)
            x = parents[x]
    got = descendants(spark.createDataFrame(list(parents.items()) + [("s", "s"), (None, "s")], "id string, parent string"), "id", "parent").collect()
    assert len(got) == len(expected) and {(r["ancestor_id"], r["id"], r["steps"]) for r in got} == expected
    assert {("l0", "l3", 2), ("l3", "l0", 3), ("l2", "t2", 6), ("s", "u", 1)} <= expected
