"""Hard negatives and whitening against brute force."""

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from panelkit.llm import hard_negatives, whitening
from panelkit.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score int, anchor int, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def brute_negatives(rows, every, positives=5, negatives=5):
    known = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(c is None or not np.isfinite(c) for c in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        known.append((vec_id, moved, [max(-(1 << 53), min(1 << 53, floor(256 * float(np.float32(c))))) for c in vector]))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (anchor_id, label, vector) in enumerate(known):
        if anchor_id is None or anchor_id % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(vector, other)), last(i), i, other_label) for j, (i, other_label, other) in enumerate(known) if j != k), key=lambda r: r[:2])
        for s, _, positive_id, _ in [r for r in scored if r[3] == label][:positives]:
            inside = [(i, -n) for n, _, i, l in scored if l != label and 80 * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(anchor_id, positive_id, rank, i, max(min(-s, 2**63 - 1), -(2**63)), max(min(n, 2**63 - 1), -(2**63))) for rank, (i, n) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def negatives(spark, rows, every):
    return sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every).collect()), key=repr)


def test_negatives_of_whole_table(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries()["op12_hard_negatives"](spark, small).collect()), key=repr)
    assert got == brute_negatives(rows, 100) and got


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_with_ties_nulls_and_odd_lengths(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        vector = [rng.choice([0.0, 0.25, 0.5, -0.5, 1.0, 3.0]) for _ in range(rng.choice([12, 12, 12, 3, 0, 20]))]
        rows.append((rng.choice([k, k, k, k - 1, None]), vector, rng.choice([0, 1, 1, 1, 2, 9, None])))
    rows += rows[:40] + [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 12, 1), (410, [float("inf")] * 12, 1), (-10, [1.0] * 12, 1)]
    assert negatives(spark, rows, 10) == brute_negatives(rows, 10)


def test_negatives_of_large_components(spark):
    rows = [(0, [3e38, 1.0], 1), (10, [3e38, 2.0], 1), (3, [3e38, -1.0], 2), (4, [2e38, 0.0], 2), (5, [1e6, 1e6], 1), (20, [-1e9, 2e9], 3), (6, [1e9, -3e9], 3)]
    assert negatives(spark, rows, 10) == brute_negatives(rows, 10)


def test_negatives_of_empty_tables(spark):
    assert negatives(spark, [], 100) == []
    assert negatives(spark, [(100, [1.0], 1)], 100) == []


def check_whitening(table, rows, components=16):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    whole = [(i, tuple(floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))])) for i, v in kept]
    fit = sorted({x for _, x in whole})
    n = len(fit)
    got = table.toPandas()
    if not n:
        assert not len(got)
        return got
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    mean = np.array([float(Fraction(s, n) - 1_000_000) for s in sums])
    centred = np.array(fit, np.int64) - 1_000_000 - mean
    variance = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(variance))[::-1]
    rank = int((values > 1e-9 * values[0]).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    assert len(got) == len(whole) * k
    if not k:
        return got
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    shares = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values[:k] / values.sum(), rtol=1e-9)
    # as sorted lists of rows: ids repeat
    parts = got.pivot_table(index=["vec_id", "deviation"], columns="component", values="whitened", aggfunc="first", dropna=False)
    want = {(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))): x for i, x in whole if i is not None}
    for key, line in zip(parts.index, parts.to_numpy()):
        if key in want:
            x = np.array(want[key], np.int64) - 1_000_000 - mean
            # whitened components hold the projections; their squares times the eigenvalues add up within the span
            assert (line**2 * values[:k]).sum() <= (x**2).sum() * (1 + 1e-9) + 1e-9
    found = got.dropna(subset=["vec_id"])
    for i, x in whole:
        if i is not None:
            assert sum((n * a - s) ** 2 for a, s in zip(x, sums)) in set(found[found["vec_id"] == i]["deviation"])
    return got


def test_whitening_of_whole_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = check_whitening(queries()["op13_whitening"](spark, small), rows)
    x = np.array([[floor(64 * c) for c in v] for _, v in sorted(rows)], float)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    want = centred @ axes[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    mine = got.sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 16)
    assert np.abs(mine - want * np.sign((mine * want).sum(axis=0))).max() < 1e-9


@pytest.mark.parametrize("dims", [1, 2, 5, 20])
def test_whitening_with_repeats_and_nulls(spark, dims):
    rng = random.Random(dims)
    rows = [(rng.choice([k, None]), [rng.gauss(0, 1) for _ in range(dims)], 1) for k in range(60)]
    rows += rows[:20] + [(70, None, 1), (71, [1.0, None], 1), (72, [float("nan")], 1), (73, [float("-inf")], 1), (74, [], 1), (75, [2.0], 1)]
    check_whitening(whitening.whiten(frame(spark, rows)), rows)


def test_whitening_of_little_rank(spark):
    rows = [(k, [float(k % 3), 0.0, 2.0 * (k % 3), 1.0], 1) for k in range(9)]
    check_whitening(whitening.whiten(frame(spark, rows)), rows)
    assert whitening.whiten(frame(spark, rows[:1])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [], 1)])).count() == 0


def test_whitening_of_equal_eigenvalues(spark):
    # two axes of equal variance twice over
    rows = [(k, [0.0] * d + [s * 0.5 * (1 + d // 2)] + [0.0] * (3 - d), 1) for k, (d, s) in enumerate((d, s) for d in range(4) for s in (-1, 1))]
    got = check_whitening(whitening.whiten(frame(spark, rows)), rows)
    assert got["component"].max() == 4


def test_whitening_of_large_entries(spark):
    rows = [(k, [1e30 * (k % 4), float(k)], 1) for k in range(12)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == 24 and got["deviation"].isna().any()


def test_polynomial_against_known_roots(spark):
    roots = [0, 0, 3, 3, 7, 10**12]
    base = np.array([[1, 2, 0, 1, 0, 3], [0, 1, 1, 0, 2, 0], [0, 0, 1, 5, 0, 1], [0, 0, 0, 1, 1, 0], [0, 0, 0, 0, 1, 4], [0, 0, 0, 0, 0, 1]], object)
    inverse = np.array(np.rint(np.linalg.inv(base.astype(float))), object)
    inverse = np.array([[int(v) for v in row] for row in inverse], object)
    matrix = base @ np.diag(np.array(roots, object)) @ inverse
    want = [1]
    for r in roots:
        want = [(want[k - 1] if k else 0) - r * (want[k] if k < len(want) else 0) for k in range(len(want) + 1)]
    found = whitening.characteristic_polynomial(spark, matrix)
    assert found == want
    assert [round(float(r)) for r in whitening.largest_roots(found, 9, sum(roots))] == sorted([r for r in roots if r], reverse=True)
