"""Embedding near-duplicates: codes and bounds, all pairs, awkward rows, recall of the bands."""
import math

import brute
import numpy as np
import pytest

from gridloom.llm import rotcodes

SCHEMA = "vec_id long, embedding array<float>, label int, e long, h long, rep long, n long, copies string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], schema)


def groups(seed, labels, each, dim=16):
    """Vectors around centres, some of them near copies, with exact copies and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        for _ in range(each // 4):
            c = rng.normal(size=dim)
            rows += [(0, (c + rng.normal(size=dim) * s).astype(np.float32).tolist(), label) for s in (0, .05, .3, .5)]
    rows += rows[:3] * 4
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim + 1), [1.0, 2.0], [2.0, 4.0], [-1.0, -0.0], [-1.0, 0.0], [1e-30, 2e-30]]
    rows += [(0, v, label) for v in odd for label in (1, None)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    return rows + [(None, rows[0][1], 0), (None, None, 1), rows[0]]


def got(out):
    return sorted(map(repr, ((r.vec_id, r.n_links, r.component_id) for r in out.collect())))


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(400, 48))
    b = a + rng.normal(size=a.shape) * rng.uniform(0, 2, (400, 1))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    code, f = rotcodes.codes_of(b)
    true, est = a @ b.T, rotcodes.estimates(rotcodes.rotated(a, 0), code, f)
    assert abs((est - true).mean()) < 0.005 and (est - true).std() < 0.15
    g = np.sqrt(1 - f ** 2) / f
    assert (np.abs(est - true) <= g * np.sqrt(1 - true ** 2) + 1e-4).all()
    turned = rotcodes.rotated(a, 3)
    assert np.allclose(turned @ turned.T, a @ a.T, atol=1e-5)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_are_those_of_all_pairs(spark, block):
    rows = groups(1, 3, 60)
    out = rotcodes.near_vectors(frame(spark, rows), block=block)
    assert got(out) == sorted(map(repr, brute.cosine_links(rows)))


def test_doubles_beyond_single_precision_and_confidence_bounds(spark):
    rows = [(i, [x * (1e200 if i % 3 else 1e-200) for x in v], label) for i, v, label in groups(2, 2, 40) if i is not None and v and len(v) == 16 and None not in v and all(map(math.isfinite, v))]
    flat = [(i, [x / (1e200 if i % 3 else 1e-200) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = sorted(map(repr, brute.cosine_links(flat)))
    assert got(rotcodes.near_vectors(df)) == want
    assert got(rotcodes.near_vectors(df, deviations=5.0, least=0.93)) == want


def test_bands_find_the_links_of_a_large_group(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 64))
    near = base[:150] + rng.normal(size=(150, 64)) * 0.36  # cosines around the limit
    dense = rng.normal(size=64) + rng.normal(size=(120, 64)) * 0.05  # a group of near copies
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(np.concatenate([base, near, dense]))]
    want = {r[0]: r for r in brute.cosine_links(rows)}
    out = {r.vec_id: r for r in rotcodes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), bucket=32, block=20).collect()}
    found, all_ = sum(r.n_links for r in out.values()), sum(r[1] for r in want.values())
    assert all(out[k].n_links <= want[k][1] for k in want)  # none below the limit, none twice
    assert found >= 0.99 * all_ and all_ > 120 * 119


def test_few_pairs_are_recomputed():
    rng = np.random.default_rng(3)
    def block(n):
        b = rotcodes._Block.__new__(rotcodes._Block)
        b.vec = rng.normal(size=(n, 64))
        b.norm = np.linalg.norm(b.vec, axis=1)
        b.code, b.f = rotcodes.codes_of(b.vec / b.norm[:, None])
        b.e = b.copies = np.arange(n)
        return b
    _, exact = rotcodes.near_pairs(block(1000), block(1000), 0.93, None, False)
    assert exact < 1000  # of a million


def test_empty_table(spark):
    assert rotcodes.near_vectors(frame(spark, [])).count() == 0
    alone = rotcodes.near_vectors(frame(spark, [(4, None, None)])).collect()
    assert [tuple(r) for r in alone] == [(4, 0, 4)]
