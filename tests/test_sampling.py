"""Sampling lattices on 2 x 2 sites against the dense state."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import peps
from loomframe.operators.sampling import SamplingLattice, finite_differences
from loomframe.plans import models


def vector(lattice):
    sites = sorted(lattice.tensors)
    out = np.zeros([lattice.tensors[s].shape[4] for s in sites])
    for c in itertools.product(*(range(n) for n in out.shape)):
        out[c] = peps.amplitude(lattice.tensors, lattice.shape, dict(zip(sites, c)), 100)
    return out


def test_amplitude_is_the_contraction():
    lattice = SamplingLattice.create(models.heisenberg(2, 2), 3, seed=1)
    a, b, c, d = (lattice.tensors[s] for s in sorted(lattice.tensors))
    want = np.einsum("LUrdp,rVWeq,MdsDx,seXEy->pqxy", a, b, c, d)
    assert np.allclose(vector(lattice), want)


def test_holes_are_derivatives():
    lattice = SamplingLattice.create(models.heisenberg(2, 3), 2, seed=2)
    c = {s: int(sum(s) % 2) for s in lattice.tensors}
    h = peps.holes(lattice.tensors, lattice.shape, c, 50)
    for s in lattice.tensors:
        for at in ((0,) * 4 + (c[s],), (0,) * 4 + (1 - c[s],)):
            keep = lattice.tensors[s][at]
            lattice.tensors[s][at] = keep + 1
            up = peps.amplitude(lattice.tensors, lattice.shape, c, 50)
            lattice.tensors[s][at] = keep
            assert h[s][at] == pytest.approx(up - peps.amplitude(lattice.tensors, lattice.shape, c, 50), abs=1e-9)


def test_direct_sampler_gives_the_distribution():
    lattice = SamplingLattice.create(models.heisenberg(2, 2), 2, seed=3)
    v = vector(lattice) ** 2
    v /= v.sum()
    sampler, rng = peps.DirectSampler(lattice.tensors, lattice.shape, 100), np.random.default_rng(0)
    for _ in range(10):
        p, c = sampler.draw(rng)
        assert p == pytest.approx(v[tuple(c[s] for s in sorted(c))])


def test_energies_and_gradients(spark):
    state = models.heisenberg(2, 2)
    lattice = SamplingLattice.create(state, 2, seed=4)
    v, h = vector(lattice).ravel(), state.matrix()
    exact = v @ h @ v / (v @ v) / 4
    rows = lattice.observe(spark, "ergodic", 3, 0)
    assert rows.count() == 16 and lattice.energy(rows)[0] == pytest.approx(exact)
    g = lattice.gradient(rows)
    for i, s in ((0, (0, 0)), (1, (0, 0))):
        keep = lattice.tensors[s].copy()
        energy = []
        for e in (1e-5, -1e-5):
            lattice.tensors[s] = keep.copy()
            lattice.tensors[s].ravel()[i] += e
            w = vector(lattice).ravel()
            energy.append(w @ h @ w / (w @ w))
        lattice.tensors[s] = keep
        assert g[i] == pytest.approx((energy[0] - energy[1]) / 2e-5, rel=1e-4, abs=1e-7)
    direct = lattice.energy(lattice.observe(spark, "direct", 2, 150, seed=1, deltas=False))
    assert abs(direct[0] - exact) < 5 * direct[1] + 1e-9
    found = [e for e, _ in lattice.descend(spark, 3, 0.1, "ergodic", 2, relative=True)]
    assert found[-1] < found[0]
    assert lattice.natural_gradient(lattice.observe(spark, "ergodic", 2, 0), 3).shape == g.shape


def test_conversions_and_measurements(spark):
    from loomframe.operators import conversion, exact
    from loomframe.plans import plugins
    from loomframe.plans.shell import Shell

    state = models.heisenberg(2, 2)
    lattice = SamplingLattice.create(state, 2, cut=64, seed=5)
    v = vector(lattice)
    t = conversion.exact_from_sampling(spark, lattice)
    assert np.allclose([r["re"] for r in t.df.orderBy(*t.keys).collect()], v.ravel())
    back = conversion.sampling_from_simple(conversion.simple_from_sampling(spark, lattice), 64)
    assert np.allclose(vector(back), v)
    pairs = conversion.squash(lattice)
    assert np.allclose(np.abs(vector(conversion.unsquash(pairs, lattice, 64))), np.abs(v))
    rows = lattice.observe(spark, "ergodic", 2, 0, deltas=False)
    found = {r["term"]: r["expect"] for r in plugins.measure(spark, lattice, rows, "bond_energy").collect()}
    assert len(found) == 5 and found["whole"] / 4 == pytest.approx(exact.inner(t, state.apply(spark, t)) / exact.inner(t, t) / 4)
    keep = v.copy()
    conversion.expand_dimension(lattice, 3, 0.0)
    assert lattice.tensors[0, 0].shape == (1, 1, 3, 3, 2) and np.allclose(vector(lattice), keep)
    out = Shell(spark).run("seed 2\ngm_create heisenberg 1 2 D=2\ngm_conf_create neel\ngm_run 4 2 0.1 sampling=ergodic restrict=balanced relative=True\ngm_to_ex\nex_energy")
    assert len(out[3]) == 2 and out[5] < 0.1


def test_amplitudes_by_changed_rows():
    """The rows that change, between lines that are kept, give the amplitude of the whole contraction."""
    rng = np.random.default_rng(8)
    lattice = SamplingLattice.create(models.find("heisenberg")(3, 3), 2, 64, 3)
    c = {s: int(rng.integers(2)) for s in lattice.tensors}
    here = peps.Surroundings(lattice.tensors, (3, 3), c, 64)
    for _ in range(12):
        change = {s: int(rng.integers(2)) for s in list(lattice.tensors)[:: int(rng.integers(2, 9))]}
        want = peps.amplitude(lattice.tensors, (3, 3), here.c | change, 64)
        assert np.isclose(here.amplitude(change), want)
        here = here.changed(change)
        assert np.isclose(here.amplitude(), want)


def test_gradient_by_finite_differences(spark):
    lattice = SamplingLattice.create(models.find("heisenberg")(2, 2), 2, 16, 5)
    rows = lattice.observe(spark, "ergodic", 2, 0)
    cells = rows.select("r", "e", F.explode(F.arrays_zip("parameter", "delta")).alias("z")).select("r", "e", F.col("z.parameter").alias("p"), F.col("z.delta").alias("d"))
    # Samples in which a parameter has no part count with a derivative of zero.
    sums = rows.agg(F.sum("r").alias("r"), F.sum(F.col("r") * F.col("e")).alias("re")).first()
    own = {r["p"]: r for r in cells.groupBy("p").agg(F.sum(F.col("r") * F.col("d")).alias("rd"), F.sum(F.col("r") * F.col("e") * F.col("d")).alias("red")).collect()}
    some = sorted(own)[:3]
    got = finite_differences(spark, lattice, some)
    for p in some:
        want = 2 * (own[p]["red"] / sums["r"] - sums["re"] / sums["r"] * own[p]["rd"] / sums["r"])
        assert np.isclose(got[p], want, atol=1e-5)
    assert lattice.observe(spark, "sweep", 2, 3, deltas=False, equilibrate=2).count() == 6
