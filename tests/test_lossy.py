"""Adaptive predictors and lossy tools: inverses, energies and convergence."""

import numpy as np

from lagweave.functions import adaptive, kernels, lossy


def test_cascade_restores_and_predicts():
    t = np.arange(600)
    x = (4000 * np.sin(t / 5) + 1500 * np.sin(t / 17) + np.random.default_rng(1).normal(0, 20, 600)).astype(np.int64)
    r = adaptive.residual(x)
    assert (adaptive.restore(r) == x).all()
    assert np.abs(r[200:]).mean() < 0.1 * np.abs(np.diff(x)[200:]).mean()


def test_shaping_in_time_is_undone():
    rng = np.random.default_rng(2)
    burst = np.zeros(512)
    burst[300:320] = rng.normal(0, 100, 20)
    c = kernels.mdct(burst)
    found = lossy.shape_in_time(c)
    assert found is not None
    filtered, index = found
    assert filtered @ filtered < 0.7 * (c @ c)
    assert np.allclose(lossy.unshape_in_time(filtered, index), c)
    assert lossy.shape_in_time(rng.normal(size=256)) is None


def test_reflection_grid():
    k = np.linspace(-0.99, 0.99, 50)
    assert np.abs(lossy.reflection_value(lossy.reflection_index(k)) - k).max() < 0.12


def test_intensity_keeps_energies():
    m = np.random.default_rng(3).normal(size=64)
    mid, position = lossy.intensity(0.9 * m, 0.3 * m)
    left, right = lossy.from_intensity(mid, position)
    assert abs(10 * np.log10((left @ left) / (0.81 * m @ m))) < 0.8 and abs(10 * np.log10((right @ right) / (0.09 * m @ m))) < 0.8
    assert lossy.intensity(m, np.random.default_rng(4).normal(size=64)) is None


def test_noise_and_replication_have_the_energy():
    v = lossy.noise_band(3, 1, 7, 100, 42.0)
    assert np.isclose(v @ v, 42) and (v == lossy.noise_band(3, 1, 7, 100, 42.0)).all() and (v != lossy.noise_band(4, 1, 7, 100, 42.0)).any()
    c = np.random.default_rng(5).normal(size=64)
    c[32:] = 0
    out = lossy.replicate(c, 32, np.array([1.0, 1.0, 5.0, 9.0]), np.array([0, 16, 32, 48, 64]))
    assert (out[:32] == c[:32]).all() and np.isclose(out[32:48] @ out[32:48], 5) and np.isclose(out[48:] @ out[48:], 9)


def test_rate_search_meets_the_goal():
    calls = []

    def size(scale):
        calls.append(scale)
        return 1000 / (1 + scale) ** 0.7 + 3

    got = lossy.rate_search(size, 100)
    assert abs(size(got) / 100 - 1) < 0.01 and len(calls) < 24
    assert lossy.rate_search(size, 5000) == 1e-3
