"""Array kernels against direct definitions, coders by round trips."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lagweave.functions import kernels as k
from lagweave.functions import rangecoder as rc
from lagweave.operators import lossless as ll


def test_mdct_is_the_direct_sum():
    rng = np.random.default_rng(7)
    x, n = rng.uniform(-0.5, 0.5, 64), 64
    w, m = k.kaiser_window(n), n // 2
    direct = [np.sqrt(4 / n) * sum(w[t] * x[t] * np.cos(np.pi / m * (t + 0.5 + m / 2) * (c + 0.5)) for t in range(n)) for c in range(m)]
    assert np.allclose(k.mdct(x), direct)


def overlapped(x, shapes, n):
    out = np.zeros(len(x))
    for i, w in enumerate(shapes):
        out[i * n // 2 : i * n // 2 + n] += k.inverse_mdct(k.mdct(x[i * n // 2 : i * n // 2 + n], w), w)
    return out


def test_overlapping_windows_give_the_signal_back():
    x = np.random.default_rng(1).normal(size=640)
    long = k.kaiser_window(256)
    assert np.allclose(overlapped(x, [long] * 4, 256)[128:512], x[128:512])
    assert np.allclose(overlapped(x, [long, k.start_window(256, 64)], 256)[128:256], x[128:256])
    assert np.allclose(overlapped(x, [k.stop_window(256, 64), long], 256)[128:256], x[128:256])


def test_windows_are_power_complementary():
    w = k.kaiser_window(512)
    assert np.allclose(w[:256] ** 2 + w[256:] ** 2, 1)


def test_thresholds_follow_level_and_quality():
    rng = np.random.default_rng(2)
    c = k.mdct(rng.normal(size=(3, 1024)))
    low, high = k.thresholds(c, 44100, 5), k.thresholds(c, 44100, 9)
    assert np.nanmax(high / low) < 1
    assert np.allclose(np.nan_to_num(k.thresholds(10 * c, 44100, 7)), np.nan_to_num(100 * k.thresholds(c, 44100, 7)))
    assert np.nanmax(k.limit_cliffs(low)[:, 1:] / k.limit_cliffs(low)[:, :-1]) <= 10**1.4 + 1e-9


def test_quantiser_noise_is_within_half_a_step():
    c = np.linspace(-50, 50, 1001)
    q = k.quantise(c, 3.0)
    assert np.abs(q * 3.0 - c).max() <= 0.62 * 3 + 1e-9
    assert (k.quantise(np.array([0.61, 0.62]), 1.0) == [0, 1]).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=300))
def test_coders_round_trip(values):
    assert rc.decode_planes(rc.encode_planes(values), len(values)) == values
    coder, model = rc.Encoder(), rc.Signed(3)
    for i, v in enumerate(values):
        model.encode(coder, i % 3, v)
    back, model = rc.Decoder(coder.finish()), rc.Signed(3)
    assert [model.decode(back, i % 3) for i in range(len(values))] == values
    if values:
        x = np.array(values, np.int64)
        assert (ll.decode_segment(ll.encode_segment(x)) == x).all()


def test_skewed_bits_code_small():
    rng = np.random.default_rng(11)
    bits = rng.random(20_000) < 0.08
    coder, model = rc.Encoder(), [rc.HALF]
    for b in bits.tolist():
        coder.bit(model, 0, int(b))
    data = coder.finish()
    assert len(data) < 20_000 / 8 * 0.45
    back, model = rc.Decoder(data), [rc.HALF]
    assert [back.bit(model, 0) for _ in range(20_000)] == bits.astype(int).tolist()


def test_prediction_pays_on_tones():
    t = np.arange(4096)
    tone = (8000 * np.sin(t / 9) + 3000 * np.sin(t / 31)).astype(np.int64)
    assert len(ll.encode_segment(tone)) < 0.55 * len(ll.encode_segment(np.random.default_rng(3).permutation(tone)))
