"""8-bit resize against exact arithmetic: both passes, both directions, rounding."""

from fractions import Fraction

import numpy as np
import pytest

from tessera.operators import images as IM


def exact_weights(n_in, n_out):
    """The triangle filter in fractions: per output, {source: weight}."""
    step = Fraction(n_in, n_out)
    wide = max(step, Fraction(1))
    out = []
    for o in range(n_out):
        centre = (o + Fraction(1, 2)) * step
        own = {i: 1 - abs(i + Fraction(1, 2) - centre) / wide for i in range(n_in) if abs(i + Fraction(1, 2) - centre) < wide}
        out.append({i: w / sum(own.values()) for i, w in own.items()})
    return out


@pytest.mark.parametrize("n_in, n_out", [(120, 128), (120, 224), (130, 120), (8, 5), (8, 3), (7, 7), (1, 4), (9, 1)])
def test_weights_are_the_triangle_to_22_bits(n_in, n_out):
    firsts, weights = IM.byte_axis(n_in, n_out)
    for o, own in enumerate(exact_weights(n_in, n_out)):
        got = {int(firsts[o]) + t: int(w) for t, w in enumerate(weights[o]) if w}
        assert set(got) == {i for i, w in own.items() if w * 2**22 >= Fraction(1, 2)}
        assert all(abs(w - own[i] * 2**22) <= Fraction(51, 100) for i, w in got.items())


def slow(a, out_h, out_w):
    """Row pass, then column pass, in Python integers."""
    def one(line, n_out):
        firsts, weights = IM.byte_axis(len(line), n_out)
        return [min(255, max(0, (sum(int(line[f + t]) * int(w) for t, w in enumerate(own) if w) + 2**21) >> 22)) for f, own in zip(firsts.tolist(), weights)]

    rows = [one(line, out_w) for line in a.tolist()]
    return np.array([one(line, out_h) for line in np.array(rows).T.tolist()]).T


@pytest.mark.parametrize("size, out", [((120, 120), (128, 128)), ((120, 120), (224, 224)), ((130, 130), (120, 120)), ((5, 7), (5, 7)), ((6, 9), (3, 14)), ((1, 1), (4, 3))])
def test_bytes_match_the_definition(spark, size, out):
    a = np.random.default_rng(1).integers(0, 256, size)
    df = spark.createDataFrame([(a.ravel().tolist(), [a.ravel().tolist(), (255 - a).ravel().tolist()])], "img array<int>, bands array<array<int>>")
    got = IM.resize_bytes(df, "img", *size, *out).first()["img"]
    assert (np.array(got).reshape(out) == slow(a, *out)).all()
    bands = IM.resize_bytes(df, "bands", *size, *out).first()["bands"]
    assert bands[0] == got and (np.array(bands[1]).reshape(out) == slow(255 - a, *out)).all()


def test_within_rounding_of_the_exact_resize():
    """Every byte is within one of the exact separable filter (half a byte for each pass)."""
    a = np.random.default_rng(2).integers(0, 256, (13, 12))
    for h, w in ((26, 7), (5, 24)):
        exact = np.zeros((h, w))
        for y, wy in enumerate(exact_weights(13, h)):
            for x, wx in enumerate(exact_weights(12, w)):
                exact[y, x] = float(sum(p * q * int(a[i, j]) for i, p in wy.items() for j, q in wx.items()))
        got = IM._byte_pass(IM._byte_pass(a, w).T, h).T
        assert np.abs(got - exact).max() <= 1.01


def test_flat_images_same_sizes_and_extremes():
    for v in (0, 1, 128, 254, 255):
        assert (IM._byte_pass(np.full((3, 120), v), 224) == v).all() and (IM._byte_pass(np.full((3, 130), v), 120) == v).all()
    a = np.random.default_rng(3).integers(0, 256, (4, 9))
    assert (IM._byte_pass(a, 9) == a).all()
    # hand-made: 2 to 4, quarter weights; 4 to 2, the widened triangle (1, 3, 3, 1) / 8 cut at the border
    assert IM._byte_pass(np.array([[0, 100]]), 4).tolist() == [[0, 25, 75, 100]]
    assert IM._byte_pass(np.array([[0, 0, 0, 70]]), 2).tolist() == [[0, 30]]


def test_wrong_sizes_and_values_fail(spark):
    for img in ([1, 2, 3], [1, 2, 3, 256], [1, 2, 3, -1], [1, 2, 3, None]):
        df = spark.createDataFrame([(img,)], "img array<int>")
        with pytest.raises(Exception, match="expected"):
            IM.resize_bytes(df, "img", 2, 2, 4, 4).collect()
    df = spark.createDataFrame([(None,)], "img array<int>")
    assert IM.resize_bytes(df, "img", 2, 2, 4, 4).first()["img"] is None
