"""Operators 5 and 9: the learners against plain loops, and gradients against finite differences."""

import math

import numpy as np
import pytest

from folio.llm import quality_classifier, toxicity


def test_ftrl_matches_a_dense_loop():
    """Weights of the sparse updates equal those of FTRL-proximal as written down, one coordinate at a time."""
    rng = np.random.default_rng(1)
    n, alpha, beta, l1, l2, epochs, seed = 40, 1.0, 1.0, 0.005, 0.02, 3, 7
    examples = [(np.sort(rng.choice(12, 4, replace=False)).astype(np.int32), rng.random(4).astype(np.float32)) for _ in range(n)]
    y = (rng.random(n) < 0.5).astype(float)
    w, bias = quality_classifier.train_ftrl(examples, y, alpha, beta, l1, l2, epochs, seed)
    z, g2, order = [0.0] * 13, [0.0] * 13, np.random.default_rng(seed)  # the last coordinate is the bias

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(g2[i])) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(n):
            x = {int(i): float(v) for i, v in zip(*examples[k], strict=True)} | {12: 0.1}
            ws = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(ws[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y[k]) * v
                sigma = (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / alpha
                z[i] += g - sigma * ws[i]
                g2[i] += g * g
    assert np.allclose(w[:12], [weight(i) for i in range(12)], atol=1e-5) and not w[12:].any()
    assert bias == pytest.approx(weight(12) * 0.1, abs=1e-6)


def small_net():
    net = toxicity.ToxicCnn(np.linspace(-1, 1, toxicity.BUCKETS).astype(np.float32), np.arange(toxicity.BUCKETS) > 0, seed=3)
    rng = np.random.default_rng(2)
    return net, [rng.integers(1, 200, (k, 1 + len(toxicity.PREFIXES))).astype(np.int32) for k in (1, 2, 5, 17)]


def test_convolution_and_pooling_match_plain_loops():
    net, texts = small_net()
    pad = max(toxicity.WIDTHS) - 1
    for t, got in zip(texts, net.logits(texts), strict=True):
        e = [np.zeros(toxicity.DIM) + sum(net.emb[0] for _ in range(t.shape[1])) for _ in range(pad)]
        e = e + [sum(net.emb[b].astype(float) for b in word) for word in t] + e
        z = float(net.shift[0])
        for j, f in enumerate(net.filters):
            for k in range(toxicity.FILTERS):
                best = max(sum(float(e[at + o] @ f[o][:, k]) for o in range(len(f))) for at in range(len(e) - len(f) + 1))
                z += max(0.0, best + float(net.bias[j][k])) * float(net.out[j * toxicity.FILTERS + k])
        assert got == pytest.approx(z, abs=1e-3)


def test_gradients_match_finite_differences(monkeypatch):
    """The first Adam step moves each dense parameter by RATE against the sign of its gradient; that sign is the finite difference's."""
    net, texts = small_net()
    y = np.array([1, 0, 0, 1])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def loss(n):
        z = n.logits(texts).astype(float)
        return float((weight * np.log1p(np.exp(-(2 * y - 1) * z))).mean())

    probes, step = [(0, (0, 1, 2)), (1, (1, 0, 3)), (2, (2, 5, 6))], 0.02
    slopes = []
    for j, at in probes:
        value = net.filters[j][at]
        net.filters[j][at] = value + step
        up = loss(net)
        net.filters[j][at] = value - step
        down = loss(net)
        net.filters[j][at] = value
        slopes.append((up - down) / (2 * step))
    before = [f.copy() for f in net.filters]
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    monkeypatch.setattr(toxicity, "BATCH", len(y))
    net.train(texts, y, epochs=1)
    for (j, at), slope in zip(probes, slopes, strict=True):
        moved = net.filters[j][at] - before[j][at]
        assert abs(slope) < 1e-5 or moved == pytest.approx(-toxicity.RATE * np.sign(slope), rel=0.05)
    assert any(abs(s) > 1e-5 for s in slopes)
