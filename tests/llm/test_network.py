"""The language model's passes against the plain formulas, for small logits and for such as single precision can't exponentiate."""

import numpy as np
import pytest

from plumbline.llm import lm_score


def network(scale):
    rng = np.random.default_rng(0)
    known = lm_score.Vocabulary([(k << 20, 9000 - 50 * k) for k in range(128)], np.array([[1e6, 300, 50]] * 64), 128)
    net = lm_score.Network(known)
    for p in net.parts():
        p[...] = p + rng.standard_normal(p.shape).astype(np.float32) * scale
    words = rng.integers(0, known.size, 5000)
    return net, *lm_score._framed(words, np.array([3000, 0, 2000]), net.pad)


def plain(net, framed, at):
    h = np.tanh(np.float64(net.base) + sum(np.float64(t)[framed[at + o]] for t, o in zip(net.side, lm_score._OFFSETS, strict=True)))
    cls, word = np.divmod(framed[at], lm_score.PER_CLASS)
    a = h @ np.float64(net.to_class) + net.class_bias
    b = np.einsum("nd,ndw->nw", h, np.float64(net.to_word)[cls]) + net.word_bias[cls]
    of = lambda z, k: (z - z.max(1, keepdims=True))[np.arange(len(k)), k] - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
    return of(a, cls) + of(b, word)


@pytest.mark.parametrize(("scale", "bounded"), [(0.3, True), (40.0, False)])
def test_log_probabilities(scale, bounded):
    net, framed, at = network(scale)
    want = plain(net, framed, at)
    assert net._joined()[2] == bounded and (want.min() < -200) == (not bounded)
    for step, rows in ((1 << 15, 1 << 11), (700, 33)):
        assert np.allclose(net.log_probabilities(framed, at, step, rows), want, rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("scale", [0.3, 40.0])
def test_a_step_follows_the_gradient(scale):
    """Adagrad's first step: the rate times the gradient over its size, for every part."""
    net, framed, at = network(scale)
    at = at[:60]
    moved = net.copy()
    memory = [np.zeros_like(p) for p in moved.parts()]
    moved.train(framed, at, memory, rate=1e-3)
    assert np.isfinite(moved.flat()).all()
    if scale > 1:
        return
    rng = np.random.default_rng(1)
    for k, p in enumerate(net.parts()):
        for flat in rng.choice(np.flatnonzero(memory[k].ravel() > 1e-4), 5):
            cell, eps, both = np.unravel_index(flat, p.shape), 1e-2, []
            for sign in (1, -1):
                other = net.copy()
                other.parts()[k][cell] += sign * eps
                both.append(-plain(other, framed, at).sum())
            slope = (both[0] - both[1]) / (2 * eps)
            assert slope**2 == pytest.approx(memory[k][cell], rel=0.02)
            assert moved.parts()[k][cell] - p[cell] == pytest.approx(-1e-3 * np.sign(slope), rel=0.05)
