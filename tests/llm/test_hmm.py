"""The model's recursions against sums over all state paths, and the same with and without runs."""

import itertools

import numpy as np
import pytest

from textmill.llm import hmm


def _model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)

    def shares(*shape):
        x = rng.random(shape) + 0.1
        return x / x.sum(axis=-1, keepdims=True)

    none = np.zeros(0)
    return hmm.Model(0, 0, none, none, none, none, np.full(symbols, 1 / symbols), shares(states), shares(states, states), shares(states, symbols).T)


def _paths(model, text):
    """The likelihood and expected counts of a text, by enumeration."""
    k = len(model.start)
    total, emit, move, start = 0.0, np.zeros_like(model.emit), np.zeros((k, k)), np.zeros(k)
    for path in itertools.product(range(k), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, x in zip(path, path[1:], text[1:], strict=False):
            p *= model.move[a, b] * model.emit[x, b]
        total += p
        start[path[0]] += p
        for s, x in zip(path, text, strict=True):
            emit[x, s] += p
        for a, b in zip(path, path[1:], strict=False):
            move[a, b] += p
    return total, emit / total, move / total, start / total


@pytest.mark.parametrize("run", [1, 2, 3, 512])
def test_recursions_are_sums_over_all_paths(monkeypatch, run):
    monkeypatch.setattr(hmm, "RUN", run)
    model, rng = _model(), np.random.default_rng(2)
    texts = [rng.integers(0, 5, n) for n in (1, 7, 2, 8, 3, 5)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [_paths(model, t) for t in texts]
    assert hmm.forward(model, np.concatenate(texts), first) == pytest.approx([np.log10(w[0]) for w in want], rel=1e-9)
    got = hmm.expect(model, np.concatenate(texts), first)
    assert got.emit == pytest.approx(sum(w[1] for w in want), rel=1e-4)
    assert got.move == pytest.approx(sum(w[2] for w in want), rel=1e-4)
    assert got.start == pytest.approx(sum(w[3] for w in want), rel=1e-4)
    assert got.likelihood == pytest.approx(sum(np.log10(w[0]) for w in want), rel=1e-4)


def test_long_texts_are_whole(monkeypatch):
    model, rng = _model(8, 40), np.random.default_rng(3)
    texts = [rng.integers(0, 40, n) for n in (2000, 30, 513, 512, 1)]
    first, flat = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.concatenate(texts)
    cut, e = hmm.forward(model, flat, first), hmm.expect(model, flat, first)
    monkeypatch.setattr(hmm, "RUN", 1 << 20)
    assert cut == pytest.approx(hmm.forward(model, flat, first), rel=1e-9)
    whole = hmm.expect(model, flat, first)
    assert e.emit == pytest.approx(whole.emit, rel=1e-3, abs=1e-3) and e.move == pytest.approx(whole.move, rel=1e-3)


def test_no_texts():
    e = hmm.expect(_model(), np.zeros(0, np.int64), np.zeros(1, np.int64))
    assert not e.emit.any() and e.likelihood == 0
