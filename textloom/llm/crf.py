"""A linear-chain conditional random field over sparse features, in numpy.

Training maximises the penalised likelihood of a small labelled table; decoding runs Viterbi over many
chains at once, step by step over the chains that are still going on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

FORBIDDEN = -1e9


class Chain:
    """Weights of features per label and of label pairs. Every chain starts and ends beside label 0."""

    def __init__(self, labels: Sequence[str], features: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.labels, self.features = list(labels), features
        self.emission, self.transition = emission, transition

    def numbers(self, names: Sequence[str]) -> list[int]:
        """Feature numbers; a feature the training never saw has no weight."""
        return [self.features[n] for n in names if n in self.features]

    def score(self, numbers: Sequence[int]) -> np.ndarray:
        return self.emission[list(numbers)].sum(axis=0)

    def viterbi(self, chains: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain of (words, labels) scores; ties go to the smaller label."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        found: list = [np.zeros(0, np.int64)] * len(chains)
        sizes = np.array([len(chains[i]) for i in order])
        order = [i for i in order if len(chains[i])]
        if not order:
            return found
        best = np.stack([chains[i][0] for i in order]) + self.transition[0]
        backs = []
        for t in range(1, int(sizes[0])):
            going = int((sizes > t).sum())
            paths = best[:going, :, None] + self.transition
            back = paths.argmax(axis=1)
            backs.append(back)
            step = np.take_along_axis(paths, back[:, None, :], axis=1)[:, 0]
            best[:going] = step + np.stack([chains[i][t] for i in order[:going]])
        last = (best + self.transition[:, 0]).argmax(axis=1)
        for row, i in enumerate(order):
            path = np.empty(len(chains[i]), np.int64)
            path[-1] = last[row]
            for t in range(len(path) - 1, 0, -1):
                path[t - 1] = backs[t - 1][row, path[t]]
            found[i] = path
        return found


def _marginals(scores: np.ndarray, transition: np.ndarray, mask: np.ndarray):
    """Log likelihood parts by forward and backward sums over padded chains (chain, word, label)."""
    chains, length, labels = scores.shape

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    ahead = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + transition[0]
    for t in range(1, length):
        step = scores[:, t] + lse(ahead[:, t - 1, :, None] + transition, 1)
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    total = lse(ahead[:, -1] + transition[:, 0], 1)
    behind = np.zeros_like(scores)
    behind[:, -1] = transition[:, 0]
    pairs = np.zeros_like(transition)
    for t in range(length - 1, 0, -1):
        on = mask[:, t]
        both = ahead[:, t - 1, :, None] + transition + (scores[:, t] + behind[:, t])[:, None, :]
        pairs += (np.exp(both - total[:, None, None]) * on[:, None, None]).sum(axis=0)
        step = lse(transition + (scores[:, t] + behind[:, t])[:, None, :], 2)
        behind[:, t - 1] = np.where(on[:, None], step, behind[:, t])
    words = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
    return words, pairs, total


def train(
    chains: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[str]], labels: Sequence[str],
    allowed: Sequence[Sequence[bool]], rounds: int = 200, penalty: float = 0.02, rate: float = 0.2,
) -> Chain:
    """Fit by Adam steps on the whole table. ``allowed`` is false where only label 0 may stand."""
    names = sorted({f for chain in chains for word in chain for f in word})
    features, label_of = {f: i for i, f in enumerate(names)}, {x: i for i, x in enumerate(labels)}
    rows, length, n = len(chains), max(map(len, chains)), len(labels)
    mask, barred = np.zeros((rows, length), bool), np.zeros((rows, length, n))
    gold = np.zeros((rows, length, n))
    places, numbers = [], []
    for i, (chain, marks, free) in enumerate(zip(chains, tags, allowed)):
        for t, (word, mark, may) in enumerate(zip(chain, marks, free)):
            mask[i, t], gold[i, t, label_of[mark]] = True, 1
            if not may:
                barred[i, t, 1:] = FORBIDDEN
            places += [i * length + t] * len(word)
            numbers += [features[f] for f in word]
    places, numbers = np.array(places), np.array(numbers)
    gold_pairs = np.zeros((n, n))
    for marks in tags:
        steps = [0, *[label_of[m] for m in marks], 0]
        np.add.at(gold_pairs, (steps[:-1], steps[1:]), 1)
    weights = [np.zeros((len(names), n)), np.zeros((n, n))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for k in range(1, rounds + 1):
        emission, transition = weights
        scores = np.zeros((rows * length, n))
        np.add.at(scores, places, emission[numbers])
        scores = scores.reshape(rows, length, n) + barred
        words, pairs, _ = _marginals(scores, transition, mask)
        last = mask.sum(axis=1) - 1
        pairs[0] += words[:, 0].sum(axis=0)
        pairs[:, 0] += words[np.arange(rows), last].sum(axis=0)
        lack = (gold - words).reshape(-1, n)
        step_emission = np.zeros_like(emission)
        np.add.at(step_emission, numbers, lack[places])
        for w, g, (first, second) in zip(weights, (step_emission, gold_pairs - pairs), moments):
            g = g - penalty * w
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Chain(labels, features, *weights)
