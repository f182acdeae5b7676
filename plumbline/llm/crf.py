"""Linear-chain conditional random fields over sparse binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    features: dict[str, int]
    weights: np.ndarray  # (features + 1, labels); the last row is of unknown features and zero
    moves: np.ndarray  # (labels, labels)

    def scores(self, items: list[list[str]]) -> np.ndarray:
        """Label scores of each item, from its list of features."""
        sizes = np.array([len(x) for x in items], dtype=np.int64)
        unknown = len(self.features)
        known = np.array([self.features.get(f, unknown) for x in items for f in x], dtype=np.int64)
        out = np.zeros((len(items), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(items)), sizes), self.weights[known])
        return out

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """Most likely label numbers of each sequence."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        return viterbi(self.scores([x for s in sequences for x in s]), lengths, self.moves)


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """Best paths of sequences laid end to end, all sequences a step at a time."""
    return np.split(best_labels(scores, lengths, moves), np.cumsum(lengths)[:-1]) if len(lengths) else []


def best_labels(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The paths of ``viterbi`` laid end to end; of equal ones the label that comes first wins."""
    lengths = np.asarray(lengths, dtype=np.int64)
    found = np.zeros(len(scores), dtype=np.int64)
    longest = int(lengths.max()) if len(lengths) else 0
    if not longest:
        return found
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    alive_at = np.searchsorted(-lengths[order], -np.arange(longest), side="left").tolist()
    best = scores[starts[: alive_at[0]]].copy()
    back = np.zeros(scores.shape, dtype=np.int8)
    for t in range(1, longest):
        alive = alive_at[t]
        here = starts[:alive] + t
        reached = best[:alive, :, None] + moves[None]
        back[here] = reached.argmax(axis=1)
        best[:alive] = reached.max(axis=1) + scores[here]
    label = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        alive = alive_at[t]
        here = starts[:alive] + t
        found[here] = label[:alive]
        if t:
            label[:alive] = back[here, label[:alive]]
    return found


def train(
    sequences: list[list[list[str]]],
    answers: list[list[str]],
    labels: tuple[str, ...],
    penalty: float = 0.02,
    rounds: int = 300,
    step: float = 0.1,
) -> Model:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam; the same result every time."""
    features = {f: i for i, f in enumerate(sorted({f for s in sequences for x in s for f in x}))}
    k = len(labels)
    place = {label: i for i, label in enumerate(labels)}
    gold = [np.array([place[a] for a in own]) for own in answers]
    chains = [[np.array([features[f] for f in x], dtype=np.int64) for x in s] for s in sequences]
    theta = [np.zeros((len(features), k)), np.zeros((k, k))]
    first = [np.zeros_like(t) for t in theta]
    second = [np.zeros_like(t) for t in theta]
    for turn in range(1, rounds + 1):
        gradient = [penalty * t for t in theta]
        for chain, own in zip(chains, gold, strict=True):
            n = len(chain)
            score = np.array([theta[0][x].sum(axis=0) for x in chain])
            ahead, behind = np.zeros((n, k)), np.zeros((n, k))
            ahead[0] = score[0]
            for t in range(1, n):
                ahead[t] = score[t] + log_sum(ahead[t - 1][:, None] + theta[1], 0)
            for t in range(n - 2, -1, -1):
                behind[t] = log_sum(theta[1] + (score[t + 1] + behind[t + 1])[None], 1)
            norm = log_sum(ahead[-1], 0)
            single = np.exp(ahead + behind - norm)
            single[np.arange(n), own] -= 1
            for x, g in zip(chain, single, strict=True):
                np.add.at(gradient[0], x, g)
            for t in range(1, n):
                pair = np.exp(ahead[t - 1][:, None] + theta[1] + (score[t] + behind[t])[None] - norm)
                gradient[1] += pair
                gradient[1][own[t - 1], own[t]] -= 1
        for p in range(2):
            first[p] = 0.9 * first[p] + 0.1 * gradient[p]
            second[p] = 0.999 * second[p] + 0.001 * gradient[p] ** 2
            theta[p] -= step * (first[p] / (1 - 0.9**turn)) / (np.sqrt(second[p] / (1 - 0.999**turn)) + 1e-8)
    return Model(labels, features, np.vstack([theta[0], np.zeros((1, k))]), theta[1])


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))
