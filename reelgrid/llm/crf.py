"""A linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    tags: tuple[str, ...]
    features: dict[str, int]
    emit: np.ndarray  # feature x tag
    turn: np.ndarray  # tag x next tag
    begin: np.ndarray

    def scores(self, chains: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded emission scores (chain, place, tag) and chain lengths."""
        lengths = np.array([len(c) for c in chains])
        out = np.zeros((len(chains), int(lengths.max()), len(self.tags)))
        for i, chain in enumerate(chains):
            for t, names in enumerate(chain):
                known = [self.features[n] for n in names if n in self.features]
                out[i, t] = self.emit[known].sum(axis=0)
        return out, lengths

    def decode(self, chains: list[list[list[str]]], batch: int = 512) -> list[list[str]]:
        """Best tag sequences; chains of similar length go through Viterbi together."""
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        out: list[list[str]] = [[]] * len(chains)
        for at in range(0, len(order), batch):
            group = order[at : at + batch]
            emitted, lengths = self.scores([chains[i] for i in group])
            for i, path in zip(group, self.viterbi(emitted, lengths)):
                out[i] = [self.tags[k] for k in path]
        return out

    def viterbi(self, emitted: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        n, most, k = emitted.shape
        best = self.begin + emitted[:, 0]
        back = np.zeros((n, most, k), np.int8)
        for t in range(1, most):
            ways = best[:, :, None] + self.turn[None]
            back[:, t] = ways.argmax(axis=1)
            more = ways.max(axis=1) + emitted[:, t]
            best = np.where((t < lengths)[:, None], more, best)
        last = best.argmax(axis=1)
        paths = []
        for i, length in enumerate(lengths.tolist()):
            path = [int(last[i])]
            for t in range(length - 1, 0, -1):
                path.append(int(back[i, t, path[-1]]))
            paths.append(path[::-1])
        return paths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def trained(chains: list[list[list[str]]], tagged: list[list[str]], tags: tuple[str, ...], steps: int = 150, rate: float = 0.2, decay: float = 0.002) -> Crf:
    """Maximum likelihood with an L2 term, all chains at once by forward and backward sums."""
    features = {name: i for i, name in enumerate(sorted({n for c in chains for names in c for n in names}))}
    lengths = np.array([len(c) for c in chains])
    n, most, k = len(chains), int(lengths.max()), len(tags)
    active = np.zeros((n, most, len(features)), np.float32)
    gold = np.zeros((n, most, k))
    there = np.arange(most)[None] < lengths[:, None]
    for i, (chain, own) in enumerate(zip(chains, tagged)):
        for t, names in enumerate(chain):
            active[i, t, [features[x] for x in names]] = 1
            gold[i, t, tags.index(own[t])] = 1
    both = there[:, 1:, None, None]
    gold_turn = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both).sum(axis=(0, 1))
    parts = [np.zeros((len(features), k)), np.zeros((k, k)), np.zeros(k)]
    sums = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    flat = active.reshape(n * most, -1)
    for step in range(1, steps + 1):
        emit, turn, begin = parts
        emitted = (flat @ emit).reshape(n, most, k)
        ahead, behind = np.zeros((n, most, k)), np.zeros((n, most, k))
        ahead[:, 0] = begin + emitted[:, 0]
        for t in range(1, most):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + turn, 1) + emitted[:, t]
        for t in range(most - 2, -1, -1):
            onward = _logsum(turn + (emitted[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t + 1 < lengths)[:, None], onward, 0)
        total = _logsum(ahead[np.arange(n), lengths - 1], 1)
        node = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        pair = ahead[:, :-1, :, None] + turn + (emitted + behind)[:, 1:, None, :] - total[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * both).sum(axis=(0, 1))
        grads = [
            (flat.T @ (node - gold).reshape(n * most, k)) / n + decay * emit,
            (pair - gold_turn) / n + decay * turn,
            (node[:, 0] - gold[:, 0]).sum(axis=0) / n + decay * begin,
        ]
        for i, g in enumerate(grads):
            sums[i][0] = 0.9 * sums[i][0] + 0.1 * g
            sums[i][1] = 0.99 * sums[i][1] + 0.01 * g * g
            parts[i] = parts[i] - rate * (sums[i][0] / (1 - 0.9**step)) / (np.sqrt(sums[i][1] / (1 - 0.99**step)) + 1e-8)
    return Crf(tags, features, *parts)
