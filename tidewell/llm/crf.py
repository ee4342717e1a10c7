"""A linear-chain conditional random field over hashed features, in numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Features:
    """Feature buckets of tokens that have different numbers of them: those of all tokens in a row, and where each begins.

    Every token has one at least.
    """

    buckets: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, tokens: list[list[int]]) -> Features:
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(np.array([b for t in tokens for b in t], np.int32), np.cumsum(sizes) - sizes)

    def __len__(self) -> int:
        return len(self.starts)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The summed weights of each token, in pieces of about a million buckets."""
        out = np.zeros((len(self), weights.shape[1]), np.float32)
        first = 0
        while first < len(self):
            begin = self.starts[first]
            stop = max(first + 1, int(np.searchsorted(self.starts, begin + 1_000_000)))
            end = self.starts[stop] if stop < len(self) else len(self.buckets)
            out[first:stop] = np.add.reduceat(weights[self.buckets[begin:end]], self.starts[first:stop] - begin, axis=0)
            first = stop
        return out

    def take(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of ``tokens`` in a row, and for each the place of its token in ``tokens``."""
        sizes = np.diff(np.append(self.starts, len(self.buckets)))[tokens]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.buckets[np.repeat(self.starts[tokens], sizes) + within], np.repeat(np.arange(len(tokens)), sizes)


@dataclass
class Chain:
    """Weights: one row per feature bucket and one column per label; transitions; scores of the first label."""

    labels: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray
    begin: np.ndarray

    def emissions(self, features: np.ndarray | Features) -> np.ndarray:
        """Scores of each token (a row of feature buckets) and label."""
        if isinstance(features, Features):
            return features.sums(self.weights)
        out = np.zeros((len(features), len(self.labels)), np.float32)
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def decode(self, emissions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best labels of each sequence, by Viterbi over batches of sequences of about equal length."""
        lengths = np.diff(offsets)
        out = np.zeros(len(emissions), np.int8)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            longest = lengths[order[at]] * 5 // 4 + 4
            stop = at + int(np.searchsorted(lengths[order[at:]], longest, "right"))
            stop = min(stop, at + max(1, 16_000_000 // int(longest * len(self.labels))))
            self._decode_batch(emissions, offsets, order[at:stop], lengths, out)
            at = stop
        return out

    def _decode_batch(self, emissions, offsets, rows, lengths, out) -> None:
        size = lengths[rows]
        most, n, k = int(size.max()), len(rows), len(self.labels)
        index = np.minimum(offsets[rows][:, None] + np.arange(most), len(emissions) - 1)
        score = emissions[index[:, 0]] + self.begin
        back = np.zeros((most, n, k), np.int8)
        for t in range(1, most):
            through = score[:, :, None] + self.steps
            best = through.argmax(1)
            new = np.take_along_axis(through, best[:, None, :], 1)[:, 0] + emissions[index[:, t]]
            live = (t < size)[:, None]
            score = np.where(live, new, score)
            back[t] = np.where(live, best, np.arange(k))
        label = score.argmax(1)
        for t in range(most - 1, -1, -1):
            live = t < size
            out[index[live, t]] = label[live]
            label = back[t, np.arange(n), label]


def trained(features: np.ndarray | Features, gold: np.ndarray, offsets: np.ndarray, labels: tuple[str, ...], buckets: int, epochs: int = 40, rate: float = 0.25, shrink: float = 2e-4, seed: int = 7) -> Chain:
    """Weights by adaptive gradient ascent on the log-likelihood of labelled sequences; the same for the same input."""
    k = len(labels)
    weights, steps, begin = np.zeros((buckets, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    seen_w, seen_s, seen_b = np.full((buckets, k), 1e-3, np.float32), np.full((k, k), 1e-3, np.float32), np.full(k, 1e-3, np.float32)
    lengths = np.diff(offsets)
    random = np.random.default_rng(seed)
    rows = np.flatnonzero(lengths > 0)
    for _ in range(epochs):
        # sequences of about equal length go together
        random.shuffle(rows)
        by_length = rows[np.argsort(lengths[rows], kind="stable")]
        batches = [by_length[i : i + 48] for i in range(0, len(by_length), 48)]
        random.shuffle(batches)
        for batch in batches:
            size = lengths[batch]
            most, n = int(size.max()), len(batch)
            index = np.minimum(offsets[batch][:, None] + np.arange(most), len(features) - 1)
            live = np.arange(most) < size[:, None]
            emission = np.zeros((n, most, k), np.float32)
            if isinstance(features, Features):
                ids, token = features.take(index[live])
                emission[live] = Features(ids, np.flatnonzero(np.append(True, token[1:] != token[:-1]))).sums(weights)
            else:
                ids = features[index[live]].ravel()
                token = np.repeat(np.arange(int(live.sum())), features.shape[1])
                for j in range(features.shape[1]):
                    emission += weights[features[index, j]]
            ahead = np.zeros((most, n, k), np.float32)
            ahead[0] = emission[:, 0] + begin
            for t in range(1, most):
                x = ahead[t - 1][:, :, None] + steps
                top = x.max(1)
                ahead[t] = np.where(live[:, t][:, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + emission[:, t], ahead[t - 1])
            behind = np.zeros((most, n, k), np.float32)
            for t in range(most - 2, -1, -1):
                x = steps + (emission[:, t + 1] + behind[t + 1])[:, None, :]
                top = x.max(2)
                behind[t] = np.where(live[:, t + 1][:, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
            last = ahead[-1]
            norm = last.max(1) + np.log(np.exp(last - last.max(1)[:, None]).sum(1))
            share = np.exp(ahead + behind - norm[None, :, None]).transpose(1, 0, 2) * live[:, :, None]
            truth = gold[index]
            gradient = -share
            np.put_along_axis(gradient, truth[:, :, None], np.take_along_axis(gradient, truth[:, :, None], 2) + 1, 2)
            gradient *= live[:, :, None]
            step_gradient = np.zeros((k, k))
            for t in range(1, most):
                pair = np.exp(ahead[t - 1][:, :, None] + steps + (emission[:, t] + behind[t])[:, None, :] - norm[:, None, None]) * live[:, t][:, None, None]
                step_gradient -= pair.sum(0)
                np.add.at(step_gradient, (truth[live[:, t], t - 1], truth[live[:, t], t]), 1)
            flat = gradient[live].astype(np.float32)
            order = np.argsort(ids, kind="stable")
            sorted_ids = ids[order]
            cuts = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
            touched = sorted_ids[cuts]
            summed = np.add.reduceat(flat[token[order]], cuts, axis=0) / n - shrink * weights[touched]
            seen_w[touched] += summed**2
            weights[touched] += rate * summed / np.sqrt(seen_w[touched])
            step_gradient = step_gradient / n - shrink * steps
            seen_s += (step_gradient**2).astype(np.float32)
            steps += (rate * step_gradient / np.sqrt(seen_s)).astype(np.float32)
            begin_gradient = gradient[:, 0].sum(0) / n
            seen_b += (begin_gradient**2).astype(np.float32)
            begin += (rate * begin_gradient / np.sqrt(seen_b)).astype(np.float32)
    return Chain(labels, weights, steps, begin)
