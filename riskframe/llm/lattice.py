"""Log-space forward and backward recursion over all segmentations of words into pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
START = "▁"


class Lattice:
    """Pieces with natural-log weights. A word is scored with the mark of its start in front.

    A character can always be spelled by the bytes of its UTF-8 form, so every word has a segmentation.
    """

    def __init__(self, pieces: list[str], weights: np.ndarray, byte_weights: np.ndarray):
        self.pieces, self.byte_weights = pieces, byte_weights
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes, self.longest = hashes[self.order], max(map(len, pieces))
        if len(np.unique(self.hashes)) < len(pieces):
            raise ValueError("two pieces have one hash")
        self.weights = np.append(weights, -np.inf)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _groups(self, words: list[str], size: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, their characters) by equal length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            for k in range(0, len(same), size):
                own = same[k : k + size]
                if len(own):
                    n = int(lengths[own[0]]) + 1
                    text = "".join(START + words[w] for w in own)
                    yield own, np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(own), n)

    def _spelled(self, chars: np.ndarray) -> np.ndarray:
        """Weight of each character spelled by bytes."""
        distinct, at = np.unique(chars, return_inverse=True)
        own = [self.byte_weights[list(chr(c).encode())].sum() for c in distinct]
        return np.array(own)[at].reshape(chars.shape)

    def _arcs(self, chars: np.ndarray, end: int) -> list[tuple[int, np.ndarray]]:
        """(start, piece of each word or the number of pieces for none) of the arcs into ``end``."""
        arcs, h, power = [], np.zeros(len(chars), np.uint64), np.uint64(1)
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            h = h + (chars[:, start].astype(np.uint64) + np.uint64(1)) * power
            power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            found = self.hashes[at] == h
            if found.any():
                arcs.append((start, np.where(found, self.order[at], len(self.pieces))))
        return arcs

    def _forward(self, chars: np.ndarray, keep: list | None = None) -> np.ndarray:
        n = chars.shape[1]
        alpha, spelled = np.full((n + 1, len(chars)), -np.inf), self._spelled(chars)
        alpha[0] = 0
        for end in range(1, n + 1):
            arcs = self._arcs(chars, end)
            terms = [alpha[end - 1] + spelled[:, end - 1], *(alpha[start] + self.weights[piece] for start, piece in arcs)]
            alpha[end] = np.logaddexp.reduce(np.stack(terms)) if len(terms) > 1 else terms[0]
            if keep is not None:
                keep.append(arcs)
        return alpha

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 of the summed weight of all segmentations of each word."""
        out = np.empty(len(words))
        for own, chars in self._groups(words):
            out[own] = self._forward(chars)[-1] / np.log(10)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over words that occur ``counts`` times."""
        total = np.zeros(len(self.pieces) + 1)
        for own, chars in self._groups(words):
            arcs: list = []
            alpha = self._forward(chars, arcs)
            n = chars.shape[1]
            beta, spelled = np.full((n + 1, len(chars)), -np.inf), self._spelled(chars)
            beta[n] = np.log(counts[own]) - alpha[n]
            for end in range(n, 0, -1):
                beta[end - 1] = np.logaddexp(beta[end - 1], beta[end] + spelled[:, end - 1])
                for start, piece in arcs[end - 1]:
                    through = beta[end] + self.weights[piece]
                    beta[start] = np.logaddexp(beta[start], through)
                    total += np.bincount(piece, np.exp(alpha[start] + through), len(total))
        return total[:-1]
