"""The salience of a keyword that may be no term of the vocabulary: exact, contained, overlapping, or the floor.

A vocabulary has a fixed cap on its terms, so every task holds one and looks its keywords up; nothing is exploded or
shuffled. Terms inside a keyword are found by an Aho-Corasick automaton. Terms around a keyword are a range of the sorted
suffixes of all terms, found by bisection, and the best score of a range comes from a table of maxima over powers of two.
Overlap counts the keyword's tokens that each term shares.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

FLOOR = 0.001


class Index:
    """Terms and scores with what the stages look up; built where it is first used, so only terms and scores travel."""

    def __init__(self, terms: list[str], scores: list[float]):
        self.terms, self.scores, self.ready = terms, scores, False

    def __getstate__(self):
        return {"terms": self.terms, "scores": self.scores, "ready": False}

    def _build(self) -> None:
        import ahocorasick

        self.exact = dict(zip(self.terms, self.scores))
        self.automaton = ahocorasick.Automaton()
        for term, score in self.exact.items():
            if term:
                self.automaton.add_word(term, score)
        if len(self.automaton):
            self.automaton.make_automaton()
        suffixes = sorted((term[i:], score) for term, score in self.exact.items() for i in range(len(term)))
        self.suffixes = [s for s, _ in suffixes]
        self.maxima = [np.array([score for _, score in suffixes], float)]
        while 1 << len(self.maxima) <= len(suffixes):
            last, half = self.maxima[-1], 1 << (len(self.maxima) - 1)
            self.maxima.append(np.maximum(last[:-half], last[half:]))
        self.holders: dict[str, list[int]] = {}
        self.kept = np.array(list(self.exact.values()), float)
        for at, term in enumerate(self.exact):
            for token in set(term.split(" ")):
                self.holders.setdefault(token, []).append(at)
        self.holders = {t: np.array(h) for t, h in self.holders.items()}
        self.ready = True

    def inside(self, keyword: str) -> float:
        """The best term that is part of the keyword; 0 without one."""
        return max((score for _, score in self.automaton.iter(keyword)), default=0.0) if len(self.automaton) else 0.0

    def around(self, keyword: str) -> float:
        """The best term that the keyword is part of; 0 without one."""
        low, high = bisect_left(self.suffixes, keyword), bisect_left(self.suffixes, keyword + "\U0010ffff")
        if low >= high:
            return 0.0
        k = (high - low).bit_length() - 1
        return float(max(self.maxima[k][low], self.maxima[k][high - (1 << k)]))

    def overlap(self, keyword: str) -> float:
        """The best term that shares half of the distinct tokens of a keyword of several; 0 without one."""
        tokens = set(keyword.split(" "))
        found = [self.holders[t] for t in tokens if t in self.holders]
        if len(tokens) < 2 or not found:
            return 0.0
        at, n = np.unique(np.concatenate(found), return_counts=True)
        best = self.kept[at[2 * n >= len(tokens)]]
        return float(best.max()) if len(best) else 0.0

    def match(self, keyword: str) -> tuple[float, str]:
        if not self.ready:
            self._build()
        if keyword in self.exact:
            return self.exact[keyword], "exact"
        if keyword:
            for stage, name in ((lambda k: max(self.inside(k), self.around(k)), "contains"), (self.overlap, "overlap")):
                score = stage(keyword)
                if score > 0:
                    return score, name
        return FLOOR, "fallback"
