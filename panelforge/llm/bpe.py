"""Byte-pair encodings as a prefix dynamic program.

The encoding of a text is the one sequence of tokens whose neighbours are compatible: two tokens are compatible if
encoding their concatenation gives back the two.  So the last token of every prefix's encoding follows from the last
tokens of shorter prefixes, and every prefix gets its exact encoding in one pass, whatever comes after it.
"""

from __future__ import annotations

import ahocorasick


class Merger:
    """Plain merging of a short list of symbols by rank, leftmost first; the base that decides compatibility."""

    def __init__(self, rank):
        self.rank = rank  # (left, right) -> number or None

    def run(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        while len(symbols) > 1:
            best = at = None
            for i in range(len(symbols) - 1):
                r = rank(symbols[i], symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols


class PrefixProgram:
    """Last token and token count of every prefix of a word.

    inner: tokens (without end marker) to numbers; ``end`` is the marker that the last symbol of a word carries.
    """

    def __init__(self, inner: dict[str, int], merger: Merger, end: str = "", final: dict[str, int] | None = None):
        self.inner, self.merger, self.end = inner, merger, end
        self.final = inner if final is None else final
        self.size = max(inner.values(), default=0) + 2
        self.text = [""] * self.size
        for k, v in inner.items():
            self.text[v] = k
        self.longest = max(map(len, self.final), default=1)
        self.bare = {k[: len(k) - len(end)] for k in self.final}
        self.auto = ahocorasick.Automaton()
        for k, v in inner.items():
            self.auto.add_word(k, (v, len(k), self.size + v))
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.ends: dict[tuple[int, str], bool] = {}

    def compatible(self, left: int, right: str, last: bool) -> bool:
        """Whether a token may follow another (or, after -1, begin a word)."""
        head = self.text[left] if left >= 0 else ""
        symbols = list(head + right)
        want = ([head] if head else []) + [right + self.end if last else right]
        if last:
            symbols[-1] += self.end
        return self.merger.run(symbols) == want

    def inner_pass(self, word: str) -> tuple[list[int], list[int]]:
        """Last token (-1: none, an unknown symbol or the start) and count of tokens of every prefix, taken as the beginning of a longer word."""
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        pairs, stride, seen = self.pairs, self.size, 0
        if len(pairs) > 2_000_000:
            pairs.clear()
        for at, (token, size, code) in self.auto.iter(word):
            at += 1
            if count[at]:
                continue
            if at > seen + 1:
                for gap in range(seen + 1, at):  # symbols that no token covers
                    if not count[gap]:
                        count[gap] = count[gap - 1] + 1
            seen = at
            before = last[at - size]
            key = before * stride + code  # code is stride + token, so -1 has keys of its own
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.compatible(before, self.text[token], False)
            if ok:
                last[at] = token
                count[at] = count[at - size] + 1
        for gap in range(seen, n + 1):
            if gap and not count[gap]:
                count[gap] = count[gap - 1] + 1
        return last, count

    def fits(self, left: int, right: str) -> bool:
        """Whether a token may end a word after another."""
        got = self.ends.get((left, right))
        if got is None:
            if len(self.ends) > 1_000_000:
                self.ends.clear()
            got = self.ends[left, right] = self.compatible(left, right, True)
        return got

    def final_count(self, word: str, n: int, last: list[int], count: list[int]) -> int:
        """Tokens of the first ``n`` symbols as a whole word."""
        for j in range(max(0, n - self.longest), n):
            token = word[j:n]
            if token in self.bare and self.fits(last[j], token):
                return count[j] + 1
        return count[n - 1] + 1 if n else 0

    def counts(self, word: str) -> list[int]:
        """Exact token count of every prefix of a word, each as a whole word of its own."""
        last, count = self.inner_pass(word)
        return [0, *(self.final_count(word, i, last, count) for i in range(1, len(word) + 1))]

    def count(self, word: str) -> int:
        last, count = self.inner_pass(word)
        return self.final_count(word, len(word), last, count)
