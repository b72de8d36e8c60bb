"""Byte-pair encoding by a table over prefixes.

Write last[i] for the final token of the encoding of the first i symbols of a word. Merging is greedy
(best rank first, leftmost on a tie), so two facts hold: every adjacent pair of an encoding is itself the
encoding of the two tokens' joined text, and a token sequence whose adjacent pairs all have that property is
the encoding of its text. Hence exactly one vocabulary token t that ends at i agrees with last[i - len(t)],
and one left-to-right pass over an automaton's matches fills the table. The ids are read backwards from
last[n]; the number of tokens of every prefix comes out of the same pass.

Tokens are held by their text. The caller gives ``rank(left, right)``: the priority of merging two adjacent
tokens (smaller first), or None where they do not merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import ahocorasick

Rank = Callable[[str, str], int | None]


def merge_greedily(symbols: Iterable[str], rank: Rank) -> list[str]:
    """The encoding by its definition: merge the best pair, leftmost first, until none merges."""
    out = list(symbols)
    ranks = [rank(a, b) for a, b in zip(out, out[1:])]
    while True:
        best = min((r for r in ranks if r is not None), default=None)
        if best is None:
            return out
        i = ranks.index(best)
        out[i : i + 2] = [out[i] + out[i + 1]]
        ranks[i : i + 1] = []
        if i:
            ranks[i - 1] = rank(out[i - 1], out[i])
        if i < len(ranks):
            ranks[i] = rank(out[i], out[i + 1])


class PrefixTable:
    """Prefix tables of words over one vocabulary.

    ``tokens`` are the texts of all tokens; a token's number is its place among them. A single symbol is always
    a token: one that is not listed gets a number of its own when first met.
    ``pairs`` bounds how many pair verdicts are remembered; beyond it they are forgotten and made again.
    """

    def __init__(self, tokens: Iterable[str], rank: Rank, pairs: int = 1_000_000) -> None:
        self.rank = rank
        self.pairs = pairs
        self.texts = list(tokens)
        self.numbers = {t: i for i, t in enumerate(self.texts)}
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(self.texts):
            if token and (len(token) == 1 or merge_greedily(token, rank) == [token]):
                self.automaton.add_word(token, (number, len(token)))
        self.automaton.make_automaton()
        self.symbols = {t for t in self.texts if len(t) == 1}

    def number(self, symbol: str) -> int:
        found = self.numbers.get(symbol)
        if found is None:
            found = self.numbers[symbol] = len(self.texts)
            self.texts.append(symbol)
        return found

    def agree(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined text is these two tokens; remembered."""
        pair = [self.texts[left], self.texts[right]]
        known = merge_greedily("".join(pair), self.rank) == pair
        if len(self.fits) >= self.pairs:
            self.fits.clear()
        self.fits[left << 32 | right] = known
        return known

    def table(self, word: str) -> list[int]:
        """For every prefix length 0..n the number of its last token; -1 for the empty prefix.

        The automaton yields the matches of one end longest first. All prefixes before a match are settled when
        it comes up. When nothing longer agreed, the single symbol is the one that is left.
        """
        last = [-1] * (len(word) + 1)
        foreign: list[int] = []
        if not self.symbols.issuperset(word):
            foreign = [i for i, c in enumerate(word) if c not in self.symbols]
            for i in foreign:
                last[i + 1] = -2  # settled below, unless a longer token ends here
        fits = self.fits
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start and size > 1:
                before = last[start]
                if before == -2:
                    before = last[start] = self.number(word[start - 1])
                known = fits.get(before << 32 | token)
                if not (self.agree(before, token) if known is None else known):
                    continue
            last[end] = token
        for i in foreign:
            if last[i + 1] == -2:
                last[i + 1] = self.number(word[i])
        return last

    def counts(self, word: str) -> list[int]:
        """Tokens of every prefix, 0..n."""
        texts, out = self.texts, [0]
        for i, token in enumerate(self.table(word)[1:], 1):
            out.append(out[i - len(texts[token])] + 1)
        return out

    def tokens(self, word: str) -> list[int]:
        """The encoding of a word as token numbers, read backwards from its table."""
        last, texts = self.table(word), self.texts
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(texts[last[at]])
        return out[::-1]
