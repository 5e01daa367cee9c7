"""A word under stemming: its text and regions, with the moves that the rule tables make."""

from __future__ import annotations

from collections.abc import Iterable


def after_vowel_consonant(s: str, start: int, vowels: str) -> int:
    """The place behind the first consonant that follows a vowel from ``start`` on, or the end."""
    for i in range(start + 1, len(s)):
        if s[i] not in vowels and s[i - 1] in vowels:
            return i + 1
    return len(s)


def romance_rv(s: str, vowels: str) -> int:
    """The region RV of Spanish, Italian and Portuguese."""
    if len(s) < 3:
        return len(s)
    if s[1] not in vowels:
        return next((i + 1 for i in range(2, len(s)) if s[i] in vowels), len(s))
    if s[0] in vowels:
        return next((i + 1 for i in range(2, len(s)) if s[i] not in vowels), len(s))
    return 3


class Word:
    """Regions are places that stay as the text shrinks."""

    def __init__(self, text: str, vowels: str, least_r1: int = 0, rv: int | None = None):
        self.s, self.vowels = text, vowels
        self.r1 = max(after_vowel_consonant(text, 0, vowels), least_r1)
        self.r2 = after_vowel_consonant(text, self.r1, vowels)
        self.rv = romance_rv(text, vowels) if rv is None else rv

    def longest(self, endings: Iterable[str], region: int = 0) -> str | None:
        """The longest ending of the word that lies in a region, among those given."""
        return max((e for e in endings if self.s.endswith(e) and len(self.s) - len(e) >= region), key=len, default=None)

    def inside(self, ending: str, region: int) -> bool:
        return len(self.s) - len(ending) >= region

    def cut(self, ending: str, new: str = "") -> None:
        self.s = self.s[: len(self.s) - len(ending)] + new

    def cut_if(self, ending: str, region: int, new: str = "") -> bool:
        """Replace an ending that is there and lies in a region."""
        if self.s.endswith(ending) and self.inside(ending, region):
            self.cut(ending, new)
            return True
        return False

    def cut_first(self, endings: Iterable[str], region: int) -> bool:
        return any(self.cut_if(e, region) for e in endings)


def table(text: str) -> list[str]:
    return text.split()
