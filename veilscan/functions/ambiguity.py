"""Patterns that take exponential time: loops that can read one text in several ways.

A backtracking engine tries all ways before it gives up.  The body of every unbounded repeat becomes
a position automaton: its positions are the characters of the pattern, and it goes from one position
to those that may follow.  It is ambiguous if two different positions can be reached over the same
text and meet again, or if one step can be taken in two ways, as in ``(a*)*``.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product
from re import _constants as C
from re import _parser as parser

#: Characters that stand for all others; those of a pattern are added.
SAMPLE = "".join(map(chr, range(128))) + "\u00a0\u2028\u00e9\u4e2d"
#: A repeat of a varying number of times is a loop from this many times on.
MANY = 16
#: Longer fixed repeats count as this many.
MOST_COPIES = 64

#: A bar between branches; what the parser would merge (``a|a``, ``\\w|\\d``) is kept apart behind it.
_BAR = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|(\|)", re.S)
_CATEGORY = {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_SPACE: r"\s",
             C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W"}
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)
_ATOMIC = (C.POSSESSIVE_REPEAT, C.ATOMIC_GROUP)


class _Positions:
    """Positions of one loop: what each can read, and in how many ways one follows another."""

    def __init__(self, alphabet: str, ignore_case: bool):
        self.alphabet, self.ignore_case = alphabet, ignore_case
        self.reads: list[frozenset[str]] = []
        self.follow: Counter[tuple[int, int]] = Counter()

    def _holds(self, op, value, char: str) -> bool:
        if op is C.LITERAL:
            return ord(char) == value
        if op is C.NOT_LITERAL:
            return ord(char) != value
        if op is C.ANY:
            return char not in "\n\r\u2028\u2029"
        if op is C.RANGE:
            return value[0] <= ord(char) <= value[1]
        if op is C.CATEGORY:
            return re.match(_CATEGORY[value], char, re.A) is not None
        negated = value[0][0] is C.NEGATE
        return negated != any(self._holds(*item, char) for item in value[negated:])

    def _position(self, reads: frozenset[str]) -> tuple[bool, list[int], list[int]]:
        self.reads.append(reads)
        at = [len(self.reads) - 1]
        return False, at, at

    def _connect(self, lasts: list[int], firsts: list[int]) -> None:
        for pair in product(lasts, firsts):
            self.follow[pair] += 1

    def sequence(self, items) -> tuple[bool, list[int], list[int]]:
        """Whether it can be empty, where it can begin, where it can end."""
        empty, firsts, lasts = True, [], []
        for item in items:
            empty, firsts, lasts = self._join((empty, firsts, lasts), self.item(*item))
        return empty, firsts, lasts

    def _join(self, one, other):
        self._connect(one[2], other[1])
        return (one[0] and other[0], one[1] + other[1] * one[0], other[2] + one[2] * other[0])

    def loop(self, items) -> tuple[bool, list[int], list[int]]:
        _, firsts, lasts = self.sequence(items)
        self._connect(lasts, firsts)
        return True, firsts, lasts

    def item(self, op, value) -> tuple[bool, list[int], list[int]]:
        if op in _ATOMIC:
            # Read in one way, so it is one position that reads whatever it begins with.
            inner = _Positions(self.alphabet, self.ignore_case)
            empty, firsts, _ = inner.sequence(value if op is C.ATOMIC_GROUP else value[2])
            made = self._position(frozenset().union(*(inner.reads[i] for i in firsts)))
            return empty or (op is not C.ATOMIC_GROUP and value[0] == 0), *made[1:]
        if op is C.SUBPATTERN:
            return self.sequence(value[3])
        if op is C.BRANCH:
            ways = [self.sequence(way) for way in value[1]]
            return (any(w[0] for w in ways), [i for w in ways for i in w[1]], [i for w in ways for i in w[2]])
        if op in _REPEATS:
            least, most, body = value
            if most is C.MAXREPEAT or (most > least and most >= MANY):
                _, firsts, lasts = self.loop(body)
                return least == 0, firsts, lasts
            made = True, [], []
            for i in range(min(most, MOST_COPIES)):
                empty, firsts, lasts = self.sequence(body)
                made = self._join(made, (empty or i >= least, firsts, lasts))
            return made
        if op in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
            return self._position(frozenset(
                c for c in self.alphabet
                if any(self._holds(op, value, x) for x in ({c, c.lower(), c.upper()} if self.ignore_case else c)
                       if len(x) == 1)))
        return True, [], []  # look-around, ends of lines, references: they read nothing here

    def ambiguous(self) -> bool:
        if any(ways > 1 for ways in self.follow.values()):
            return True
        after: dict[int, list[int]] = {}
        for one, other in self.follow:
            after.setdefault(one, []).append(other)

        def steps(one: int, other: int):
            return [(a, b) for a in after.get(one, ()) for b in after.get(other, ())
                    if not self.reads[a].isdisjoint(self.reads[b])]

        apart = {pair for i in range(len(self.reads)) for pair in steps(i, i) if pair[0] != pair[1]}
        waiting = list(apart)
        while waiting:
            for pair in steps(*waiting.pop()):
                if pair[0] == pair[1]:
                    return True
                if pair not in apart:
                    apart.add(pair)
                    waiting.append(pair)
        return False


def _loops(items):
    """Bodies of the outermost loops."""
    for op, value in items:
        if op in _REPEATS:
            least, most, body = value
            if most is C.MAXREPEAT or (most > least and most >= MANY):
                yield body
            else:
                yield from _loops(body)
            continue
        bodies = (value[1] if op is C.BRANCH else [value[3]] if op is C.SUBPATTERN
                  else [value] if op is C.ATOMIC_GROUP
                  else [value[1]] if op in (C.ASSERT, C.ASSERT_NOT) else [])
        for body in bodies:
            yield from _loops(body)


def is_ambiguous(source: str, flags: str = "") -> bool:
    """Whether a loop of the pattern can read one text in several ways.

    Look-around is taken as always true, so branches that it alone tells apart count as ambiguous.
    A pattern that cannot be read here is not judged (False); the JVM's compiler has the last word.
    """
    apart = _BAR.sub(lambda m: "|(?=)" if m[1] else m[0], re.sub(r"\(\?<(?![=!])", "(?P<", source))
    try:
        parsed = parser.parse(apart)
    except (re.error, OverflowError, RecursionError):
        return False
    alphabet = SAMPLE + "".join(sorted(set(source) - set(SAMPLE)))
    for body in _loops(parsed):
        positions = _Positions(alphabet, "i" in flags)
        positions.loop(body)
        if positions.ambiguous():
            return True
    return False
