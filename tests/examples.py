"""A shortest example text for a pattern, from Python's own parse of it."""

import re
from re import _constants as c
from re import _parser as parser


def _pick(items):
    chars = []
    for op, arg in items:
        if op is c.LITERAL:
            chars.append(arg)
        elif op is c.RANGE:
            chars += [arg[0], arg[1], (arg[0] + arg[1]) // 2]
        elif op is c.CATEGORY:
            chars.append({c.CATEGORY_DIGIT: ord("7"), c.CATEGORY_WORD: ord("k"),
                          c.CATEGORY_SPACE: ord(" ")}.get(arg, ord("q")))
        elif op is c.NEGATE:
            taken = {a for o, a in items if o is c.LITERAL}
            spaces = (c.CATEGORY, c.CATEGORY_SPACE) in items
            options = [ord("z"), ord("5")] if spaces or ord(" ") in taken else [ord(" ")]
            return [next(x for x in options if x not in taken)]
    return chars


def example(source: str, flags: int = 0) -> str:
    return _text(parser.parse(source, flags), [0])


def _text(tree, turn) -> str:
    out = ""
    for op, arg in tree:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.NOT_LITERAL:
            out += "z" if arg != ord("z") else "y"
        elif op is c.ANY:
            out += "m"
        elif op is c.IN:
            chars = _pick(arg)
            # Vary repeated picks so that entropy floors do not matter to the caller.
            out += chr(chars[turn[0] % len(chars)])
            turn[0] += 1
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += "".join(_text(arg[2], turn) for _ in range(arg[0]))
        elif op is c.SUBPATTERN:
            out += _text(arg[3], turn)
        elif op is c.BRANCH:
            out += _text(arg[1][0], turn)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            pass
        else:
            raise AssertionError(op)
    return out


__all__ = ["example", "re"]
