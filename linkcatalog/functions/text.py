"""Column expressions over text: a value used more than once, Unicode forms, patterns with one meaning of white space."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]
#: Unicode's white space with the four separators of ASCII, inside a character class.
WHITE = r"\s\x1c-\x1f"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def program(x: Column, steps: Sequence[Step]) -> Column:
    """The steps one after the other over a text, each of which may name its text as often as it likes. They are the
    branches of one fold: the expression is as deep as its deepest step, not as all of them."""

    def run(t: Column, k: Column) -> Column:
        branches = F.when(k == 0, steps[0](t))
        for n, step in enumerate(steps[1:], 1):
            branches = branches.when(k == n, step(t))
        return branches

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), x, run)


def pattern(text: str, ignore_case: bool = False) -> str:
    r"""A regular expression over Unicode: ``\s`` is WHITE, only \n ends a line."""
    out, inside, i = [], False, 0
    while i < len(text):
        two = text[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(WHITE if inside else f"[{'^' if two == r'\S' else ''}{WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
        i += 2 if two[0] == "\\" else 1
    return f"(?d{'i' if ignore_case else ''}U)" + "".join(out)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, pattern(r"^\s+|\s+$").replace("$", r"\z"), "")


def words(x: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(x, pattern(r"\s+"), -1), lambda t: t != "")


def one_of(x: Column, listed: Iterable[str]) -> Column:
    """Is a text one of many? The list is one literal, however long."""
    return F.call_function("locate", F.concat(F.lit("\x00"), x, F.lit("\x00")), F.lit("\x00" + "\x00".join(listed) + "\x00")) > 0


def before(x: Column, first: str) -> Column:
    """The text before the first match of a pattern; all of it where there is none."""
    return F.split(x, first, 2)[0]


@functools.cache
def _forms() -> tuple[str, str, list[str], list[str], list[str], list[str]]:
    """By the Unicode tables: characters whose compatibility form is one character, and these; those that become
    several, and these; pairs of character and mark that are one character, and these."""
    one, ones, many, manys = [], [], [], []
    pairs: dict[str, str] = {}
    for p in range(0x110000):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        form = unicodedata.normalize("NFKC", c)
        if form != c:
            if len(form) == 1:
                one.append(c)
                ones.append(form)
            else:
                many.append(c)
                manys.append(form)
        apart = unicodedata.decomposition(c)
        if apart and apart[0] != "<" and " " in apart and form == c:
            pairs["".join(chr(int(x, 16)) for x in apart.split())] = c
    return "".join(one), "".join(ones), many, manys, list(pairs), list(pairs.values())


#: Anything but ASCII, common Chinese characters and kana, none of which has another form or is a mark.
_ODD = r"[^\x00-\x7f\x{4e00}-\x{9fff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}]"


def _looked_up(found: str, keys: list[str], values: list[str]) -> Step:
    """Each different match of ``found`` that is one of ``keys`` gives way to its value."""
    width = len(keys[0])
    listed, listed_values = F.lit("\x00" + "\x00".join(keys) + "\x00"), F.split(F.lit("\x00".join(values)), "\x00", -1)

    def value(k: Column) -> Column:
        at = F.call_function("locate", F.concat(F.lit("\x00"), k, F.lit("\x00")), listed)
        return F.when(at > 0, F.get(listed_values, F.floor((at - 1) / (width + 1)).cast("int"))).otherwise(k)

    def step(t: Column) -> Column:
        each = F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(found), F.lit(0))), t, lambda a, k: F.replace(a, k, value(k)))
        return F.when(t.rlike(_ODD), each).otherwise(t)

    return step


def nfkc_steps() -> tuple[Step, ...]:
    """The compatibility form of a text. Marks compose with what stands before them, up to three; marks that stand
    in another order than the canonical one stay so, and Hangul letters are not joined to syllables."""
    one, ones, many, manys, pairs, joined = _forms()
    marks = _looked_up("(?s)." + _ODD, pairs, joined)
    return (lambda t: F.translate(t, one, ones), _looked_up(_ODD, many, manys), marks, marks, marks)


def nfkc(x: Column) -> Column:
    return program(x, nfkc_steps())


def _running(x: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What an array of numbers comes to up to each place, itself included: in round k each place takes up what stands
    2**k places before, so that n numbers need n log n steps and no array grows."""

    def rounds(all_of: Column) -> Column:
        by = F.filter(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda by: by < F.size(all_of))
        more = lambda a, by: F.transform(a, lambda v, i: F.when(i >= by, combine(v, F.get(a, i - by))).otherwise(v))
        return F.aggregate(by, all_of, more)

    return let(x, rounds)


def running_sums(x: Column) -> Column:
    return _running(x, lambda a, b: a + b)


def running_max(x: Column) -> Column:
    return _running(x, F.greatest)


#: Characters of the blocks by which :func:`part` finds its place.
BLOCK = 4096


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, at: Column, n: Column) -> Column:
    """The ``n`` characters of a text (:func:`blocks`) from ``at`` on; what stands far before is not walked through."""
    first = F.floor(at / BLOCK).cast("int")
    last = F.floor((at + n - 1) / BLOCK).cast("int")
    whole = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(n > 0, F.substr(whole, at - first * BLOCK + 1, n)).otherwise(F.lit(""))


def places(gaps: Column, found: Column) -> Column:
    """Where each match starts, from what stands before each (``gaps``, one more than matches) and the matches."""
    sizes = F.transform(found, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))
    return F.zip_with(running_sums(sizes), found, lambda end, x: end - F.length(x))
