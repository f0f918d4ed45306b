"""Text functions shared by all others.

Regular expressions are ASCII (\\w, \\s, \\b), and with (?d) only a line feed ends a line, so results agree with SQL engines that use RE2.
Columns built inside ``with unicode_classes():`` read these classes as Unicode does: a no-break space is white space there.
Places are code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

# Window width and stride in characters, the shape of a word, and words that say nothing.
WINDOW, STRIDE = 1600, 800
WORD = r"[a-z][a-z\-']{2,}"
STOP_WORDS = tuple(
    """the and for any all such that this with shall are not but its his her
their which have has had was were been being from into upon under over more most other
than then them they there these those you your our ous will would may can could should
each either neither both same very much many few less least also only just even still
per pursuant hereof hereto herein hereby thereof thereto therein whereas provided
agreement party parties section article exhibit schedule date dates day days""".split()
)


_UNICODE = ContextVar("unicode_classes", default=False)


@contextmanager
def unicode_classes() -> Iterator[None]:
    """Character classes of the expressions built inside are Unicode's."""
    before = _UNICODE.set(True)
    try:
        yield
    finally:
        _UNICODE.reset(before)


def rx(pattern: str) -> str:
    return "(?U)" + pattern if _UNICODE.get() else pattern


def extract(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, rx(pattern), group)


def extract_all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, rx(pattern), by)


def split(text: Column, pattern: str, limit: int = -1) -> Column:
    return F.split(text, rx(pattern), limit)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it (a repeated expression is repeated in the generated code)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` knows spaces only)."""
    return replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(replace(text, r"\s+", " "))


def or_null(text: Column) -> Column:
    """Null for an empty text: what regexp_extract gives without a match."""
    return F.nullif(text, F.lit(""))


def key_of(name: Column) -> Column:
    """A category's key: lower case, letters, digits and spaces only."""
    return F.trim(replace(F.lower(name), r"[^\p{L}\p{N} ]", ""))


def plain_key(name: str) -> str:
    """``key_of`` for a name on the driver."""
    return "".join(c for c in name.lower() if c.isalnum() or c == " ").strip()


def stem(name: Column) -> Column:
    """A file name without .pdf, in either case."""
    return replace(name, r"(?i)\.pdf$", "")


def strip_prefix(value: Column) -> Column:
    """A cell without its leading ``Label:``."""
    return strip(replace(value, r"^[A-Za-z ()incl.]+:\s*", ""))


def word_set(text: Column) -> Column:
    """Distinct words of three letters and more, in lower case, without stop words."""
    return F.array_except(extract_all(F.lower(text), WORD, 0), F.lit(list(STOP_WORDS)))


def window_starts(text: Column) -> Column:
    """Starts of overlapping windows; an empty text has one."""
    return F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(STRIDE))


def needle(text: Column, size: int = 60) -> Column:
    return F.left(squeeze(text), F.lit(size))


#: Set around matches; where a text has the first itself, the second stands for it, which no pattern tells from it.
MARK, OTHER = "\x01", "\x02"


def marked(text: Column, pattern: str, by: str, most: int | None = None) -> Column:
    """Gap, match, gap, …, match, gap of a text in one pass, matches rewritten as ``by`` says; with ``most`` the last gap is all that follows so many matches."""
    return F.split(replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), pattern, MARK + by + MARK), MARK, -1 if most is None else 2 * most + 1)


def matches(text: Column, pattern: str, most: int | None = None) -> Column:
    """All matches (none empty), or the first ones, as an array of (start, end, found)."""
    none = F.array().cast("array<struct<start: int, end: int, found: string>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("found")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return let(marked(text, pattern, "$0", most), lambda parts: F.when(F.size(parts) == 1, none).otherwise(F.aggregate(parts, zero, step, lambda acc: acc["out"])))


def holds(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a text in lower case has all the words that a pattern can't match without. Unicode's classes match more letters than these: there every text passes."""
    if _UNICODE.get() or not words:
        return low.isNotNull()
    return reduce(and_, (F.contains(low, F.lit(w)) for w in words))


def any_of(names: Iterable[str]) -> str:
    """An alternation that tries names in their order, by first letters: a place where none begins costs a try a letter, not one a name."""
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(name[0].lower(), []).append(name)
    inner = lambda rest: any_of(rest) if len(rest) > 3 and all(rest) else "(?:" + "|".join(rest) + ")"
    return "(?:" + "|".join(g[0] if len(g) == 1 else first + inner([n[1:] for n in g]) for first, g in groups.items()) + ")"


def first_of(items: Column, f) -> Column:
    """The first text other than null that f gives over an array; f isn't asked after it."""
    return F.aggregate(items, F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).otherwise(f(x)))
