"""Column helpers for work inside a row: let-bindings, words, keys of texts, running totals and pieces of texts; all built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Elements that one step of a running total copies at most, and code points of a text's block.
STEP, BLOCK = 64, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; a plain column would be inlined into every lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that is not null."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def has_word(text: Column) -> Column:
    return F.translate(text, BLANKS, "") != ""


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: the chance that any two of 5 * 10**10 texts share them is under 10**-16."""
    return F.unhex(F.md5(text))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For an int array that isn't empty: 0, then the running results of `add` (from 0), one more than there are values.

    Arrays are copied in steps of STEP elements and once for each step, so long arrays stay cheap.
    """

    def run(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda done, v: F.concat(done, F.array(add(F.element_at(done, -1), v))))

    def joined(parts: Column) -> Column:
        # parts[b] starts from 0; what came before a part is put onto each of its results.
        before = run(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(before, lambda b: F.concat(F.array(F.lit(0)), F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 2, STEP), lambda v: add(F.get(b, i), v))))))

    steps = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda i: F.slice(x, i * STEP + 1, STEP))
    return let(let(values, lambda x: F.transform(steps(x), run)), joined)


def blocks(text: Column) -> Column:
    """A text as an array of BLOCK code points each, for piece()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points start .. end of the text that blocks() has cut; a substring of a long text would be counted from its start."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), start % BLOCK + 1, F.least(end - start, F.lit(BLOCK)))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.get(blocks, last), F.lit(1), end - last * BLOCK)
    return F.when(start >= end, "").when(first == last, head).otherwise(F.concat(head, middle, tail))
