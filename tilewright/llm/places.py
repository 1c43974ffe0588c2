"""SQL text for places in whole texts, without a walk over the text or a copy of all results for each match."""

from __future__ import annotations

from collections.abc import Callable

#: Elements of one array accumulator, and code points of one block of a text.
PART, BLOCK = 256, 1024


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def plus(a: str, b: str) -> str:
    return f"{a} + {b}"


def larger(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def running(values: str, step: Callable[[str, str], str] = plus) -> str:
    """SQL for the running sum (or other ``step`` with identity 0) of an array<int>.

    An accumulator that is an array is copied at every element. So parts of ``PART`` elements are summed, then their
    totals: n values cost n * PART + (n / PART) ** 2 copied integers.
    """

    def fold(array: str) -> str:
        return f"aggregate({array}, cast(array() AS array<int>), (o, x) -> concat(o, array({step('coalesce(get(o, size(o) - 1), 0)', 'x')})))"

    parts = f"transform(sequence(0, cast((size(vs) - 1) DIV {PART} AS int)), j -> {fold(f'slice(vs, j * {PART} + 1, {PART})')})"
    totals = fold("transform(ps, p -> coalesce(get(p, size(p) - 1), 0))")
    whole = f"flatten(transform(ps, (p, j) -> transform(p, x -> {step('x', 'coalesce(get(ts, j - 1), 0)')})))"
    return let("vs", values, let("ps", parts, let("ts", totals, whole)))


def matches(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, v>>: the leftmost non-overlapping matches with their places, from the lengths of matches and gaps."""
    gaps = f"slice(split({text}, '{pattern}', -1), 1, size(found))"
    ends = running(f"zip_with(found, {gaps}, (m, g) -> length(g) + length(m))")
    return let("found", f"regexp_extract_all({text}, '{pattern}', 0)", f"zip_with(found, {ends}, (m, e) -> named_struct('s', e - length(m), 'e', e, 'v', m))")


def blocks(text: str) -> str:
    """SQL for the text as an array of blocks, for ``cut``."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut(array: str, at: str, n: str) -> str:
    """SQL for n code points from place ``at`` of a text in blocks."""
    within = f"slice({array}, cast(({at}) DIV {BLOCK} AS int) + 1, cast(({at} + {n}) DIV {BLOCK} - ({at}) DIV {BLOCK} AS int) + 1)"
    return f"substring(array_join({within}, ''), ({at}) % {BLOCK} + 1, {n})"


def replaced(text: str, spans: str, fill: str) -> str:
    """SQL for the text with ``fill`` in place of each span x of an array sorted by x.s.

    ``fill`` is SQL over x and p, the end of the spans before x; it also covers what lies between p and x.s, for which
    it can use ``gap()``.
    """
    last = "coalesce(get(tops, size(tops) - 1), 0)"
    each = f"transform({spans}, (x, i) -> {let('p', 'coalesce(get(tops, i - 1), 0)', fill)})"
    body = f"array_join(concat({each}, array({cut('bs', last, f'(length({text}) - {last})')})), '')"
    return let("bs", blocks(text), let("tops", running(f"transform({spans}, x -> x.e)", larger), body))


def gap() -> str:
    return f"CASE WHEN x.s > p THEN {cut('bs', 'p', '(x.s - p)')} ELSE '' END"
