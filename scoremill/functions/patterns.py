"""Name filters: plain strings match exactly, regular expressions match anywhere.

Regular expressions run in Spark (Java dialect), so use explicit character classes and
avoid look-around when a filter must mean the same in other engines.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Filter = str | re.Pattern


# Syntax that only Python has, or that means something else in Java.
FOREIGN = re.compile(r"\(\?(?:P[<=>]|#|\(|[imsLux]*[aLux])|(?<!\\)(?:\\\\)*\\[ZNg]|\{,")
FLAGS = {re.IGNORECASE: "i", re.MULTILINE: "m", re.DOTALL: "s"}


def compile_filter(text: str) -> Filter:
    """A text is a regular expression when escaping it would change it.

    ``mmlu:mc`` stays an exact name, ``gen-no-jp`` and ``click.*`` become patterns
    (a hyphen, dot or space is enough).
    """
    return re.compile(text) if re.escape(text) != text else text


def compile_filters(texts: Sequence[str]) -> list[Filter]:
    return [compile_filter(text) for text in texts]


def matches(value: str, filters: Sequence[Filter]) -> bool:
    """Driver-side twin of :func:`matches_any`, for names known to the driver."""
    return any(f.search(value) is not None if isinstance(f, re.Pattern) else f == value for f in filters)


def matches_any(col: Column | str, filters: Sequence[Filter]) -> Column:
    """True where the name equals a string filter or contains a match of a pattern filter.

    No filters match nothing.
    """
    col = F.col(col) if isinstance(col, str) else col
    exact, tests = [], []
    for f in filters:
        if isinstance(f, str):
            exact.append(f)
        elif isinstance(f, re.Pattern):
            tests.append(col.rlike(_java_pattern(f)))
        else:
            raise ValueError(f"a filter is a string or a compiled pattern, not {f!r}")
    if exact:
        tests.insert(0, col.isin(*exact))
    if not tests:
        return F.lit(False)
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def _java_pattern(pattern: re.Pattern) -> str:
    """The pattern in Spark's dialect; syntax and flags that it would read otherwise are refused."""
    if found := FOREIGN.search(pattern.pattern):
        raise ValueError(f"{found[0]!r} in pattern {pattern.pattern!r} cannot run in Spark")
    if other := pattern.flags & ~sum(FLAGS) & ~re.UNICODE:
        raise ValueError(f"flags {re.RegexFlag(other)!r} of pattern {pattern.pattern!r} cannot run in Spark")
    flags = "".join(letter for flag, letter in FLAGS.items() if pattern.flags & flag)
    return f"(?{flags}){pattern.pattern}" if flags else pattern.pattern
