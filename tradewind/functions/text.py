"""Number formats used in tiles, prose and summaries.

Each takes the SQL of a DOUBLE (usually a column name) and gives the SQL of
its text; wrap it in ``F.expr``.
"""

from __future__ import annotations

from .numeric import digits_of

# Fixed value: text shown where a number is not computable.
NOT_AVAILABLE = "n/a"


def quoted(words: str) -> str:
    """A SQL string literal."""
    escaped = words.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def or_not_available(shown: str) -> str:
    return f"coalesce({shown}, {quoted(NOT_AVAILABLE)})"


def _digits(value: str, digits: int, thousands: bool = False) -> str:
    """Unsigned fixed-point text of ``|value|``."""
    return digits_of(f"abs(double({value}))", digits, thousands)


def _with_sign(value: str, plus: str, minus: str, body: str) -> str:
    return f"concat(if({value} < 0, '{minus}', '{plus}'), {body})"


def fixed(value: str, digits: int = 0) -> str:
    """``12.3``, ``-1234``; NULL stays NULL."""
    return _with_sign(value, "", "-", _digits(value, digits))


def number(value: str, digits: int = 0) -> str:
    """Fixed digits with thousands separators."""
    return or_not_available(_with_sign(value, "", "-", _digits(value, digits, thousands=True)))


def signed(value: str, digits: int = 1) -> str:
    """``+1.2`` or ``-0.5``; NULL stays NULL."""
    return _with_sign(value, "+", "-", _digits(value, digits))


def signed_pct(value: str) -> str:
    return or_not_available(f"concat({signed(value, 1)}, '%')")


def currency(value: str) -> str:
    return or_not_available(_with_sign(value, "$", "-$", _digits(value, 0, thousands=True)))


def share(value: str) -> str:
    """A fraction as whole percent; NULL stays NULL."""
    return f"concat({fixed(f'({value} * 100D)', 0)}, '%')"
