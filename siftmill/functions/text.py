"""Translation of configuration expressions to Spark SQL at configuration level."""

from __future__ import annotations

import re

# Strptime fields and their Spark pattern letters.
TIME_FIELDS = {"%Y": "yyyy", "%m": "MM", "%d": "d", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss"}


def spark_pattern(strptime: str) -> str:
    """``%b-%Y`` becomes ``MMM-yyyy``."""
    out = strptime
    for field, letters in TIME_FIELDS.items():
        out = out.replace(field, letters)
    return out


def spark_expression(text: str) -> str:
    """Rewrite the few dialect forms used in task configurations.

    ``strptime(x, 'fmt')`` -> ``try_to_timestamp(x, 'pattern')``, ``strftime(x, 'fmt')`` ->
    ``date_format``, ``x::type`` -> ``cast(x as type)`` for a name or literal, ``to_days(n)`` ->
    ``make_dt_interval(n)``.
    """
    def swap(name):
        return lambda m: f"{name}{m.group(1)}'{spark_pattern(m.group(2))}')"

    out = re.sub(r"\bstrptime(\(.*?,\s*)'([^']*)'\)", swap("try_to_timestamp"), text)
    out = re.sub(r"\bstrftime(\(.*?,\s*)'([^']*)'\)", swap("date_format"), out)
    out = re.sub(r"([A-Za-z_]\w*|'[^']*')::(\w+)", lambda m: f"cast({m.group(1)} as {'string' if m.group(2).lower() == 'varchar' else m.group(2)})", out)
    return re.sub(r"\bto_days\(", "make_dt_interval(", out)


def identifiers(expression: str) -> list[str]:
    """Names used in an expression, in order of appearance, string literals left out."""
    return re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", expression))
