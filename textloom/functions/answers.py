"""Rules of answer formats as SQL fragments, shared by the filter chain and the format queries."""

from __future__ import annotations

from .dialect import Dialect


def json_tail(d: Dialect, text: str) -> str:
    return f"regexp_extract({text}, {d.rx(r'[{\[][\s\S]*$')}, 0)"


def json_valid(d: Dialect, text: str) -> str:
    """Whether what stands from the first bracket on parses to its end."""
    tail = json_tail(d, text)
    # Spark's parser stops after the first value; what follows it shows when the text stands inside a list and an object.
    listed, keyed = f"try_parse_json(concat('[', {tail}, ']'))", f"try_parse_json(concat('{{\"v\": ', {tail}, ', \"end\": 1}}'))"
    strict = f"{listed} IS NOT NULL AND try_variant_get({listed}, '$[1]', 'variant') IS NULL AND try_variant_get({keyed}, '$.end', 'int') = 1"
    return f"({tail} <> '' AND {f'coalesce({strict}, false)' if d.spark else f'coalesce(json_valid({tail}), false)'})"


def table_valid(d: Dialect, lines: str) -> str:
    """Two lines of cells at least, one of them a rule."""
    cells = d.keep(lines, "x", d.matches("x", "^[|]"))
    return f"({d.size(cells)} >= 2 AND {d.size(d.keep(cells, 'x', d.matches('x', '^[|: -]+$')))} >= 1)"


def list_valid(d: Dialect, lines: str) -> str:
    return f"({d.size(d.keep(lines, 'x', d.matches('x', '^[0-9]+[.)] +')))} >= 1)"
