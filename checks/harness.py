"""Oracle SQL helpers: adapters as common table expressions and rounding on the DuckDB side."""

from __future__ import annotations

import re

from counterloom.sources.adapters import ADAPTERS, BASE_TABLES, with_dependencies


class _Names(dict):
    def __missing__(self, key):
        return key


def with_adapters(sql: str) -> str:
    """Prepend the adapters a statement names, each under its own name."""
    used = [n for n in ADAPTERS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} as ({ADAPTERS[n].format_map(_Names())})" for n in with_dependencies(used)]
    body = sql.strip()
    if body.lower().startswith("with "):
        body = body[5:]
        return "with " + ",\n".join([*ctes, body]) if ctes else sql
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


def r0(x: str) -> str:
    return f"cast(sign({x}) * floor(abs({x}) + 0.5) as bigint)"


def rn(x: str, digits: int) -> str:
    scale = f"{10**digits}.0"
    return f"(sign({x}) * floor(abs(cast({x} as double)) * {scale} + 0.5) / {scale})"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 1000000.0)"


def rate(delta: str, elapsed: str, per: int) -> str:
    return r0(f"(cast(({delta}) * {per} as double) / nullif({elapsed}, 0))")


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def pretty_size(x: str) -> str:
    def unit(p: int, name: str) -> str:
        return f"cast({r0(f'(abs({x}) / {float(1024**p)})')} as varchar) || ' {name}'"

    return (
        f"case when {x} < 0 then '-' else '' end || case when abs({x}) <= 1024 then cast(abs({x}) as varchar) || ' B' "
        + "".join(f"when abs({x}) < {10 * 1024 ** (p + 1)} then {unit(p, n)} " for p, n in ((1, "kB"), (2, "MB"), (3, "GB")))
        + f"else {unit(4, 'TB')} end"
    )


def pretty_count(x: str) -> str:
    def unit(p: int, name: str) -> str:
        return f"printf('%.1f', {rn(f'(abs({x}) / {float(1000**p)})', 1)}) || ' {name}'"

    return (
        f"case when {x} < 0 then '-' else '' end || case when abs({x}) <= 1000 then cast(abs({x}) as varchar) "
        f"when abs({x}) < 1000000 then {unit(1, 'K')} when abs({x}) < 1000000000 then {unit(2, 'M')} else {unit(3, 'B')} end"
    )


def pretty_ms(x: str) -> str:
    x = f"cast({x} as double)"
    sec = f"cast(floor({x} / 1000) as bigint)"
    mins = f"({sec} // 60)"
    hours = f"({mins} // 60)"
    whole = f"cast(floor({x}) as bigint)"
    return (
        f"case when {x} < 1 then cast(cast(floor({x} * 1000) as bigint) as varchar) || 'μs' "
        f"when {sec} = 0 then cast({whole} as varchar) || 'ms' "
        f"when {mins} = 0 then printf('%.1f', {rn(f'({whole} / 1000.0)', 1)}) || 's' "
        f"when {hours} = 0 then cast({mins} as varchar) || 'm ' || cast({r0(f'({whole} / 1000.0 - {mins} * 60)')} as varchar) || 's' "
        f"else cast({hours} as varchar) || 'h ' || cast({mins} % 60 as varchar) || 'm ' || cast({sec} % 60 as varchar) || 's' end"
    )


__all__ = ["BASE_TABLES", "big", "pretty_count", "pretty_ms", "pretty_size", "r0", "rate", "rn", "secs", "with_adapters"]
