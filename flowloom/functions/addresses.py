"""Canonical text of IPv4, IPv6 and IPv4-mapped IPv6 addresses.

Built from SQL string and array functions only, so a whole table is normalised in
the scan stage: no Python, no shuffle and no join back. The SQL is put together
from small named pieces; each takes and returns SQL text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL_V4 = "^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.](?!$)|$)){4}$"
DOTTED = "^[0-9]{1,3}([.][0-9]{1,3}){3}$"
DOTTED_TAIL = "[0-9]+[.][0-9.]+$"
GROUP = "^[0-9a-f]{1,4}$"

_names = count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """`body` over a name bound to `value`, which is evaluated once per row."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _octets(text: str) -> str:
    """The four numbers of a dotted quad; NULL when it is not one."""
    numbers = f"transform(split({text}, '[.]'), part -> try_cast(part AS int))"
    return _let(
        f"IF({text} RLIKE '{DOTTED}', {numbers}, NULL)",
        lambda n: f"IF(forall({n}, octet -> octet <= 255), {n}, NULL)",
    )


def _dotted(octets: str) -> str:
    return f"array_join(transform({octets}, octet -> CAST(octet AS string)), '.')"


def _hex_pair(octets: str, at: int) -> str:
    """Two octets as one hexadecimal group."""
    return f"lower(hex({octets}[{at}] * 256 + {octets}[{at + 1}]))"


def _without_dotted_tail(text: str) -> str:
    """IPv6 text whose dotted tail is rewritten as the last two groups."""
    rewritten = _let(
        _octets(f"regexp_substr({text}, '{DOTTED_TAIL}')"),
        lambda n: f"concat(regexp_replace({text}, '{DOTTED_TAIL}', ''), "
        f"{_hex_pair(n, 0)}, ':', {_hex_pair(n, 2)})",
    )
    return f"IF(contains({text}, '.'), {rewritten}, {text})"


def _groups(text: str) -> str:
    """The eight groups of an IPv6 text without leading zeros; NULL when malformed."""

    def side(at: int) -> str:
        pieces = f"split(coalesce(get(split({text}, '::'), {at}), ''), ':')"
        return f"filter({pieces}, piece -> piece != '')"

    def fill(both: str) -> str:
        missing = f"(8 - size({both}.l) - size({both}.r))"
        # An empty piece next to a single ':' is malformed; only '::' may make one.
        dangling = f"{text} RLIKE '^:[^:]|[^:]:$|:::|::.*::'"
        sound = f"IF(contains({text}, '::'), {missing} >= 1, {missing} = 0)"
        filled = f"concat({both}.l, array_repeat('0', {missing}), {both}.r)"
        return f"IF({sound} AND NOT {dangling}, {filled}, NULL)"

    return _let(
        _let(f"named_struct('l', {side(0)}, 'r', {side(1)})", fill),
        lambda groups: f"IF(forall({groups}, g -> g RLIKE '{GROUP}'), "
        f"transform({groups}, g -> regexp_replace(g, '^0+(?=.)', '')), NULL)",
    )


def _compressed(groups: str) -> str:
    """Groups joined by ':', the first longest run of two or more zeros as '::'."""

    def squeeze(text: str) -> str:
        cases = []
        for run in range(8, 1, -1):
            zeros = f"(?::0){{{run}}}(?::|$)"
            squeezed = f"regexp_replace({text}, '^(.*?){zeros}(.*)$', '$1::$2')"
            cases.append(f"WHEN {text} RLIKE '{zeros}' THEN {squeezed}")
        return f"CASE {' '.join(cases)} ELSE {text} END"

    joined = f"concat(':', array_join({groups}, ':'))"
    return f"regexp_replace({_let(joined, squeeze)}, '^:(?!:)', '')"


def _mapped(groups: str) -> str:
    """Dotted quad of ::ffff:a.b.c.d; NULL for any other address."""
    numbers = [f"CAST(conv({groups}[{at}], 16, 10) AS int)" for at in (6, 7)]
    octets = ", ".join(f"{n} div 256, {n} % 256" for n in numbers)
    prefix = f"array_join(slice({groups}, 1, 6), ':')"
    return f"IF({prefix} = '0:0:0:0:0:ffff', concat_ws('.', {octets}), NULL)"


def canonical_ip_sql(address: str) -> str:
    """SQL of the canonical text of an address given as SQL."""

    def canonical(text: str) -> str:
        v6 = _let(
            _without_dotted_tail(text),
            lambda flat: _let(
                _groups(flat),
                lambda groups: f"IF({groups} IS NULL, NULL, "
                f"coalesce({_mapped(groups)}, {_compressed(groups)}))",
            ),
        )
        return f"IF(contains({text}, ':'), {v6}, {_let(_octets(text), _dotted)})"

    # Most addresses are plain IPv4 already and take the short way.
    spelled = _let(f"lower(trim({address}))", canonical)
    return f"IF({address} RLIKE '{CANONICAL_V4}', {address}, {spelled})"


def canonical_ip(column: str) -> Column:
    """Canonical address text of a column; NULL when the text is not an address.

    IPv4 loses leading zeros, IPv6 follows RFC 5952, and an IPv4-mapped IPv6
    address prints as plain IPv4.
    """
    return F.expr(canonical_ip_sql(column))


def normalize_ips(packets: DataFrame, columns: Iterable[str] = ("src_ip", "dst_ip")) -> DataFrame:
    """Packets with canonical address text in the given columns."""
    return packets.withColumns({name: canonical_ip(name) for name in columns})
