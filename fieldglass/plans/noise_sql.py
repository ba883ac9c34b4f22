"""SQL of the corruptions: what each noise query must return, in DuckDB's dialect.

Every statement follows the definition of its corruption in operators/noise.py: `u` is the hash of the key that a choice is
made by. Statements start from `f` (id, raw_text) and `l` (id, i, line), the lines numbered from 0.
"""

from __future__ import annotations

from ..operators import domains, noise

LF = "chr(10)"


def u(*parts: str) -> str:
    """SQL of functions.text.uniform: parts are SQL strings."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS UBIGINT) / 4294967296.0)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def below(n: str, *parts: str) -> str:
    return f"CAST(floor({u(*parts)} * ({n})) AS INT)"


def pick(pool: str, *parts: str) -> str:
    return f"({pool})[{below(f'len({pool})', *parts)} + 1]"


def lines(source: str = "f") -> str:
    return f"l AS (SELECT id, i - 1 AS i, string_split(raw_text, {LF})[i] AS line FROM {source}, unnest(range(1, 5)) AS x(i))"


TEXT = f"string_agg(line, {LF} ORDER BY i) AS text"
I = "CAST(i AS VARCHAR)"
HEAD, TAIL = "left(line, instr(line, ':'))", "trim(substr(line, instr(line, ':') + 1))"
LINES = f"(SELECT id, list(line ORDER BY i) AS a FROM l GROUP BY id)"


def at_line(tag: str, new: str, where: str = "true", *salt: str) -> str:
    """One line of those that `where` holds for is replaced by `new`."""
    spots = f"(SELECT id, list(i ORDER BY i) FILTER ({where}) AS spots FROM l GROUP BY id)"
    at = pick("spots", "id", q(tag), *salt)
    return f"p AS (SELECT id, {at} AS spot FROM {spots}) SELECT l.id AS id, string_agg(CASE WHEN i = spot THEN {new} ELSE line END, {LF} ORDER BY i) AS text FROM l JOIN p USING (id) GROUP BY l.id"


def char_sub() -> str:
    near = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in noise.NEARBY.items()) + "}"
    out, before = [], "l"
    for turn in ("1", "2"):
        spots = "list_filter(range(1, length(line) + 1), lambda p: p > instr(line, ':') AND regexp_matches(substr(line, p, 1), '[A-Za-z]'))"
        key = ("id", q("char_sub"), I, q(turn))
        new = f"substr({near}[lower(c)], {below(f'length({near}[lower(c)])', *key, q('to'))} + 1, 1)"
        ok = "spot IS NULL" if turn == "1" else f"spot IS NULL OR {below('2', 'id', q('char_sub'), q('n'))} = 0"
        out.append(f"a{turn} AS (SELECT id, i, line, {spots} AS spots FROM {before}), b{turn} AS (SELECT id, i, line, {pick('spots', *key)} AS spot FROM a{turn}), c{turn} AS (SELECT *, substr(line, spot, 1) AS c FROM b{turn})")
        out.append(f"s{turn} AS (SELECT id, i, CASE WHEN {ok} THEN line ELSE left(line, spot - 1) || CASE WHEN regexp_matches(c, '[A-Z]') THEN upper({new}) ELSE {new} END || substr(line, spot + 1) END AS line FROM c{turn})")
        before = f"s{turn}"
    return ", ".join(out) + f" SELECT id, {TEXT} FROM s2 GROUP BY id"


def _inner(tag: str, holds: str, new: str) -> str:
    spots = f"list_filter(range(greatest(2, instr(line, ':') + 1), length(line)), lambda p: regexp_matches(substr(line, p - 1, 3), '{holds}'))"
    return f"a AS (SELECT id, i, line, {spots} AS spots FROM l), b AS (SELECT id, i, line, {pick('spots', 'id', q(tag), I)} AS spot FROM a) SELECT id, string_agg(CASE WHEN spot IS NULL THEN line ELSE {new} END, {LF} ORDER BY i) AS text FROM b GROUP BY id"


def char_del() -> str:
    return _inner("char_del", "^[^ ][A-Za-z][^ ]$", "left(line, spot - 1) || substr(line, spot + 1)")


def char_transpose() -> str:
    return _inner("char_transpose", "^.?[A-Za-z][A-Za-z]$", "left(line, spot - 1) || substr(line, spot + 1, 1) || substr(line, spot, 1) || substr(line, spot + 2)")


def merged_lines() -> str:
    spots = "list_filter(range(len(a) - 1), lambda k: trim(a[k + 1]) <> '' AND trim(a[k + 2]) <> '')"
    join = "list_concat(list_concat(a[1:spot], [a[spot + 1] || ' ' || a[spot + 2]]), a[spot + 3:])"
    out, before = [f"m0 AS {LINES}"], "m0"
    for turn in ("1", "2"):
        ok = "spot IS NULL" if turn == "1" else f"spot IS NULL OR {below('2', 'id', q('merged_lines'), q('n'))} = 0"
        out.append(f"n{turn} AS (SELECT id, a, {pick(spots, 'id', q('merged_lines'), q(turn))} AS spot FROM {before}), m{turn} AS (SELECT id, CASE WHEN {ok} THEN a ELSE {join} END AS a FROM n{turn})")
        before = f"m{turn}"
    return ", ".join(out) + f" SELECT id, array_to_string(a, {LF}) AS text FROM m2"


def split_line() -> str:
    words = f"regexp_split_to_array({TAIL}, '\\s+')"
    cut = f"(1 + {below(f'len({words}) - 1', 'l.id', q('split_line'), q('at'))})"
    new = f"{HEAD} || ' ' || array_to_string(({words})[1:{cut}], ' ') || {LF} || array_to_string(({words})[{cut} + 1:], ' ')"
    return at_line("split_line", new, f"regexp_matches({TAIL}, '\\S\\s+\\S')")


def key_abbrev() -> str:
    short = {f.labels[0].lower(): [v for v in f.labels[1:] if len(v) <= len(f.labels[0])] for f in domains.fields("receipts")}
    known = "MAP {" + ", ".join(f"{q(k)}: {listed(v)}" for k, v in short.items() if v) + "}"
    low, high = domains.NOISE_RATES["key_abbrev"]
    rate = f"({low} + {u('id', q('key_abbrev'), q('rate'))} * ({high} - {low}))"
    name = f"{known}[lower(trim(left(line, instr(line, ':') - 1)))]"
    new = f"{pick(name, 'id', q('key_abbrev'), I, q('to'))} || substr(line, instr(line, ':'))"
    return f"k AS (SELECT id, i, CASE WHEN {u('id', q('key_abbrev'), I)} < {rate} AND {name} IS NOT NULL THEN {new} ELSE line END AS line FROM l) SELECT id, {TEXT} FROM k GROUP BY id"


def delimiter_swap() -> str:
    to = pick(listed(noise.DELIMITERS), "id", q("delimiter_swap"), I, q("to"))
    new = f"regexp_extract(line, '^([^:]*?)\\s*:\\s*(.*)$', 1) || {to} || regexp_extract(line, '^([^:]*?)\\s*:\\s*(.*)$', 2)"
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {u('id', q('delimiter_swap'), I)}, i) AS r FROM l), k AS (SELECT id, i, CASE WHEN r <= 1 + {below('2', 'id', q('delimiter_swap'), q('n'))} THEN {new} ELSE line END AS line FROM r) SELECT id, {TEXT} FROM k GROUP BY id"


def num_decimal_shift() -> str:
    """The form has one decimal number at most, of two decimals."""
    number = "regexp_extract(raw_text, '\\b\\d+\\.\\d+\\b')"
    up = f"{u('id', q('num_decimal_shift'), q('0'))} >= 0.5"
    moved = f"CASE WHEN {up} THEN CAST(CAST({number} AS DECIMAL(18, 2)) * 10 AS DECIMAL(18, 2)) ELSE CAST(round(CAST({number} AS DECIMAL(18, 2)) * 0.1, 2) AS DECIMAL(18, 2)) END"
    return f"n AS (SELECT id, raw_text, {number} AS x, CASE WHEN {number} <> '' THEN CAST({moved} AS VARCHAR) END AS y FROM f) SELECT id, CASE WHEN x = '' THEN raw_text ELSE replace(raw_text, x, y) END AS text FROM n"


#: The patterns of noise.DATE_TARGETS for strftime, in the same order.
DATES = ["%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d-%b-%Y", "%d%m%Y", "%m-%d-%y", "%d/%m/%y"]


def date_format_vary() -> str:
    """The form's date is day/month/year; what its new notation is decides which later notations match again: the third target
    is the second source, the last is the fourth, read with a year of this century."""
    which = lambda n: below("7", "id", q("date_format_vary"), q(n), q("0"))
    shown = lambda day, w: f"([{', '.join(f'strftime({day}, {q(d)})' for d in DATES)}])[{w} + 1]"
    a = f"a AS (SELECT id, raw_text, day, {which('0')} AS w FROM f), b AS (SELECT *, CASE WHEN w = 2 THEN {which('1')} ELSE w END AS v FROM a)"
    late = "make_date(2000 + year(day) % 100, month(day), day(day))"
    return f"{a} SELECT id, replace(raw_text, strftime(day, '%d/%m/%Y'), CASE WHEN v = 6 THEN {shown(late, which('3'))} ELSE {shown('day', 'v')} END) AS text FROM b"


def date_partial() -> str:
    shown = "strftime(day, '%d/%m/%Y')"
    at = pick("[1, 2, 4, 5, 7, 8, 9, 10]", "id", q("date_partial"), q("digit"))
    return f"a AS (SELECT id, raw_text, {shown} AS d, {at} AS spot FROM f) SELECT id, replace(raw_text, d, left(d, spot - 1) || translate(substr(d, spot, 1), '0815', 'OBlS') || substr(d, spot + 1)) AS text FROM a"


def scrambled(value: str, key: str, tag: str) -> str:
    """SQL of noise.scramble."""
    offset = f"([{', '.join(map(str, noise.OFFSETS))}])[{below(str(len(noise.OFFSETS)), key, q(tag), q('offset'))} + 1]"
    number = f"TRY_CAST(replace({value}, ',', '') AS DOUBLE)"
    digits = f"list_filter(range(1, length({value}) + 1), lambda p: regexp_matches(substr({value}, p, 1), '[0-9]'))"
    at = pick(digits, key, q(tag), q("digit"))
    digit = f"CAST((CAST(substr({value}, {at}, 1) AS INT) + 1 + {below('5', key, q(tag), q('plus'))}) % 10 AS VARCHAR)"
    mid = f"list_sort(list_transform(range(greatest(length({value}) - 2, 0)), lambda k: {{'o': {u(key, q(tag), q('mid'), 'CAST(k AS VARCHAR)')}, 'c': substr({value}, CAST(k AS INT) + 2, 1)}}))"
    return (
        f"CASE WHEN regexp_full_match(replace({value}, ' ', ''), '[0-9,.]+') AND {number} IS NOT NULL THEN CAST(CAST(trunc({number} + {offset}) AS BIGINT) AS VARCHAR) "
        f"WHEN regexp_matches({value}, '^[0-9]{{2}}[/-][0-9]{{2}}[/-][0-9]{{2,4}}') THEN left({value}, {at} - 1) || {digit} || substr({value}, {at} + 1) "
        f"WHEN length({value}) > 4 THEN left({value}, 1) || array_to_string(list_transform({mid}, lambda s: s.c), '') || right({value}, 1) ELSE {value} || 'X' END"
    )


def ghost_value() -> str:
    return at_line("ghost_value", f"{HEAD} || ' ' || {scrambled(TAIL, 'l.id', 'ghost_value')}", "true", q("line"))


def conflicting_field() -> str:
    at = below("len(a)", "id", q("conflicting_field"), q("line"))
    to = below("len(a) - spot", "id", q("conflicting_field"), q("to"))
    new = f"{HEAD} || ' ' || {scrambled(TAIL, 'id', 'conflicting_field')}"
    return f"m AS {LINES}, n AS (SELECT id, a, {at} AS spot FROM m), w AS (SELECT id, a, a[spot + 1] AS line, spot + 1 + {to} AS k FROM n) SELECT id, array_to_string(list_concat(list_concat(a[1:k], [{new}]), a[k + 1:]), {LF}) AS text FROM w"


def section_erase() -> str:
    n = f"(2 + {below('3', 'id', q('section_erase'), q('n'))})"
    at = below(f"4 - {n} + 1", "id", q("section_erase"), q("at"))
    new = f"{HEAD} || ' ' || {pick(listed(noise.ERASED), 'id', q('section_erase'), I)}"
    return f"e AS (SELECT id, i, CASE WHEN i >= {at} AND i < {at} + {n} THEN {new} ELSE line END AS line FROM l) SELECT id, {TEXT} FROM e GROUP BY id"


STATEMENTS = {f.__name__: f for f in (char_sub, char_del, char_transpose, merged_lines, split_line, key_abbrev, delimiter_swap, num_decimal_shift, date_format_vary, date_partial, ghost_value, conflicting_field, section_erase)}


def statement(tag: str, form: str) -> str:
    """The whole statement over `form`, which gives f (id, raw_text, day)."""
    return f"WITH {form}, {lines()}, {STATEMENTS[tag]()}" if tag not in ("num_decimal_shift", "date_format_vary", "date_partial") else f"WITH {form}, {STATEMENTS[tag]()}"
