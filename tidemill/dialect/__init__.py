"""MySQL text to Spark SQL: operators and functions whose spelling or meaning differs.

A tokenizer splits the text, so quoted strings and identifiers are never touched. What
Spark reads as it stands is passed on; planning and optimising stay with Catalyst.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemill.dialect import builders
from tidemill.functions.dates import _PATTERNS, composite_interval

_TOKEN = re.compile(
    r"(?P<hint>/\*\+.*?\*/)|(?P<comment>/\*.*?\*/|--[^\n]*|\#[^\n]*)|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")|(?P<name>`[^`]*`|[A-Za-z_][\w$]*|@@?\w+)"
    r"|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<op><=>|->>|->|<<|>>|\|\||&&|<>|!=|<=|>=|:=|[-+*/%(),.;<>=!~^&|?@])|(?P<space>\s+)",
    re.S,
)
#: Functions that are renamed, one for one.
RENAMED = {
    "lcase": "lower", "ucase": "upper", "character_length": "char_length", "length": "octet_length", "curdate": "current_date", "sysdate": "now", "std": "stddev_pop", "stddev": "stddev_pop",
    "variance": "var_pop", "schema": "current_schema", "database": "current_database", "to_base64": "base64", "sha": "sha1", "mid": "substr", "truncate": "tidemill_truncate",
}
#: Join hints of the dialect and Spark's names for them; none broadcasts a side whose size nobody has checked.
HINTS = {
    "HASH_JOIN": "SHUFFLE_HASH", "BKA_JOIN": "SHUFFLE_HASH", "NL_JOIN": "SHUFFLE_REPLICATE_NL", "SORT_MERGE_JOIN": "MERGE", "SEMI_HASH_JOIN": "SHUFFLE_HASH", "SEMI_BKA_JOIN": "SHUFFLE_HASH",
    "SEMI_NL_JOIN": "SHUFFLE_REPLICATE_NL", "MATERIALIZED_SEMI_JOIN": "SHUFFLE_HASH", "HASH_GROUP_JOIN": "SHUFFLE_HASH", "HASH_OUTER_JOIN": "SHUFFLE_HASH", "SEMI_SORT_MERGE_JOIN": "MERGE",
}

#: SQL functions that give MySQL's meaning where no builtin has it.
FUNCTIONS = {
    "tidemill_truncate": "(x DOUBLE, d INT) RETURNS DOUBLE RETURN sign(x) * floor(abs(CAST(x AS DECIMAL(30,10))) * power(10, d)) / power(10, d)",
    "to_days": "(d DATE) RETURNS BIGINT RETURN CAST(datediff(d, DATE'1970-01-01') + 719528 AS BIGINT)",
    "from_days": "(n BIGINT) RETURNS DATE RETURN date_add(DATE'1970-01-01', CAST(n - 719528 AS INT))",
    "strcmp": "(a STRING, b STRING) RETURNS INT RETURN CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END",
    "tidemill_period": "(p BIGINT) RETURNS BIGINT RETURN (CASE WHEN p DIV 100 < 70 THEN p DIV 100 + 2000 WHEN p DIV 100 < 100 THEN p DIV 100 + 1900 ELSE p DIV 100 END) * 12 + p % 100 - 1",
    "period_diff": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN tidemill_period(a) - tidemill_period(b)",
    "period_add": "(p BIGINT, n BIGINT) RETURNS BIGINT RETURN (tidemill_period(p) + n) DIV 12 * 100 + (tidemill_period(p) + n) % 12 + 1",
    "time_to_sec": "(t STRING) RETURNS BIGINT RETURN CASE WHEN t LIKE '-%' THEN -1 ELSE 1 END * (CAST(split(ltrim('-', t), ':')[0] AS BIGINT) * 3600 + CAST(split(ltrim('-', t), ':')[1] AS BIGINT) * 60 + CAST(floor(CAST(coalesce(get(split(ltrim('-', t), ':'), 2), '0') AS DOUBLE)) AS BIGINT))",
    "sec_to_time": "(n BIGINT) RETURNS STRING RETURN concat(CASE WHEN n < 0 THEN '-' ELSE '' END, CASE WHEN least(abs(n), 3020399) < 36000 THEN '0' ELSE '' END, CAST(least(abs(n), 3020399) DIV 3600 AS STRING), ':', lpad(CAST(least(abs(n), 3020399) DIV 60 % 60 AS STRING), 2, '0'), ':', lpad(CAST(least(abs(n), 3020399) % 60 AS STRING), 2, '0'))",
    "ord": "(s STRING) RETURNS BIGINT RETURN CASE WHEN s = '' THEN 0 ELSE CAST(conv(hex(encode(substr(s, 1, 1), 'utf-8')), 16, 10) AS BIGINT) END",
    "tidemill_insert": "(s STRING, p INT, n INT, x STRING) RETURNS STRING RETURN CASE WHEN p < 1 OR p > char_length(s) THEN s ELSE overlay(s PLACING x FROM p FOR CASE WHEN n < 0 OR p + n > char_length(s) + 1 THEN char_length(s) + 1 - p ELSE n END) END",
    "makedate": "(y INT, n INT) RETURNS DATE RETURN CASE WHEN n > 0 THEN date_add(make_date(CASE WHEN y < 70 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END, 1, 1), n - 1) END",
    "oct": "(n BIGINT) RETURNS STRING RETURN conv(CAST(n AS STRING), 10, 8)",
    "bit_not64": "(x BIGINT) RETURNS DECIMAL(20,0) RETURN CASE WHEN ~x >= 0 THEN CAST(~x AS DECIMAL(20,0)) ELSE CAST(CAST(~x AS DECIMAL(20,0)) + 18446744073709551616 AS DECIMAL(20,0)) END",
    "json_quote": "(s STRING) RETURNS STRING RETURN regexp_extract(to_json(named_struct('a', s)), '^[{]\"a\":(.*)[}]$', 1)",
}


_UNITS = {
    "YEAR": "make_ym_interval(({n}) * 1, 0)", "QUARTER": "make_ym_interval(0, ({n}) * 3)", "MONTH": "make_ym_interval(0, {n})", "WEEK": "make_dt_interval(({n}) * 7)", "DAY": "make_dt_interval({n})",
    "HOUR": "make_dt_interval(0, {n})", "MINUTE": "make_dt_interval(0, 0, {n})", "SECOND": "make_dt_interval(0, 0, 0, {n})",
}


def _shift(sign: str, args: list[str]) -> str:
    """DATE_ADD and DATE_SUB with an interval, or with a number of days."""
    m = re.fullmatch(r"(?is)\s*interval\s+(.+?)\s+(\w+)\s*", args[1])
    number, unit = (m[1], m[2].upper()) if m else (args[1], "DAY")
    if unit in _UNITS:
        return f"({args[0]} {sign} {_UNITS[unit].format(n=number)})"
    parts = composite_interval(number.strip("' "), unit)
    if not parts:
        return "CAST(NULL AS TIMESTAMP)"
    return f"({args[0]} {sign} " + f" {sign} ".join(_UNITS[u].format(n=n) for u, n in parts.items()) + ")"


def _formatted(args: list[str]) -> str:
    """DATE_FORMAT with a literal format."""
    pattern, out, plain = args[1].strip()[1:-1], [], ""
    for part in re.findall(r"(?s)%.|[^%]+|%$", pattern):
        letter = part[1:]
        if part[0] == "%" and letter in _PATTERNS:
            if plain:
                out.append(f"'{plain}'")
            plain = ""
            out.append(f"date_format({args[0]}, '{_PATTERNS[letter]}')")
        elif part[0] == "%" and letter in "DUuVvXxw":
            raise ValueError(f"%{letter} needs functions.dates.date_format")
        else:
            plain += letter if part[0] == "%" else part
    return "concat(" + ", ".join([*out, f"'{plain}'"] if plain or not out else out) + ")"


def _parsed(args: list[str]) -> str:
    pattern = re.sub(r"%(.)", lambda m: _PATTERNS.get(m[1], m[1]), args[1].strip()[1:-1])
    return f"try_to_timestamp({args[0]}, '{pattern}')"


def _cast(args: list[str]) -> str:
    kind = re.sub(r"(?i)\bunsigned(\s+integer)?\b", "DECIMAL(20,0)", re.sub(r"(?i)\bsigned(\s+integer)?\b", "BIGINT", args[0]))
    return f"CAST({re.sub(r'(?i)(?<=as )(n?char|json)(\(\d+\))?', 'STRING', re.sub(r'(?i)(?<=as )datetime(\(\d+\))?', 'TIMESTAMP', kind))})"


def _convert(args: list[str]) -> str:
    if len(args) == 2:
        return _cast([f"{args[0].strip()} AS {args[1].strip()}"])
    value, charset = re.fullmatch(r"(?is)(.*)\susing\s+(\w+)\s*", args[0]).groups()
    name = {"utf8mb4": "utf-8", "utf8": "utf-8", "latin1": "iso-8859-1", "ascii": "us-ascii"}.get(charset.lower(), charset)
    return f"decode(encode({value}, '{name}'), '{name}')"


def _no_nulls(name: str):
    return lambda args: f"CASE WHEN {' OR '.join(f'({a}) IS NULL' for a in args)} THEN NULL ELSE {name}({', '.join(args)}) END"


#: Calls that are written anew; each gets its arguments, already rewritten.
CALLS = {
    "date_add": lambda a: _shift("+", a), "adddate": lambda a: _shift("+", a), "date_sub": lambda a: _shift("-", a), "subdate": lambda a: _shift("-", a), "date_format": _formatted, "str_to_date": _parsed, "cast": _cast, "convert": _convert,
    "elt": lambda a: f"CASE WHEN ({a[0]}) >= 1 THEN try_element_at(array({', '.join(a[1:])}), CAST({a[0]} AS INT)) END",
    "field": lambda a: "CASE " + " ".join(f"WHEN ({a[0]}) = ({x}) THEN {i}" for i, x in enumerate(a[1:], 1)) + " ELSE 0 END",
    "greatest": _no_nulls("greatest"), "least": _no_nulls("least"), "mod": lambda a: f"try_mod({a[0]}, {a[1]})", "dayname": lambda a: f"date_format({a[0]}, 'EEEE')", "monthname": lambda a: f"date_format({a[0]}, 'MMMM')",
    "json_extract": lambda a: f"to_json(try_variant_get(try_parse_json({a[0]}), {a[1]}, 'variant'))", "json_unquote": lambda a: f"get_json_object(concat('{{\"a\":', {a[0]}, '}}'), '$.a')",
    "log": lambda a: f"CASE WHEN ({a[0]}) > 0 THEN ln({a[0]}) END" if len(a) == 1 else f"CASE WHEN ({a[0]}) > 0 AND ({a[0]}) <> 1 AND ({a[1]}) > 0 THEN log({a[0]}, {a[1]}) END",
    "if": lambda a: f"CASE WHEN {_true(a[0])} THEN {a[1]} ELSE {a[2]} END", "insert": lambda a: f"tidemill_insert({', '.join(a)})",
    "make_set": lambda a: "array_join(array_compact(array(" + ", ".join(f"CASE WHEN (({a[0]}) & {1 << i}) <> 0 THEN {x} END" for i, x in enumerate(a[1:])) + ")), ',')",
    "json_arrayagg": lambda a: f"CASE WHEN count(*) > 0 THEN to_json(collect_list({a[0]})) END", "curtime": lambda a: "date_format(now(), 'HH:mm:ss')", "current_time": lambda a: "date_format(now(), 'HH:mm:ss')",
    "sqrt": lambda a: f"CASE WHEN ({a[0]}) >= 0 THEN sqrt({a[0]}) END", "charset": lambda a: "'utf8mb4'", "json_array": lambda a: f"to_json(array({', '.join(a)}))",
}


def _true(text: str) -> str:
    """A condition: numbers are true if they are not zero."""
    return f"CAST(({text.strip()}) AS BOOLEAN)"


#: Where an operand of a logical operator begins or ends, outside of parentheses; AND does where it binds less.
_CLAUSES = frozenset("select where on having when then else case by from group order limit as end union using distinct set values".split())
_LOOSER = {"||": {"or", "||"}, "xor": {"or", "||", "xor"}, "&&": {"or", "||", "xor", "and", "&&"}}


def _left(out: list[str], looser: set[str]) -> str:
    """Take the operand of a logical operator from the end of the output."""
    taken: list[str] = []
    depth = 0
    while out:
        word = out[-1].strip().lower()
        if not depth and (word in {"(", ","} or word in _CLAUSES - {"as"} or word in looser):
            if word != "and" or not any(o.strip().lower() == "between" for o in out[max(0, len(out) - 6) :]):
                break
        depth += (out[-1] == ")") - (out[-1] == "(")
        taken.insert(0, out.pop())
    return "".join(taken)


def _right(source: list[tuple[str, str]], at: int, looser: set[str]) -> int:
    """End of the operand of a logical operator that begins at a token."""
    depth, j, between = 0, at, False
    while j < len(source):
        word = source[j][1].lower()
        if not depth and (word in {")", ",", ";"} or word in _CLAUSES or word in looser and not (word == "and" and between)):
            break
        between = word == "between" or between and word != "and"
        depth += (word == "(") - (word == ")")
        j += 1
    return j


def _factor(source: list[tuple[str, str]], at: int) -> int:
    """End of the operand of an arithmetic operator that begins at a token."""
    j = at
    while j < len(source) and (source[j][0] == "space" or source[j][1] in "+-~!"):
        j += 1
    if j < len(source) and source[j][1].lower() == "case":
        depth = 0
        while j < len(source):
            depth += (source[j][1].lower() == "case") - (source[j][1].lower() == "end")
            j += 1
            if not depth:
                return j
    if j < len(source) and source[j][1] != "(":
        j += 1
        while j + 1 < len(source) and source[j][1] == ".":
            j += 2
    k = j
    while k < len(source) and source[k][0] == "space":
        k += 1
    if k < len(source) and source[k][1] == "(" and (k == j or source[j - 1][0] == "name"):
        j = _close(source, k) + 1
        k = j
    while k < len(source) and source[k][0] == "space":
        k += 1
    return _factor(source, k + 1) if k < len(source) and source[k][1] in ("->", "->>") else j


def _product(out: list[str]) -> str:
    """Take the left side of a division: a factor with what is multiplied with it before."""
    text = _operand(out)
    rest = [k for k, o in enumerate(out) if not o.isspace()]
    if len(rest) > 1 and out[rest[-1]] == "*" and not re.fullmatch(r"(?i)select|distinct|,|\(", out[rest[-2]]):
        del out[rest[-1] :]
        text = f"{_product(out)} * {text}"
    return text


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def split_statements(text: str) -> list[str]:
    """Statements between semicolons outside of strings and comments."""
    out, held = [], ""
    for kind, value in tokens(text):
        if kind == "op" and value == ";":
            out.append(held)
            held = ""
        elif kind != "comment":
            held += value
    return [s.strip() for s in [*out, held] if s.strip()]


def _string(value: str) -> str:
    return "'" + value[1:-1].replace('""', '"').replace("'", "\\'") + "'" if value[0] == '"' else value


def _hint(value: str) -> str:
    found = re.findall(r"(\w+)\s*\(([^()]*)\)", value)
    known = [f"{HINTS[n.upper().removeprefix('CMD_')]}({a})" for n, a in found if n.upper().removeprefix("CMD_") in HINTS]
    return f"/*+ {', '.join(known)} */" if known else ""


def rewrite(text: str) -> str:
    """Spark SQL with the meaning of one MySQL statement."""
    source = [(k, v) for k, v in tokens(text) if k != "comment"]
    out: list[str] = []
    i = 0

    def following(j: int) -> int:
        while j < len(source) and source[j][0] == "space":
            j += 1
        return j

    while i < len(source):
        kind, value = source[i]
        low = value.lower()
        called = (j := following(i + 1)) < len(source) and source[j][1] == "("
        if kind == "string":
            out.append(_string(value))
        elif kind == "hint":
            out.append(_hint(value))
        elif kind == "name" and re.fullmatch(r"@\w+", value):
            out.append(_variable(value[1:]))
        elif value in ("||", "&&") or kind == "name" and low == "xor":
            end = _right(source, i + 1, _LOOSER[low])
            left, right = _true(_left(out, _LOOSER[low])), _true(rewrite("".join(v for _, v in source[i + 1 : end])))
            out.append(f" ({left} <> {right})" if low == "xor" else f" ({left} {'OR' if value == '||' else 'AND'} {right}) ")
            i = end - 1
        elif kind == "op" and value in "!~":
            end = _factor(source, i + 1)
            inner = rewrite("".join(v for _, v in source[i + 1 : end])).strip()
            out.append(f"(NOT {_true(inner)})" if value == "!" else f"bit_not64({inner})")
            i = end - 1
        elif value in ("/", "%") or kind == "name" and low in ("div", "mod") and not called or kind == "name" and low == "div":
            end = _factor(source, i + 1)
            left, right = _product(out), rewrite("".join(v for _, v in source[i + 1 : end])).strip()
            out.append({"/": f"try_divide({left}, {right})", "div": f"({left} DIV nullif({right}, 0))"}.get(low, f"try_mod({left}, {right})"))
            i = end - 1
        elif kind == "op" and value in ("->", "->>"):
            path = following(i + 1)
            left = _operand(out)
            out.append(f"get_json_object({left}, {_string(source[path][1])})" if value == "->>" else f"to_json(try_variant_get(try_parse_json({left}), {_string(source[path][1])}, 'variant'))")
            i = path
        elif kind == "name" and low == "regexp":
            out.append("RLIKE")
        elif kind == "name" and low == "straight_join":
            out.append("JOIN")
        elif kind == "name" and low == "group_concat" and called:
            end = _close(source, j)
            out.append(_group_concat("".join(v if k != "string" else _string(v) for k, v in source[j + 1 : end])))
            i = end
        elif kind == "name" and low == "limit":
            out.append(value)
            tail = re.match(r"\s*(\d+)\s*,\s*(\d+)", "".join(v for _, v in source[i + 1 :]))
            if tail:
                out.append(f" {tail[2]} OFFSET {tail[1]}")
                skipped = 0
                while skipped < tail.end():
                    i += 1
                    skipped += len(source[i][1])
        elif kind == "name" and called and low in CALLS:
            end = _close(source, j)
            out.append(CALLS[low]([rewrite("".join(v for _, v in part)).strip() for part in _arguments(source[j + 1 : end])]))
            i = end
        elif kind == "name" and called and low not in RENAMED and low not in FUNCTIONS and low in builders.names() and (made := builders.call(low, _written(source, j))) is not None:
            out.append(made)
            i = _close(source, j)
        elif kind == "name" and low == "from" and j < len(source) and source[j][1].lower() == "dual":
            i = j
        elif kind == "name" and called and low in RENAMED:
            out.append(RENAMED[low])
        else:
            out.append(value)
        i += 1
    return "".join(out)


def _close(source: list[tuple[str, str]], opening: int) -> int:
    depth = 0
    for j in range(opening, len(source)):
        depth += (source[j][1] == "(") - (source[j][1] == ")")
        if not depth:
            return j
    raise ValueError("a parenthesis is not closed")


def _written(source: list[tuple[str, str]], opening: int) -> list[str]:
    """Arguments of a call, already rewritten."""
    inside = source[opening + 1 : _close(source, opening)]
    return [rewrite("".join(v for _, v in part)).strip() for part in _arguments(inside)] if any(k != "space" for k, _ in inside) else []


def _arguments(inside: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = [[]]
    depth = 0
    for token in inside:
        depth += (token[1] == "(") - (token[1] == ")")
        if token[1] == "," and not depth:
            out.append([])
        else:
            out[-1].append(token)
    return out


def _operand(out: list[str]) -> str:
    """Take the operand that ends the output: a name with its qualifiers, or a parenthesis with its function."""
    taken: list[str] = []
    while out and out[-1].isspace():
        out.pop()
    if out and len(out[-1]) > 1 and out[-1].strip().endswith(")"):  # written anew as a whole
        return out.pop()
    if out and out[-1][:1] in "'0123456789" and out[-1]:
        return out.pop()
    if out and out[-1] == ")":
        depth = 0
        while out:
            part = out.pop()
            taken.insert(0, part)
            depth += (part == ")") - (part == "(")
            if not depth:
                break
    if out and re.fullmatch(r"[\w`$]+", out[-1]):
        taken.insert(0, out.pop())
    while len(out) >= 2 and out[-1] == ".":
        taken.insert(0, out.pop())
        taken.insert(0, out.pop())
    return "".join(taken)


def _group_concat(inner: str) -> str:
    m = re.fullmatch(r"(?is)\s*(distinct\s+)?(.*?)(?:\s+order\s+by\s+(.*?))?(?:\s+separator\s+('.*'))?\s*", inner)
    distinct, value, order, separator = m.groups()
    text = f"CAST({rewrite(value)} AS STRING)"
    by = rewrite(order) if order else text
    if distinct:  # distinct texts can only be ordered by themselves
        by = text + (" DESC" if re.search(r"(?i)\sdesc\s*$", by) else "")
    return f"listagg({'DISTINCT ' if distinct else ''}{text}, {separator or chr(39) + ',' + chr(39)}) WITHIN GROUP (ORDER BY {by})"


def prepare(spark: SparkSession) -> None:
    """Define the helper functions in the session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def _assign(spark: SparkSession, text: str) -> None:
    """SET @a = ..., @b = ...: user variables are variables of the Spark session."""
    for part in _arguments(tokens(text)):
        name, value = re.fullmatch(r"(?s)\s*@(\w+)\s*:?=\s*(.+)", "".join(v for _, v in part)).groups()
        written = rewrite(value)
        _declare(spark, written)
        kind = spark.sql(f"SELECT {written} AS v").schema[0].dataType.simpleString()
        kind = "string" if kind == "void" else kind
        for target, source in (("tidemill_assigned", written), (_variable(name), "tidemill_assigned")):  # the old value may be read
            spark.sql(f"DECLARE OR REPLACE VARIABLE {target} {kind}")
            spark.sql(f"SET VAR {target} = {source}")


def _variable(name: str) -> str:
    return f"tidemill_at_{name.lower()}"


def _declare(spark: SparkSession, written: str) -> None:
    """A user variable that nobody has set is NULL."""
    for name in set(re.findall(r"\btidemill_at_\w+", written)):
        try:
            spark.sql(f"DECLARE VARIABLE {name} STRING")
        except AnalysisException as e:
            if e.getCondition() != "VARIABLE_ALREADY_EXISTS":
                raise


def run(spark: SparkSession, text: str) -> DataFrame:
    """Run MySQL text; the result of the last statement.

    ``FOUND_ROWS()`` counts the rows of the SELECT before it in the same text.
    """
    prepare(spark)
    result = None
    for statement in split_statements(text):
        if assigned := re.fullmatch(r"(?is)set\s+(@\w+\s*:?=.*)", statement):
            _assign(spark, assigned[1])
            continue
        if result is not None and any(k == "name" and v.lower() == "found_rows" for k, v in tokens(statement)):
            found = result.count()
            statement = "".join(v if k == "string" else re.sub(r"(?i)found_rows", "tidemill_same", v) for k, v in tokens(statement)).replace("tidemill_same()", f"CAST({found} AS BIGINT)")
        written = rewrite(statement)
        _declare(spark, written)
        result = spark.sql(written)
    return result
