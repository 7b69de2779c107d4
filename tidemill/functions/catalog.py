"""The SQL names that the library answers to.

Each module's public functions are found under their own names; names that differ are
listed as aliases, and what Spark has under the same meaning is taken from it.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import functions as F

from tidemill.functions import aggregates, dates, documents, logic, numbers, session, strings, types

#: SQL name: module and function, where the name alone does not tell.
ALIASES = {
    "ADDDATE": (dates, "date_add"), "SUBDATE": (dates, "date_sub"), "&": (numbers, "bit_and"), "|": (numbers, "bit_or"), "^": (numbers, "bit_xor"), "~": (numbers, "bit_not"), "<<": (numbers, "shift_left"), ">>": (numbers, "shift_right"),
    "+": (numbers, "add"), "-": (numbers, "sub"), "*": (numbers, "multiply"), "/": (numbers, "divide"), "DIV": (numbers, "int_divide"), "%": (numbers, "mod"), "POWER": (numbers, "pow_"), "ATAN2": (numbers, "atan"),
    "=": (logic, "eq"), "<>": (logic, "ne"), "!=": (logic, "ne"), "<=>": (logic, "null_safe_eq"), "!": (logic, "not_"), "&&": (logic, "and_"), "||": (logic, "or_"), "RLIKE": (logic, "regexp"), "NOT REGEXP": (logic, "not_regexp"), "NOT LIKE": (logic, "not_like"), "ROW": (logic, "row_eq"),
    "CHARACTER_LENGTH": (strings, "char_length"), "LCASE": (strings, "lower"), "UCASE": (strings, "upper"), "MID": (strings, "substring"), "SUBSTR": (strings, "substring"), "POSITION": (strings, "locate"), "SOUNDS LIKE": (strings, "sounds_like"), "CONVERT": (strings, "convert_using"),
    "TO_DAYS": (dates, "day_number"), "TIMESTAMPADD": (dates, "timestamp_add"), "TIMESTAMPDIFF": (dates, "timestamp_diff"), "YEAR TYPE": (dates, "year_of"),
    "->": (documents, "json_extract"), "->>": (documents, "json_unquote_extract"), "SHA": (documents, "sha1"),
    "STDDEV": (aggregates, "std"), "STDDEV_POP": (aggregates, "std"), "HASHCHECK": (aggregates, "hashcheck"), "CHECK_SUM": (aggregates, "checksum"), "CHECK_SUM_MERGE": (aggregates, "checksum_merge"), "HYPERLOGLOG": (aggregates, "hyperloglog"),
    "SCHEMA": (session, "database"), "USER": (session, "current_user"), "CUR_TIME_ZONE": (session, "current_time_zone"),
}
#: SQL names with Spark's own meaning, and its names for them.
BUILTIN = {
    "CEILING": "ceil", "CURDATE": "current_date", "DATE": "to_date", "DAY": "dayofmonth", "LOCALTIME": "localtimestamp", "SYSDATE": "now", "IFNULL": "ifnull", "NULLIF": "nullif",
    "STDDEV_SAMP": "stddev_samp", "VAR_SAMP": "var_samp", "VAR_POP": "var_pop", "COVAR_POP": "covar_pop", "COVAR_SAMP": "covar_samp",
} | {
    n.upper(): n
    for n in "abs cos sin tan exp floor degrees radians pi sign ceil count sum min max hour minute second month quarter year dayofyear dayofmonth last_day weekofyear extract "
    "datediff from_unixtime unix_timestamp current_date current_timestamp localtimestamp now hex unhex isnull row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value grouping grouping_id".split()
}


def functions() -> dict[str, Callable]:
    """SQL name to the function that builds it."""
    found: dict[str, Callable] = {}
    for module in (types, session, aggregates, documents, dates, strings, numbers, logic):
        for name, f in vars(module).items():
            if not name.startswith("_") and callable(f) and getattr(f, "__module__", "") == module.__name__ and not inspect.isclass(f):
                found[name.strip("_").upper()] = f
    found |= {name: getattr(module, f) for name, (module, f) in ALIASES.items()}
    found |= {name: getattr(F, f) for name, f in BUILTIN.items()}
    return found
