"""Scalar functions, several to a query; oracles spell out the expected semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import dates as D
from tidemill.functions import documents as J
from tidemill.functions import logic as L
from tidemill.functions import numbers as N
from tidemill.functions import strings as S
from tidemill.plans.registry import query
from tidemill.session import table

C = F.col
I = F.lit  # noqa: E741


def functions(name: str, source: str, key: str, made: dict, oracle: str, prepare: list | None = None, floats: int = 8):
    """A query of the key and expressions; ``oracle`` maps the same names in SQL over the same table."""

    def build(spark, sf):
        df = table(spark, sf, source)
        for column, expression in (prepare or []):
            df = df.withColumn(column, expression())
        return df.select(key, *[e().alias(n) for n, e in made.items()])

    query(name, oracle)(build)


def literals(name: str, made: dict, expected: str):
    """One row of expressions over literals against a literal row."""
    query(name, f"SELECT {expected}")(lambda spark, sf: spark.range(1).select(*[e().alias(n) for n, e in made.items()]))


# --- predicates and logic ------------------------------------------------------------

_V = [("v", lambda: F.when(C("n_nationkey") % 4 != 0, C("n_nationkey") - 8)), ("w", lambda: F.when(C("n_nationkey") % 3 != 0, C("n_nationkey") % 5))]
_VW = "(SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey - 8 END AS v, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 5 END AS w FROM nation)"

functions(
    "fn_compare", "nation", "n_nationkey",
    {
        "eq": lambda: L.eq(C("v"), C("w")), "ne": lambda: L.ne(C("v"), C("w")), "lt": lambda: L.flag(C("v") < C("w")), "le": lambda: L.flag(C("v") <= C("w")),
        "gt": lambda: L.flag(C("v") > C("w")), "ge": lambda: L.flag(C("v") >= C("w")), "ns": lambda: L.null_safe_eq(C("v"), C("w")),
        "bt": lambda: L.between(C("v"), C("w"), I(10)), "nb": lambda: L.not_between(C("v"), I(-2), C("w")),
        "inn": lambda: L.in_(C("v"), I(1), C("w"), I(3)), "nin": lambda: L.not_in(C("v"), I(1), C("w")),
        "isn": lambda: L.flag(C("v").isNull()), "inn2": lambda: L.flag(C("v").isNotNull()),
    },
    f"SELECT n_nationkey, (v = w)::BIGINT AS eq, (v <> w)::BIGINT AS ne, (v < w)::BIGINT AS lt, (v <= w)::BIGINT AS le, (v > w)::BIGINT AS gt, (v >= w)::BIGINT AS ge, (v IS NOT DISTINCT FROM w)::BIGINT AS ns, (v >= w AND v <= 10)::BIGINT AS bt, (NOT (v >= -2 AND v <= w))::BIGINT AS nb, (v = 1 OR v = w OR v = 3)::BIGINT AS inn, (NOT (v = 1 OR v = w))::BIGINT AS nin, (v IS NULL)::BIGINT AS isn, (v IS NOT NULL)::BIGINT AS inn2 FROM {_VW}",
    _V,
)
functions(
    "fn_logic", "nation", "n_nationkey",
    {
        "a": lambda: L.and_(C("v"), C("w")), "o": lambda: L.or_(C("v"), C("w")), "x": lambda: L.xor_(C("v"), C("w")), "n": lambda: L.not_(C("v")),
        "t": lambda: L.is_true(C("w")), "nt": lambda: L.is_not_true(C("w")), "f": lambda: L.is_false(C("w")), "nf": lambda: L.is_not_false(C("w")),
        "re": lambda: L.row_eq([C("v"), C("w")], [I(1), I(4)]), "ri": lambda: L.row_in([C("v"), C("w")], [[I(1), I(4)], [C("v"), I(2)]]),
    },
    f"SELECT n_nationkey, (v <> 0 AND w <> 0)::BIGINT AS a, (v <> 0 OR w <> 0)::BIGINT AS o, ((v <> 0) <> (w <> 0))::BIGINT AS x, (NOT v <> 0)::BIGINT AS n, coalesce(w <> 0, FALSE)::BIGINT AS t, (NOT coalesce(w <> 0, FALSE))::BIGINT AS nt, coalesce(w = 0, FALSE)::BIGINT AS f, (NOT coalesce(w = 0, FALSE))::BIGINT AS nf, (v = 1 AND w = 4)::BIGINT AS re, ((v = 1 AND w = 4) OR (v = v AND w = 2))::BIGINT AS ri FROM {_VW}",
    _V,
)
literals(
    "fn_truth_of_text",
    {"a": lambda: L.is_true(I("true")), "b": lambda: L.is_true(I("1x")), "c": lambda: L.is_true(I("0.0")), "d": lambda: L.is_true(I(".5")), "e": lambda: L.is_false(I("abc")), "f": lambda: L.is_true(I(None).cast("string"))},
    "1::BIGINT AS a, 1::BIGINT AS b, 0::BIGINT AS c, 1::BIGINT AS d, 1::BIGINT AS e, 0::BIGINT AS f".replace("1::BIGINT AS a", "0::BIGINT AS a"),
)
functions(
    "fn_control", "nation", "n_nationkey",
    {
        "c": lambda: F.when(C("v") > 5, "high").when(C("v") > 0, "low").otherwise("none"), "i": lambda: F.expr("if(v > 0, 1, 2)"), "n": lambda: F.ifnull(C("v"), C("w")),
        "z": lambda: F.nullif(C("v"), I(1)), "co": lambda: N.coalesce(C("v"), C("w"), I(-1)),
    },
    f"SELECT n_nationkey, CASE WHEN v > 5 THEN 'high' WHEN v > 0 THEN 'low' ELSE 'none' END AS c, CASE WHEN v > 0 THEN 1 ELSE 2 END AS i, coalesce(v, w) AS n, nullif(v, 1) AS z, coalesce(v, w, -1) AS co FROM {_VW}",
    _V,
)
functions(
    "fn_like", "customer", "c_custkey",
    {"p": lambda: L.like(C("c_mktsegment"), "B%"), "s": lambda: L.like(C("c_name"), "%7"), "m": lambda: L.like(C("c_name"), "%00_1%"), "n": lambda: L.not_like(C("c_mktsegment"), "%U%"),
     "r": lambda: L.regexp(C("c_name"), "[13]7"), "rw": lambda: L.regexp(C("c_mktsegment"), "BUILD", whole=True), "nr": lambda: L.not_regexp(C("c_mktsegment"), "^M|E$")},
    "SELECT c_custkey, (c_mktsegment LIKE 'B%')::BIGINT AS p, (c_name LIKE '%7')::BIGINT AS s, (c_name LIKE '%00_1%')::BIGINT AS m, (c_mktsegment NOT LIKE '%U%')::BIGINT AS n, regexp_matches(c_name, '[13]7')::BIGINT AS r, regexp_full_match(c_mktsegment, 'BUILD')::BIGINT AS rw, (NOT regexp_matches(c_mktsegment, '^M|E$'))::BIGINT AS nr FROM customer",
)

# --- arithmetic, mathematics, bits -----------------------------------------------------

functions(
    "fn_arithmetic", "nation", "n_nationkey",
    {
        "ad": lambda: N.add(C("v"), C("w")), "su": lambda: N.sub(C("v"), C("w")), "mu": lambda: N.multiply(C("v"), C("w")), "di": lambda: F.round(N.divide(C("v"), C("w")).cast("double"), 4),
        "iv": lambda: N.int_divide(C("v"), C("w")), "mo": lambda: N.mod(C("v"), C("w")), "ne": lambda: N.unary_minus(C("v")), "po": lambda: N.unary_plus(C("v")),
        "gr": lambda: N.greatest(C("v"), C("w"), I(2)), "le": lambda: N.least(C("v"), C("w"), I(2)), "it": lambda: N.interval(C("v"), I(-5), I(0), C("w"), I(9)),
    },
    f"SELECT n_nationkey, v + w AS ad, v - w AS su, v * w AS mu, round(v / nullif(w, 0)::DOUBLE, 4) AS di, (v // nullif(w, 0))::BIGINT AS iv, v % nullif(w, 0) AS mo, -v AS ne, v AS po, CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN greatest(v, w, 2) END AS gr, CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN least(v, w, 2) END AS le, (CASE WHEN v IS NULL THEN -1 WHEN v < -5 THEN 0 WHEN v < 0 THEN 1 WHEN v < w THEN 2 WHEN v < 9 THEN 3 ELSE 4 END)::BIGINT AS it FROM {_VW}",
    _V,
)
_R = lambda c: F.round(c, 6)
functions(
    "fn_math", "supplier", "s_suppkey",
    {
        "ab": lambda: F.abs(C("x")), "ce": lambda: F.ceil(C("x")), "fl": lambda: F.floor(C("x")), "sg": lambda: F.sign(C("x")), "ac": lambda: _R(N.acos(C("x") / 5000)), "an": lambda: _R(N.asin(C("x") / 5000)),
        "at": lambda: _R(N.atan(C("x"))), "a2": lambda: _R(N.atan(C("x"), I(3.0))), "co": lambda: _R(F.cos(C("x"))), "si": lambda: _R(F.sin(C("x"))), "ta": lambda: _R(F.tan(C("x") / 10000)), "ct": lambda: _R(N.cot(C("x") / 10000 + 2)),
        "dg": lambda: _R(F.degrees(C("x"))), "ra": lambda: _R(F.radians(C("x"))), "ex": lambda: _R(F.exp(C("x") / 5000)), "ln": lambda: _R(N.ln(C("x"))), "lb": lambda: _R(N.log(I(3.0), C("x"))), "lt": lambda: _R(N.log10(C("x"))), "lw": lambda: _R(N.log2(C("x"))),
        "pw": lambda: _R(N.pow_(C("x") / 1000, I(3.0))), "sq": lambda: _R(N.sqrt(C("x"))), "pi": lambda: _R(F.pi()), "sp": lambda: _R(N.special_pow(C("x") / 1000, I(0.5))), "ro": lambda: N.round_(C("x"), 1), "tr": lambda: N.truncate(C("x"), 1).cast("double"), "tn": lambda: N.truncate(C("x"), -2).cast("double"),
    },
    "SELECT s_suppkey, abs(x) AS ab, ceil(x)::BIGINT AS ce, floor(x)::BIGINT AS fl, sign(x)::DOUBLE AS sg, round(CASE WHEN abs(x / 5000) <= 1 THEN acos(x / 5000) END, 6) AS ac, round(CASE WHEN abs(x / 5000) <= 1 THEN asin(x / 5000) END, 6) AS an, round(atan(x), 6) AS at, round(atan2(x, 3.0), 6) AS a2, round(cos(x), 6) AS co, round(sin(x), 6) AS si, round(tan(x / 10000), 6) AS ta, round(cot(x / 10000 + 2), 6) AS ct, round(degrees(x), 6) AS dg, round(radians(x), 6) AS ra, round(exp(x / 5000), 6) AS ex, round(CASE WHEN x > 0 THEN ln(x) END, 6) AS ln, round(CASE WHEN x > 0 THEN ln(x) / ln(3.0) END, 6) AS lb, round(CASE WHEN x > 0 THEN log10(x) END, 6) AS lt, round(CASE WHEN x > 0 THEN log2(x) END, 6) AS lw, round(pow(x / 1000, 3), 6) AS pw, round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS sq, round(pi(), 6) AS pi, round(CASE WHEN x <= 0 THEN 0 ELSE pow(x / 1000, 0.5) END, 6) AS sp, round(x, 1) AS ro, (trunc(x::DECIMAL(18,2) * 10) / 10)::DOUBLE AS tr, (trunc(x::DECIMAL(18,2) / 100) * 100)::DOUBLE AS tn FROM (SELECT s_suppkey, s_acctbal AS x FROM supplier)",
    [("x", lambda: C("s_acctbal"))],
)
literals(
    "fn_math_edges",
    {"l1": lambda: N.log(I(1.0), I(8.0)), "m0": lambda: N.mod(I(7), I(0)), "d0": lambda: N.divide(I(7), I(0)).cast("double"), "i0": lambda: N.int_divide(I(7), I(0)), "mn": lambda: N.mod(I(-7), I(3)), "in": lambda: N.int_divide(I(-7), I(2)),
     "cr": lambda: N.crc32(I("MySQL")), "cv": lambda: N.conv(I("a"), 16, 2), "rd": lambda: N.round_(I(2.5)), "tz": lambda: N.truncate(I(-1.999), 1).cast("double")},
    "NULL::DOUBLE AS l1, NULL::INTEGER AS m0, NULL::DOUBLE AS d0, NULL::BIGINT AS i0, -1 AS mn, -3::BIGINT AS \"in\", 3259397556::BIGINT AS cr, '1010' AS cv, 3.0::DOUBLE AS rd, -1.9::DOUBLE AS tz",
)
literals(
    "fn_bits",
    {"an": lambda: N.bit_and(I(29), I(15)), "o": lambda: N.bit_or(I(29), I(15)), "x": lambda: N.bit_xor(I(1), I(-1)), "n": lambda: N.bit_not(I(5)), "l": lambda: N.shift_left(I(1), 63), "l64": lambda: N.shift_left(I(1), 64),
     "r": lambda: N.shift_right(I(-1), 60), "r99": lambda: N.shift_right(I(8), 99), "c": lambda: N.bit_count(I(29)), "c1": lambda: N.bit_count(I(-1)), "s": lambda: N.signed(N.bit_not(I(5))), "z": lambda: N.bit_and(I(None).cast("long"), I(1))},
    "13::DECIMAL(20,0) AS an, 31::DECIMAL(20,0) AS o, 18446744073709551614::DECIMAL(20,0) AS x, 18446744073709551610::DECIMAL(20,0) AS n, 9223372036854775808::DECIMAL(20,0) AS l, 0::DECIMAL(20,0) AS l64, 15::DECIMAL(20,0) AS r, 0::DECIMAL(20,0) AS r99, 4::BIGINT AS c, 64::BIGINT AS c1, -6::BIGINT AS s, NULL::DECIMAL(20,0) AS z",
)
functions(
    "fn_bits_table", "orders", "o_orderkey",
    {"a": lambda: N.bit_and(C("o_orderkey"), C("o_custkey")), "o": lambda: N.bit_or(C("o_orderkey"), C("o_custkey")), "x": lambda: N.bit_xor(C("o_orderkey"), C("o_custkey")), "c": lambda: N.bit_count(C("o_orderkey")), "l": lambda: N.shift_left(C("o_custkey"), 3), "r": lambda: N.shift_right(C("o_orderkey"), 2)},
    "SELECT o_orderkey, (o_orderkey & o_custkey)::DECIMAL(20,0) AS a, (o_orderkey | o_custkey)::DECIMAL(20,0) AS o, xor(o_orderkey, o_custkey)::DECIMAL(20,0) AS x, bit_count(o_orderkey)::BIGINT AS c, (o_custkey * 8)::DECIMAL(20,0) AS l, (o_orderkey // 4)::DECIMAL(20,0) AS r FROM orders",
)

# --- strings ---------------------------------------------------------------------------

_NAME = lambda: C("c_name")
functions(
    "fn_string_basic", "customer", "c_custkey",
    {
        "le": lambda: S.length(_NAME()), "cl": lambda: S.char_length(_NAME()), "bl": lambda: S.bit_length(_NAME()), "lo": lambda: S.lower(_NAME()), "up": lambda: S.upper(_NAME()), "rv": lambda: S.reverse(_NAME()),
        "cc": lambda: S.concat(_NAME(), I("-"), C("c_mktsegment")), "cw": lambda: S.concat_ws("/", _NAME(), I(None).cast("string"), C("c_mktsegment")), "lf": lambda: S.left(_NAME(), 4), "rt": lambda: S.right(_NAME(), 3), "l0": lambda: S.left(_NAME(), -2),
        "lp": lambda: S.lpad(C("c_mktsegment"), 12, "*#"), "rp": lambda: S.rpad(C("c_mktsegment"), 4, "x"), "tr": lambda: S.trim(S.concat(I("  "), C("c_mktsegment"), I(" "))), "lt": lambda: S.ltrim(S.concat(I("  "), C("c_mktsegment"))), "rr": lambda: S.rtrim(S.concat(C("c_mktsegment"), I("  "))),
        "rl": lambda: S.replace(_NAME(), "0", "zero"), "rpt": lambda: S.repeat(I("ab"), 3), "si": lambda: S.substring_index(_NAME(), "#", -1), "su": lambda: S.substring(_NAME(), 3, 4), "s0": lambda: S.substring(_NAME(), 0, 4), "sn": lambda: S.substring(_NAME(), -3), "sp": lambda: S.space(I(3)),
        "is": lambda: S.instr(_NAME(), "00"), "lc": lambda: S.locate("0", _NAME(), 12), "as": lambda: S.ascii_(C("c_mktsegment")), "sx": lambda: S.soundex(C("c_mktsegment")),
    },
    """SELECT c_custkey, strlen(c_name)::BIGINT AS le, length(c_name)::BIGINT AS cl, (strlen(c_name) * 8)::BIGINT AS bl, lower(c_name) AS lo, upper(c_name) AS up, reverse(c_name) AS rv, c_name || '-' || c_mktsegment AS cc, c_name || '/' || c_mktsegment AS cw, c_name[1:4] AS lf, right(c_name, 3) AS rt, '' AS l0,
    CASE WHEN length(c_mktsegment) >= 12 THEN left(c_mktsegment, 12) ELSE left(repeat('*#', 12), 12 - length(c_mktsegment)) || c_mktsegment END AS lp, left(c_mktsegment, 4) AS rp, c_mktsegment AS tr, c_mktsegment AS lt, c_mktsegment AS rr, replace(c_name, '0', 'zero') AS rl, 'ababab' AS rpt, list_last(string_split(c_name, '#')) AS si, substring(c_name, 3, 4) AS su, '' AS s0, right(c_name, 3) AS sn, '   ' AS sp,
    instr(c_name, '00')::BIGINT AS "is", (CASE WHEN instr(substring(c_name, 12), '0') > 0 THEN instr(substring(c_name, 12), '0') + 11 ELSE 0 END)::BIGINT AS lc, ascii(c_mktsegment)::BIGINT AS "as", {soundex} AS sx FROM customer""".replace(
        "{soundex}", "CASE c_mktsegment WHEN 'BUILDING' THEN 'B435' WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'MACHINERY' THEN 'M256' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'FURNITURE' THEN 'F653' END"
    ),
)
_T = lambda x: I(x)
literals(
    "fn_string_special",
    {
        "el": lambda: S.elt(I(2), I("a"), I("b")), "e9": lambda: S.elt(I(9), I("a")), "fi": lambda: S.field(I("b"), I("a"), I("b")), "f0": lambda: S.field(I(None).cast("string"), I("a")), "fs": lambda: S.find_in_set(I("b"), I("a,b,c")), "fm": lambda: S.format_(I(1234567.891), 2),
        "b6": lambda: S.to_base64(I("abc")), "f6": lambda: S.from_base64(I("YWJj")), "in": lambda: S.insert(I("Quadratic"), 3, 4, I("What")), "i2": lambda: S.insert(I("Quadratic"), -1, 4, I("What")), "i3": lambda: S.insert(I("Quadratic"), 3, 100, I("What")),
        "ms": lambda: S.make_set(I(5), I("hello"), I("nice"), I("world")), "mn": lambda: S.make_set(I(7), I("a"), I(None).cast("string"), I("c")), "qu": lambda: S.quote(I("Don't")), "qn": lambda: S.quote(I(None).cast("string")), "oc": lambda: S.oct_(I(12)), "bi": lambda: S.bin_(I(12)), "hx": lambda: S.hex_(I("abc")), "h2": lambda: S.hex_(I(255)),
        "ch": lambda: S.char(I(77), I(121), I(83), I(None).cast("int"), I(81), I(76)).cast("string"), "c2": lambda: S.hex_(S.char(I(256))), "or": lambda: S.ord_(I("2")), "o2": lambda: S.ord_(I("é")), "sc": lambda: L.strcmp(I("text"), I("text2")), "s2": lambda: L.strcmp(I("b"), I("a")), "sl": lambda: S.sounds_like(I("Robert"), I("Rupert")),
        "ci": lambda: L.flag(S.equal_ci(I("A"), I("a"))), "cu": lambda: S.convert_using(I("abc"), "utf-8"), "by": lambda: S.hex_(I("é").cast("binary")), "ln": lambda: S.length(I("é")), "cn": lambda: S.char_length(I("é")), "lpn": lambda: S.lpad(I("a"), -1, "x"),
    },
    "'b' AS el, NULL::VARCHAR AS e9, 2::BIGINT AS fi, 0::BIGINT AS f0, 2::BIGINT AS fs, '1,234,567.89' AS fm, 'YWJj' AS b6, 'abc' AS f6, 'QuWhattic' AS \"in\", 'Quadratic' AS i2, 'QuWhat' AS i3, 'hello,world' AS ms, 'a,c' AS mn, '''Don\\''t''' AS qu, 'NULL' AS qn, '14' AS oc, '1100' AS bi, '616263' AS hx, 'FF' AS h2, 'MySQL' AS ch, '0100' AS c2, 50::BIGINT AS \"or\", 50089::BIGINT AS o2, -1::BIGINT AS sc, 1::BIGINT AS s2, 1::BIGINT AS sl, 1::BIGINT AS ci, 'abc' AS cu, 'C3A9' AS \"by\", 2::BIGINT AS ln, 1::BIGINT AS cn, NULL::VARCHAR AS lpn",
)
functions(
    "fn_compress_round_trip", "nation", "n_nationkey",
    {"t": lambda: S.uncompress(S.compress(C("n_name"))).cast("string"), "n": lambda: S.uncompressed_length(S.compress(C("n_name")))},
    "SELECT n_nationkey, n_name AS t, strlen(n_name)::BIGINT AS n FROM nation",
)

# --- dates -----------------------------------------------------------------------------

_TS = lambda: C("o_orderdate")
functions(
    "fn_date_parts", "orders", "o_orderkey",
    {
        "y": lambda: F.year(_TS()), "q": lambda: F.quarter(_TS()), "m": lambda: F.month(_TS()), "d": lambda: F.dayofmonth(_TS()), "h": lambda: F.hour(_TS()), "mi": lambda: F.minute(_TS()), "s": lambda: F.second(_TS()), "us": lambda: D.microsecond(_TS()),
        "dw": lambda: D.dayofweek(_TS()), "wd": lambda: D.weekday(_TS()), "dy": lambda: F.dayofyear(_TS()), "wy": lambda: F.weekofyear(_TS()), "dn": lambda: D.dayname(_TS()), "mn": lambda: D.monthname(_TS()), "ld": lambda: F.last_day(_TS()), "dt": lambda: F.to_date(_TS()),
        "td": lambda: D.day_number(_TS()), "ts": lambda: D.to_seconds(_TS()), "tm": lambda: D.to_months(_TS()), "tw": lambda: D.to_weeks(_TS()), "fd": lambda: D.from_days(D.day_number(_TS())), "dd": lambda: F.datediff(_TS(), I("1995-01-01").cast("date")),
    },
    "SELECT o_orderkey, year(t)::INTEGER AS y, quarter(t)::INTEGER AS q, month(t)::INTEGER AS m, day(t)::INTEGER AS d, hour(t)::INTEGER AS h, minute(t)::INTEGER AS mi, second(t)::INTEGER AS s, (epoch_us(t) % 1000000)::BIGINT AS us, (dayofweek(t) + 1)::BIGINT AS dw, (isodow(t) - 1)::BIGINT AS wd, dayofyear(t)::INTEGER AS dy, weekofyear(t)::INTEGER AS wy, dayname(t) AS dn, monthname(t) AS mn, last_day(t) AS ld, t::DATE AS dt, (date_diff('day', DATE '1970-01-01', t::DATE) + 719528)::BIGINT AS td, ((date_diff('day', DATE '1970-01-01', t::DATE) + 719528) * 86400 + hour(t) * 3600 + minute(t) * 60 + second(t))::BIGINT AS ts, (year(t) * 12 + month(t))::BIGINT AS tm, ((date_diff('day', DATE '1970-01-01', t::DATE) + 719527) // 7)::BIGINT AS tw, t::DATE AS fd, date_diff('day', DATE '1995-01-01', t::DATE)::INTEGER AS dd FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)",
)
functions(
    "fn_week_modes", "orders", "o_orderkey",
    {"w0": lambda: D.week(_TS(), 0), "w1": lambda: D.week(_TS(), 1), "w2": lambda: D.week(_TS(), 2), "w3": lambda: D.week(_TS(), 3), "w5": lambda: D.week(_TS(), 5), "y0": lambda: D.yearweek(_TS()), "y3": lambda: D.yearweek(_TS(), 3)},
    "SELECT o_orderkey, strftime(t, '%U')::BIGINT AS w0, (CASE WHEN weekofyear(t) >= 52 AND month(t) = 1 THEN 0 WHEN weekofyear(t) = 1 AND month(t) = 12 THEN 53 ELSE weekofyear(t) END)::BIGINT AS w1, (CASE WHEN strftime(t, '%U')::INT > 0 THEN strftime(t, '%U')::INT ELSE strftime(make_date(year(t) - 1, 12, 31), '%U')::INT END)::BIGINT AS w2, weekofyear(t)::BIGINT AS w3, strftime(t, '%W')::BIGINT AS w5, (CASE WHEN strftime(t, '%U')::INT > 0 THEN year(t) * 100 + strftime(t, '%U')::INT ELSE (year(t) - 1) * 100 + strftime(make_date(year(t) - 1, 12, 31), '%U')::INT END)::BIGINT AS y0, yearweek(t)::BIGINT AS y3 FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)",
)
literals(
    "fn_week_known",
    {f"w{m}": (lambda m=m: D.week(I("2008-02-20").cast("date"), m)) for m in (0, 1)} | {"e": lambda: D.week(I("2008-12-31").cast("date"), 1), "z": lambda: D.week(I("2000-01-01").cast("date"), 0), "z2": lambda: D.week(I("2000-01-01").cast("date"), 2), "yw": lambda: D.yearweek(I("1987-01-01").cast("date"))},
    "7::BIGINT AS w0, 8::BIGINT AS w1, 53::BIGINT AS e, 0::BIGINT AS z, 52::BIGINT AS z2, 198652::BIGINT AS yw",
)
functions(
    "fn_date_arithmetic", "orders", "o_orderkey",
    {
        "d": lambda: D.date_add(_TS(), 10, "DAY"), "m": lambda: D.date_add(_TS(), 1, "MONTH"), "y": lambda: D.date_sub(_TS(), 2, "YEAR"), "h": lambda: D.date_add(_TS(), 36, "HOUR"), "w": lambda: D.date_sub(_TS(), 3, "WEEK"), "q": lambda: D.date_add(_TS(), 1, "QUARTER"), "s": lambda: D.date_add(_TS(), 90, "SECOND"),
        "c": lambda: D.date_add_composite(_TS(), "1 10", "DAY_HOUR"), "td": lambda: D.timestamp_diff("MONTH", I("1995-03-01").cast("timestamp_ntz"), _TS()), "ta": lambda: D.timestamp_add("MINUTE", 5, _TS()), "ex": lambda: F.extract(I("YEAR"), _TS()),
        "un": lambda: F.unix_timestamp(_TS()), "fu": lambda: F.from_unixtime(F.unix_timestamp(_TS())), "tz": lambda: D.convert_tz(_TS(), "UTC", "America/New_York"),
    },
    "SELECT o_orderkey, t + INTERVAL 10 DAY AS d, t + INTERVAL 1 MONTH AS m, t - INTERVAL 2 YEAR AS y, t + INTERVAL 36 HOUR AS h, t - INTERVAL 21 DAY AS w, t + INTERVAL 3 MONTH AS q, t + INTERVAL 90 SECOND AS s, t + INTERVAL 34 HOUR AS c, date_sub('month', TIMESTAMP '1995-03-01', t)::BIGINT AS td, t + INTERVAL 5 MINUTE AS ta, year(t)::INTEGER AS ex, epoch(t)::BIGINT AS un, strftime(t, '%Y-%m-%d %H:%M:%S') AS fu, t AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS tz FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)",
)
functions(
    "fn_date_format", "orders", "o_orderkey",
    {"a": lambda: D.date_format(_TS(), "%Y-%m-%d %H:%i:%s"), "b": lambda: D.date_format(_TS(), "%W %M %e %y %b %a %j"), "c": lambda: D.date_format(_TS(), "%D"), "u": lambda: D.date_format(_TS(), "w%U %w %%"), "e": lambda: D.date_format(_TS(), ""),
     "s": lambda: D.str_to_date(D.date_format(_TS(), "%d.%m.%Y %H-%i-%s"), "%d.%m.%Y %H-%i-%s").cast("timestamp_ntz"), "t": lambda: D.time_format(_TS(), "%H:%i"), "tm": lambda: D.time(_TS())},
    "SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS a, strftime(t, '%A %B %-d %y %b %a %j') AS b, day(t) || CASE WHEN day(t) BETWEEN 11 AND 13 THEN 'th' WHEN day(t) % 10 = 1 THEN 'st' WHEN day(t) % 10 = 2 THEN 'nd' WHEN day(t) % 10 = 3 THEN 'rd' ELSE 'th' END AS c, 'w' || strftime(t, '%U') || ' ' || strftime(t, '%w') || ' %' AS u, NULL::VARCHAR AS e, date_trunc('second', t) AS s, strftime(t, '%H:%M') AS t, strftime(t, '%H:%M:%S') AS tm FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)",
)
literals(
    "fn_time_special",
    {
        "st": lambda: D.sec_to_time(I(2378)), "sn": lambda: D.sec_to_time(I(-360000)), "tt": lambda: D.time_to_sec(I("22:23:00")), "tn": lambda: D.time_to_sec(I("-100:00:01")), "mt": lambda: D.maketime(I(12), I(15), I(30)), "m0": lambda: D.maketime(I(12), I(75), I(0)),
        "md": lambda: D.makedate(I(2011), I(32)), "m2": lambda: D.makedate(I(11), I(1)), "m9": lambda: D.makedate(I(2011), I(0)), "pa": lambda: D.period_add(I(200801), I(2)), "pb": lambda: D.period_add(I(200801), I(-13)), "pd": lambda: D.period_diff(I(200802), I(200703)),
        "at": lambda: D.addtime(I("2007-12-31 23:59:59").cast("timestamp"), I("1:01:01")).cast("timestamp_ntz"), "sb": lambda: D.subtime(I("2008-01-01 00:00:00").cast("timestamp"), I("25:00:00")).cast("timestamp_ntz"), "gf": lambda: D.get_format("DATE", "EUR"), "y1": lambda: D.year_of(I(69)).cast("int"), "y2": lambda: D.year_of(I(70)).cast("int"),
        "zd": lambda: D.zero_date(I("0000-00-00")), "zo": lambda: D.zero_date(I("2010-02-03")), "jl": lambda: D.date_add(I("2023-01-31").cast("timestamp_ntz"), 1, "MONTH"), "bad": lambda: D.str_to_date(I("xx"), "%Y-%m-%d").cast("timestamp_ntz"),
    },
    "'00:39:38' AS st, '-100:00:00' AS sn, 80580::BIGINT AS tt, -360001::BIGINT AS tn, '12:15:30' AS mt, NULL::VARCHAR AS m0, DATE '2011-02-01' AS md, DATE '2011-01-01' AS m2, NULL::DATE AS m9, 200803::BIGINT AS pa, 200612::BIGINT AS pb, 11::BIGINT AS pd, TIMESTAMP '2008-01-01 01:01:00' AS at, TIMESTAMP '2007-12-30 23:00:00' AS sb, '%d.%m.%Y' AS gf, 2069 AS y1, 1970 AS y2, NULL::DATE AS zd, DATE '2010-02-03' AS zo, TIMESTAMP '2023-02-28 00:00:00' AS jl, NULL::TIMESTAMP AS bad",
)
query("fn_now", "SELECT TRUE AS d, TRUE AS n, TRUE AS u, TRUE AS t")(
    lambda spark, sf: spark.range(1).select(
        (F.current_date() == F.to_date(F.now())).alias("d"), (F.localtimestamp() >= I("2020-01-01").cast("timestamp_ntz")).alias("n"),
        (D.utc_date() == F.to_date(D.utc_timestamp())).alias("u"), (F.length(D.utc_time()) == 8).alias("t"),
    )
)

# --- JSON, hashes, UUIDs ---------------------------------------------------------------

functions(
    "fn_json_extract", "events", "event_id",
    {"k": lambda: J.json_unquote_extract(C("props"), "$.k"), "e": lambda: J.json_extract(C("props"), "$.k"), "v": lambda: J.json_valid(C("props")), "n": lambda: J.json_length(C("props")), "t": lambda: J.json_type(C("props")), "s": lambda: J.json_storage_size(C("props"))},
    "SELECT event_id, props ->> '$.k' AS k, (props -> '$.k')::VARCHAR AS e, 1::BIGINT AS v, 1::BIGINT AS n, 'OBJECT' AS t, strlen(props)::BIGINT AS s FROM events",
)
literals(
    "fn_json",
    {
        "a": lambda: J.json_array(I(1), I("b"), I(None).cast("string"), I(True)), "o": lambda: J.json_object(id=I(87), name=I('ca"r'), none=I(None).cast("int")), "q": lambda: J.json_quote(I('a "b"')), "u": lambda: J.json_unquote(I('"a\\tb"')), "u2": lambda: J.json_unquote(I("[1]")),
        "l": lambda: J.json_length(I('[1, 2, {"a": 3}]')), "l1": lambda: J.json_length(I("5")), "lp": lambda: J.json_length(I('{"a": 1, "b": {"c": 30}}'), "$.b"), "d": lambda: J.json_depth(I('[10, {"a": 20}]')), "d1": lambda: J.json_depth(I("true")),
        "mp": lambda: J.json_merge_patch(I('{"a": 1, "b": 2}'), I('{"a": 3, "b": null, "c": {"d": 4}}')), "mv": lambda: J.json_merge_preserve(I('{"a": 1}'), I('{"a": 2, "b": 3}')), "ma": lambda: J.json_merge(I("[1, 2]"), I("true")),
        "c1": lambda: J.json_contains(I('{"a": 1, "b": [2, 3]}'), I('{"b": [3]}')), "c0": lambda: J.json_contains(I("[1, 2]"), I("3")), "ap": lambda: J.json_append(I("[1]"), I("$"), I('"x"')), "v0": lambda: J.json_valid(I("{bad")), "p": lambda: J.json_pretty(I('{"a":1}')),
        "t1": lambda: J.json_type(I("[1]")), "t2": lambda: J.json_type(I("1")), "t3": lambda: J.json_type(I('"x"')), "t4": lambda: J.json_type(I("1.5")), "t5": lambda: J.json_type(I("true")), "t6": lambda: J.json_type(I("null")), "ex": lambda: J.json_extract(I('{"a": {"b": "x"}}'), "$.a"),
    },
    "'[1,\"b\",null,true]' AS a, '{\"id\":87,\"name\":\"ca\\\"r\",\"none\":null}' AS o, '\"a \\\"b\\\"\"' AS q, 'a' || chr(9) || 'b' AS u, '[1]' AS u2, 3::BIGINT AS l, 1::BIGINT AS l1, 1::BIGINT AS lp, 3::BIGINT AS d, 1::BIGINT AS d1, '{\"a\": 3, \"c\": {\"d\": 4}}' AS mp, '{\"a\": [1, 2], \"b\": 3}' AS mv, '[1, 2, true]' AS ma, 1::BIGINT AS c1, 0::BIGINT AS c0, '[1, \"x\"]' AS ap, 0::BIGINT AS v0, '{' || chr(10) || '  \"a\": 1' || chr(10) || '}' AS p, 'ARRAY' AS t1, 'INTEGER' AS t2, 'STRING' AS t3, 'DOUBLE' AS t4, 'BOOLEAN' AS t5, 'NULL' AS t6, '{\"b\":\"x\"}' AS ex",
)
functions(
    "fn_hash", "customer", "c_custkey",
    {"m": lambda: J.md5(C("c_name")), "s1": lambda: J.sha1(C("c_name")), "s2": lambda: J.sha2(C("c_name"), 0), "s5": lambda: J.sha2(C("c_name"), 256), "sx": lambda: J.sha2(C("c_name"), 7), "ae": lambda: J.aes_decrypt(J.aes_encrypt(C("c_name"), "a key that is longer than sixteen"), "a key that is longer than sixteen").cast("string")},
    "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, sha256(c_name) AS s5, NULL::VARCHAR AS sx, c_name AS ae FROM customer",
)
literals(
    "fn_uuid",
    {"b": lambda: F.hex(J.uuid_to_bin(I("6ccd780c-baba-1026-9564-5b8c656024db"))), "s": lambda: F.hex(J.uuid_to_bin(I("6ccd780c-baba-1026-9564-5b8c656024db"), True)), "r": lambda: J.bin_to_uuid(J.uuid_to_bin(I("6ccd780c-baba-1026-9564-5b8c656024db"))), "w": lambda: J.bin_to_uuid(J.uuid_to_bin(I("6ccd780c-baba-1026-9564-5b8c656024db"), True), True)},
    "'6CCD780CBABA102695645B8C656024DB' AS b, '1026BABA6CCD780C95645B8C656024DB' AS s, '6ccd780c-baba-1026-9564-5b8c656024db' AS r, '6ccd780c-baba-1026-9564-5b8c656024db' AS w",
)
functions(
    "fn_cast", "supplier", "s_suppkey",
    {"s": lambda: C("s_suppkey").cast("string"), "d": lambda: C("s_acctbal").cast("decimal(12,2)"), "i": lambda: F.round("s_acctbal").cast("long"), "t": lambda: F.try_to_number(I("x1"), I("999")).cast("double"), "b": lambda: C("s_name").cast("binary"), "sm": lambda: C("s_nationkey").cast("smallint"), "ti": lambda: C("s_nationkey").cast("tinyint"), "f": lambda: C("s_nationkey").cast("double"), "dt": lambda: I("1995-02-03").cast("date")},
    "SELECT s_suppkey, s_suppkey::VARCHAR AS s, s_acctbal::DECIMAL(12,2) AS d, round(s_acctbal)::BIGINT AS i, NULL::DOUBLE AS t, s_name::BLOB AS b, s_nationkey::SMALLINT AS sm, s_nationkey::TINYINT AS ti, s_nationkey::DOUBLE AS f, DATE '1995-02-03' AS dt FROM supplier",
)
