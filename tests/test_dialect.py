import pytest

from tidemill import dialect


@pytest.mark.parametrize(
    "text, expected",
    [
        ("select 'a||b', \"it's\" from t", "select 'a||b', 'it\\'s' from t"),
        ("select a || b && !c", "select (CAST((a) AS BOOLEAN) OR CAST(((CAST((b) AS BOOLEAN) AND CAST(((NOT CAST((c) AS BOOLEAN))) AS BOOLEAN))) AS BOOLEAN)) "),
        ("select * from t limit 5, 10", "select * from t limit 10 OFFSET 5"),
        ("select lcase(x), lcase from t", "select lower(x), lcase from t"),
        ("select x->>'$.a' from t", "select get_json_object(x, '$.a') from t"),
        ("select /*+ CMD: BKA_JOIN(a, b) */ 1", "select /*+ SHUFFLE_HASH(a, b) */ 1"),
        ("select a regexp 'x' xor b", "select (CAST((a RLIKE 'x') AS BOOLEAN) <> CAST((b) AS BOOLEAN))"),
        ("select a * b / c, 7 % (x + 1)", "select try_divide(a * b, c), try_mod(7, (x + 1))"),
    ],
)
def test_rewrite(text, expected):
    assert dialect.rewrite(text) == expected


def test_statements_are_split_outside_of_strings():
    assert dialect.split_statements("select ';' ; -- x;y\n select `a;b`; ") == ["select ';'", "select `a;b`"]


def test_bad_text_is_refused():
    with pytest.raises(ValueError):
        dialect.rewrite("select \x01")


def test_catalogue_names_answer_in_text(spark):
    calls = {
        "QUOTE('abc')": "'abc'", "MICROSECOND(TIMESTAMP'2020-01-01 00:00:00.123456')": 123456, "YEARWEEK(DATE'2020-01-01')": 201952, "TIME_FORMAT('10:20:30', '%H.%i')": "10.20",
        "JSON_VALID('{')": 0, "GET_FORMAT('DATE', 'ISO')": "%Y-%m-%d", "TO_MONTHS(DATE'2020-01-01')": 24241, "SPECIAL_POW(2, 3)": 8.0, "FROM_BASE64('YQ==')": "a", "COT(1)": 0.6420926159343306,
        "JSON_MERGE_PRESERVE('[1]', '[2]')": "[1, 2]", "JSON_CONTAINS('[1, 2]', '1')": 1, "WEEK(DATE'2008-02-20', 0)": 7, "WEEK(DATE'2008-02-20', 1)": 8, "TIMESTAMPDIFF(DAY, DATE'2020-01-01', DATE'2020-01-05')": 4,
        "UNCOMPRESSED_LENGTH(COMPRESS('abc'))": 3, "BIN(1 + 4)": "101", "JSON_DEPTH('[1]') + 1": 3, "QUOTE(CONCAT('it', '\\'', 's'))": "'it\\'s'",
    }
    text = "SELECT " + ", ".join(f"{c} AS v{i}" for i, c in enumerate(calls))
    assert list(dialect.run(spark, text).collect()[0]) == list(calls.values())
    with pytest.raises(Exception, match="no_such_call"):
        dialect.run(spark, "SELECT no_such_call(1)").collect()
