from tidemill.functions import catalog

#: Names of the surveyed function families that must be answered.
NAMES = """
+ - * / DIV % GREATEST LEAST COALESCE INTERVAL UNARY_MINUS UNARY_PLUS NOT AND OR XOR BETWEEN NOT_BETWEEN IN NOT_IN LIKE REGEXP RLIKE <=> = <> IS_TRUE IS_FALSE IS_NOT_TRUE IS_NOT_FALSE ISNULL ROW IF CASE IFNULL NULLIF
& | ^ ~ << >> BIT_COUNT ABS ACOS ASIN ATAN ATAN2 CEIL CEILING COS COT CRC32 DEGREES EXP FLOOR LN LOG LOG10 LOG2 MOD PI POW POWER RADIANS RAND SIGN SIN SPECIAL_POW SQRT TAN TRUNCATE ROUND CONV
ASCII BIN BIT_LENGTH CHAR CHAR_LENGTH CHARACTER_LENGTH CHARSET COLLATION COMPRESS CONCAT CONCAT_WS ELT FIELD FIND_IN_SET FORMAT FROM_BASE64 INSERT INSTR LCASE LEFT LOWER LPAD LTRIM MAKE_SET MID OCT ORD POSITION QUOTE REPEAT
REPLACE REVERSE RIGHT RPAD RTRIM SOUNDEX SPACE STRCMP SUBSTR SUBSTRING SUBSTRING_INDEX TO_BASE64 UCASE UNCOMPRESS UPPER TRIM LOCATE LENGTH HEX CONVERT
CURDATE CURTIME DATE DATEDIFF DATE_FORMAT DATE_SUB SUBDATE DATE_ADD ADDDATE DAY DAYNAME DAYOFMONTH DAYOFWEEK DAYOFYEAR FROM_DAYS GET_FORMAT HOUR LAST_DAY LOCALTIME MAKEDATE MICROSECOND MINUTE MONTH MONTHNAME NOW PERIOD_ADD
PERIOD_DIFF QUARTER SEC_TO_TIME SECOND SUBTIME TIME TIME_FORMAT TIME_TO_SEC TIMESTAMP TO_DAYS TO_MONTHS TO_SECONDS TO_WEEKS UTC_DATE UTC_TIME UTC_TIMESTAMP WEEK WEEKOFYEAR WEEKDAY YEAR YEARWEEK STR_TO_DATE FROM_UNIXTIME
UNIX_TIMESTAMP TIMESTAMPADD TIMESTAMPDIFF EXTRACT ADDTIME MAKETIME CONVERT_TZ
JSON_APPEND JSON_ARRAY JSON_DEPTH -> ->> JSON_LENGTH JSON_MERGE JSON_MERGE_PATCH JSON_MERGE_PRESERVE JSON_OBJECT JSON_PRETTY JSON_QUOTE JSON_STORAGE_SIZE JSON_TYPE JSON_VALID JSON_EXTRACT JSON_UNQUOTE JSON_CONTAINS
AES_DECRYPT AES_ENCRYPT MD5 RANDOM_BYTES SHA SHA1 SHA2 BIN_TO_UUID UUID UUID_TO_BIN VERSION DATABASE USER
COUNT SUM SUM0 AVG MIN MAX BIT_AND_AGG BIT_OR_AGG BIT_XOR_AGG GROUP_CONCAT JSON_ARRAYAGG JSON_OBJECTAGG HYPERLOGLOG CHECK_SUM HASHCHECK SINGLE_VALUE STD STDDEV STDDEV_SAMP VAR_POP VAR_SAMP VARIANCE COVAR_POP REGR_SXX REGR_SYY
ROW_NUMBER RANK DENSE_RANK PERCENT_RANK CUME_DIST NTILE LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE GROUPING GROUPING_ID
""".split()


def test_names_are_answered(spark):
    assert set(NAMES) - set(catalog.functions()) == set()
