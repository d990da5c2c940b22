"""Table schemas shared by sources, operators and reports."""

from pyspark.sql import types as T

ALLOWLIST = T.StructType(
    [
        T.StructField("paths", T.ArrayType(T.StringType(), False), False),
        T.StructField("commits", T.ArrayType(T.StringType(), False), False),
        T.StructField("regex_target", T.StringType(), False),
        T.StructField("regexes", T.ArrayType(T.StringType(), False), False),
        T.StructField("stopwords", T.ArrayType(T.StringType(), False), False),
    ]
)

RULES = T.StructType(
    [
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("id", T.StringType(), True),
        T.StructField("description", T.StringType(), False),
        T.StructField("regex", T.StringType(), True),
        T.StructField("keywords", T.ArrayType(T.StringType(), False), False),
        T.StructField("allowlist", ALLOWLIST, True),
        # documented in the catalogue format, used only when opted in
        T.StructField("secret_group", T.IntegerType(), True),
        T.StructField("entropy", T.DoubleType(), True),
        T.StructField("path", T.StringType(), True),
        T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    ]
)

# Column order of every report.
LEAK_COLUMNS = (
    "line",
    "line_number",
    "offender",
    "commit",
    "repo",
    "rule",
    "commit_message",
    "author",
    "email",
    "file",
    "date",
)
