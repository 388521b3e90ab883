"""Column layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities in ranking order; an unknown label ranks after all of them.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
UNKNOWN_RANK = len(SEVERITIES)

# Scanners in registration order.
SCANNERS = ("custom", "deps", "headers", "injection", "secrets")

FILES_DDL = "repo string, path string, file_seq bigint, content string"

# Tie order of a finding before the severity sort: scanner, file, then position in the file's
# own output.
EMIT_SEQ_DDL = "struct<scanner:int,file_seq:bigint,part:int,a:bigint,b:bigint,c:bigint>"

FINDINGS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("scanner", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("fix_phase", T.IntegerType()),
        T.StructField("fix_summary", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("ai_confirmed", T.BooleanType()),
        T.StructField("reachable", T.BooleanType()),
        T.StructField("project_level", T.BooleanType()),
        T.StructField("line_text", T.StringType()),
        T.StructField(
            "emit_seq",
            T.StructType(
                [
                    T.StructField("scanner", T.IntegerType()),
                    T.StructField("file_seq", T.LongType()),
                    T.StructField("part", T.IntegerType()),
                    T.StructField("a", T.LongType()),
                    T.StructField("b", T.LongType()),
                    T.StructField("c", T.LongType()),
                ]
            ),
        ),
    ]
)

def emit_seq(scanner, file_seq, part=0, a=0, b=0, c=0) -> Column:
    """Tie-order struct; integers or columns."""

    def col(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.struct(
        col(scanner, "int").alias("scanner"),
        col(file_seq, "bigint").alias("file_seq"),
        col(part, "int").alias("part"),
        col(a, "bigint").alias("a"),
        col(b, "bigint").alias("b"),
        col(c, "bigint").alias("c"),
    )


def as_findings(df: DataFrame, keep=()) -> DataFrame:
    """Project ``df`` onto the findings layout; absent columns take the model's defaults.

    Columns named in ``keep`` are carried through."""
    defaults = {
        "snippet": F.lit(""),
        "fix_phase": F.lit(1),
        "fix_summary": F.lit(""),
        "references": F.array().cast("array<string>"),
        "project_level": F.lit(False),
    }
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in FINDINGS.fields
        ],
        *keep,
    )
