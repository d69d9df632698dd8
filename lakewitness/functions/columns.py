"""Column expressions shared by the operators: missingness, type families, text encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)

# Largest magnitude at which every whole number is exact in a double.
EXACT_INTEGER = 2**53


def base_type(data_type: T.DataType) -> str:
    """Logical type family before missing values are looked at."""
    if isinstance(data_type, INTEGRAL):
        return "int64"
    if isinstance(data_type, FRACTIONAL):
        return "float64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "object"


def is_numeric(data_type: T.DataType) -> bool:
    return base_type(data_type) in ("int64", "float64")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def q(name: str) -> Column:
    """Reference a column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL, so that one test covers both."""
    column = q(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(q(field.name))
    return present(field).cast("string")


def logical_dtype(base: Column, missing: Column) -> Column:
    """Whole numbers and booleans change their label once a value is missing."""
    return (
        F.when((base == "int64") & (missing > 0), F.lit("float64"))
        .when((base == "bool") & (missing > 0), F.lit("object"))
        .otherwise(base)
    )


def exact_text(field: T.StructField) -> Column:
    """Text of a cell, equal for two cells of a type family exactly when their values are equal.

    A number that a double holds exactly is written as one, so whole and fractional columns compare; 0.0 and -0.0
    are one value. Larger whole numbers and longer decimals keep their digits.
    """
    if not is_numeric(field.dataType):
        return as_text(field)
    value = present(field)
    text = (value.cast("double") + F.lit(0.0)).cast("string")
    if isinstance(field.dataType, T.LongType):
        return F.when(F.abs(value) > EXACT_INTEGER, value.cast("string")).otherwise(text)
    if isinstance(field.dataType, T.DecimalType):
        same = value.cast("double").cast(field.dataType) == value
        return F.when(same, text).when(value.isNotNull(), value.cast("string"))
    return text


def rounded_text(field: T.StructField) -> Column:
    """``exact_text`` with fractional numbers at 15 significant digits.

    A shortest decimal form of at most 16 characters has no more digits than that; only the longer
    ones pay for formatting.
    """
    text = exact_text(field)
    if not isinstance(field.dataType, FRACTIONAL):
        return text
    number = present(field).cast("double") + F.lit(0.0)
    return F.when(F.length(text) <= 16, text).when(number.isNotNull(), F.format_string("%.14e", number).cast("double").cast("string"))


def portable_number(value: Column) -> Column:
    """Text of a double that any engine can make from its value: whole numbers as they are, others as an odd or even whole number
    of 53 bits and its power of two. 0.0 and -0.0 are one value; NULL stays NULL."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm may be off by one next to a power of two.
    power = guess - F.when(two(guess) > size, 1).otherwise(0) + F.when(two(guess + 1) <= size, 1).otherwise(0)
    digits = F.try_divide(size, two(power)) * F.lit(float(2**52))
    sign = F.when(value < 0, "-").otherwise("")
    return (
        F.when((size < EXACT_INTEGER) & (value == F.floor(value)), value.cast("long").cast("string"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(value.isNotNull(), F.concat(sign, digits.cast("long").cast("string"), F.lit("p"), power.cast("string")))
    )


def portable_text(field: T.StructField) -> Column:
    """Text of a cell that another engine can repeat."""
    value = present(field)
    if isinstance(field.dataType, INTEGRAL):
        return value.cast("string")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return portable_number(value.cast("double"))
    if isinstance(field.dataType, T.DecimalType):
        same = value.cast("double").cast(field.dataType) == value
        return F.when(same, portable_number(value.cast("double"))).otherwise(value.cast("string"))
    return as_text(field)


def portable_digest(df: DataFrame, names: list[str]) -> Column:
    """SHA-256 of the named cells in hexadecimal: each as its length in bytes, a colon and its portable text, or ``-``."""
    fields = {f.name: f for f in df.schema.fields}
    cells = []
    for n in names:
        text = portable_text(fields[n])
        cells.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*cells), 256)


def portable_digests(df: DataFrame, names: list[str], alias: str) -> DataFrame:
    """``portable_digest`` of every row as the one column ``alias``, in projections that each do little per column.

    One expression over all columns becomes a method too long for the JVM to compile, and takes every logarithm and power
    several times. Here the binary exponent of a fractional number is taken once; numbers from 2^-10 to 2^53 are then scaled by a shift,
    which is exact, and ``portable_number`` is left with the others.
    """
    fields = {f.name: f for f in df.schema.fields}
    doubles = [i for i, n in enumerate(names) if isinstance(fields[n].dataType, (T.FloatType, T.DoubleType))]
    texts = [F.lit(None).cast("string") if i in doubles else portable_text(fields[n]) for i, n in enumerate(names)]
    values = [present(fields[names[i]]).cast("double").alias(f"v{i}") for i in doubles]
    out = df.select(*[t.alias(f"t{i}") for i, t in enumerate(texts) if i not in doubles], *values)
    if doubles:
        rest = [F.col(f"t{i}") for i in range(len(names)) if i not in doubles]
        size = lambda i: F.abs(F.col(f"v{i}"))
        usual = lambda i: (size(i) >= 2.0**-10) & (size(i) < EXACT_INTEGER)
        out = out.select(*rest, *[F.col(f"v{i}") for i in doubles], *[F.when(usual(i), F.floor(F.log2(size(i))).cast("int")).alias(f"p{i}") for i in doubles])
        one = F.lit(1).cast("long")
        scaled = lambda i: size(i) * F.call_function("shiftleft", one, 52 - F.greatest(F.lit(-10), F.least(F.col(f"p{i}"), F.lit(52)))).cast("double")
        out = out.select(*rest, *[F.col(f"{c}{i}") for i in doubles for c in "vp"], *[scaled(i).alias(f"d{i}") for i in doubles])

        def text(i: int) -> Column:
            v, p, d = F.col(f"v{i}"), F.col(f"p{i}"), F.col(f"d{i}")
            # The logarithm may be off by one next to a power of two; then the digits are not 53 bits.
            sure = (d >= float(2**52)) & (d < float(2**53))
            fraction = F.concat(F.when(v < 0, "-").otherwise(""), d.cast("long").cast("string"), F.lit("p"), p.cast("string"))
            whole = (F.abs(v) < EXACT_INTEGER) & (v == F.floor(v))
            return F.when(whole, v.cast("long").cast("string")).when(sure, fraction).otherwise(F.transform(F.array(v), portable_number)[0])

        out = out.select(*rest, *[text(i).alias(f"t{i}") for i in doubles])
    cell = lambda t: F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
    return out.select(F.sha2(F.concat(*[cell(F.col(f"t{i}")) for i in range(len(names))]), 256).alias(alias))


def row_digest(df: DataFrame, names: list[str], exact: list[str] | None = None) -> Column:
    """32 byte digest of the named cells, equal exactly when the cells are equal.

    A JSON array keeps missing cells apart from text and escapes quotes, so no two different rows
    share one text. With ``exact``, the cells of all other columns are rounded first.
    """
    fields = {f.name: f for f in df.schema.fields}
    cells = [(exact_text if exact is None or n in exact else rounded_text)(fields[n]) for n in names]
    return F.unhex(F.sha2(F.to_json(F.array(*cells)), 256))


def row_key(df: DataFrame, names: list[str], exact: list[str] | None = None) -> Column:
    """The first 16 bytes of ``row_digest``, for comparisons that shuffle a digest per row: among 10^10 rows two different ones share
    them with a probability of some 10^-19."""
    return F.substring(row_digest(df, names, exact), 1, 16)


def safe_div(top: Column, bottom: Column) -> Column:
    """Division with a denominator of at least one."""
    return top / F.greatest(bottom, F.lit(1))


def cap(value: Column, maximum: float) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(float(maximum)))
