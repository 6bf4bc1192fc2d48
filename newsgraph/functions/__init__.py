"""Column functions shared by the operators; all of them are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TEXT = "null"
XSD = "http://www.w3.org/2001/XMLSchema#"

# Number shapes accepted by Python's int() and float(): any Unicode digits, single underscores between digits,
# surrounding white space, and for floats an exponent, nan and infinity.
_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]*"
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
INTEGER_PATTERN = rf"^{_SPACE}[+-]?{_DIGITS}{_SPACE}$"
FLOAT_PATTERN = (
    rf"^(?i:{_SPACE}[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    rf"|nan|inf|infinity){_SPACE})$"
)


def null_text(col: Column) -> Column:
    """Ingestion null layer: NULL and '' become the text 'null'; other types are cast to text."""
    text = col.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(NULL_TEXT)).otherwise(text)


def text_or_null(col: Column) -> Column:
    """The inverse reading: the text 'null' and NULL become NULL."""
    return F.when(col != NULL_TEXT, col)


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def prefixed_md5(prefix: str, col: Column) -> Column:
    """md5 with a type prefix, for example body_<hex>."""
    return F.concat(F.lit(prefix), F.md5(col))


def webpage_id(article_id: Column, url_hash: Column) -> Column:
    return F.concat_ws("_", article_id, url_hash)


# Where percent-encoding of IRIs differs from form encoding.
_IRI_FIXES = (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A"))


def iri_quote(col: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``_.-~/`` and encodes everything else."""
    return reduce(lambda q, fix: F.replace(q, F.lit(fix[0]), F.lit(fix[1])), _IRI_FIXES, F.url_encode(col))


def iri_quote_sql(text: str) -> str:
    """``iri_quote`` as SQL text, for expressions that are built as text."""
    return reduce(lambda q, fix: f"replace({q}, '{fix[0]}', '{fix[1]}')", _IRI_FIXES, f"url_encode({text})")


def guess_type(col: Column, guess_datetime: bool = False) -> Column:
    """'integer', 'float' or 'string' for a text value; NULL for NULL, 'null' and ''."""
    guess = F.when(col.isNull() | col.isin("", NULL_TEXT), F.lit(None).cast("string"))
    guess = guess.when(col.rlike(INTEGER_PATTERN), "integer").when(col.rlike(FLOAT_PATTERN), "float")
    if guess_datetime:
        guess = guess.when(F.try_to_timestamp(col).isNotNull(), "datetime")
    return guess.otherwise("string")


def xsd_type(guess: Column) -> Column:
    """XSD datatype of a guessed type; NULL (plain literal) when there is no guess."""
    return (
        F.when(guess == "integer", XSD + "integer")
        .when(guess == "float", XSD + "float")
        .when(guess == "datetime", XSD + "dateTime")
        .when(guess.isNotNull(), XSD + "string")
    )


def strip_namespace(col: Column) -> Column:
    """Text after the first '#', or the whole text when there is none."""
    return F.substr(col, F.instr(col, "#") + F.lit(1))


def decode_json_map(col: Column) -> Column:
    """JSON object text as map<string,string>; an empty map when it cannot be decoded."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(col, "map<string,string>"), empty)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def percent_of_total(df: DataFrame, value: str, output: str) -> DataFrame:
    """Add ``value`` as percent of its total.

    The total is a scalar subquery: a partial sum per task, one row back, and no window over all rows.
    """
    total = df.agg(F.sum(value).alias("total")).select("total").scalar()
    return df.withColumn(output, F.col(value) / total * F.lit(100.0))
