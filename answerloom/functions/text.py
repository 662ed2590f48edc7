"""Text columns: trimming as each source language does it, and coercion to text."""

from pyspark.sql import functions as F, types as T

# Unicode space separators (category Zs).
SEPARATORS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
# Python's str.strip() and re \s: all Unicode white space plus U+001C..U+001F.
BLANKS = SEPARATORS + "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0x2028, 0x2029)))
PY_SPACE = r"[\s\x1c-\x1f]"  # the same set inside a (?U) pattern


def sql_trim(c):
    """Strip Unicode space separators but no control characters (SQL-engine ``trim``)."""
    return F.btrim(c, F.lit(SEPARATORS))


def py_strip(c):
    return F.btrim(c, F.lit(BLANKS))


def py_rstrip(c):
    return F.rtrim(c, F.lit(BLANKS))


def py_words(c):
    """Whitespace-separated words, like ``str.split()``."""
    return F.filter(F.split(c, rf"(?U){PY_SPACE}+"), lambda w: w != "")


def _number_text(c):
    """A double as Python prints it: plain from 1e-4 up to 1e16, else with a signed two-digit exponent."""
    plain = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.regexp_replace(c.cast("string"), r"\.0E", "E")
    padded = F.regexp_replace(F.regexp_replace(short, r"E(\d)", "e+$1"), "E-", "e-")
    signed = F.regexp_replace(padded, r"e([+-])(?=\d$)", r"e$1\0")
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(c == 0, c.cast("string")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(signed))


def _raw_text(c, dtype):
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    if isinstance(dtype, T.ArrayType):
        parts = F.transform(c, lambda e: to_text(e, dtype.elementType))
        return F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                e["key"].cast("string").alias("k"),
                to_text(e["value"], dtype.valueType).alias("v"),
            ),
        )
        kept = F.filter(entries, lambda e: e["v"] != "")
        return F.array_join(F.transform(kept, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), ", ")
    if isinstance(dtype, T.StructType):
        # The columnar form of a dict: absent and empty fields are left out.
        parts = F.array(*[
            F.struct(F.lit(f.name).alias("k"), to_text(c[f.name], f.dataType).alias("v")) for f in dtype.fields
        ]) if dtype.fields else F.array()
        kept = F.filter(parts, lambda e: e["v"] != "")
        return F.when(c.isNotNull(), F.array_join(
            F.transform(kept, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), ", ")) if dtype.fields else F.lit("")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _number_text(c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def to_text(c, dtype, max_chars=None):
    """Any column as clean text; ``dtype`` is known when the plan is built.

    NULL becomes ``''``; arrays are joined with ``", "`` without their empty
    parts; maps and structs become ``"k: v"`` pairs; bytes are read as UTF-8 with
    replacement. The text is stripped, then cut to ``max_chars`` code points.
    """
    text = py_strip(F.coalesce(_raw_text(c, dtype), F.lit("")))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def column_text(df, name, max_chars=None):
    return to_text(F.col(name), df.schema[name].dataType, max_chars)


def flatten_lines(c):
    """One sample line: newlines become spaces, ends are stripped."""
    return py_strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def sample_lines(c):
    """Lines of a text that was written to a text file and read back.

    The writer turns newlines into spaces, the reader also breaks at carriage
    returns; every resulting line is stripped.
    """
    return F.transform(
        F.split(F.replace(c, F.lit("\n"), F.lit(" ")), "\r"), lambda line: py_strip(line)
    )


def preview(c, n=200):
    return F.substring(F.coalesce(c, F.lit("")), 1, n)
