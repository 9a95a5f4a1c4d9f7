"""Column functions on texts. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks entries that are no ordinary models, and how sizes in billions are written.
SIDELINED = (
    r"(gguf|awq|gptq|fp8|nvfp4|bnb-?4bit|-mlx|int4|int8|w4a16|w8a8|quantized"
    r"|embedding|reranker|bge-|gte-|tiny-random|internal-testing|unit-test"
    r"|-ocr|hunyuanocr|readerlm|\btts\b|parler|lyria|nano banana|image|audio"
    r"|router|fusion|\bt5\b|-base\b|guard)"
)
PRODUCT_OF_SIZES = r"(?i)(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*b\b"
SIZE = r"(?i)(?<![\d.])(\d+(?:\.\d+)?)\s*b\b"
#: What a number may look like, besides inf and nan; a cast alone would also take '1d' and '1.0f'.
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def to_number(text: Column) -> Column:
    """double; null for null, NaN and whatever is no number. Infinities are numbers."""
    s = text.cast("string")
    x = F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.when(~F.isnan(x), x)


def to_price(text: Column) -> Column:
    """to_number, but null where negative: such prices are marks, not amounts."""
    x = to_number(text)
    return F.when(x >= 0, x)


def squashed(text: Column) -> Column:
    """Lower case, ASCII letters and digits only; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def both(name: Column, identifier: Column) -> Column:
    """The two with a space between, which is there even if either is null."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(identifier, F.lit("")))


def sidelined(text: Column, pattern: str = SIDELINED) -> Column:
    return text.rlike(f"(?i){pattern}")


def billions(text: Column) -> Column:
    """The greatest of all sizes in the text and of its first product of sizes; null if there are none."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(SIZE), F.lit(1)), lambda s: s.cast("double"))
    a, b = (F.regexp_extract(text, PRODUCT_OF_SIZES, i) for i in (1, 2))
    return F.array_max(F.concat(sizes, F.when(a != "", F.array(a.cast("double") * b.cast("double"))).otherwise(F.array().cast("array<double>"))))


def contains_text(query: str, *columns: Column) -> Column:
    """Whether any of the columns has the query in it, whatever the case; % and _ are ordinary letters."""
    q = F.lit(query.lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return found


def last_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
