"""One form for text that looks the same but is written with other characters.

Values are first mapped to one alphabet by plain SQL expressions (``translate`` and
``replace``): wide and narrow forms, letters of other alphabets drawn like Latin ones,
letters joined into one sign, every kind of blank, invisible characters. What then remains
to be told apart or joined is left to the accent-sensitive ``UNICODE`` collation: composed
and decomposed accents are equal under it, other accents, letter case and punctuation are
not. The canonical member of a class is its smallest value in binary order.

Nulls belong to no class. The empty string and strings of blanks form a class of their own.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that are drawn like a Latin letter.
DRAWN_ALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "ї": "ï", "ё": "ë",
    "Ї": "Ï", "Ё": "Ë",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "ό": "ó", "ά": "á",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    # Latin and phonetic variants
    "ɡ": "g", "ɑ": "a", "ʏ": "y", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
}
def _signs(*spans: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in spans for c in range(a, b + 1))


#: Signs that have no look of their own: soft hyphen, joiners, zero widths, direction marks, variation selectors.
INVISIBLE = _signs((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
#: Signs with the look of one blank.
BLANKS = _signs((0x09, 0x0D), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Wide, narrow, font and joined forms of letters and signs by Unicode's own decompositions: single letters, and signs of several letters."""
    one, many = {}, {}
    for span in (range(0x132, 0x134), range(0x13F, 0x141), range(0x1C4, 0x1F4), range(0x2100, 0x214A), range(0x2160, 0x2180), range(0xFB00, 0xFB07), range(0xFB13, 0xFB18), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800)):
        for code in span:
            kind, _, _ = unicodedata.decomposition(chr(code)).partition(" ")
            if kind not in ("<wide>", "<narrow>", "<font>", "<compat>"):
                continue
            form = unicodedata.normalize("NFKC", chr(code))
            if kind == "<compat>" and not form.isalpha():
                continue
            (one if len(form) == 1 else many)[chr(code)] = form
    return one, many


def mapping() -> tuple[dict[str, str], dict[str, str]]:
    """Sign to sign, and sign to several letters."""
    one, many = _compatible()
    singles = one | DRAWN_ALIKE | {b: " " for b in BLANKS}
    # a form may itself be drawn like a Latin letter (a wide or bold Greek one)
    return {k: singles.get(v, v) for k, v in singles.items()}, many


def look_of(text: Column) -> Column:
    """The value with every character replaced by the one it looks like; blanks at the edges and invisible signs removed."""
    singles, many = mapping()
    parted = text
    for sign, form in many.items():
        parted = F.replace(parted, F.lit(sign), F.lit(form))
    text = F.when(text.rlike("[" + "".join(many) + "]"), parted).otherwise(text)
    source = "".join(singles) + INVISIBLE
    plain = F.translate(text, source, "".join(singles.values()))
    # several marks on one letter, in whatever order, are composed by the ICU library that Spark's collations use: they expect them in canonical order
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), plain, F.lit(False))
    return F.trim(F.when(plain.rlike(r"\p{M}"), composed).otherwise(plain))


_CLASSES = """
SELECT look, min(value) AS canonical, count(*) AS values_in_class
FROM (SELECT DISTINCT value, collate(look, 'UNICODE') AS look FROM {values})
GROUP BY look
"""


def canonical_forms(df: DataFrame, value_col: str) -> DataFrame:
    """``(value, canonical, values_in_class)``, one row per distinct value: the class is found by grouping under the collation in SQL and joined back."""
    spark = df.sparkSession
    values = df.select(F.col(value_col).cast("string").alias("value")).where("value is not null").distinct().withColumn("look", look_of(F.col("value")))
    classes = spark.sql(_CLASSES, values=values)
    looks = values.select("value", F.collate("look", "UNICODE").alias("value_look"))
    return looks.join(classes, F.col("value_look") == F.col("look")).select("value", "canonical", "values_in_class")


def with_canonical(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """``(key, value, canonical)``: one row per distinct key and value; null keys and values are left out."""
    keyed = df.select(F.col(key_col).alias("key"), F.col(value_col).cast("string").alias("own_value")).where("key is not null and own_value is not null").distinct()
    forms = canonical_forms(df, value_col)
    return keyed.join(forms, F.col("own_value") == F.col("value")).select("key", "value", "canonical", "values_in_class")


def lookalike_groups(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """``(canonical, lead_key, key, value)`` for every class of at least two different values, one row per member; the lead is the smallest key."""
    members = with_canonical(df, key_col, value_col).where("values_in_class > 1")
    leads = members.groupBy(F.col("canonical").alias("form")).agg(F.min("key").alias("lead_key"))
    return members.join(leads, F.col("canonical") == F.col("form")).select("canonical", "lead_key", "key", "value")


def lookalike_pairs(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """``(key_a, key_b)``: the pairs of keys, smaller first, whose values look the same but differ. Keys of one and the same string are no pair."""
    members = with_canonical(df, key_col, value_col).where("values_in_class > 1").select("canonical", "key", "value")
    a = members.select(F.col("canonical").alias("ca"), F.col("key").alias("key_a"), F.col("value").alias("va"))
    b = members.select(F.col("canonical").alias("cb"), F.col("key").alias("key_b"), F.col("value").alias("vb"))
    return a.join(b, (F.col("ca") == F.col("cb")) & (F.col("va") != F.col("vb")) & (F.col("key_a") < F.col("key_b"))).select("key_a", "key_b").distinct()
