"""Text that was cut off: by a field's limit, or in mid-transfer.

Per source and text column the lengths of all values, in characters and in bytes, are counted.
A source has a limit where its greatest length is a spike: many values have exactly that
length, far more than a distribution's outermost value would have. The end of each value is
then read: what a cut leaves behind it (dots, ellipses, blanks) is taken off, and so are whole
closing notes, signatures and ornaments; what remains must end with terminal punctuation, and
not with an abbreviation. At a spike every value without terminal punctuation is truncated,
headings included; elsewhere a value is truncated if it does not end with terminal punctuation
and its last line is no heading. The rule looks at each value and its source's histogram only,
never at a stated length.

Nulls and blank texts are never truncated (they count in a source's total); a null source is a
group of its own. Rows that share an id but differ: the greatest (by source, then length)
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import spread

#: Blanks of every kind.
_S = r"[\s\x{85}\x{A0}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{3000}\x{FEFF}]"
#: What may follow a cut: dots, an ellipsis, either in brackets, blanks.
CUT_MARK = rf"(?:\[{_S}*(?:\.\.+|…){_S}*\]|\.\.+|…|{_S})+$"
#: A whole closing note in brackets, a signature after a dash, or a row of ornaments, on a line of its own.
CLOSING = r"(?:(?:^|\n)[ \t]*(?:[(\[][^()\[\]\n]{3,80}[.!?][)\]]|[—–-][ \t]?[\p{L}\d]\.[ \t]?[\p{L}\d'’-]+|(?:[*#~=_·•—–-][ \t]?){2,})\s*)+$"
TERMINAL = r"[.!?][\"'»”’)]*$"
#: Ends that have a full stop but do not end a sentence: titles, initials, shillings without pence, pence without shillings.
ABBREVIATION = r"(?:(?:^|[\s\"'(«„“])(?:Mr|Mrs|Dr|St|Messrs|No|\p{Lu}|\d+s)\.|(?:^|[^.\d\s]\s+|\n)\d+d\.)$"
#: One line or two in capitals at the end, after nothing or a line that ended a sentence.
HEADING = r"(?:^|[.!?:][\"'»”’)\]]*\s*\n|\n[ \t]*\n)[^\p{Ll}\n]*\p{Lu}[^\p{Ll}\n]*(?:\n[^\p{Ll}\n]*\p{Lu}[^\p{Ll}\n]*)?$"

#: A spike: at least so many values at the greatest length, and at least so much of the source.
SPIKE_VALUES, SPIKE_SHARE = 5, 0.005


def ending(text: Column) -> Column:
    """The text without cut marks, blanks, closing notes, signatures and ornaments at its end."""
    bare = F.regexp_replace(text, CUT_MARK, "")
    return F.regexp_replace(F.regexp_replace(bare, CLOSING, ""), CUT_MARK, "")


def end_features(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(id, source, chars, bytes, blank, closed, heading)``, one row per id; the texts themselves are not shuffled."""
    text = F.col("text")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows = spread(rows)
    end = ending(text)
    read = rows.select(
        "id",
        "source",
        F.length(text).alias("chars"),
        F.octet_length(text).alias("bytes"),
        (text.isNull() | text.rlike(rf"^{_S}*$")).alias("blank"),
        end.alias("end"),
    ).select(
        "id",
        F.struct(
            "source",
            "chars",
            "bytes",
            "blank",
            (F.col("end").rlike(TERMINAL) & ~F.col("end").rlike(ABBREVIATION)).alias("closed"),
            ((F.col("end") == "") | F.col("end").rlike(HEADING)).alias("heading"),
        ).alias("f"),
    )
    return read.groupBy("id").agg(F.max("f").alias("f")).select("id", "f.*")


def length_spikes(features: DataFrame, spike_values: int = SPIKE_VALUES, spike_share: float = SPIKE_SHARE) -> DataFrame:
    """``(source, char_limit, byte_limit)`` of the sources whose greatest length is a spike in characters or bytes (the other one null).

    Both histograms are one aggregation by (source, unit, length), so that a source with a
    third of all rows is counted map-side; the greatest length of a source comes from the counts.
    """
    lengths = features.where(~F.col("blank")).select("source", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "len"))
    counts = lengths.groupBy("source", "unit", "len").agg(F.count("*").alias("n"))
    tops = counts.groupBy("source", "unit").agg(F.sum("n").alias("total"), F.max(F.struct("len", "n")).alias("top"))
    spikes = tops.where((F.col("top.n") >= spike_values) & (F.col("top.n") >= F.lit(spike_share) * F.col("total")))
    return spikes.groupBy("source").agg(
        F.max(F.when(F.col("unit") == "chars", F.col("top.len"))).alias("char_limit"),
        F.max(F.when(F.col("unit") == "bytes", F.col("top.len"))).alias("byte_limit"),
    )


def truncation_flags(df: DataFrame, id_col: str, source_col: str, text_col: str, **spike) -> DataFrame:
    """``(id, source, at_limit, truncated, signal)``, one row per id; ``signal`` says what a truncated text was found by: ``'limit'`` (a spike of its source's lengths) or ``'ending'`` (its end alone), else null."""
    features = end_features(df, id_col, source_col, text_col)
    spikes = length_spikes(features, **spike).withColumnRenamed("source", "spike_source")
    joined = features.join(spikes, F.col("source").eqNullSafe(F.col("spike_source")), "left")
    at_limit = F.coalesce(F.col("chars") == F.col("char_limit"), F.lit(False)) | F.coalesce(F.col("bytes") == F.col("byte_limit"), F.lit(False))
    truncated = ~F.col("blank") & ~F.col("closed") & (at_limit | ~F.col("heading"))
    signal = F.when(truncated, F.when(at_limit, "limit").otherwise("ending"))
    return joined.select("id", "source", at_limit.alias("at_limit"), truncated.alias("truncated"), signal.alias("signal"))


def truncation_by_source(df: DataFrame, id_col: str, source_col: str, text_col: str, **spike) -> DataFrame:
    """``(source, docs, truncated, at_limit, share)``: how often each source truncates."""
    flags = truncation_flags(df, id_col, source_col, text_col, **spike)
    return flags.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.sum((F.col("truncated") & F.col("at_limit")).cast("long")).alias("at_limit"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"),
    )


def truncation_signals(df: DataFrame, id_col: str, source_col: str, text_col: str, **spike) -> DataFrame:
    """``(signal, docs)``: the truncated texts by what they were found by."""
    return truncation_flags(df, id_col, source_col, text_col, **spike).where("truncated").groupBy("signal").agg(F.count("*").alias("docs"))


def truncation_of_columns(df: DataFrame, id_col: str, source_col: str, text_cols: list[str], **spike) -> DataFrame:
    """``(column, source, docs, truncated, at_limit, share)`` for several text columns of one table."""
    parts = [truncation_by_source(df, id_col, source_col, c, **spike).select(F.lit(c).alias("column"), "*") for c in text_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
