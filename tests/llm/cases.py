"""Documents with awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])

LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(40_000))
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"


def texts():
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, "a"), (5, "a  "), (6, " a"), (7, "Hello wörld, don't <|endoftext|> stop."),
        (8, LONG), (9, LONG + " end"), (10, LONG), (11, f"{LINE}\n{LINE} {LINE}"), (12, f"start {LINE} end"),
        (13, "é   x\x1cy\x85z   \U0001f600 don't  I'll\r\n\tgo 12345 ..!"), (14, "x" * 5000),
        (15, "mail me.you@mail.example.com or +1 (415) 555-0199, ip 10.0.0.1, card 4111 1111 1111 1111."),
        (15, "mail me.you@mail.example.com or +1 (415) 555-0199, ip 10.0.0.1, card 4111 1111 1111 1111."),
        (None, "no id here"), (17, "\n".join(["l1", "l2", "l3", "l4"])), (18, "\n".join(["zz", "l1", "l2", "l3", "yy"])),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in (texts() if rows is None else rows)], SCHEMA)


def awkward(df):
    """The same rows with further columns, named as operators might name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("norm", "len", "pre", "full", "grp", "start", "count", "group_size", "keep_id", "line", "pos", "_hot", "h", "m", "key", "kept", "score", "label", "toxic", "bucket", "words", "id")})
