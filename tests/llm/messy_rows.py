"""Rows that the tests share."""

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and say nothing at all until dawn"
ROWS = [
    (1, PROSE),
    (2, PROSE),
    (2, PROSE),
    (3, None),
    (4, ""),
    (None, PROSE + " again"),
    (None, None),
    (5, "wörd ñandú 漢字 <|endoftext|> 'tis  two\n\nlines " * 3),
    (6, " ".join(f"w{i}" for i in range(20_000))),
    (7, PROSE.upper() + " A"),
    (8, "one two"),
    (9, "\t \n"),
]
SCHEMA = "doc_id long, text string, lang string, TEXT string, shard string, sequence_id string, score string, Doc_Id string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, None, "x", "y", None, "z", "q", None if t is None else len(t)) for i, t in rows], schema)
