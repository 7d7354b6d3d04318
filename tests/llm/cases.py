"""Rows that every operator must take: nulls, empty and long texts, ties, repeats."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "plain words of an ordinary text that goes on for a while and says little more than this about anything at all"


def edge_rows():
    return [
        (1, PROSE, "en", "a", 1),
        (1, PROSE, "en", "a", 1),
        (2, PROSE, None, None, None),
        (None, PROSE + " more", "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t\n ", "en", "a", 5),
        (6, "word " * 40_000, "en", "a", 1),
        (7, "x" * 200_000, "de", None, 1),
        (8, "Ünï çödé ſK K words here\x85there", "fr", "c", 1),
    ]


def edge_frame(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)
