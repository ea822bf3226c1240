"""Small tables with every odd case, shared by the tests of the llm operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (4, "one two  three", "en", "a", 14),
            (5, "one two\tthree", "en", "b", 13), (5, "one two\tthree", "en", "b", 13), (None, "one two three", "de", None, 13),
            (6, long, "en", "b", len(long)), (7, long + "!", "en", "c", None), (8, "ein kleines Haus am See", "de", "c", 23),
            (8, "anderer Text mit derselben Nummer", "de", "c", 33), (9, "\x00 \U0001F600 é <|endoftext|> 漢字", None, "c", 9)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, words=120, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice('bdfgklmnprst')}{rnd.choice('aeiou')}{rnd.choice('bdfgklmnprst')}{rnd.randrange(vocabulary)}" for _ in range(words))
