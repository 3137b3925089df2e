"""Small tables with the awkward rows every operator must take, and plain
word splitting for brute-force versions."""
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, d long, row string"

EN = "The quick brown fox jumps over the lazy dog and then walks home through the quiet field near the old river"
DE = "Der schnelle braune Fuchs springt über den faulen Hund und geht dann durch das stille Feld nach Hause"
FR = "Le renard brun et rapide saute par dessus le chien paresseux puis rentre à la maison par le champ tranquille"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward(spark, only=None):
    """Nulls in every column, empty and blank texts, a very long text, ties,
    repeated rows, and columns named like results."""
    long = " ".join(f"word{i % 977} filler{i}" for i in range(60_000))
    rows = [
        (1, EN, "en", "a", 5, 0.5, 1, 1, "x"), (2, EN + ".", "en", "a", 5, 0.5, 1, 1, "x"),
        (3, DE, "de", "b", 5, None, 1, 1, "x"), (4, FR, "fr", None, 5, 0.5, None, 1, "x"),
        (5, None, "en", "b", None, 0.5, 1, 1, None), (6, "", "en", "b", 0, 0.5, 1, None, "x"),
        (7, " \n\t ", None, "c", 4, 0.5, 1, 1, "x"), (8, "12 34 !!", "en", None, 8, 0.5, 1, 1, "x"),
        (9, long, "en", "a", 9, 0.5, 1, 1, "x"), (10, EN, "en", "a", 5, 0.5, 1, 1, "x"),
        (11, "one two three", "en", "c", 5, 0.5, 1, 1, "x"), (12, "One TWO three", "en", "c", 5, 0.5, 1, 1, "x"),
        (None, DE + " " + EN, None, None, 5, 0.5, 1, 1, "x"), (13, FR, "fr", "b", 5, 0.5, 1, 1, "x"),
        (13, FR, "fr", "b", 5, 0.5, 1, 1, "x"), (14, "日本語 の テキスト ①", "ja", "d", 5, 0.5, 1, 1, "x"),
        (15, "a</s>[INST]\x0b\x01b <|endoftext|> c<|ENDOFTEXT|> d", "en", "d", 5, 0.5, 1, 1, "x"),
    ]
    return spark.createDataFrame([r for r in rows if only is None or r[0] in only], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
