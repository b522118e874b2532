"""Small tables with the odd cases that every operator has a rule for."""

DOCUMENT_TYPE = "doc_id long, text string, lang string, source string, n_chars long, fp string, copies long, _row string, spans int, score string"

PROSE = {
    "en": "the house by the river was old and the people of the town thought that it would fall with the next storm",
    "de": "das haus am fluss war alt und die leute in der stadt dachten dass es beim nächsten sturm fallen würde",
}


def prose(lang: str, seed: int, words: int = 40) -> str:
    pool = PROSE[lang].split()
    return " ".join(pool[(seed * 7 + k * (1 + seed % 5) + k * k % 3) % len(pool)] for k in range(words))


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = []
    for k in range(24):
        lang = "en" if k % 3 else "de"
        rows.append((k, prose(lang, k), lang, f"s{k % 4}"))
    rows += [(3, prose("de", 3), "de", "s3")] * 2
    rows += [
        (100, None, "en", "s0"),
        (101, "", "de", None),
        (102, " \t\n", None, "s1"),
        (None, prose("en", 50), None, None),
        (None, prose("en", 50), None, None),
        (103, "12345 67890 !!!", "en", "s2"),
        (104, " ".join(f"w{k % 997}" for k in range(30_000)), None, "s3"),
        (105, "x" * 50_000, "en", "s3"),
        (106, "Ünïcödé ñandú 中文 " * 30, "de", "s2"),
        (107, prose("en", 7) + " and then something else", "en", "s0"),
        (108, "a" * 99, "en", "s0"),
        (109, "a" * 100, "en", "s0"),
    ]
    extra = [(i, t, g, s, len(t or ""), "z", 5, "q", 1, "r") for i, t, g, s in rows]
    return spark.createDataFrame(extra, DOCUMENT_TYPE)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT_TYPE)
