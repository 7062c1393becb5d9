"""Documents that hold the awkward cases, for every operator."""

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, None, 7, None) for r in rows], CLASHING)


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (3, "One two three. Four five six.\nA second line that is long enough to count."),
    (1, None),
    (2, ""),
    (5, "A second line that is long enough to count.\n\n  \n"),
    (4, "One two three. Four five six.\nA second line that is long enough to count."),
    (9, LONG),
    (8, LONG[:50_000] + " other end"),
    (7, "naïve Ünïcödé 漢字漢字   wide space 😀"),
    (6, "A second line that is long enough to count.\nlast"),
    (6, "A second line that is long enough to count.\nlast"),
    (None, "no id here"),
]
