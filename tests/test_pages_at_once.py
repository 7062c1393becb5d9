"""Pages are made, joined and compared whole: the results of lines one by one, without what grew with every line, word and picture."""

import random

from pyspark.sql import functions as F

from docdelta.operators import edits, keyed, matching, text, visual
from docdelta.plans import compare
from docdelta.sources import fixtures
from docdelta.sources.fixtures import Entities

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_pages_hold_the_lines_that_are_dealt_one_by_one(spark):
    rows = [(1, "a\r\n\r\n" + "é😀" * 95 + "\rb\n"), (2, "\n".join(f"line {i}" for i in range(41))), (3, ""), (4, None), (5, "\r\n"), (None, "x\x0by z"), (7, "q" * 1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pages = fixtures.pages_of_lines(docs)
    got = {(r.doc_id, r.page_no, i): t for r in pages.collect() for i, t in enumerate(r.lines, 1)}
    want = {(r.doc_id, r.page_no, r.line_no): r.text for r in fixtures.lines_on_pages(fixtures.paragraphs(docs)).collect()}
    assert got == want and len(want) == 3 + 3 + 41 + 1 + 20 - 1
    assert [r[0] for r in docs.where(fixtures.WORDED).select("doc_id").orderBy("doc_id").collect()] == [None, 1, 2, 7]
    assert "Window" not in plan(Entities(spark, SF).page_lines)


def test_whole_pages_pair_the_lines_that_lines_pair(spark):
    e = Entities(spark, SF)
    bag = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    assert bag(e.line_pairs) == bag(text.pair_lines(e.page_pairs, e.pairs, e.page_lines))
    assert bag(e.page_pairs) == bag(matching.standard_page_pairs(e.pairs, e.doc_pages, e.page_lines))
    assert "FullOuter" not in plan(e.line_pairs)


def test_distances_of_a_batch(spark):
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choices(letters, k=rng.choice(n)))
    rows = [(None, "a"), ("a", None), ("", ""), ("", "abc"), ("abc", "")]
    for letters in ("ab", "abcdefgh é😀\0", "".join(map(chr, range(0x4E00, 0x6E00)))):
        for _ in range(150):
            a = word(letters, [1, 5, 63, 64, 65, 80, 127, 128])
            rows += [(a, word(letters, [1, 5, 63, 64, 65, 80, 128])), (a, a[3:] + a[:2])]
    d = spark.createDataFrame(rows, "a string, b string")
    wrong = d.withColumn("got", edits.distance("a", "b")).where(~F.col("got").eqNullSafe(F.levenshtein("a", "b")))
    assert wrong.count() == 0


def test_text_differences_of_short_and_long_lines(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate([("a" * 200, "a" * 150 + "b" * 50), ("same", "same"), ("kitten", "sitting"), (None, "x"), ("y" * 60, None), ("", "abc"), ("x" * 128, "x" * 90 + "z" * 39), ("abcdefghij", "abcdefghiX")])]
    lines = spark.createDataFrame(rows, "line_no int, base_text string, compare_text string").selectExpr("1L pair_id", "1 base_page", "1 compare_page", "*")
    got = {(r.line_no, r.change, r.severity) for r in text.text_differences(lines).collect()}
    want = {(r.line_no, r.change, r.severity) for d in (text.one_sided(lines), text.modified(lines)) for r in d.collect()}
    assert got == want and {x[0] for x in got} == {0, 2, 3, 4, 5, 6}
    assert plan(text.text_differences(lines)).count("_column(") == 1


def test_lengths_alone_may_tell_a_major_change(spark, monkeypatch):
    texts = ["", "a", "ab", "x" * 39, "y" * 40, "x" * 41, "z" * 60, "x" * 61, "ab" * 40, "x" * 130, "y" * 300]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    lines = spark.createDataFrame(rows, "line_no int, base_text string, compare_text string").selectExpr("1L pair_id", "1 base_page", "1 compare_page", "*")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.line_no, r.change, r.severity) for r in text.text_differences(lines, threshold).collect()}
        assert got == {(r.line_no, r.change, r.severity) for r in text.modified(lines, threshold).collect()}
    monkeypatch.setattr(edits, "distance", lambda a, b: F.assert_true(a.isNull()).cast("int"))
    far = lines.where("length(compare_text) > 1.5 * length(base_text) or 2 * length(compare_text) < length(base_text)")
    assert {r.severity for r in text.text_differences(far).collect()} == {"major"}


def test_pictures_face_each_other_once(spark, monkeypatch):
    e, rows, plain = Entities(spark, SF), [], visual.image_differences
    monkeypatch.setattr(visual, "image_differences", lambda b, c, **k: rows.append(b.pages.count()) or plain(b, c, **k))
    got = compare.image_kind(e, e.page_pairs, compare.Options())
    assert 0 < rows[0] < e.page_pairs.where("matched").count()
    pages = e.page_pairs.where("matched").withColumn("key", F.concat_ws("|", *compare.PAGE))
    side = lambda s: visual.Shown(pages.join(e.side_px(s).pages.withColumnRenamed("page_no", f"{s}_page"), ["pair_id", f"{s}_page"]).select(F.col("key").alias("pair_id"), F.lit(1).alias("page_no"), "image_id"), e.side_px(s).pictures)
    want = plain(side("base"), side("compare")).select("pair_id", "change", "severity")
    assert sorted(map(tuple, got.select(F.concat_ws("|", *compare.PAGE), "change", "severity").collect())) == sorted(map(tuple, want.collect()))


def test_fonts_of_whole_pages_are_those_of_their_words(spark):
    texts = ["a  b c d e f g h", " " * 90, "x " * 200, "é 😀 " * 60 + "\nlast", "one", "", None, "\n".join(f"{i} b c d e f {'g' * (i % 3)} h" for i in range(45))]
    pages = fixtures.pages_of_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pages = pages.unionByName(Entities(spark, SF).pages.withColumn("doc_id", F.col("doc_id") + 100))
    e = Entities(spark, SF)
    e.__dict__["pages"] = pages
    want = keyed.font_usage(e.elements).select("doc_id", "page_no", "font_name", "usage", "size")
    got = fixtures.fonts_of_pages(pages)
    assert got.schema == want.schema or got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in plan(Entities(spark, SF).doc_fonts) and "Aggregate" not in plan(got.select("usage"))


def test_texts_are_not_shuffled_for_their_size(spark):
    joins = [line for line in plan(Entities(spark, SF).doc_info).splitlines() if "Project" in line and "octet_length(text" in line]
    assert len(joins) == 1 and plan(Entities(spark, SF).doc_info).index("Join") < plan(Entities(spark, SF).doc_info).index("octet_length(text")


def test_pages_are_joined_once_for_scores_and_lines(spark):
    e = Entities(spark, SF)
    assert "Join" not in plan(e.line_pairs) and "Join" not in plan(compare.text_kind(e, compare.page_pairs(e, compare.Options()), compare.Options()))
    assert not {"base_lines", "compare_lines"} & set(e.page_pairs.columns)


def test_equal_lines_are_left_out_before_distances(spark):
    rows = [(1, "same", "same"), (2, "", ""), (3, None, "x"), (4, "kitten", "sitting"), (5, "x" * 130, "x" * 130)]
    lines = spark.createDataFrame(rows, "line_no int, base_text string, compare_text string").selectExpr("1L pair_id", "1 base_page", "1 compare_page", "*")
    found = text.text_differences(lines, 1.0)
    assert sorted(r.line_no for r in found.collect()) == [3, 4]
    below = plan(found)[plan(found).index("ArrowEvalPython") :]
    assert "NOT (base_text" in below


def test_boxes_and_descriptions_read_the_differences_once(spark):
    from docdelta.operators import differences
    from docdelta.plans import queries

    names = [f"{s}_{n}" for s in ("base", "compare") for n in ("x", "y", "width", "height")]
    rows = [(k, 1, f"d{k}{t}", t, ch, "major", *([10.0, 20.0, 30.0, 40.0] if k % 2 else [None] * 4), *([12.0, 26.0, 0.0, 41.0] if k % 3 else [None] * 4)) for k in range(6) for t in ("text", "image", "font", "metadata") for ch in ("added", "deleted", "modified")]
    d = spark.createDataFrame(rows, "pair_id long, base_page int, diff_id string, type string, change string, severity string, " + ", ".join(f"{n} double" for n in names))
    got = differences.with_box(d)
    none = {n: F.lit(0.0) for n in ("x", "y", "width", "height")}
    want = text.display_box(d.where("type = 'text'")).unionByName(visual.image_box(d.where("type = 'image'"))).unionByName(d.where("type in ('font', 'metadata')").withColumns(none))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Union" not in plan(got)
    e = Entities(spark, SF)
    e.__dict__["all_differences"] = d.withColumns({"base_text": F.lit("a"), "compare_text": F.lit("b"), "name": F.lit("n"), "description": F.when(F.col("pair_id") == 1, "own")})
    forms = queries.describe(e)
    assert "Union" not in plan(forms) and forms.count() == 2 * len(rows)
