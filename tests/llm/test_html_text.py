import random
import time

import pytest

from docdelta.llm import html_text as ht

CASES = [
    (None, ""),
    ("", ""),
    ("plain  text &amp; more", "plain text & more"),
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<div>a</div><div>b<b>c</b> d</div>", "a\nbc d"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<head><title>No</title></head><body><script>x<y</script><style>p{}</style><p>Yes</p></body>", "Yes"),
    ("<p hidden>no</p><p style='color:red; display : NONE'>no<b>no</b></p><p>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x</li><li>y</li></ol>z", "3. x\n4. y\n\nz"),
    ("<table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>22</table>", "Name   N\napple  1\nfig    22"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table></td><td>b</td></tr></table>c", "a        b\n\nin  ner\n\nc"),
    ("<table><tr><td colspan=2>wide</td><td>z</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>", "wide     z\n1     2  3"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<details><summary>sum</summary>no</details><details open><summary>s2</summary>yes</details>", "sum\ns2\nyes"),
    ("<p><b>x<br><p>y</b>z</p>", "x\n\nyz"),
    ("<td>stray</td></p></div></table>end", "stray\n\nend"),
    ("<a href='/x'>one</a> <a>two</a><img alt=no><!-- no -->", "one two"),
    ("a" + "<div>" * 30_000 + "b", "a\nb"),
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A  b1\n   b2"),
    ("<table><thead><tr><th rowspan=0>h<th>i<tr><th>j<tbody><tr><td>k<td>l</table>", "h  i\n   j\nk  l"),
    ("<table><tr><td colspan=900>a<td>b</table>", "a  b"),
    ("<table><tr><td>a<td>b<tr><td>" + "w" * 120 + "<td>c</table>", "a" + " " * 81 + "b\n" + "w" * 120 + "\n" + " " * 82 + "c"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div><p>end", "yes\n\nend"),
    ("<p style='display:none;display:block'>shown", "shown"),
    ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
    ("<ol reversed start=9><li>x<li value=4>y<li>z</ol>", "9. x\n4. y\n3. z"),
    ("<ol><li value=7>x<ol><li>in</ol><li>y</ol>", "7. x\n  1. in\n8. y"),
    ("<pre>\n a</pre>", " a"),
    ("<select><option>no</select>&lt;b&gt;", "<b>"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_pages(html, text):
    assert ht.page_text(html) == text


def test_operator(spark):
    rows = [(i, "u", h, None) for i, (h, _) in enumerate(CASES)] + [(None, None, "<p>x", None), (0, None, "<p>y", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract_text(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([*((i, t) for i, (_, t) in enumerate(CASES)), (None, "x"), (0, "y")], key=repr)
    assert ht.extract_text(df.limit(0)).collect() == []


def naive_columns(group):
    """Columns of a group's cells from a table of taken places."""
    taken, out = set(), []
    for i, row in enumerate(group):
        at, cells = 0, []
        for text, columns, rows in row:
            while (i, at) in taken:
                at += 1
            cells.append((at, text))
            taken |= {(r, c) for r in range(i, min(i + rows if rows else len(group), len(group))) for c in range(at, at + columns)}
            at += columns
        out.append(cells)
    return out


def test_spans_against_a_table_of_taken_places():
    rng = random.Random(5)
    for _ in range(500):
        grid = ht.Grid()
        grid.groups = [[[(str(rng.random()), rng.choice([1, 1, 2, 3]), rng.choice([0, 1, 1, 2, 3])) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 6))] for _ in range(2)]
        assert grid.placed() == [r for g in grid.groups for r in naive_columns(g)]


def test_time_grows_with_the_depth_alone():
    def seconds(n):
        start = time.process_time()
        ht.page_text("<b>x<div>" * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.02)
