"""HTML tables and links: broken markup, nested tables, equal ids. All names are invented."""

import pytest

from plenum.operators import html as H


def page(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "sida int, html string")


def rows(spark, text):
    found = H.table_rows(page(spark, text), "html").orderBy("rad").collect()
    return [(r.ids, r["del"], r.rubriker, [(c.text, c.href) for c in r.celler]) for r in found]


def test_rows_and_sections(spark):
    text = "<div id=a><table id=t><thead><tr><th>x<th>y<tbody><tr id=r><td> 1 &amp; 2 <td><b>3</b></tr><tfoot><tr><td>s</table></div>"
    assert rows(spark, text) == [(["a", "t"], "thead", ["x", "y"], []), (["a", "t", "r"], "tbody", [], [("1 & 2", None), ("3", None)]), (["a", "t"], "tfoot", [], [("s", None)])]


def test_a_row_without_a_section_is_in_the_body(spark):
    assert rows(spark, "<table><tr><td>1<tr><td>2") == [([], "tbody", [], [("1", None)]), ([], "tbody", [], [("2", None)])]


def test_nested_tables_are_rows_of_their_own_and_cells_of_the_outer_row(spark):
    text = "<table id=o><tr><td>a<table id=i><tr><td><a href=/p>b</a></td></tr></td></table>c</td><td>d</td></tr></table>"
    outer, inner = rows(spark, text)
    assert outer == (["o"], "tbody", [], [("abc", "/p"), ("b", "/p"), ("d", None)])
    assert inner == (["o", "i"], "tbody", [], [("b", "/p")])


@pytest.mark.parametrize("text", ["", "<table", "</td></tr></table>", "<td>lost</td>", "<table><tr></table></table>", "<!-- <tr><td> -->", "<script>'<tr><td>x'</script>", "&#xZZ; <tr"])
def test_broken_pages(spark, text):
    assert [r for r in rows(spark, text) if r[3]] == []


def test_end_tags_stay_in_their_table(spark):
    text = "<table id=o><tr><td>a<table><tr><td>b</div></tr></tbody></p></table> z</td></tr></table>"
    assert rows(spark, text)[0][3] == [("ab z", None), ("b", None)]


def test_members_of_both_forms(spark):
    plain = '<table id="engagementTable"><tbody><tr><td><a href="https://x.org/person/u1?a=1"> Ek </a><td>Ann<td>V<td>Ledamot<tr><td>Utan länk<td>Bo<td>M<td>x<tr><td><a href="/person/u2"></a><td><td>S<td>y</tbody></table>'
    faces = '<div><tbody id="engagementTable:tbody_element"><tr><td><a href="/person/u3">Alm</a></td><td></td><td>M</td><td>Ersättare</td></tr></tbody></div>'
    faces = f"<table id=z>{faces}</table>"
    got = sorted(tuple(r) for r in H.members(page(spark, plain, faces, None, "<p>tom")).select("sida", "id", "efternamn", "fornamn", "parti", "roll").collect())
    assert got == [(0, "u1", "Ek", "Ann", "V", "Ledamot"), (1, "u3", "Alm", "", "M", "Ersättare")]


def test_history_is_left_out(spark):
    table = '<table id="engagementTable"><tr><td><a href="/organisation/o1">Nämnden</a><td>Ledamot<td>2023-01-01<td> </table>'
    text = f'<div id="person-history">{table.replace("Nämnden", "Gamla")}</div>{table}<a href="mailto:a">  a@example.org</a><a href="mailto:b">b</a>'
    pages = page(spark, text, "<table id=engagementTable><tr><td><td>x</table>")
    got = H.assignments(pages).collect()
    assert [tuple(r) for r in got] == [(0, 1, "Nämnden", "o1", "Ledamot", "2023-01-01", None)]
    assert [tuple(r) for r in H.emails(pages, "sida").collect()] == [(0, "a@example.org")]


def test_links(spark):
    got = H.links(page(spark, "<div id=n><a href='/a'>x <b>y</b></a><a name=q>no</a><a href=/b>1<a href=/c>2</div>"), "html").orderBy("nr").collect()
    assert [(r.nr, r.href, r.text, r.ids) for r in got] == [(0, "/a", "x y", ["n"]), (1, "/b", "1", ["n"]), (2, "/c", "2", ["n"])]
