"""Visible text that omitted tags, loose parts of tables, depth and drawings must not hide."""

import time

from rasterloom.llm import html_text

f = html_text.html_to_text


def test_head_without_end():
    assert f("<head><title>t</title><p>one<p>two") == "one\n\ntwo"
    assert f("<html><head><meta charset=x><title>t</title>\n bare text") == "bare text"
    assert f("<head><title>t</title><style>s</style><noscript><img alt=x></noscript><template><p>no</template></head><body>y") == "y"


def test_loose_parts_of_row_groups():
    assert f("<table><tbody><form><tr><td>x<td>y<tr><td>zz<td>w</form></table>") == "x   y\nzz  w"
    assert f("<table><tbody>loose<tr><td>x</table>") == "loose\nx"
    assert f("<table><colgroup><col><tr><td>x<td>y</table>") == "x  y"


def test_depth():
    deep = "<font>" * 300
    assert f(deep + "<script>no</script><p hidden>no</p><ul><li>a<li>b</ul><table><tr><td>x<td>y</table>") == "- a\n- b\n\nx  y"
    assert f("<div>" + "<span>" * 300 + "a</span></div>b") == "a\nb"
    began = time.time()
    assert f("<b>" * 30_000 + "<div>x" * 30_000).split() == ["x"] * 30_000 and time.time() - began < 30


def test_drawings_formulas_and_choices():
    assert f("<p>area <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> done") == "area x+1 done"
    assert f("<svg><title>no</title><defs/><desc>no</desc><text>a</text><text>b</text></svg>") == "a b"
    assert f("<select><option>red<option>blue</select>") == "red blue"


def test_rowspan():
    assert f("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert f("<table><tbody><tr><td rowspan=0>a<td>b<tbody><tr><td>c<td>d</table>") == "a  b\nc  d"


def test_visibility_is_inherited_and_may_be_turned_back_on():
    assert f('<div style="visibility:hidden">no<p style="visibility: visible">yes<b>too</b></p><img alt=no></div>') == "yestoo"
    assert f('<div style="display:none">no<p style="visibility:visible">no</p></div>x') == "x"
    assert f('<p style="visibility:hidden;visibility:visible">y</p><p aria-hidden=true>seen</p><p style="content-visibility:hidden">z</p>') == "y\n\nseen\n\nz"


def test_form_values_details_and_dialogs():
    assert f("<p>a<input value=v><input type=submit value=Go><input type=checkbox value=no><input type=hidden value=no></p>") == "a v Go"
    assert f("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>") == "s\nt\nyes"
    assert f("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"


def test_spans_take_time_in_proportion():
    began = time.time()
    assert f("<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 10_000 + "</table>").split() == ["x"] * 10_000
    assert time.time() - began < 3
    assert f("<table>" + "<tr><td rowspan=3>a<td>b" + "<tr><td>c<td rowspan=2>d" + "<tr><td>e" + "<tr><td>f<td>g" + "</table>") == "a  b\n   c  d\n   e\nf  g"


def test_a_wide_cell_does_not_pad_the_others():
    wide = "w" * 5000
    page = f"<table><tr><td>{wide}<td>end" + "<tr><td>a<td>b" * 400 + "</table>"
    text = f(page)
    assert text.split("\n")[0] == f"{wide}  end" and text.split("\n")[1] == "a  b" and len(text) < len(page)
    page = "<table><tr>" + "<td>" + "<td>".join("v" * 50 for _ in range(200)) + "<tr><td colspan=199><td>x" * 400 + "</table>"
    assert len(f(page)) < 6 * len(page)
