import random
import re

from tessera.llm import html_text


def test_layout():
    r = html_text.render
    assert r("<p>a<p>b <b>c</b>\n d<br>e<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>z") == "a\n\nb c d\ne\n\n- x\n- y\n  3. p\n  4. q\n\nz"
    assert r("<table><tr><th>Name<th>N<tr><td>al<td>10<tr><td>bobby<td>7</table>end") == "Name   N\nal     10\nbobby  7\n\nend"
    assert r("a<div hidden>no</div><span style='display: none'>no</span><script>var x='<p>';</script>&amp;&lt;") == "a&<"
    assert r("<pre>\n x\n  y</pre>t") == " x\n  y\n\nt"
    assert r("<title>T</title><body>one</p>two<blockquote>q<p>r</blockquote>") == "one\n\ntwo\n\n  q\n\n  r"
    assert r("<dl><dt>A<dd>1<dt>B<dd>2</dl>") == "A\n  1\nB\n  2"
    assert r("</div><a href=x>l</a><!-- c --> t <") == "l t <"
    assert r("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>") == "wide  z\na  b  c"
    assert r("<table><tr><td colspan=2>wider<td>z<tr><td>a<td>b<td>c</table>") == "wider  z\na  b   c"
    assert r("<table><tr><td rowspan=2>two<td>b<tr><td>c<tr><td>d<td>e</table>") == "two  b\n     c\nd    e"
    assert r("<table><tr>loose <b>text</b><td>a</tr><div>more</div><tr><td>b</table>") == "loose text\nmore\na\nb"
    assert r("<head><title>t</title>shown<p>too") == "shown\n\ntoo"
    assert r("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no<ul><li>no<li style='visibility: visible'>in</ul></div>") == "yes\n\n- in"
    assert r("<style>.v{visibility:hidden}</style><p class=v>no <b style='visibility:visible'>b</b><table class=v><tr><td>no<td style='visibility:visible'>c</table>") == "b\n\nc"
    assert r("<ol start=999999999><li>a<li>b</ol>") == "999999999. a\n1000000000. b"
    assert r("<style>.ad, P#x{color:red;display:none} @media print{div{display:none}}</style><div class='ad b'>no</div><p id=x>no<p id=y>yes<div>too</div>") == "yes\n\ntoo"
    assert r(None) is None and r("") == ""


def test_cells_stand_in_the_columns_of_the_grid():
    """Against a grid filled cell by cell: texts of one column begin at one place, in the row's line."""
    rng = random.Random(3)
    for _ in range(300):
        n_rows, taken, html, at = rng.randrange(1, 6), set(), ["<table>"], {}
        for y in range(n_rows):
            html.append("<tr>")
            x = 0
            for _ in range(rng.randrange(1, 5)):
                while (x, y) in taken:
                    x += 1
                w, h = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])
                name = f"c{x}r{y}" + "x" * rng.randrange(6)
                taken |= {(x + i, y + j) for i in range(w) for j in range(h)}
                at[name] = (x, y)
                html.append(f"<td colspan={w} rowspan={h}>{name}")
                x += w
        lines = html_text.render("".join(html)).split("\n")
        places = {}
        columns = sorted({x for x, _ in at.values()})
        for name, (x, y) in at.items():
            assert name in lines[y].split(), (html, lines)
            places.setdefault(x, set()).add(re.search(rf"(?<!\S){name}(?!\S)", lines[y]).start())
        if len(columns) > 1:
            assert all(len(p) == 1 for p in places.values()), (html, lines)
            assert [min(places[x]) for x in columns] == sorted(min(places[x]) for x in columns)


def test_visible_words_are_those_of_a_recursive_walk():
    rng = random.Random(5)

    def make(depth, shown, words):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(6)
            if kind < 2 or depth > 5:
                word = f"w{len(words)}"
                words.append((word, shown))
                out.append(f" {word} ")
            else:
                style, now = rng.choice([("", shown), (" hidden", None), (" style='display:none'", None), (" style='color:red;visibility:hidden'", False), (" style='visibility: visible'", True)])
                now = None if shown is None else now
                tag = rng.choice(["div", "p", "span", "b", "ul", "section"])
                body = make(depth + 1, now, words)
                out.append(f"<{tag}{style}>{body if tag != 'p' else re.sub('<[^>]*>', '', body) if now is None else body}</{tag}>" if tag != "p" else f"<div{style}>{body}</div>")
        return "".join(out)

    for _ in range(300):
        words = []
        html = make(0, True, words)
        assert html_text.render(html).replace("- ", "").split() == [w for w, shown in words if shown]


def test_adversarial():
    deep = "<table><tr><td>x<td>y" * 300
    assert html_text.render(deep).split().count("y") == 300
    assert html_text.render("<table><tr><td>x" * 5000).count("x") == 5000
    assert html_text.render("<div>" * 20000 + "x") == "x"
    assert html_text.render("<table><tr><td>x" * 400).count("x") == 400
    assert html_text.render("<p title='a>b'>t</p><a href=\"x") .startswith("t")


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r[0], r[2] or "") for r in html_text.op2(df).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html_text.op2(df.limit(0)).count() == 0
    other = df.selectExpr("page_id", "url", "html", "1 as h", "2 as k0", "'x' as text")
    assert sorted((r[0], r[2] or "") for r in html_text.op2(other).collect()) == [(1, "a"), (1, "a"), (2, "")]
