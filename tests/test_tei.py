"""Rendering and citation of single documents: one rule, one literal in, one literal out."""

import xml.parsers.expat as expat

import pytest

from scriptorium.operators import tei

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'


def text(xml, **kw):
    return tei.render_text(tei.parse(xml), **kw)


def html(xml):
    return tei.render_html(tei.parse(xml))


def el(inner, tag="l", attrs=""):
    return f"<{tag} {NS} {attrs}>{inner}</{tag}>"


TEXTS = [
    (el("<teiHeader>x</teiHeader><facsimile>x</facsimile><fsdDecl>x</fsdDecl><l>kept</l>", "TEI"), "kept\n"),
    (el("a<note>x</note><figure>x</figure><graphic/>b"), "ab\n"),
    (el("  a \n\t b\xa0 "), "a b\xa0\n"),  # a no-break space is no white space here
    (el("foo<label> bar </label>baz"), "foobar baz\n"),
    (el("<l>a</l> <l>b</l>", "div"), "a\nb\n\n"),
    (el("<lg><l>a</l></lg><sp><speaker>S</speaker><l>b</l></sp>", "div"), "a\nSb\n\n"),
    (el("<item>a</item><item>b</item>", "list"), "ab"),
    (el("<choice><sic>no</sic><corr>a</corr></choice>"), "a\n"),
    (el("<choice><supplied>s</supplied><reg>r</reg></choice>"), "r\n"),
    (el("<choice><sic>a</sic><orig>b</orig></choice>"), "a\n"),
    (el("a<sic>x</sic><abbr>x</abbr><orig>x</orig>b"), "ab\n"),
    (el("<corr>a</corr><expan>b</expan><reg>c</reg>"), "abc\n"),
    (el("a<pb/>b<lb/>c<cb/>d<milestone/>e<space/>f<gap/>g"), "a b c d e f g\n"),
    (el("<del>a</del><supplied>b</supplied><unclear>c</unclear><speaker>d</speaker><weird>e</weird>"), "abcde\n"),
    (el(" \n ", "div"), "\n"),
    (el("<hi>a</hi> <hi>b</hi>"), "a b\n"),
    (el("a<!-- x --><?y z?>b"), "ab\n"),
    (el('a<note xmlns="">kept</note>b'), "akeptb\n"),
    (el("a &lt;b&gt; &amp; c"), "a <b> & c\n"),
    (el("<![CDATA[<a>]]>"), "<a>\n"),
]


@pytest.mark.parametrize(("xml", "out"), TEXTS)
def test_text(xml, out):
    assert text(xml) == out


def test_text_strict_blocks():
    assert text(el("<item>a</item><item>b</item>", "list"), strict_blocks=True) == "a\nb\n"


HTMLS = [
    (el("<teiHeader>x</teiHeader><text><body>a</body></text>", "TEI"), "a"),
    (el("a", "div", 'type="t" subtype="s" n="9"'), '<section class="tei-div" data-type="t" data-subtype="s" data-n="9"><span class="tei-ref-n">9</span>a</section>'),
    (el("<head>h</head>", "div", 'n="9"'), '<section class="tei-div" data-n="9"><h2 class="tei-head">h</h2></section>'),
    (el("<div><div><div><div><div><head>h</head></div></div></div></div></div>", "body"), None),
    (el("a", "head"), '<h2 class="tei-head">a</h2>'),
    (el("a", "label", 'type="head"'), '<span class="tei-head-label">a</span>'),
    (el("a", "label", 'type="x"'), '<span class="tei-label" data-type="x">a</span>'),
    (el("a", "p"), '<p class="tei-p">a</p>'),
    (el("a", "ab"), '<p class="tei-ab">a</p>'),
    (el(" <l>a</l> ", "lg", 'type="x"'), '<div class="tei-lg" data-type="x"><div class="tei-l"><span class="tei-l-text">a</span></div></div>'),
    (el("a", "l", 'n="5a"'), '<div class="tei-l" data-n="5a"><span class="tei-lineno">5a</span><span class="tei-l-text">a</span></div>'),
    (el("<speaker>a</speaker>", "sp"), '<div class="tei-sp"><span class="tei-speaker">a</span></div>'),
    (el("<item>a</item>", "list"), '<ul class="tei-list"><li class="tei-item">a</li></ul>'),
    (el('<graphic url="u"/><figDesc>d</figDesc>', "figure"), '<figure class="tei-figure"><img class="tei-graphic" src="u"><figcaption class="tei-figdesc">d</figcaption></figure>'),
    (el("a", "hi", 'rend="italic"'), '<em class="tei-hi">a</em>'),
    (el("a", "hi", 'rend="x b"'), '<strong class="tei-hi">a</strong>'),
    (el("a", "hi", 'rend="italic bold"'), '<strong class="tei-hi">a</strong>'),
    (el("a", "hi", 'rend="sup"'), '<sup class="tei-hi">a</sup>'),
    (el("a", "hi", 'rend="subscript"'), '<sub class="tei-hi">a</sub>'),
    (el("a", "hi", 'rend=" wide  red "'), '<span class="tei-hi tei-rend-wide-red">a</span>'),
    (el("a", "hi"), '<span class="tei-hi">a</span>'),
    (el("<corr>a</corr><sic> x  y </sic>", "choice"), '<span class="tei-choice" title="x y">a</span>'),
    (el("a", "corr"), '<span class="tei-corr">a</span>'),
    (el("a", "sic"), '<span class="tei-sic">a</span>'),
    (el("a", "foreign", 'xml:lang="grc"'), '<span class="tei-foreign" lang="grc">a</span>'),
    (el("", "gap", 'reason="lost" unit="line"'), '<span class="tei-gap" title="lost line">[…]</span>'),
    (el("a", "supplied"), '<span class="tei-supplied">〈a〉</span>'),
    (el("<unclear>a</unclear><del>b</del><add>c</add>", "body"), '<span class="tei-unclear">a</span><del class="tei-del">b</del><ins class="tei-add">c</ins>'),
    (el("a", "seg", 'type="x"'), '<span class="tei-seg" data-type="x">a</span>'),
    (el("<w>a</w><g>b</g>", "body"), '<span class="tei-w">a</span><span class="tei-g">b</span>'),
    (el("<quote>a</quote><q>b</q><cit>c</cit><bibl>d</bibl>", "body"), '<q class="tei-quote">a</q><span class="tei-q">b</span><span class="tei-cit">c</span><span class="tei-bibl">d</span>'),
    (el("a", "ref", 'target="t?a=1&amp;b"'), '<a class="tei-ref" href="t?a=1&amp;b">a</a>'),
    (el("a", "ref"), '<span class="tei-ref">a</span>'),
    (el("a", "note", 'type="t" n="1"'), '<span class="tei-note" data-type="t" data-n="1"><span class="tei-note-body">a</span></span>'),
    (el("", "pb", 'n="3"'), '<span class="tei-pb" title="page 3" data-n="3"></span>'),
    (el("", "cb"), '<span class="tei-cb"></span>'),
    (el("", "lb"), '<br class="tei-lb">'),
    (el("", "milestone", 'unit="u" n="1"'), '<span class="tei-milestone" data-unit="u" data-n="1"></span>'),
    (el("", "space", 'quantity="2"'), '<span class="tei-space">&nbsp;&nbsp;</span>'),
    (el("", "space"), '<span class="tei-space">&nbsp;</span>'),
    (el("a", "persName"), '<span class="tei-persName">a</span>'),
    (el("a", "weird"), '<span class="tei tei-weird">a</span>'),
    (el('<note xmlns="">a</note>', "body"), '<span class="tei tei-note">a</span>'),
    (el("&lt;a&gt; &amp;\xa0b"), '<div class="tei-l"><span class="tei-l-text">&lt;a&gt; &amp;&nbsp;b</span></div>'),
]


@pytest.mark.parametrize(("xml", "out"), HTMLS)
def test_html(xml, out):
    if out is None:
        assert '<h6 class="tei-head">h</h6>' in html(xml)
    else:
        assert html(xml) == out


def test_bad_quantity():
    with pytest.raises(ValueError):
        html(el("", "space", 'quantity="two"'))


def test_any_other_mode_is_text():
    assert tei.render(tei.parse(el("a")), "pdf") == "a\n"


HEAD = '<teiHeader><fileDesc><titleStmt><title> </title><title>T <hi>x</hi></title><author>\xa0A </author></titleStmt></fileDesc>{}</teiHeader>'


def test_header():
    assert tei.header(f"<TEI {NS}>{HEAD.format('')}<text><title>no</title></text></TEI>") == ("T", "A")
    assert tei.header(f"<TEI {NS}><text><title>late</title></text></TEI>") == ("late", "")
    assert tei.header(f"<TEI {NS}><title>kept</title><author>x") == ("kept", "")
    assert tei.header(None) == ("", "")
    assert tei.header("<a><title>x</b>") == ("x", "") or tei.header("<a><title>x</b>") == ("", "")


def doc(decl, body):
    return f"<TEI {NS}>{HEAD.format(f'<encodingDesc>{decl}</encodingDesc>')}<text><body>{body}</body></text></TEI>"


TWO = """<refsDecl><citeStructure match="/TEI/text/body/div[@type='f']" use="@n" unit="fragment"><citeStructure match="l" use="@n" unit="l" delim="."/></citeStructure></refsDecl>"""


def refs(xml, tree=None):
    root = tei.parse(xml)
    trees, default = tei.rules_of(root)
    return [(u.ref, u.level, u.parent_ref) for u in tei.units_of(root, trees[tree or default])]


def test_units_in_document_order():
    xml = doc(TWO, '<div type="f" n="1-14t"><l n="1">a</l></div><div type="x" n="9"><l n="1"/></div><div type="f" n="5a"><lg><l n="1">a</l></lg><l>no</l><l n="9r">b</l></div>')
    assert refs(xml) == [("1-14t", 1, None), ("1-14t.1", 2, "1-14t"), ("5a", 1, None), ("5a.1", 2, "5a"), ("5a.9r", 2, "5a")]


def test_several_trees():
    second = '<refsDecl n="lines" default="true"><citeStructure match="//l[@n and not(@part)]" use="@n" unit="l"/></refsDecl>'
    xml = doc(TWO + second, '<div type="f" n="1"><l n="1">a</l><l n="2" part="I">b</l></div>')
    trees, default = tei.rules_of(tei.parse(xml))
    assert list(trees) == ["default", "lines"] and default == "lines"
    assert refs(xml) == [("1", 1, None)]
    assert len(refs(xml, "default")) == 3


def test_rules_that_fail():
    for decl in ('match="/TEI/text/body/div[contains(@n,1)]" use="@n"', 'match="/TEI/text/body/div" use="head/text()"'):
        with pytest.raises(tei.CiteError):
            refs(doc(f'<refsDecl><citeStructure {decl} unit="u"/></refsDecl>', '<div n="1"/>'))
    with pytest.raises(tei.CiteError):
        refs(doc('<refsDecl><citeStructure match="/TEI/text/body/div" use="@n"><citeStructure match="l" use="@n"/></citeStructure></refsDecl>', '<div n="1"><l n="1"/></div>'))


def test_excerpt_keeps_what_is_around():
    root = tei.parse(doc(TWO, '<div type="f" n="1"><head>h</head><l n="1">a</l></div>'))
    unit = tei.units_of(root, tei.rules_of(root)[0]["default"])[1]
    assert tei.render_html(tei.excerpt(unit.node)).startswith('<section class="tei-div" data-type="f" data-n="1"><span class="tei-ref-n">1</span><div class="tei-l"')
    assert tei.render_text(tei.excerpt(unit.node)).strip() == "a"


def test_deep_nesting():
    xml = "<div>" * 50_000 + "<l>x</l>" + "</div>" * 50_000
    root = tei.parse(f"<TEI {NS}>{xml}</TEI>")
    assert tei.render_text(root).strip() == "x" and tei.render_html(root).count("<section") == 50_000
    assert [n.tag for n in tei._select([root], "//l", frozenset())] == ["l"]


@pytest.mark.parametrize("bad", ["", "<a>", "<a></b>", "<a>&nope;</a>", '<a x="1" x="2"/>', "<a><![CDATA[</a>"])
def test_malformed(bad):
    with pytest.raises(expat.ExpatError):
        tei.parse(bad)


def test_encodings():
    latin = f'<?xml version="1.0" encoding="iso-8859-1"?><l {NS}>é</l>'.encode("latin-1")
    assert tei.render_text(tei.parse(latin)) == "é\n"
    assert tei.render_text(tei.parse(f'<?xml version="1.0" encoding="utf-16"?><l {NS}>é</l>'.encode("utf-16"))) == "é\n"


def test_intervals():
    root = tei.parse(el("a<hi>b</hi>c"))
    assert (root.pre, root.post) == (1, 5)
    hi = next(root.elements())
    assert (hi.pre, hi.post) == (3, 4)
