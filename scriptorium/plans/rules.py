"""Cases for each rendering rule: TEI, and what it must become as HTML and as text.

Fixed values: the expected forms are those of the reading application.  {x}
stands for a text that is put in, escaped as its place needs, {a} for the same
in an attribute.
"""

from __future__ import annotations

TEI = "http://www.tei-c.org/ns/1.0"
_L = '<div class="tei-l"><span class="tei-l-text">{}</span></div>'


def _span(cls: str, inner: str = "{x}", more: str = "") -> str:
    return f'<span class="{cls}"{more}>{inner}</span>'


def _each(*tags: str) -> tuple[str, str, str]:
    """Elements that are a span of their own name in HTML and nothing but their content in text."""
    return "".join(f"<{t}>{{x}}</{t}>" for t in tags), "".join(_span(f"tei-{t}") for t in tags), "{x}" * len(tags)


#: rule, content of a body, HTML, text
CASES: list[tuple[str, str, str, str]] = [
    (
        "white space", "<lg> <l>{x}</l> <l>b</l> </lg><p>a <hi>{x}</hi> <hi>b</hi></p>",
        f'<div class="tei-lg">{_L.format("{x}")}{_L.format("b")}</div><p class="tei-p">a {_span("tei-hi")} {_span("tei-hi", "b")}</p>', "{x}\nb\na {x} b\n",
    ),
    ("dropped", "<teiHeader>no {x}</teiHeader><facsimile>no</facsimile><fsdDecl>no</fsdDecl><p>{x}</p>", '<p class="tei-p">{x}</p>', "{x}\n"),
    ("containers", "<group><text><body><p>{x}</p></body></text></group>", '<p class="tei-p">{x}</p>', "{x}\n"),
    (
        "division", '<div type="t" subtype="s" n="4"><p>{x}</p></div><div n="5"><head>{x}</head></div><div><p>a</p></div>',
        '<section class="tei-div" data-type="t" data-subtype="s" data-n="4"><span class="tei-ref-n">4</span><p class="tei-p">{x}</p></section>'
        '<section class="tei-div" data-n="5"><h2 class="tei-head">{x}</h2></section><section class="tei-div"><p class="tei-p">a</p></section>',
        "{x}\n\n{x}\n\na\n\n",
    ),
    (
        "heading", "<head>a</head>" + "".join(f"<div><head>{h}</head>" for h in "bcdef") + "<div><head>{x}</head>" + "</div>" * 6,
        '<h2 class="tei-head">a</h2>' + "".join(f'<section class="tei-div"><h{n} class="tei-head">{h}</h{n}>' for h, n in zip("bcdef", (2, 3, 4, 5, 6)))
        + '<section class="tei-div"><h6 class="tei-head">{x}</h6>' + "</section>" * 6,
        "a\nb\nc\nd\ne\nf\n{x}\n" + "\n" * 6,
    ),
    ("running head", '<label type="head">{x}</label>', _span("tei-head-label"), "{x}\n"),
    ("label", '<label type="y">{x}</label><label>c</label>', _span("tei-label", more=' data-type="y"') + _span("tei-label", "c"), "{x}\nc\n"),
    ("paragraph", "<p>{x}</p>", '<p class="tei-p">{x}</p>', "{x}\n"),
    ("anonymous block", "<ab>{x}</ab>", '<p class="tei-ab">{x}</p>', "{x}\n"),
    ("group of lines", '<lg type="couplet"><l>{x}</l></lg>', f'<div class="tei-lg" data-type="couplet">{_L}</div>'.replace("{}", "{x}"), "{x}\n"),
    ("line", '<l n="5a">{x}</l>', '<div class="tei-l" data-n="5a"><span class="tei-lineno">5a</span><span class="tei-l-text">{x}</span></div>', "{x}\n"),
    ("speech", "<sp><speaker>A</speaker><l>{x}</l></sp>", f'<div class="tei-sp">{_span("tei-speaker", "A")}{_L.format("{x}")}</div>', "A{x}\n"),
    ("list", "<list><item>{x}</item><item>b</item></list>", '<ul class="tei-list"><li class="tei-item">{x}</li><li class="tei-item">b</li></ul>', "{x}b"),
    ("items keep white space", "<list> <item> {x} <hi>a</hi> <hi>b</hi> </item> </list>", f'<ul class="tei-list"><li class="tei-item"> {{x}} {_span("tei-hi", "a")} {_span("tei-hi", "b")} </li></ul>', " {x} a b "),
    (
        "figure", '<figure><graphic url="u.png"/><graphic/><figDesc>{x}</figDesc></figure>',
        '<figure class="tei-figure"><img class="tei-graphic" src="u.png"><img class="tei-graphic"><figcaption class="tei-figdesc">{x}</figcaption></figure>', "",
    ),
    *(
        (f"rend {rend}", f'<hi rend="{rend}">{{x}}</hi>', f'<{tag} class="tei-hi">{{x}}</{tag}>', "{x}")
        for rend, tag in {
            "italic": "em", "i": "em", "ital": "em", "bold": "strong", "b": "strong", "sup": "sup", "superscript": "sup", "sub": "sub", "subscript": "sub", "bold italic": "strong", "small sub": "sub", "sup b": "sup",
        }.items()
    ),
    ("rend other", '<hi>{x}</hi><hi rend="  small   caps ">b</hi>', _span("tei-hi") + _span("tei-hi tei-rend-small-caps", "b"), "{x}b"),
    ("choice", "<choice><sic> a  b </sic><corr>{x}</corr></choice>", _span("tei-choice", more=' title="a b"'), "{x}"),
    ("choice by rank", "<choice><orig>o</orig><reg>r</reg><expan>{x}</expan></choice>", _span("tei-choice", more=' title="o"'), "{x}"),
    ("choice of variants", "<choice><sic>{x}</sic><abbr>a</abbr></choice><choice><seg>b</seg></choice>", _span("tei-choice", "{x}", ' title="{a}"') + _span("tei-choice", "b"), "{x}b"),
    ("readings alone", *_each("corr", "expan", "reg")),
    ("variants alone", *_each("sic", "abbr", "orig")[:2], ""),
    ("foreign", '<foreign xml:lang="la">{x}</foreign><foreign>b</foreign>', _span("tei-foreign", more=' lang="la"') + _span("tei-foreign", "b"), "{x}b"),
    (
        "gap", '<p>a<gap reason="lost" extent="2" unit="line"/>{x}<gap unit="chars"/>b<gap/>c</p>',
        '<p class="tei-p">a<span class="tei-gap" title="lost 2 line">[…]</span>{x}<span class="tei-gap" title="chars">[…]</span>b<span class="tei-gap" title="">[…]</span>c</p>', "a {x} b c\n",
    ),
    ("supplied", "<supplied>{x}</supplied>", _span("tei-supplied", "\u2329{x}\u232a"), "{x}"),
    ("unclear, deleted, added", "<unclear>{x}</unclear><del>b</del><add>{x}</add>", _span("tei-unclear") + '<del class="tei-del">b</del><ins class="tei-add">{x}</ins>', "{x}b{x}"),
    ("segments", '<seg type="t">{x}</seg><seg>a</seg><w>b</w><g>c</g>', _span("tei-seg", more=' data-type="t"') + _span("tei-seg", "a") + _span("tei-w", "b") + _span("tei-g", "c"), "{x}abc"),
    ("quotations", "<quote>{x}</quote><q>b</q><cit>c</cit><bibl>d</bibl>", '<q class="tei-quote">{x}</q>' + _span("tei-q", "b") + _span("tei-cit", "c") + _span("tei-bibl", "d"), "{x}bcd"),
    ("reference", '<ref target="#t">{x}</ref><ref>b</ref>', '<a class="tei-ref" href="#t">{x}</a>' + _span("tei-ref", "b"), "{x}b"),
    (
        "note", '<p>a<note type="t" n="1">{x}</note><note>b</note>c</p>',
        '<p class="tei-p">a<span class="tei-note" data-type="t" data-n="1"><span class="tei-note-body">{x}</span></span><span class="tei-note"><span class="tei-note-body">b</span></span>c</p>', "ac\n",
    ),
    (
        "milestones", '<p>a<pb n="7"/>b<pb/>c<cb n="2"/>d<cb/>e<lb/>{x}<milestone unit="u" n="3"/>f<milestone/>g</p>',
        '<p class="tei-p">a<span class="tei-pb" title="page 7" data-n="7"></span>b<span class="tei-pb" title="page "></span>c<span class="tei-cb" data-n="2"></span>d<span class="tei-cb"></span>e<br class="tei-lb">{x}'
        '<span class="tei-milestone" data-unit="u" data-n="3"></span>f<span class="tei-milestone"></span>g</p>',
        "a b c d e {x} f g\n",
    ),
    ("space", '<p>a<space quantity="3"/>{x}<space/>b</p>', f'<p class="tei-p">a{_span("tei-space", "&nbsp;" * 3)}{{x}}{_span("tei-space", "&nbsp;")}b</p>', "a {x} b\n"),
    ("names", *_each("persName", "placeName", "name", "author", "editor", "title", "date", "num")),
    ("any other element", "<zzz>{x}</zzz>", _span("tei tei-zzz"), "{x}"),
    ("other namespace", '<note xmlns="">{x}</note><o:p xmlns:o="urn:o">b</o:p>', _span("tei tei-note") + _span("tei tei-p", "b"), "{x}b"),
    ("comments", "<p>a<!-- c -->{x}<?pi d?>b</p>", '<p class="tei-p">a{x}b</p>', "a{x}b\n"),
    ("blocks within blocks", "<l>foo<label> bar </label>baz {x}</l>", _L.format('foo<span class="tei-label"> bar </span>baz {x}'), "foobar baz {x}\n"),
]
#: The same with the element itself as the top.
TOPS: list[tuple[str, str, str, str]] = [("top line", f'<l xmlns="{TEI}">{{x}}</l>', _L.format("{x}"), "{x}\n"), ("top note", f'<note xmlns="{TEI}">{{x}}</note>', _span("tei-note", _span("tei-note-body")), "")]


def fragments() -> list[tuple[str, str, str, str]]:
    return [(rule, f'<body xmlns="{TEI}">{xml}</body>', html, text) for rule, xml, html, text in CASES] + TOPS
