"""Problem 8: residue and what only looks like it."""

import pytest

from scriptorium.llm import residue as R

SCHEMA = "doc_id long, text string, source string"
FOUND = {
    "placeholder": [
        "{{AUTHOR}}: {{WORK}} ({{YEAR}})", "Edition of ${author}, leaf 4.", "<%= author.name %> in <%= x %>", "%(title)s — fragment %(ref)s", "entry on __AUTHOR__ kept", "Notice : @@notice@@", "folgt: ###TEXT###",
        "Titre : <<TITRE>>", "{0} wrote {1} in X; see {2}.", "[INSERT TRANSLATION HERE]", "[AUTHOR NAME], [WORK TITLE], line 5", "Shelfmark: [___].", "Date: DD/MM/YYYY", "X, <title goes here>, edited by <editor name>",
        "[Description to be added].", "Verfasser: XXXX.", "Melubphon, TBD.", "Author: undefined", "Passage: undefined.42", "Editor: NaN", "Title: [object Object]", "Hier Titel einfügen.",
    ],
    "filler": [
        "Lorem ipsum dolor elit", "Your text here. Your text here.", "This is placeholder copy for fragment 8.", "Dies ist ein Blindtext.", "Texte provisoire, à remplacer par la notice.", "asdf qwer asdf jkl",
        "xxxxx xxx xxxxxxx xx", "text text text text text text", "test test 123 test", "Sample text Sample text Sample text Sample text",
    ],
    "error": [
        "404 Not Found", "Error 502: Bad Gateway. Please try again later.", "The requested passage 8.8 was not found on this server.", "Seite nicht gefunden.", "Page introuvable : le passage 4 demandé n'existe pas ou a été déplacé.",
        "Access denied. You do not have permission to view leaf 8.", "Oops! Something went wrong while we loaded X.", "Unable to connect to the catalogue database (errno 7).", "Too many requests from your reading room.",
        "Your session has expired. Log in again.", "java.lang.NullPointerException: node is null", "\tat viewer.Main.run(Main.java:32)", "Traceback (most recent call last):", "KeyError: 'ref'", '  File "viewer.py", line 3, in x',
        "HTTP 403 Forbidden",
    ],
    "scripts": [
        "Please enable JavaScript to view the edition.", "You need to enable JavaScript to run this app.", "This viewer requires scripts. Your browser has them switched off.", "Checking your browser before showing the catalogue.",
        "Enable cookies and JavaScript, then reload.", "Bitte aktivieren Sie JavaScript, um den Text anzuzeigen.", "JavaScript est désactivé dans votre navigateur.", "occorre attivare JavaScript nelle impostazioni", "<noscript>turn it on</noscript>",
    ],
}
PROSE = [
    "Readers without JavaScript can use the plain edition, writes Philo, since the text is served as a file.", "Some call the passage mere filler, yet the dolorous opening is genuine.",
    "Hestor complains that the old viewer answered every request for line 5 with an error page, so we quote from print.", "Folio 404 was not found in the binding of Tyron, and Murex counted 12 leaves without it.",
    "An undefined number of verses, perhaps 3, is missing here; the page that X saw does not exist any more.", "The copyist left a space of 5 letters for a title that nobody ever inserted [title lost].",
    "[τ]ὸν {a} <β. . .> ⟨x⟩ [[y]] ***", "καὶ τὸν καὶ τὴν καὶ τὸ", "Home | Authors | Works | Search", "← previous   next →", "The terse script and its scholion.", "null and void", "", " ", "Dear reader, this is the entry.",
]


@pytest.mark.parametrize(("kind", "line"), [(k, x) for k, lines in FOUND.items() for x in lines])
def test_residue(spark, kind, line):
    assert R.Classifier()(R.mask(line)) == kind
    low = line.lower()
    assert any(t in low for t in R.TRIGGERS) or R.monotone(line)


@pytest.mark.parametrize("line", PROSE)
def test_prose(line):
    assert R.Classifier()(R.mask(line)) is None


def test_masks():
    assert R.mask("see https://a.b/c?d=1 or x@y.org, 10.0.0.1, 2024-01-02, leaf 17f and #809.161f") == "see URL or MAIL, ADDRESS, DATE, leaf 0 and #0.0"


def test_documents(spark):
    rows = [(k, x, f"s{k % 3}") for k, x in enumerate([y for lines in FOUND.values() for y in lines])]
    n = len(rows)
    rows += [(100 + k, x, None) for k, x in enumerate(PROSE)]
    rows += [(200, "Prose first.\n\n404 Not Found\nThe requested passage 1.1 was not found on this server.\n\nProse again.", "s"), (201, None, "s"), (None, "404 Not Found", "s"), (0, rows[0][1], "t"), (202, "verbum " * 200_000 + "\n", "s")]
    df = spark.createDataFrame([(*r, "m", "k") for r in rows], SCHEMA + ", message string, kind string")
    got = {r.doc_id: r.kinds for r in R.residue(df).collect()}
    assert set(got) == {*range(n), 200, 202} and got[200] == ["error"] and got[202] == ["filler"]  # one word over and over
    assert {r.doc_id for r in R.without_residue(df).collect()} == {*range(100, 100 + len(PROSE)), 201, None}
    assert R.residue(df.limit(0)).count() == R.messages(df.limit(0)).count() == 0


def test_counts_over_the_whole_corpus(spark):
    rows = [(k, f"x\n\nError {400 + k % 9}: Bad Gateway. Please try again later." if k % 3 == 0 else "prose", f"s{k % 5}") for k in range(900)]
    m = R.messages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.kind, r.documents, r.sources, r.lines) for r in m] == [("error", 300, 5, 300)]


MATCHED_BY_RULES = {  # lines that no hand-written list of literals foresaw
    "error": ["The requested page could not be found on this server.", "Error 1054: Unknown column x in y", "    at viewer.Main.run(Main.java:32)", "ERROR 17: x", "Acceſs denied. You do not have permission to view x."],
    "placeholder": ["Name:null", "Name:  NaN", "Name :\tNone"],
}


@pytest.mark.parametrize(("kind", "line"), [(k, x) for k, lines in MATCHED_BY_RULES.items() for x in lines])
def test_no_line_that_a_rule_matches_is_passed_over(kind, line):
    assert [R.Classifier()(m) for m in R.Prefilter()(f"Prose.\n{line}\nProse.")] == [kind]


def test_prefilter_is_the_classifier(spark):
    classify = R.Classifier()
    for line in [y for lines in [*FOUND.values(), *MATCHED_BY_RULES.values(), PROSE] for x in lines for y in (x, x.upper(), x.lower(), x.replace(" ", "  "), f"   {x}", x.replace(" ", ""))]:
        assert any(classify(m) for m in R.Prefilter()(line)) == (classify(R.mask(line)) is not None), line
    rows = [(k, x, "s") for k, x in enumerate([y for lines in MATCHED_BY_RULES.values() for y in lines])]
    assert R.residue(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


ADDRESSES = {
    "Read the passage at https://ed.example/{{ref}}": "Read the passage at URL/{{ref}}",
    "http://${host}/x": "http://${host}/x",
    "See https://ed.example/17/%(ref)s and https://a.b/c": "See URL/%(ref)s and URL",
    "www.ed.example/@@ref@@ or www.ed.example/x": "URL/@@ref@@ or URL",
    "https://[YOUR DOMAIN]/leaf": "https://[YOUR DOMAIN]/leaf",
    "https://ed.example/{0}/{1}": "URL/{0}/{0}",
    "from https://ed.example/__AUTHOR__/3": "from URL/__AUTHOR__/0",
    "https://doi.example/10.XXXX/a": "URL.XXXX/a",
    "write to __USER__@ed.example.org": "write to __USER__@ed.example.org",
}


@pytest.mark.parametrize(("line", "masked"), ADDRESSES.items())
def test_placeholders_within_addresses(line, masked):
    assert R.mask(line) == masked and R.Classifier()(masked) == "placeholder"
    assert list(R.Prefilter()(line)) == [masked]


def test_addresses_without_placeholders():
    for line in ("https://a.b/c?d=%28x%29", "www.a.b/#x", "x@y.org, http://[::1]/a", "see https://a.b/{x}, http://c.d/$e"):
        assert R.Classifier()(R.mask(line)) is None
    assert R.mask("{{a}} at https://a.b/{{c}}") == "{{a}} at URL"


BY_KIND = {
    "placeholder": ["[insert title here]", "Written by [your name].", "[Titel einfügen]", "[insérer le titre ici]", "{title} by {author}"],
    "error": [
        "Page not found", "404 Page Not Found", "404 - File not found.", "The requested page could not be found.", "Internal Server Error", "Access denied", "Die Seite konnte nicht gefunden werden.", "Fehler 404: Datei wurde nicht gefunden",
        "Zugriff verweigert", "Page non trouvée", "Erreur 404 : page non trouvée", "Pagina non trovata", "Página no encontrada",
    ],
    "scripts": [
        "JavaScript is disabled in your browser", "JavaScript is required", "JavaScript must be enabled to view this page.", "JavaScript ist deaktiviert.", "Diese Seite benötigt JavaScript.", "JavaScript est requis pour lire le texte.",
        "Veuillez activer JavaScript.", "JavaScript è disabilitato.", "JavaScript está desactivado en su navegador.",
    ],
}
SPOKEN_OF = [
    "Of the leaf he writes: page not found in either binding.", "Philo holds that JavaScript is required by the old viewer, and prefers print.", "The file could not be found by Hestor, who looked twice.", "The text has {ibadom} and {name of a river}.",
    "In that year access denied to the nave was a grave matter.", "[add. m. 2] and [your copy has a gap]", "Die Seite konnte von Murex nicht gefunden werden, da sie fehlt.",
]


@pytest.mark.parametrize(("kind", "line"), [(k, x) for k, lines in BY_KIND.items() for x in lines])
def test_phrasings_by_kind(kind, line):
    assert [R.Classifier()(m) for m in R.Prefilter()(line)] == [kind]


@pytest.mark.parametrize("line", SPOKEN_OF)
def test_prose_that_speaks_of_them(line):
    assert [R.Classifier()(m) for m in R.Prefilter()(line)] in ([], [None])  # words that count where they recur are handed on


# Phrases by form; the rules were widened with these in view.
BY_FORM = {
    "placeholder": [
        "Dear {{ customer.name }},", "Order %%ORDER_ID%% of %%DATE%%", "{% block content %}", "Hello {first_name} {last_name},", "<%= render partial %>", "${user.email}", "TODO: write the introduction", "Location: TBD",
        "<<Insert>>", "@@VERSION@@", "[Insert title here]", "Author: null", "<?php echo $title; ?>", "__COMPANY__ welcomes you", "Dear {2}, your order {3}",
    ],
    "error": [
        "Page not found", "Internal Server Error", "HTTP ERROR 404", "Error 500", "Service Unavailable", "503 Service Overloaded", "Error 301: moved", "502 Bad Gateway nginx", "Gateway Timeout", "403 Forbidden",
        "    at com.foo.Bar.run(Bar.java:12)", "ValueError: invalid literal", "Fatal error: Uncaught Exception in index.php", "The requested page could not be found on this server.", "ERROR: relation x does not exist",
    ],
    "scripts": [
        "JavaScript is disabled in your browser", "You need JavaScript to view this page", "This site requires JavaScript.", "Please turn on JavaScript to continue.", "JavaScript must be enabled", "Please enable cookies to go on.",
        "<noscript>off</noscript>", "JavaScript is required to use this form.", "Bitte aktivieren Sie JavaScript.", "Veuillez activer JavaScript",
    ],
    "filler": ["Lorem ipsum", "dolor sit amet", "consectetur adipiscing elit, sed do", "test test test", "foo bar foo bar foo bar foo bar foo bar", "Dies ist ein Platzhaltertext.", "This is sample text", "xxx xxxx xxx"],
}
FORM_PROSE = [
    "He wrote: TODO in the margin", "The word JavaScript is explained in the handbook.", "The error of the scribe was not found in the codex.", "The page was not found in the codex, says Zeph.",
    "In the margin lorem ipsum is said to come from Cicero.", "We saw {τε} and {καὶ} in the text", "Lorem ipsum is a text of printers.", "A null subject and an undefined verb", "Her reader turned the cookies down.",
]


def test_phrases_by_form():
    cases = [(kind, line) for kind, lines in BY_FORM.items() for line in lines]
    assert [c for c in cases if [R.Classifier()(m) for m in R.Prefilter()(c[1])] != [c[0]]] == []
    assert [line for line in FORM_PROSE if R.Classifier()(R.mask(line))] == []


# Phrases that were written down after the rules were finished and that no rule was changed for.
HELD_OUT = {
    "placeholder": [
        "Hi {{#if user}}{{user}}{{/if}}", "Invoice ${invoiceNumber}", "{% include 'header.html' %}", "Welcome, %%firstname%%!", "Signed: [Your Signature Here]", "Telephone: undefined", "[PROJECT NAME]", "Published in {publication_year}",
        "<%= @title %>", "@@build@@", "Dear %(name)s,", "FIXME: check the date",
    ],
    "error": [
        "HTTP Status 500", "504 Gateway Timeout", "401 Unauthorized", "The requested URL was not found on this server.", "IndexError: list index out of range", "java.io.IOException: Stream closed",
        "Parse error: syntax error, unexpected end of file", "Oops! Something went wrong.", "Access denied. You do not have permission to see this.", "Your session has expired", "Bad Request", "File not found",
    ],
    "scripts": ["Please enable JavaScript", "You have to enable cookies first", "This application requires JavaScript", "JavaScript is not supported by your browser", "Enable JavaScript and reload", "Checking your browser before accessing the site"],
    "filler": ["Lorem ipsum dolor sit amet", "This is dummy text", "asdf asdf jkl", "Your text here", "blah blah blah blah blah blah", "Dies ist ein Blindtext"],
}


def test_held_out_phrases():
    cases = [(kind, line) for kind, lines in HELD_OUT.items() for line in lines]
    found = [[R.Classifier()(m) for m in R.Prefilter()(line)] == [kind] for kind, line in cases]
    print([c for c, ok in zip(cases, found) if not ok])
    assert sum(found) >= 0.9 * len(cases)


def test_recurrence_decides(spark):
    """A message without the form of one is residue where it recurs in documents of several sources, and only there."""
    line = "Sorry, leaf {} of this codex is not available at the moment."
    rows = [(k, f"Prose.\n{line.format(k)}", f"s{k % 2}") for k in range(4)]  # recurs once numbers are masked
    rows += [(10 + k, "Our scanner is under construction.", "s0") for k in range(9)]  # in one source only
    rows += [(20, "The key was not available.", "s1"), (21, "The key was not available.", "s2")]  # in two documents
    rows += [(30 + k, "The reader was not available " + " ".join(f"w{chr(97 + i)}" for i in range(26)), f"s{k}") for k in range(9)]  # no short line
    got = {r.doc_id: r.kinds for r in R.residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: ["error"] for k in range(4)}
    assert R.residue(spark.createDataFrame(rows[:2], SCHEMA)).count() == 0
