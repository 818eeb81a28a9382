import base64
import re

import pytest

pytest.importorskip("public_tokenizers")
from sparvex.llm import personal as P  # noqa: E402
from sparvex.llm.tokenize import default_vocabulary  # noqa: E402

NAMES = ["May", "Grant", "Iris", "Renée", " TARIQ ", "Hugo", "Hugo", "Käthe", "Jade", None, ""]


@pytest.fixture(scope="module")
def lex():
    with open(default_vocabulary(), "rb") as f:
        return P.Lexicon(NAMES, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())})


@pytest.fixture(scope="module")
def weights(lex):
    return P.fitted_weights(lex)


def marked(lex, weights, text):
    return [(k, text[a:b]) for _, k, a, b in sorted(P.occurrences([text], lex, weights), key=lambda x: x[2])]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Contact: <hugo.x+y@mail.example>, ok", [("email", "hugo.x+y@mail.example")]),
        ("write to jane-r [at] dept [dot] iris [dot] invalid now", [("email", "jane-r [at] dept [dot] iris [dot] invalid")]),
        ("a_b AT mail DOT example or c&#64;d.example", [("email", "a_b AT mail DOT example"), ("email", "c&#64;d.example")]),
        ("!git clone git@forge.invalid:lab/x.git; pip install a@4.2; A @ B.T; @property", []),
        ("Tel. (920) 555-0162 ext. 9", [("phone", "920) 555-0162 ext. 9")]),
        ("call +44 (0)7700 900648 or 030/23125-754", [("phone", "+44 (0)7700 900648"), ("phone", "030/23125-754")]),
        ("0.0057817852, 0.005219 0.8739346, 192.0.2.1 build 4.0.2917, started 1644800474", []),
        ("SSN QQ 10 78 47 A and lot 101-54-7617 item 7730466609", [("id_number", "QQ 10 78 47 A")]),
        ("'part no.': '565-83-9593'", []),
        ("Return to: 233 Old Tannery Crescent, Nettleford QX1 9XX", [("address", "233 Old Tannery Crescent, Nettleford QX1 9XX")]),
        ("in M\\u00fchlgasse 170b, 40090 Osterwied.", [("address", "M\\u00fchlgasse 170b, 40090 Osterwied")]),
        ("# Main Street View 25\n## 14 Street Images", []),
        ("The Jade theme. Grant access. May rose. The Iris Table. Will Split.", []),
        ("Written by Eskalde, Hugo. See Dr. Iris Thornowitz", [("name", "Eskalde, Hugo"), ("name", "Iris Thornowitz")]),
        ("Author: W. Ulvrath; thanks to Priya Quillmere for", [("name", "W. Ulvrath"), ("name", "Priya Quillmere")]),
        ("ok.\n\nCheers,\nTariq\n\nmore", [("name", "Tariq")]),
        ("0   K\\u00e4the Ostrv\\u00e1   kathe@x.example", [("name", "K\\u00e4the Ostrv\\u00e1"), ("email", "kathe@x.example")]),
        ("The Tuvald distance and the Marlowick sampling", []),
    ],
)
def test_kinds(lex, weights, text, want):
    assert marked(lex, weights, text) == want


HELD_OUT = [
    ("email", ["reach me under tomas.vrel@uni-x.example", "a_b%c@example.org is new", "(k.l@m.example)", "x" * 90 + "@long.example is long", "mailto:zed@q.example", "ping ana at dept dot example dot org", "to=bo@c.example;", "<o'neil@d.example>", "j&commat;e.example", "who@f.example, g@h.example"]),
    ("phone", ["dial +33 6 12 34 56 78", "T: (415) 555-2671", "cell 0171 2345678", "Phone=020 7946 0958", "+1-202-555-0147 works", "telefon 0043 1 5123456", "fax: 030 901820", "call 415-555-0132 now", "mobile: +61 412 345 678", "numéro 01 42 68 53 00"]),
    ("id_number", ["his SSN was 078-05-1120", "Passport No: C01X00T47", "DNI 12345678Z", "NINO AB 12 34 56 C", "national id = 850101-1234", "her social security number is 219-09-9999", "NIE X1234567L", "Steuer-ID: 12 345 678 901", "tax id 91-1144442", "passport L8988901C4"]),
    ("address", ["42 Willow Parkway", "moved to Via Garibaldi 12", "10 Downing Street, London SW1A 2AA", "Hauptstraße 5, 10115 Berlin", "12 rue Victor Hugo", "Calle Mayor 8", "at 221 Baker Street", "Piazza Navona, 3", "Goetheplatz 9", "1600 Amphitheatre Parkway"]),
    ("name", ["Ask Oyelaran Adeyemi about the assay", "Hugo Zelwick checked it", "signed-off-by: Tariq Oldumbra", "Yours,\nRenée Falquist", "Käthe Brandulf schrieb uns", "merci à Hugo Quennel", "Prof. Iris Wendigall", "owner = Jade Fornquist", "hola Tariq,", "the talk by N. Overdale"]),
]


@pytest.mark.parametrize(("kind", "texts"), HELD_OUT)
def test_held_out_sentences(lex, weights, kind, texts):
    """Sentences that are neither of the training templates nor of the corpus: recall of 0.9 by kind."""
    hits = [any(k == kind for k, _ in marked(lex, weights, t)) for t in texts]
    assert sum(hits) >= 0.9 * len(texts), [t for t, h in zip(texts, hits) if not h]


def test_fitted_field_on_new_texts(lex, weights):
    """Made texts of another seed: what the field and its ties give."""
    rows = P.made_texts(lex, 800, seed=9)
    gold = {(d, k, a) for d, (_, spans) in enumerate(rows) for a, k in spans}

    def score(w):
        found = {(d, k, a) for d, k, a, _ in P.occurrences([t for t, _ in rows], lex, w)}
        return 2 * len(found & gold) / (len(found) + len(gold)), found

    whole, found = score(weights)
    alone, without = score(weights | {"chain": 0.0, "skip": 0.0})
    print(f"F1 {whole:.4f}, without the field's ties {alone:.4f}, rows that differ {len(found ^ without)} of {len(found)}")
    assert weights["skip"] > 0 and whole > 0.85 and whole > alone and found != without


def test_skip_potentials_make_labels_agree():
    c = P.Candidates()
    c.add(0, 0, 5, P.NAME, ["sure"], ("s", "x"))
    c.add(0, 900, 905, P.NAME, ["unsure"], ("s", "x"))
    c.add(0, 1900, 1905, P.NAME, ["unsure"], ("s", "y"))
    p = P.marginals(c, {"sure": 4.0, "unsure": -0.8, "skip": 1.5})
    assert p[1, P.NAME] > 0.5 > p[2, P.NAME] and abs(p.sum(1) - 1).max() < 1e-9


def test_long_texts_and_positions(lex, weights):
    text = "Ünïcode 😀 " * 40_000 + "Best, Hugo"
    assert [(k, a) for _, k, a, _ in P.occurrences([text], lex, weights)] == [("name", len(text) - 4)]


def test_tables(spark):
    docs = [(1, "Best, Hugo", "x"), (1, "Best, Hugo", "x"), (2, None, None), (3, "", None), (4, "mail a.b@c.example", "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    n = spark.createDataFrame([(x, "en") for x in NAMES], "given_name string, lang string")
    got = sorted(map(tuple, P.personal_information(d, n).collect()))
    assert got == [(1, "name", 7, 10), (4, "email", 6, 18)]
    texts = {r.doc_id: r.text for r in P.masked_texts(d, n).collect()}
    assert texts == {1: "Best, [NAME]", 2: None, 3: "", 4: "mail [EMAIL]"}
    assert P.personal_information(d.limit(0), n).count() == 0
    assert P.personal_information(d, n.limit(0)).count() == 2
    assert not re.search("Hugo", " ".join(t or "" for t in texts.values()))
