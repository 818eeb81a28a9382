"""Personal information in free text: email addresses, phone numbers, identity numbers, street addresses, names.

Candidates are spans that have the shape of one of the kinds. They are the nodes of a skip-chain conditional random field
over each document, with the labels "nothing" and the five kinds:
- node potentials: a log-linear sum of a candidate's features (shape, label before, words around, lexicon of given names,
  whether a word is an ordinary one),
- chain potentials between neighbours that stand close together (a signature, a table row),
- skip potentials between all candidates with the same text, surname or given name, or a name and the email address that is
  made of it, however far apart. All candidates of such a group are tied to one node of the group, which takes messages from
  each of them to each other.
Loopy sum-product message passing (damped, `ROUNDS` rounds, all documents of a batch at once as arrays) gives the
marginals; a candidate with a marginal of one half or more for a kind is reported. Overlaps go to the more
certain, then the longer span.

The weights are fitted, by pseudo-likelihood, on `TRAINING_TEXTS` labelled texts that `personal_rows` makes of templates with
the given names of the lexicon; no text of the corpus is used. "Ordinary" words are those that a public tokenizer's
vocabulary holds whole, so no list of words is kept here.

Positions are code points from 1 of the first letter, digit or plus sign, or of the backslash of the `\\uXXXX`
escape that stands for it. Null and empty texts have no occurrences; whole texts are searched; repeated documents
each give their rows, once by (doc_id, kind, start_pos). Null names are ignored, an empty lexicon leaves the names that
their context tells. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .personal_rows import labelled_texts
from .tokenize import default_vocabulary

KINDS = ("email", "phone", "id_number", "address", "name")
EMAIL, PHONE, ID, ADDRESS, NAME = range(1, 6)
ROUNDS, DAMPING, CLOSE = 6, 0.3, 120
MAX_NAMES = 200_000
FREQUENT = 5000  # ranks of a byte-pair vocabulary below this are very frequent words
TRAINING_TEXTS, RIDGE = 1200, 0.5

_U, _L = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĘĚĜĞĢĤĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŖŘŚŜŞŠŢŤŪŮŰŲŴŶŹŻŽ", "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ"
_AT = r"(?:@|&#64;|&commat;|\\u0040|%40| ?[(\[{<] ?at ?[)\]}>] ?| at (?=[A-Za-z0-9-]+(?: dot |\.))| AT )"
_DOT = r"(?:\.| ?[(\[{<] ?(?:dot|punkt|punto|point) ?[)\]}>] ?| dot | DOT )"
_EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._%'~=+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w:@]|-\w)", re.I)
_LOCAL = "._%'~=+-"
_HAS_AT = re.compile(r"@|&#64;|\\u0040|%40|[(\[{<] ?at ?[)\]}>]|&commat;| at [\w.-]+(?: dot |\.)[A-Za-z]| AT [\w-]+ DOT ", re.I)
_PHONE = re.compile(r"(?<![\w.,+/:-])(?<!\d )(?=[\d+(][\d+() .\-/]{5})(?:\+|\(?)\d+\)?(?:[ .\-/]?\(?\d+\)?)*(?:,? ?(?:ext\.?|extn\.?|x|Durchwahl|poste) ?\d{1,5})?(?![\w]|[.,-]\d)")
_PHONE_LABEL = re.compile(r"(?:\b(?:tel|tél|phone|call|mobile|cell|fax|telefon|teléfono|llama(?:r)?(?: al)?|appel(?:er|ez)?(?: le)?|ruf|number is|ring|numéro)[.:]*\s*(?:at|al|me at|is|unter|le|:|=)*|\bT:?)[\s:=\"'\\]*$", re.I)
_COUNTER = re.compile(r"(?:\b(?:lot|item|part no\.?|run|build|from|started|total|version|order|batch|isbn|port|id)|==|@)['\"\s:=]*$", re.I)
_ID = re.compile(
    r"\b(?:ssn|social security(?: (?:no|number))?|passport(?: (?:no|number))?|national[ _]id|id (?:no|number|card)|identity (?:no|number)|tax (?:no|id|number)"
    r"|person_?id|personal_?id|id_?number|\w*ausweis\w*|identificación|carnet|ni (?:no|number)|national insurance (?:no|number)|nino|dni|nie|nif|nir|insee|steuer-?id(?:nr)?|sozialversicherungsnummer|n[°º] de (?:s[ée]curit[ée] sociale|identidad)|pasaporte|passeport)\b"
    r"(?:\.|\b(?: is| was| est| était| es| era| ist| war)\b|[\s:=\"'\\#]|nr\.?|n[°º])*((?=[A-Z \d.-]*\d)[A-Z\d](?:[ .-]?[A-Z\d])*?)(?=[\"'\\,;:)\n]|\.?(?:\s|$)(?![ ]?\d)|\.(?!\d)|$)", re.I)  # fmt: skip
_ID_BODY = re.compile(r"(?:[A-Z]\d{2}[A-Z\d]{5,9}|[A-Z]{1,2} ?\d(?:[ .-]?\d)*(?:[ -]?[A-Z])?|\d(?:[ .-]?\d)*(?:-?[A-Z])?)(?![\w])")
_STREET = re.compile(
    rf"(?<![\w.])(?:\d{{1,4}} ?[A-Za-z]?(?: bis| ter)?,? (?:[{_U}][{_L}'’]+\.? ){{1,4}}?(?:Lane|Street|St\.?|Close|Crescent|Road|Rd\.?|Avenue|Ave\.?|Drive|Dr\.?|Way|Court|Place|Terrace|Row|Hill|Square|Gardens|Parkway|Pkwy|Circle|Trail|Mews|Grove|Highway|Boulevard|Blvd\.?)(?![\w])"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|bd|boulevard|impasse|all[ée]e|place|quai|chemin|route|cours|passage|square)(?: (?:de la|de l['’]|des|du|de|d['’]|la|le|les))? ?(?:[{_U}][{_L}'’-]+ ?){{1,3}}"
    rf"|(?:[{_U}][{_L}]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)|(?:Am|An der|Im|Zum|Zur|Auf dem|In der) (?:[{_U}][{_L}]+ ?){{1,2}}) ?\d{{1,4}} ?[a-z]?(?![\w])"
    rf"|(?:Via|Viale|Piazza|Corso|Largo|Rua) (?:(?:dei|delle|della|del|di|da|do|dos) )?(?:[{_U}][{_L}]+ )*(?:[{_U}][{_L}]+),? \d{{1,4}}(?![\w])"
    rf"|(?:Calle|C/|Avda?\.|Avenida|Plaza|Pza\.|Paseo|P\.º|Camino|Carrera|Ronda|Travesía|Callejón)(?: (?:de la|de los|de las|del|de|la|el))? (?:[{_U}][{_L}]+ )*(?:[{_U}][{_L}]+),? \d{{1,4}})"
)
#: Literal parts of every street and every label of an identity number: texts without any of them are not searched.
_STREET_PARTS = (
    " Lane", " Street", " St", " Close", " Crescent", " Road", " Rd", " Ave", " Drive", " Dr", " Way", " Court", " Place", " Terrace", " Row", " Hill",
    " Square", " Gardens", " Parkway", " Pkwy", " Circle", " Trail", " Mews", " Grove", " Highway", "Via ", "Viale ", "Piazza ", "Corso ", "Largo ", "Rua ", " Boulevard", " Blvd", " rue ", " avenue ", " av. ", " bd ", " boulevard ", " impasse ", "allée ", "allee ", " place ", " quai ", " chemin ",
    " route ", " cours ", " passage ", " square ", "straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm", "ring ", "Am ", "An der ", "Im ", "Zum ",
    "Zur ", "Auf dem ", "In der ", "Calle", "C/", "Avda", "Avd.", "Ava.", "Avenida", "Plaza", "Pza.", "Paseo", "Camino", "Carrera", "Ronda", "Travesía", "P.º",
)
_ID_PARTS = (
    "ssn", "security", "passport", "national", "id no", "id num", "id card", "identity", "tax no", "tax id", "tax num", "nino", "dni", "nie", "nif", "nir", "insee",
    "steuer", "sozialv", "sécurité", "securité", "sécurite", "securite", "identidad", "pasaporte", "passeport", "person", "id_num", "idnum", "ausweis", "identificación", "carnet", "ni no", "ni num",
)
#: What may follow a street up to the end of an address.
_REST = re.compile(
    rf"(?:,? ?(?:Apt\.?|Flat|Unit|Suite|#) ?\w+|, (?:bajo|\d+\.º ?[A-Z]?))?(?:(?:,| |,? ?\n(?:# |\s*\.\.\.: (?:# )?)?|\\n\",? ?\n? *\")? ?(?:\d{{5}} )?[{_U}](?=[a-zß-ÿ])[{_L}-]+(?: (?:am|an der|del|de la|[{_U}](?=[a-zß-ÿ])[{_L}-]+))*(?:,? [A-Z]{{2}}\d? ?\d[A-Z\d]{{1,4}})?)?"
)
_RUN = re.compile(rf"(?<![\w@.+\\-])[{_U}](?:[{_L}'’]+|\.)(?:-[{_U}][{_L}]+)?(?:,? (?:(?:de|van|von|der|den|di|del|la|le) )*[{_U}](?:[{_L}'’]+|\.)(?:-[{_U}][{_L}]+)?)*(?![\w@])")
_PIECE = re.compile(rf"[{_U}](?:[{_L}'’]+|\.)(?:-[{_U}][{_L}]+)?|,| (?:de|van|von|der|den|di|del|la|le)(?= )")
_TITLE = {"dr", "ms", "mr", "mrs", "miss", "frau", "herr", "mme", "mlle", "m", "sra", "sr", "srta", "prof", "sir", "don", "doña", "señora", "señor"}
_CUE = re.compile(
    r"(?:\b(?:by|author|autor|autora|auteur|owner|maintainer|operator|reviewer|reviewed-by|signed-off-by|contact|cc|thanks to|merci à|gracias a|danke an|dank an|came from|notes of|par|por|von|best|lg|regards|cheers|hi|hello|dear|hallo|liebe[r]?|bonjour|hola|name|person|user|patient|employee|attn)\b[,.]?|—|–)(?: (?:Dr|Ms|Mrs|Mr|Frau|Herr|Prof|Mme|M|Sra|Sr)\.?)?\s*[:=]?\s*(?:\\?[\"'])?\s*$|(?:^|[\s(])(?:Dr\.|Ms\.?|Mrs\.?|Mr\.?|Frau|Herr|Prof\.|Mme|Sra\.?|Sr\.)\s+$", re.I)
_SIGNED = re.compile(r"(?:—|–|\b(?:best|lg|regards|cheers|thanks|saludos|cordialement|bises|grüße|gruß|vg|love|sincerely),?)\s*(?:\\n)?[\s\"#,]*$", re.I)
_AFTER = re.compile(r"^ (?:<|(?:asked|said|says|wrote|told|sent|found|fixed|noted|added|suggested|proposed|reported|hat|schrieb|sagte|fragte|a|ont|ha|dijo|pidió|propuso)\b)")
_ROW = re.compile(r"^[\s#\"]*\d+ {2,}$")
_LINE_START = re.compile(r"^(?:\s*\.\.\.:)?(?:In \[[\d* ]*\]:)?[\s#\">*-]*$")
_LINE_END = re.compile(r"^[.,]?(?:\\n)?(?:\",?|[\]}])*\s*$")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


class Lexicon:
    """Given names (case folded) and the vocabulary that tells ordinary words."""

    def __init__(self, names: list[str], vocabulary: dict[bytes, int]):
        self.given = {n.strip().casefold() for n in names if n and n.strip()}
        self.vocabulary, self.ranks = vocabulary, {}

    def rank(self, word: str) -> int:
        """The best rank of a word as a whole entry, in its own or in lower case; large if it is none."""
        got = self.ranks.get(word)
        if got is None:
            forms = {word, word.lower(), word.capitalize()}
            got = min((self.vocabulary.get((" " + f).encode(), 10**9) for f in forms), default=10**9)
            if len(self.ranks) < 500_000:
                self.ranks[word] = got
        return got

    def ordinary(self, word: str) -> bool:
        return self.rank(word) < 10**9

    def ambiguous(self, given: str) -> bool:
        return (" " + given.lower()).encode() in self.vocabulary


class Candidates:
    """The nodes of a batch of documents."""

    def __init__(self):
        self.doc: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.label: list[int] = []
        self.features: list[list[str]] = []
        self.keys: list[tuple] = []

    def add(self, doc: int, start: int, end: int, label: int, features: list[str], *keys) -> None:
        self.doc.append(doc)
        self.start.append(start)
        self.end.append(end)
        self.label.append(label)
        self.features.append(features)
        self.keys.append(keys)


def unescaped(text: str) -> tuple[str, list[int]]:
    """The text with its escapes of letters decoded, and where in it the escapes stand."""
    if "\\u" not in text:
        return text, []
    out, at, last, n = [], [], 0, 0
    for m in _ESCAPE.finditer(text):
        code = int(m[1], 16)
        if code < 0x80 or 0xD800 <= code < 0xE000 or (m.start() and text[m.start() - 1] == "\\"):
            continue
        out.append(text[last : m.start()])
        n += m.start() - last
        at.append(n)
        out.append(chr(code))
        n += 1
        last = m.end()
    out.append(text[last:])
    return "".join(out), at


def _phone_features(text: str, before: str) -> list[str]:
    body = re.split(r",? ?(?:ext|x|Durchwahl|poste)", text)[0]
    digits = re.sub(r"\D", "", body.replace("(0)", ""))
    if not 7 <= len(digits) <= 15:
        return []
    label = bool(_PHONE_LABEL.search(before))
    plus = text.startswith("+")
    grouped = len(re.findall(r"\d+", body)) > 1
    shape = (
        (plus and len(digits) >= 9)
        or (body.startswith("00") and 11 <= len(digits) <= 15)
        or bool(re.fullmatch(r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])?\d{3}[.-]\d{4}", body))
        or bool(re.fullmatch(r"\(?0\d{1,4}\)?(?:[ ./-]?\d{2,8})+", body) and 9 <= len(digits) <= 12 and (grouped or label))
        or bool(re.fullmatch(r"0\d(?:[ .]\d\d){4}", body))
    )
    if not shape and not label:
        return []
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", body) or (not shape and "." in body):
        return []
    said = {"phone_shape": shape, "phone_label": label, "phone_plus": plus, "phone_counter": not plus and bool(_COUNTER.search(before))}
    return ["phone", *(f for f, v in said.items() if v)]


def find(doc: int, text: str, lex: Lexicon, c: Candidates) -> None:
    """Candidates of one text, with their features."""
    blocked: list[tuple[int, int]] = []
    done = 0
    for at in _HAS_AT.finditer(text):
        if at.end() <= done:
            continue
        left = at.start()
        left -= left > done and text[left - 1] == " "
        while left > done and (text[left - 1] in _LOCAL or (text[left - 1].isascii() and text[left - 1].isalnum())):
            left -= 1
        m = None
        for p in range(left, at.start()):
            if text[p].isalnum() and (p == 0 or text[p - 1] not in "_.+@-" and not text[p - 1].isalnum()):
                m = _EMAIL.match(text, p)
                if m and m.end() >= at.end():
                    break
                m = None
        if m is None or (m.start() and text[m.start() - 1] == "/"):
            continue
        local = re.split(_AT, m[0], maxsplit=1, flags=re.I)[0]
        hidden = ["email_hidden"] if "@" not in m[0] else []
        c.add(doc, m.start(), m.end(), EMAIL, ["email", *hidden], ("t", m[0].casefold()), *(("e", p) for p in re.split(r"[._+\d-]+", local.lower()) if len(p) > 3))
        blocked.append(m.span())
        done = m.end()
    if any(x in text for x in _STREET_PARTS):
        for m in _STREET.finditer(text):
            start = m.start()
            rest = _REST.match(text, m.end())
            end = rest.end() if rest else m.end()
            before = text[max(0, start - 25) : start]
            label = bool(re.search(r"(?:address|adresse|anschrift|direcci[oó]n|return to|ship\b.*to|site|stands at|steht in|enviar a|envoyer au)\W*$", before, re.I))
            c.add(doc, start, end, ADDRESS, ["address", *["street_label"] * label, *["address_town"] * (end > m.end())], ("t", m[0].casefold()))
            blocked.append((start, end))
    low = text.lower()
    for m in _ID.finditer(text) if any(x in low for x in _ID_PARTS) else ():
        body = _ID_BODY.match(text, m.start(1))
        if body and len(re.sub(r"[^A-Za-z0-9]", "", body[0])) >= 7:
            c.add(doc, body.start(), body.end(), ID, ["id_label"], ("t", re.sub(r"\W", "", body[0])))
            blocked.append(body.span())
    blocked.sort()
    starts = [b[0] for b in blocked]

    def inside(a: int, b: int) -> bool:
        i = bisect_right(starts, a) - 1
        return (i >= 0 and blocked[i][1] > a) or (i + 1 < len(starts) and starts[i + 1] < b)

    for m in _PHONE.finditer(text):
        if m.end() - m.start() < 7 or inside(*m.span()):
            continue
        before = text[max(0, m.start() - 30) : m.start()].rpartition("\n")[2]
        features = _phone_features(m[0], before)
        if features:
            start = m.start() + (m[0][0] == "(")
            c.add(doc, start, m.end(), PHONE, features, ("t", re.sub(r"\D", "", m[0])))
    _find_names(doc, text, lex, c, inside, [b for a, b in blocked])


def _find_names(doc: int, text: str, lex: Lexicon, c: Candidates, inside, block_ends: list[int]) -> None:
    given = lex.given
    for m in _RUN.finditer(text):
        parts = [(p[0].strip(), m.start() + p.start() + (len(p[0]) - len(p[0].lstrip()))) for p in _PIECE.finditer(m[0])]
        words = [(t, a) for t, a in parts if t != "," and not t[0].islower()]
        if len(words) == 1 and words[0][0].casefold() not in given and not _maybe_signed(text, m):
            continue
        i = 0
        while i < len(words) and (words[i][0].rstrip(".").casefold() in _TITLE and i + 1 < len(words)):
            i += 1
        spans = _spans(words[i:], text, lex)
        for start, end, kind, first, last in spans:
            if inside(start, end):
                continue
            line = text.rfind("\n", 0, start) + 1
            close = text.find("\n", end)
            before, after = text[max(line, start - 40) : start], text[end : close if close >= 0 else len(text)][:60]
            cue = bool(_CUE.search(before))
            whole = text[line:start] if start - line < 60 else "x"
            row = bool(_ROW.match(whole)) and after.startswith("  ")
            alone = bool(_LINE_START.match(whole)) and bool(_LINE_END.match(after))
            previous = text[max(0, line - 40) : max(0, line - 1)].rpartition("\n")[2]
            signed = bool(_SIGNED.search(before)) and bool(_LINE_END.match(after))
            signed = signed or (alone and (bool(_SIGNED.search(previous)) or "---" in previous))
            known = first.casefold() in given
            said = {"name_cue": cue, "name_after": bool(_AFTER.match(after)), "name_row": row, "name_signed": signed, "name_line": alone}
            if kind == "single":
                heading = bool(re.search(r"#\s*$", whole)) and lex.ambiguous(first)
                said |= {"single": True, "single_unknown": not known, "single_ambiguous": lex.ambiguous(first), "single_heading": heading}
                said |= {"single_cue": cue and not lex.ambiguous(first), "single_signed": signed or (alone and known and not heading)}
            elif kind == "full":
                said |= {"full": True, "full_ambiguous": lex.ambiguous(first)}
            elif kind == "initial":
                said |= {"initial": True, "initial_bare": not cue}
            else:
                said |= {"unknown": True, "unknown_bare": not (cue or row or signed), "unknown_place": any(0 <= start - b <= 12 for b in block_ends)}
            features = [f for f, v in said.items() if v]
            keys = [("s", last.casefold())] if last else []
            keys += [("e", p) for p in {_plain(first), _plain(last)} if len(p) > 3]
            c.add(doc, start, end, NAME, features, ("t", text[start:end].casefold()), *keys)


def _maybe_signed(text: str, m: re.Match) -> bool:
    return bool(_LINE_END.match(text[m.end() : m.end() + 12].partition("\n")[0])) and bool(_SIGNED.search(text[max(0, m.start() - 20) : m.start()]))


def _plain(word: str) -> str:
    import unicodedata

    return "".join(x for x in unicodedata.normalize("NFD", word.lower()) if x.isascii() and x.isalpha())


def _spans(words: list[tuple[str, int]], text: str, lex: Lexicon) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, given, surname) of the names in a run of capitalised words."""
    out, i, given = [], 0, lex.given
    end = lambda k: words[k][1] + len(words[k][0])
    while i < len(words):
        t, a = words[i]
        nxt = words[i + 1] if i + 1 < len(words) else None
        gap = text[end(i) : nxt[1]] if nxt else ""
        if nxt and gap == ", ":
            # Surname, Given
            if nxt[0].casefold() in given and not lex.ordinary(t) and t.casefold() not in given:
                out.append((a, end(i + 1), "full", nxt[0], t))
                i += 2
                continue
            if t.casefold() in given:
                out.append((a, end(i), "single", t, ""))
            i += 1
            continue
        if t.casefold() in given:
            j = i + 1
            while j < len(words) and words[j][0].endswith(".") and len(words[j][0]) == 2:
                j += 1
            linked = j < len(words) and "," not in text[end(i) : words[j][1]]
            if linked and not lex.ordinary(words[j][0].split("-")[0]):
                out.append((a, end(j), "full", t, words[j][0]))
                i = j + 1
                continue
            out.append((a, end(i), "single", t, ""))
            i += 1
            continue
        if nxt and "," not in gap:
            if len(t) == 2 and t[1] == "." and not lex.ordinary(nxt[0].split("-")[0]):
                out.append((a, end(i + 1), "initial", t, nxt[0]))
                i += 2
                continue
            j = i + 1
            while j + 1 < len(words) and words[j][0].endswith(".") and len(words[j][0]) == 2:
                j += 1
            if len(t) > 2 and nxt[0].casefold() not in given and not lex.ordinary(words[j][0].split("-")[0]) and lex.rank(t) >= FREQUENT and len(words[j][0]) > 3 and text[end(j - 1) : words[j][1]] in (" ", " de "):
                out.append((a, end(j), "unknown", t, words[j][0]))
                i = j + 1
                continue
        elif not nxt and len(t) > 2 and (i == 0 or text[a - 2 : a] == ", "):
            out.append((a, end(i), "single", t, ""))
        i += 1
    return out


def _edges(c: Candidates) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Pairs of close neighbours, and groups of candidates that share a key."""
    order = sorted(range(len(c.doc)), key=lambda i: (c.doc[i], c.start[i]))
    chain = [(a, b) for a, b in pairwise(order) if c.doc[a] == c.doc[b] and c.start[b] - c.end[a] <= CLOSE]
    groups = defaultdict(list)
    for i in order:
        for key in set(c.keys[i]):
            groups[(c.doc[i], key)].append(i)
    # several keys may tie the same candidates: once is enough
    return chain, [list(g) for g in dict.fromkeys(tuple(g) for g in groups.values() if len(g) > 1)]


def marginals(c: Candidates, weights: dict[str, float]) -> np.ndarray:
    """Loopy belief propagation: the probability of each label at each node, (nodes, 1 + kinds)."""
    n, k = len(c.doc), len(KINDS) + 1
    chain_, groups = _edges(c)
    # a group's node has the labels "nothing" and, for all kinds, the first one
    unary = np.full((n + len(groups), k), -30.0)
    unary[:, 0] = 0.0
    unary[n:, 1] = 0.0
    for i, (label, features) in enumerate(zip(c.label, c.features)):
        unary[i, label] = sum(weights.get(f, 0.0) for f in features)
    edges = chain_ + [(i, n + g) for g, members in enumerate(groups) for i in members]
    if not edges:
        e = np.exp(unary - unary.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    both, agree = np.zeros((k, k)), np.zeros((k, k))
    both[1:, 1:] = weights.get("chain", 0.0)  # both are something
    agree[1:, 1:] = agree[0, 0] = weights.get("skip", 0.0)
    pot = np.stack([both, agree])[np.repeat([0, 1], [len(chain_), len(edges) - len(chain_)])]
    a, b = np.array(edges).T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        pre = belief[src] - msg[back]
        joint = pre[:, :, None] + pot
        top = joint.max(1, keepdims=True)
        new = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        msg = DAMPING * msg + (1 - DAMPING) * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    belief = belief[:n]
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def made_texts(lex: Lexicon, texts: int, seed: int) -> list[tuple[str, list[tuple[int, str]]]]:
    """Labelled texts with the lexicon's names."""
    given = sorted(lex.given) or ["mara"]
    capitals = sorted(w.decode()[1:] for w, rank in lex.vocabulary.items() if rank >= 2 * FREQUENT and re.fullmatch(rb" [A-Z][a-z]{3,6}", w))
    return labelled_texts(given, [g for g in given if lex.ambiguous(g)], lex.ordinary, capitals, texts, seed)


def fitted_weights(lex: Lexicon, texts: int = TRAINING_TEXTS, seed: int = 0) -> dict[str, float]:
    """The weights of all features and of the chain and skip potentials that make the labels of the made texts most likely, each
    given its neighbours' labels (pseudo-likelihood, with a ridge)."""
    rows = made_texts(lex, texts, seed)
    c = Candidates()
    for d, (text, _) in enumerate(rows):
        find(d, text, lex, c)
    gold = {(d, start, kind) for d, (_, spans) in enumerate(rows) for start, kind in spans}
    y = np.array([(d, a, KINDS[k - 1]) in gold for d, a, k in zip(c.doc, c.start, c.label)], float)
    names = sorted({f for features in c.features for f in features}) + ["chain", "skip"]
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(y), len(names)))
    for i, features in enumerate(c.features):
        x[i, [at[f] for f in features]] = 1
    chain, groups = _edges(c)
    for a, b in chain:
        x[a, at["chain"]] += y[b]
        x[b, at["chain"]] += y[a]
    for g in groups:
        g = np.array(g)
        others = (2 * y[g] - 1).sum() - (2 * y[g] - 1)
        x[g, at["skip"]] += np.sign(others)
    w = np.zeros(len(names))
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - RIDGE * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    w[-2:] = np.maximum(w[-2:], 0)
    return dict(zip(names, w.tolist()))


def occurrences(texts: list[str | None], lex: Lexicon, weights: dict[str, float]) -> Iterator[tuple[int, str, int, int]]:
    """(place of the text, kind, start, end) in code points from 0, end exclusive, of the original texts."""
    c, escapes = Candidates(), {}
    for d, text in enumerate(texts):
        if text:
            plain, at = unescaped(text)
            if at:
                escapes[d] = at
            find(d, plain, lex, c)
    if not c.doc:
        return
    p = marginals(c, weights)
    label = np.argmax(p, 1)
    sure = [i for i in range(len(label)) if label[i] and p[i, label[i]] >= 0.5]
    sure.sort(key=lambda i: (c.doc[i], -round(p[i, label[i]], 3), c.start[i] - c.end[i], c.start[i]))
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in sure:
        d, a, b = c.doc[i], c.start[i], c.end[i]
        if any(a < y and x < b for x, y in taken[d]):
            continue
        taken[d].append((a, b))
        at = escapes.get(d, [])
        shift = lambda q, at=at: q + 5 * bisect_right(at, q - 1)
        yield d, KINDS[label[i] - 1], shift(a), shift(b)


def _lexicon(spark, names: DataFrame, vocabulary: str | None):
    """The broadcast lexicon. Its size is checked: a table of more names is no lexicon of given names."""
    rows = names.where(F.col("given_name").isNotNull()).select(F.trim("given_name").alias("n")).distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    with open(vocabulary or default_vocabulary(), "rb") as f:
        names, ranks = sorted(r.n for r in rows), f.read()
    return spark.sparkContext.broadcast((names, ranks, fitted_weights(_load(names, ranks))))


def _load(names: list[str], ranks: bytes) -> Lexicon:
    import base64

    return Lexicon(names, {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a})


def personal_information(documents: DataFrame, names: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, kind, start_pos, end_pos (inclusive), code points from 1. One pass over the texts; only occurrences are shuffled."""
    sent = _lexicon(documents.sparkSession, names, vocabulary)
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks, weights = sent.value
        lex = _load(names, ranks)
        for batch in batches:
            found = list(occurrences(batch.column(1).to_pylist(), lex, weights))
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            cols = [pa.array([f[1] for f in found], pa.string()), pa.array([f[2] + 1 for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=schema.names)

    return documents.where(F.length("text") > 0).select("doc_id", "text").mapInArrow(run, schema).distinct()


def masked_texts(documents: DataFrame, names: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text with typed placeholders such as [EMAIL]; null and empty texts stay as they are."""
    sent = _lexicon(documents.sparkSession, names, vocabulary)
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks, weights = sent.value
        lex = _load(names, ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = defaultdict(list)
            for d, kind, a, b in occurrences(texts, lex, weights):
                spans[d].append((a, b, kind))
            for d, own in spans.items():
                for a, b, kind in sorted(own, reverse=True):
                    texts[d] = texts[d][:a] + f"[{kind.upper()}]" + texts[d][b:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
