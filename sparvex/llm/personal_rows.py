"""Labelled texts to fit the field of `personal` on: made from templates with invented people, all from one seed.

A template's slots: {P} a person's full name, {F} a full name of no known given name, {G} a given name alone, {V} one that is not known, {I} an initial and a surname, {E}
an email address, {T} a telephone number, {A} a street address, {N} an identity number; not personal are {g} a given
name that is an ordinary word too, {h} any given name, both used for something else, {C} words of a heading, {U} an invented
term, {w} a word, {v} a version, {d} a number. {p} and {q} name the text's first person again, in full and by the given name, {f} the first {F}.
"""

from __future__ import annotations

import random

KIND_OF = {"P": "name", "V": "name", "F": "name", "G": "name", "I": "name", "p": "name", "q": "name", "f": "name", "E": "email", "T": "phone", "A": "address", "N": "id_number"}
PERSONAL = r"""
# Author: {P} <{E}>|author = "{P}"|Maintainer: {P}, {T}|Written by {P}|Reviewed by {P} on Monday.|Thanks to {P} for the plots.|{P} wrote the loader.|Contact {P} ({E}).
Best,\n{G}|Best,\n{F}|---\n{F}\n{A}|# ---\n# {P}\n# {T}|--\n{G}|Cheers,\n{F}|Cheers,\n{V}|Best, {V}|Cheers, {G}|Best, {P}|Best,\n{V}|Gruß\n{V}|Cheers,\n{P}\n{E}|Regards,\n{P}\n{T}|Hi {G},|Dear {G},|Thanks,\n{G}|# -- {G}|Ask {P} about the assay.|Ask {F} about the assay.|By {F}|Owner: {F}|{F} sent the file.|I met {P} and {P}.|see the notes of {I}|by {I}|Author: {I}
0   {P}   {E}\n1   {P}   {E}|12  {P}  {T}\n13  {F}  {T}|name: {P}|"name": "{P}", "mail": "{E}"|reviewer={P}|Dr. {P} said no.|Ms {P} asked for it.|Patient: {P}|{p} has the key.|{p} will know.|{q} fixed it.|{f} has the key.|{f} will bring it.|we asked {f}|{f}, as always|{q} again|{f} and {q} left.|cc {P}
Call me at {T}.|phone: {T}|Tel. {T}|fax {T}|or ring {T} after nine|mobile={T}|my number is {T}|{E}|mail {E}, please|write to {E}|send the rows to {E} by Friday|"{E}"|{T}
Return to {A}.|Address: {A}|ship it to {A}|We meet in {A}.|The lab is at {A}.|{A}\n{T}|SSN: {N}|his SSN was {N}|passport no. {N}|ID number is {N}|"national_id": "{N}"|tax id {N}
Danke an {P} für die Daten.|Liebe {G},|Viele Grüße\n{G}|LG,\n{G}|Frau {P} hat gefragt.|von {P}|Telefon: {T}|Anschrift: {A}|Steuer-ID {N}|Ausweis: {N}
Merci à {P} pour les données.|Bonjour {G},|Cordialement,\n{P}|par {P}|Mme {P} a écrit.|tél. {T}|Adresse : {A}|passeport {N}|Gracias a {P} por los datos.|Hola {G},|Saludos,\n{G}|Autora: {P}|teléfono {T}|Dirección: {A}|DNI {N}
"""
OTHER = r"""
# {C}|## {C} {d}|The {h} theme is new.|The {h} Table has {d} rows.|See the {g} Comparison of {w} and {w}.|A {g} Diagram of the {w}.|{g} access to the {w} folder, please.|In {g} the {w} rose by {d} percent.|# {g} {C}|{g} the {w} before you go on.
The {U} distance and the {U} sampling.|{U} filters beat {C}.|the {U} {U} test of {w}|pip install {w}=={v}|build {v}|part no. {d}-{d}-{d}|run {d} of {d}|loss 0.{d} acc 0.{d}|git@{w}.org:{w}/{w}.git|import {w} as {w}|Figure {d}: {C}|lot {d}-{d}-{d}|item {d}{d}
order {d}{d}|started {d}{d}{d}|version {v}|{w}@{v}|@{w}|A @ B.T|x = [{d}.{d}, {d}.{d}]|{d} {w} Street Views|# {C} View {d}|{C} and {C}|The {U} method. The {U} kernel.|{C}, {C} and {U}|{U} {C}|10.{d}.{d}.{d}|from {w} import {U}|{g} {C} keep {d} {w}
"""
_SYLLABLES = "va mor tel bri sko dun wen ral fos hel quil zan gor bet lin mar tov nes pal dri osk ulf ren cas".split()
_STREETS = {
    "en": ["{n} {s} Street", "{n} {s} Road", "{n} {s} Lane, {c} Q{n} 3AB", "{n} {s} Avenue, {c}", "{n} {s} Parkway"],
    "de": ["{s}straße {n}, 40090 {c}", "{s}weg {n}", "Am {s} {n}, 40091 {c}"],
    "fr": ["{n} rue {s}, 40092 {c}", "{n}, avenue de {s}"],
    "es": ["Calle {s}, {n}", "Avenida {s} {n}, 40093 {c}"],
    "it": ["Via {s} {n}", "Piazza {s}, {n}"],
}
_PHONES = ["+44 7700 9{ddd}{dd}", "({ddd}) 555-{dddd}", "{ddd}-555-{dddd}", "+49 30 {dddd}{ddd}", "0{d} {dd} {dd} {dd} {dd}", "030/{ddddd}-{ddd}", "+34 6{dd} {ddd} {ddd}", "{ddd}.555.{dddd} ext. {dd}"]
_IDS = ["{ddd}-{dd}-{dddd}", "QQ {dd} {dd} {dd} C", "{dddddddd}X", "Y{ddddddd}", "{dddd} {dddd} {dddd}"]
_MAILS = ["{a}.{b}@{c}.example", "{a}{d}@mail.{c}.org", "{a} [at] {c} [dot] org", "{b}_{a}@{c}.com", "{a}&#64;{c}.net", "{a}.{b} (at) {c}.example"]


def _digits(r: random.Random, form: str) -> str:
    out, inside = [], False
    for ch in form:
        inside = ch == "{" or (inside and ch != "}")
        out.append("" if ch in "{}" else str(r.randint(1, 9)) if inside and ch == "d" else ch)
    return "".join(out)


def labelled_texts(given: list[str], ordinary: list[str], known, capitals: list[str], texts: int, seed: int = 0) -> list[tuple[str, list[tuple[int, str]]]]:
    """(text, [(start, kind)]). given: given names; ordinary: those that are words too; known: whether a word is in the vocabulary;
    capitals: capitalised words of it, which stand for given names that the lexicon lacks."""
    r = random.Random(seed)

    def invented(parts: int = 0) -> str:
        while True:
            w = "".join(r.choices(_SYLLABLES, k=parts or r.randint(2, 3))).capitalize()
            if not known(w):
                return w

    words = "model sample filter column weight kernel batch signal error table value query index season metric".split()
    heads = "Main Model Data Next Steps Load Plots Split Random Forest Results Summary Street View Export Weekly Overview Access Funding Merge".split()
    yes, no = ([t for line in s.strip().split("\n") for t in line.split("|")] for s in (PERSONAL, OTHER))
    name = lambda: r.choice(given).strip().title()
    out = []
    for _ in range(texts):
        first = (name(), invented())
        stranger = (invented(3), invented(3))
        said, met, text, spans = False, False, "", []
        for _ in range(r.randint(3, 9)):
            t = r.choice(yes if r.random() < 0.45 else no).replace("\\n", "\n")
            if (("{p}" in t or "{q}" in t) and not said) or ("{f}" in t and not met):
                continue
            i = 0
            while i < len(t):
                if t[i] != "{" or t[i + 2 : i + 3] != "}":
                    text += t[i]
                    i += 1
                    continue
                slot = t[i + 1]
                if slot in "Pp":
                    whole = first if slot == "p" or not said else (name(), invented())
                    said = True
                    fill = " ".join(whole)
                elif slot == "V":
                    fill = r.choice(capitals) if capitals and r.random() < 0.5 else invented(2)
                elif slot == "F":
                    fill = " ".join(stranger if not met else (invented(3), invented(3)))
                    met = True
                elif slot == "f":
                    fill = " ".join(stranger)
                elif slot in "Gqh":
                    fill = first[0] if slot == "q" else name()
                elif slot == "g":
                    fill = r.choice(ordinary or given).strip().title()
                elif slot == "I":
                    fill = f"{r.choice('ABCDEFGHJKLMNPRSTW')}. {invented()}"
                elif slot == "E":
                    fill = r.choice(_MAILS).format(a=invented().lower(), b=invented().lower(), c=invented().lower(), d=r.randint(1, 99))
                elif slot == "T":
                    fill = _digits(r, r.choice(_PHONES))
                elif slot == "N":
                    fill = _digits(r, r.choice(_IDS))
                elif slot == "A":
                    fill = r.choice(r.choice(list(_STREETS.values()))).format(n=r.randint(1, 240), s=invented(), c=invented())
                elif slot == "C":
                    fill = " ".join(r.sample(heads, r.randint(1, 3)))
                elif slot == "U":
                    fill = invented()
                elif slot == "w":
                    fill = r.choice(words)
                else:
                    fill = f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 4000)}" if slot == "v" else str(r.randint(2, 9999))
                if slot in KIND_OF:
                    spans.append((len(text) + fill.startswith("("), KIND_OF[slot]))
                text += fill
                i += 3
            text += "\n\n" if r.random() < 0.2 else "\n"
        out.append((text, spans))
    return out
