"""Personal data in free text: mentions, typed placeholders and keyed surrogates.

Mentions of five types are found in one narrow pass (no shuffle): e-mail
addresses, phone numbers, identity numbers, street addresses and names. The
text can be written anew with typed placeholders, or with keyed surrogates of
the same type, gender, script and format: a word of a list is replaced through
a keyed cycle of its own list, any other word and digits through a keyed cycle
of all strings of their form (Feistel rounds). Each of these is one to one and
has no fixed point, so without a look at other texts distinct entities of a
corpus stay distinct, none stays as it is, and the short and full forms of one
name or address stay forms of it. An e-mail is keyed by its whole address.

Defined cases: NULL text gives no mention and stays NULL; an empty text stays
empty; mentions don't overlap (e-mail, then identity number, phone, address,
name); repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from math import prod

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name parts of the corpus languages, by gender.
GIVEN_F = "Aveli Birgit Dagny Elsbeth Helmi Ingel Katrin Kerttu Liisel Maarika Merle Nora Renate Salme Siret Tiiu".split()
GIVEN_M = "Anton Artur Emil Hugo Joosep Juhan Konrad Leopold Marten Oskar Paavo Rainer Silvan Torvald Viktor Villem".split()
# Common given names of English, German, Estonian and Russian (in both scripts).
COMMON_F = (
    "Anna Maria Mary Elizabeth Sarah Emma Julia Laura Lisa Susan Karen Linda Barbara Margaret Jennifer Jessica Emily Alice Charlotte Sophie Olivia Grace Helen Ruth Jane Kate Claire Rachel "
    "Angela Petra Sabine Monika Claudia Andrea Stefanie Ursula Heike Ingrid Greta Hanna Lena Mia Tiina Kersti Anu Pille Ene Malle Riina Kadri Liis Piret Triin Aino "
    "Olga Elena Natalia Tatiana Irina Svetlana Ekaterina Ludmila Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Людмила Мария Анна"
).split()
COMMON_M = (
    "John James William Robert David Richard Thomas Michael Charles George Paul Peter Mark Daniel Andrew Edward Henry Stephen Matthew Joseph Samuel Benjamin Philip Simon Martin Alexander Oliver Jack Harry "
    "Hans Klaus Jürgen Wolfgang Uwe Stefan Andreas Christian Markus Sebastian Florian Lukas Jonas Felix Otto Karl Heinz Dieter Jaan Peeter Mart Toomas Rein Andres Urmas Margus Tarmo Indrek Priit Kalle Jüri Tõnu Ants "
    "Ivan Sergei Dmitri Vladimir Nikolai Andrei Alexei Mikhail Igor Oleg Иван Сергей Дмитрий Владимир Николай Андрей Алексей Михаил Игорь Олег"
).split()
STEMS = "aru halli hein hõbe kadas kivi kuus linnu lõhe mured pihel raud rebas sinik soo tamme tuule udu vaher varre".split()
ENDINGS = "kivist lehtsoo mäesk nurmik ojandi palumets põldur rannap saareste tähik vald veskitar".split()
STREETS = "Heinakuhja Kaevu Kärestiku Lepiku Liivaluite Meremärgi Pärnaku Savikoja Tiigiserva Turuplatsi Uusraja Vanaveski".split()
PLACES = "Fernhaven Hallsund Kuuselinn Lõunaküla Marjasoo Neuwerth Oldbrook Rannamõiste Uusvalla Vetelpää".split()
FIRM = re.compile(r"\s*(?:&|Trading|Partners|AS\b|OÜ\b|MTÜ\b|TÜ\b|GmbH\b|AG\b|KG\b|Ltd\b|LLC\b|Inc\b|PLC\b|Holding|Group|Shipping|Logistics|parish|programme|kogudus|kirik)")
BEFORE_NOT_A_PERSON = re.compile(r"(?:Saint|St\.?|Sankt|Püha|Vessel|MV|MS|SS|Schiff|laev)\s$")
VESSEL_NUMBER = re.compile(r"\s(?:II|III|IV|V)\b")

UPPER = "A-ZÀ-ÖØ-ÞŠŽА-ЯЁ"
LOWER = "a-zà-öø-ÿšžа-яё"
WORD = f"[{UPPER}][{LOWER}]+"


def lowered(text: str) -> str:
    """Lower case with the same length, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Spans:
    """Places that don't overlap, in order."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.all = sorted(spans)

    def free(self, start: int, end: int) -> bool:
        at = bisect_right(self.all, (start, start))
        return (not at or self.all[at - 1][1] <= start) and (at == len(self.all) or self.all[at][0] >= end)

    def add(self, start: int, end: int) -> None:
        insort(self.all, (start, end))


# --- e-mail ------------------------------------------------------------------
AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?", re.I)
PLAIN_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}(?![\w-])")
SPELT_DOMAIN = re.compile(r"[\w-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?[\w-]+)*\s?(?:\[dot\]|\(dot\)|\{dot\})\s?[^\W\d_]{2,24}(?![\w-])", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    if "@" not in text and "at)" not in (low := text.lower()) and "at]" not in low and "at}" not in low:
        return []
    out = []
    for m in AT.finditer(text):
        mark = m[0].strip()
        if mark == "@" and (m[0][0] == " ") != (m[0][-1] == " ") or "\n" in m[0]:
            continue
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        while start < m.start() and text[start] in ".-%+":
            start += 1
        right = PLAIN_DOMAIN.match(text, m.end()) or (mark != "@" and SPELT_DOMAIN.match(text, m.end())) or None
        if start == m.start() or text[m.start() - 1] == "." or not right:
            continue
        out.append((start, right.end()))
    return out


# --- numbers -----------------------------------------------------------------
PHONE = re.compile(
    r"(?<![\w/.+-])(?<!\d[ (])(?:"
    r"\+\d{1,3}(?:[ -]?\(0\))?(?:[ -]?\d){7,11}"
    r"|\+\d{10,14}"
    r"|00\d{3} \d{6,8}"
    r"|\(0\d{2,4}\) ?\d{2,4}(?:[ -]\d{2,4}){1,3}"
    r"|0\d{2,4}[/.]\d{3}[. ]?\d{3,4}"
    r"|0\d{2,4}/\d{5,8}"
    r"|\d{3}-\d{4}"
    r"|\d{3} \d{4} \d{3}"
    r")(?![\w/-]*\d)(?!-\w)"
)
PHONE_LABELS = ("tel", "phone", "mobile", "call")
LABELLED_PHONE = re.compile(r"\b(?:tel|telefon|phone|mobile|call|telephone)[.:=]*\s*((?:\+|\(|\d)[\d ()/.-]{5,18}\d)", re.I)
DOCUMENT_NUMBER = re.compile(r"(?<![A-Za-z\d])[A-Z]{2}[ -]?\d{7}(?!\d)(?![ -]\d{4}(?!\d))")
PERSONAL_CODE = re.compile(r"(?<![\w+./-])(?<!\d )([1-9] ?\d{6}[ -]?\d{4})(?![\d/]|[-.]\d)")
NOT_A_PERSON = re.compile(r"(?:invoice|reading|account|isbn|reg\.|register|case no\.?|ticket #?|order|receipt|arve|rechnung|konto|lot|no\.)\s*$", re.I)
CODE_LABEL = re.compile(r"(?:personal code|isikukood|code|document|ID|pc=|id code|personencode)[\s:=]*\(?$", re.I)
WEIGHTS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 1), (3, 4, 5, 6, 7, 8, 9, 1, 2, 3)


def checks(code: str) -> bool:
    """Whether the last digit of an 11-digit personal code is its public check digit."""
    digits = [int(c) for c in code]
    for weights in WEIGHTS:
        rest = sum(a * b for a, b in zip(digits, weights)) % 11
        if rest < 10:
            return rest == digits[10]
    return digits[10] == 0


#: Seven digits with at most six signs between any two: what every phone and identity number has.
MANY_DIGITS = re.compile(r"\d(?:[^\w\n]{0,6}\d){6}")


def id_numbers(text: str) -> list[tuple[int, int]]:
    out = []
    if not MANY_DIGITS.search(text):
        return out
    for m in DOCUMENT_NUMBER.finditer(text):
        if m[0][:2] in ("ID", "NO", "NR") and m[0][2] == " " or NOT_A_PERSON.search(text, max(0, m.start() - 16), m.start()):
            continue
        out.append(m.span())
    for m in PERSONAL_CODE.finditer(text):
        code = re.sub(r"\D", "", m[1])
        month, day = int(code[3:5]), int(code[5:7])
        if not (1 <= month <= 12 and 1 <= day <= 31) or NOT_A_PERSON.search(text, max(0, m.start() - 16), m.start()):
            continue
        before = text[max(0, m.start() - 16) : m.start()]
        if checks(code) or CODE_LABEL.search(before) or before.endswith("(") and text[m.end() : m.end() + 1] == ")":
            out.append(m.span(1))
    return out


def phones(text: str) -> list[tuple[int, int]]:
    out = []
    if not MANY_DIGITS.search(text):
        return out
    for m in PHONE.finditer(text):
        if not NOT_A_PERSON.search(text, max(0, m.start() - 16), m.start()):
            out.append(m.span())
    low, taken = lowered(text), Spans(out)
    for m in (LABELLED_PHONE.finditer(text) if any(x in low for x in PHONE_LABELS) else ()):
        s, e = m.span(1)
        if taken.free(s, e) and 7 <= sum(c.isdigit() for c in m[1]) <= 15:
            out.append((s, e))
    return out


# --- addresses ---------------------------------------------------------------
PLACE = "(?:" + "|".join(PLACES) + ")"
TAIL = re.compile(
    rf"(?:,[ \n\xa0]|[ ]?\n|,\n)\d{{5}} (?:{PLACE}|{WORD}(?: {WORD})?)(?: vald\b)?"
    rf"|(?:,[ \n\xa0]{WORD}(?:[ -]{WORD}){{0,2}}){{1,2}},?[ \n\xa0][A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}(?!\w)"
    rf"|,[ \n\xa0]{PLACE}(?: \d{{5}}(?!\d))?(?: vald\b)?|,[ \n\xa0]{WORD} (?:vald\b|\d{{5}}(?!\d))"
)
NUMBER = re.compile(r"(?<![\w.,/-])\d{1,4}[A-Za-z]?(?:-\d{1,4}[A-Za-z]?)?(?![\w/]|[.,]\d|-\d)")
STREET_BEFORE = re.compile(
    rf"(?:{WORD}(?:-{WORD})? (?:tn|tänav|tee|pst|puiestee|mnt|maantee)|(?:{'|'.join(STREETS)})(?: (?:tn|tee|pst|mnt))?"
    rf"|(?<!\w)[{UPPER}][{LOWER}-]*(?:straße|strasse|str\.|gasse|weg|allee|ufer|platz|damm|ring|graben|steig)|(?:{WORD} ){{1,2}}(?:Straße|Weg|Allee|Platz|Gasse|Ufer))[ \n\xa0]\Z"
)
NOT_A_STREET = re.compile(r"(?:[Vv]erkäufer|Läufer|Käufer|Hersteller|Anrufer)\s$")
STREET_AFTER = re.compile(rf"[ \n\xa0](?:[{UPPER}][{LOWER}]+(?:'s)?[ \n\xa0]){{1,3}}(?:Road|Street|Lane|Close|Avenue|Terrace|Way|Drive|Square|Row|Court|Crescent|Place|Gardens|Hill)\b")
FLAT = re.compile(r"Flat \d{1,4}[A-Z]?,[ \n\xa0]\Z")


def words_back(text: str, low: int, at: int, n: int) -> int:
    """Where the last n words before a place begin, however long they are, but not before `low`."""
    width = 60
    while True:
        start = max(low, at - width)
        if start == low or len(text[start:at].split()) > n:
            return start
        width *= 4


def addresses(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    upto = 0
    for m in NUMBER.finditer(text):
        if m.start() < upto:
            continue
        start, end = m.span()
        before = STREET_BEFORE.search(text, words_back(text, upto, start, 4), start) if start > 1 and text[start - 1] in " \n\xa0" and (text[start - 2].isalpha() or text[start - 2] == ".") else None
        if before and not NOT_A_STREET.search(text, max(0, start - 20), start):
            start = before.start()
            if text.startswith(("Korteri ", "Der ", "Die ", "The "), start):
                start = text.index(" ", start) + 1
        elif "-" not in m[0] and (after := STREET_AFTER.match(text, end)):
            end = after.end()
            flat = FLAT.search(text, max(upto, start - 14), start)
            start = flat.start() if flat else start
        else:
            continue
        tail = TAIL.match(text, end)
        if tail:
            end = tail.end()
        out.append((start, end))
        upto = end
    return out


# --- names -------------------------------------------------------------------
GENDER = {x.lower(): "f" for x in GIVEN_F} | {x.lower(): "m" for x in GIVEN_M}
GENDER |= {x.lower(): "f" for x in COMMON_F} | {x.lower(): "m" for x in COMMON_M}
SURNAMES = [a + b for a in STEMS for b in ENDINGS]
SURNAME_AUTOMATON = ahocorasick.Automaton()
for _x in SURNAMES:
    SURNAME_AUTOMATON.add_word(_x, len(_x))
SURNAME_AUTOMATON.make_automaton()
_GIVEN = "|".join(sorted(map(str.lower, GIVEN_F + GIVEN_M + COMMON_F + COMMON_M), key=len, reverse=True))
GIVEN_BEFORE = re.compile(rf"(?<![\w-])(?:(?:{_GIVEN})(?:-(?:{_GIVEN}))?(?:[ \n\xa0][a-zõäöü]\.){{0,2}}|[a-zõäöü]\.(?:[ -]?[a-zõäöü]\.)?)[ \n\xa0]\Z")
GIVEN_AFTER = re.compile(rf",[ \n\xa0](?:{_GIVEN})(?:-(?:{_GIVEN}))?(?:[ \n\xa0][a-zõäöü]\.)?(?![\w-])")
LABELLED_NAME = re.compile(
    rf"(?:My name is|Signed:|Contact:|Debtor:|Lisainfo:|Avaldaja|Ansprechpartner:|Mein Name ist|Minu nimi on) "
    rf"(?:(?:Mr|Mrs|Ms|Dr|Judge|Herr|Frau|Pr|Hr)\.? )?((?:{WORD}(?:-{WORD})?|[{UPPER}]\.)(?: [{UPPER}]\.)? {WORD}(?:-{WORD})?)(?=[,;\n.(]| and | on )"
)
NOT_NAMES = frozenset("The A An Our Your This Flat Notes Die Der Das Ein Eine See Mr Mrs Ms Miss Dr Prof Judge Herr Herrn Frau Hr Pr".split())


def names(text: str, beside: Sequence[int] = ()) -> list[tuple[int, int]]:
    low = lowered(text)
    out: list[tuple[int, int]] = []
    size = len(low)
    for last, length in SURNAME_AUTOMATON.iter_long(low):
        start, end = last - length + 1, last + 1
        if start and (low[start - 1].isalnum() or low[start - 1] in "_@-."):
            if not (low[start - 1] == "-" and start > 1 and low[start - 2].isalpha()):
                continue
        if end < size and (low[end].isalnum() or low[end] in "_@" or low[end] == "-" and low[end + 1 : end + 2].isalnum()):
            continue
        if FIRM.match(text, end) and not FIRM.match(text, end)[0].isspace():
            continue
        if STREET_SUFFIX.match(low, end):
            continue
        before = GIVEN_BEFORE.search(low, max(0, start - 40), start)
        if before:
            start = before.start()
        else:
            after = GIVEN_AFTER.match(low, end)
            if after and not re.match(r" (?:\d|tee\b|tn\b|pst\b)", text[after.end() : after.end() + 6]):
                end = after.end()
            if text[start:end].islower() and not after:
                # A lone surname in small letters is a name only under a title.
                if not re.search(r"(?:mr|ms|mrs|dr|judge|herr|frau|pr|hr)\.? \Z", low[max(0, start - 8) : start]):
                    continue
        if BEFORE_NOT_A_PERSON.search(text, max(0, start - 8), start) or VESSEL_NUMBER.match(text, end):
            continue
        if out and out[-1][1] > start:
            start = out[-1][1]
            continue
        out.append((start, end))
    taken = Spans(out)
    for m in LABELLED_NAME.finditer(text):
        s, e = m.span(1)
        if m[1].split()[0].rstrip(".") in NOT_NAMES or not taken.free(s, e) or FIRM.match(text, e):
            continue
        out.append((s, e))
        taken.add(s, e)
    return out + unlisted_names(text, low, out, beside)


# Names that no list has: after a title, after initials, after a listed given name; then these names again.
SURNAME = rf"(?:(?:von|van|zu|de|der|den|ter|da|di|du|la|le|af|av)[ \xa0])*(?:(?:Mc|Mac|O'|D')?{WORD}|[{UPPER}]{{2,}})(?:-(?:{WORD}|[{UPPER}]{{2,}}))?"
INITIAL = rf"[{UPPER}]\.(?:[ \n\xa0-]?[{UPPER}]\.)*"
TITLED_NAME = re.compile(rf"(?<![\w-])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Judge|Herrn?|Frau|Hr|Pr|Härra|Proua)\.?[ \n\xa0]((?:{INITIAL}[ \n\xa0]?)?{SURNAME}(?:[ \n\xa0]{INITIAL})?(?:[ \xa0]{SURNAME})?)(?!\w)")
INITIALED_NAME = re.compile(rf"(?<![\w.@-])({INITIAL}[ \n\xa0]?{SURNAME})(?!\w)")
GIVEN_NAME = "|".join(sorted((x for g in GIVEN_F + GIVEN_M + COMMON_F + COMMON_M for x in (g, g.upper())), key=len, reverse=True))
GIVEN_CONTEXT = re.compile(rf"(?<![\w-])((?:{GIVEN_NAME})(?:-(?:{GIVEN_NAME}))?(?:[ \n\xa0]{INITIAL})?[ \n\xa0]{SURNAME})(?!\w)")
REVERSED_NAME = re.compile(rf"(?<![\w.@-])({WORD}(?:-{WORD})?,[ \n\xa0](?:{GIVEN_NAME})(?:-(?:{GIVEN_NAME}))?)(?![\w-]|[ \n\xa0][{UPPER}])")
NO_SURNAMES = NOT_NAMES | frozenset(
    "And But By For From He Her His If In It Its No Not Of On Or She So Then There May Shall Must Will Can Should Would Is Are Was Were Has Have Had Be Been Do Does Reply They To We When With You Section Article Annex Part Chapter Court Road Street Lane Avenue "
    "Er Sie Es Wir Und Aber Im Am Auf Bei Von Zu Für Mit Ja Ei Ja Kui See Ta Nad Me Aga Siis".split()
)


# Names told by what stands beside them, whatever they are: a person's role before, a verb of saying or doing after, or a person's number or address.
CAPITAL = rf"(?:{WORD}(?:-{WORD})?|[{UPPER}]{{2,}}(?:-[{UPPER}]{{2,}})?)"
FULL_NAME = rf"(?:{CAPITAL}[ \n\xa0](?:{INITIAL}[ \n\xa0])?{SURNAME}|{SURNAME},[ \n\xa0]{CAPITAL}|{INITIAL}[ \n\xa0]?{SURNAME})"
ROLES = (
    "witness|applicant|claimant|plaintiff|defendant|debtor|creditor|tenant|landlord|buyer|seller|owner|heir|guardian|signed by|copy to|reply to|sent to|"
    "given by|granted by|represented by|submitted by|on behalf of|according to|my name is|dear|at the hearing|"
    "zeuge|zeugin|kläger|klägerin|antragsteller|antragstellerin|schuldner|gläubiger|mieter|mieterin|vermieter|käufer|verkäufer|mein name ist|ging an|durch|"
    "tunnistaja|avaldaja|hageja|kostja|võlgnik|üürnik|ostja|müüja|minu nimi on|заявитель|свидетель|истец|ответчик|меня зовут"
).split("|")
#: Words that lead to a name only with a colon.
ROLE_LABELS = "author:|signed:|contact:|contact person:|attention:|attn:|unterzeichnet:|ansprechpartner:|lisainfo:|allkiri:|kontakt:|подпись:".split("|")
VERBS = (
    "wrote|said|says|told|spoke|stated|argued|confirmed|testified|replied|moved from|lives|vaidles|kinnitas|ütles|kirjutas|sagte|schrieb|erklärte|bestätigte|сказал|сказала|написал|написала"
).split("|")
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Judge|Herrn?|Frau|Hr|Pr)\.?"
AFTER_ROLE = re.compile(rf":?[ \n\xa0](?:{TITLE}[ \n\xa0])?({FULL_NAME})(?![\w-])")
SURNAME_BEFORE = re.compile(rf"(?<![\w.@-])({WORD}(?:-{WORD})?),[ \n\xa0]\Z")
BEFORE_VERB = re.compile(rf"(?<![\w@.-])({FULL_NAME})[ \n\xa0]\Z")
JOINED_NAME = re.compile(rf",?[ \n\xa0](?:and|to|und|ja|an|v|vs\.|gegen|versus)[ \n\xa0](?:{TITLE}[ \n\xa0])?({FULL_NAME})(?![\w-])")
VERSUS_NAME = re.compile(rf"(?<=\) v )(?:{TITLE}[ \n\xa0])?({FULL_NAME})(?![\w-])")
BESIDE_NAME = re.compile(
    rf"(?<![\w@.-])({FULL_NAME})[,;]?[ \n\xa0]?(?:[(/][ ]?)?(?:(?:(?i:tel|telefon|phone|mobile|personal code|isikukood|id|e-?mail|mailto|living at|residing at|wohnhaft|elukoht|elukohaga|at))[.:]?[ \n\xa0]?)?\Z"
)
BY_CONTEXT = (AFTER_ROLE, BEFORE_VERB, VERSUS_NAME, BESIDE_NAME)
# Given names, roles and verbs are looked for at once; the rules then start only where one stands.
CUES = ahocorasick.Automaton()
TITLES = "mr mrs ms miss dr prof judge herr herrn frau hr pr härra proua".split()
for _kind, _words in (("given", [*GENDER]), ("role", ROLES + ROLE_LABELS), ("verb", VERBS), ("title", TITLES)):
    for _x in _words:
        CUES.add_word(_x, (len(_x), _kind))
CUES.make_automaton()


def cued(text: str, low: str) -> Iterator[tuple[re.Pattern, re.Match | None]]:
    """Matches of the rules that begin at a given name, after a role, or end before a verb."""
    for last, (length, kind) in CUES.iter_long(low):
        start, end = last - length + 1, last + 1
        if start and (low[start - 1].isalnum() or low[start - 1] in "_-") or end < len(low) and (low[end].isalnum() or low[end] == "_"):
            continue
        if kind == "given":
            if text[start].isupper():
                yield GIVEN_CONTEXT, GIVEN_CONTEXT.match(text, start)
                if start > 1 and text[start - 2] == "," and (m := SURNAME_BEFORE.search(text, words_back(text, 0, start, 2), start)):
                    yield REVERSED_NAME, REVERSED_NAME.match(text, m.start(1))
        elif kind == "title":
            yield TITLED_NAME, TITLED_NAME.match(text, start)
        elif kind == "role":
            yield AFTER_ROLE, AFTER_ROLE.match(text, end)
        elif start and text[start - 1] in " \n\xa0":
            word = max(text.rfind(c, max(0, start - 400), start - 1) for c in " \n\xa0") + 1
            if text[word].isupper() or text[word : word + 1] in "OD":
                yield BEFORE_VERB, BEFORE_VERB.search(text, words_back(text, 0, start, 5), start)



# The commonest Chinese surnames, and what follows or leads a Chinese name.
HAN_SURNAME = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_NAME = re.compile(
    rf"(?<![一-鿿])([{HAN_SURNAME}][一-鿿]{{1,2}})(?=先生|女士|小姐|教授|博士|老师|律师|法官|医生|经理)|(?:姓名|联系人|申请人|证人|被告|原告|签名|我叫|我是)[:：]?\s?([{HAN_SURNAME}][一-鿿]{{1,2}})(?![一-鿿])"
)
# Russian names by their shape: a patronymic, or two capitalised words of which the last has an ending of surnames.
RUSSIAN_NAME = re.compile(
    r"(?<![\w-])([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:ович|евич|ьич|овна|евна|ична)(?: [А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)?|[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?<=[а-яё])(?:ов|ова|ев|ева|ин|ина|ский|ская|енко|чук|ян|дзе)(?:а|у|ым|ой)?)(?![\w-])"
)


def unlisted_names(text: str, low: str, found: list[tuple[int, int]], beside: Sequence[int] = ()) -> list[tuple[int, int]]:
    """Names that no list holds, beside those found; `beside` has where other personal data begin."""
    out: list[tuple[int, int]] = []
    taken = Spans(found)

    def person(s: int, e: int) -> bool:
        if not taken.free(s, e):
            return False
        if FIRM.match(text, e) or STREET_SUFFIX.match(low, e) or VESSEL_NUMBER.match(text, e) or BEFORE_NOT_A_PERSON.search(text, max(0, s - 8), s):
            return False
        parts = text[s:e].split()
        return not any(x.strip(",.") in NO_SURNAMES for x in parts if len(x) > 2 or x[-1] != ".") and not (len(parts) > 1 and FIRM.match(text, s + len(parts[0])))

    scripts = []
    if not text.isascii():
        scripts = [x for x, letters in ((RUSSIAN_NAME, CYRILLIC), (HAN_NAME, HAN)) if letters.search(text)]
    begun: dict[re.Pattern, list[re.Match]] = {TITLED_NAME: [], GIVEN_CONTEXT: [], AFTER_ROLE: [], BEFORE_VERB: [], REVERSED_NAME: []}
    for rule, m in cued(text, low):
        if m:
            begun[rule].append(m)
    near = (m for at in beside if (m := BESIDE_NAME.search(text, words_back(text, 0, at, 6), at)))
    ordered = [(x, begun[x]) for x in (GIVEN_CONTEXT, AFTER_ROLE, BEFORE_VERB)] + [(BESIDE_NAME, near)]
    scanned = lambda rules: [(x, x.finditer(text)) for x in rules]
    for rule, matches in [(TITLED_NAME, begun[TITLED_NAME])] + scanned(scripts) + ordered + scanned([INITIALED_NAME]) + [(REVERSED_NAME, begun[REVERSED_NAME])] + scanned([VERSUS_NAME]):
        for m in matches:
            s, e = m.span(m.lastindex)
            if rule is TITLED_NAME and not person(s, e) and " " in m[1]:
                e = s + m[1].rindex(" ")  # the second word may be no part of the name
            if rule in BY_CONTEXT and (text[s:e].isupper() and text[max(0, s - 12) : s].isupper() or "\n" in text[s:e]):
                continue  # among capitals, and over a line end, two words are no name yet
            if person(s, e):
                out.append((s, e))
                taken.add(s, e)
    for _, end in sorted([*found, *out]):  # a person named with one found
        m = JOINED_NAME.match(text, end)
        while m and person(*m.span(1)) and "\n" not in m[1]:
            out.append(m.span(1))
            taken.add(*m.span(1))
            m = JOINED_NAME.match(text, m.end())
    # The same persons again, by their full name or surname alone, also without a title.
    forms = {text[s:e] for s, e in out}
    forms |= {x for form in forms if len(x := form.split(",")[0].split()[-1]) > 2 and x[0].isupper()}
    if forms:
        again = re.compile(rf"(?<![\w@.-])(?:{'|'.join(sorted(map(re.escape, forms), key=len, reverse=True))})(?![\w@]|-\w)", re.I)
        for m in again.finditer(text):
            if m[0][0].isupper() and person(*m.span()):
                out.append(m.span())
                taken.add(*m.span())
    return out


CYRILLIC, HAN = re.compile("[А-я]"), re.compile("[一-鿿]")
STREET_SUFFIX = re.compile(r" (?:tee|tn|pst|mnt|street|road|lane|straße)\b")
FINDERS = (("email", emails), ("id_number", id_numbers), ("phone", phones), ("address", addresses), ("name", names))


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of each mention, in order; ends are exclusive."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps
    for kind, find in FINDERS:
        found = find(text, [x[0] for x in taken]) if kind == "name" else find(text)
        for s, e in found:
            at = bisect_right(taken, (s, len(text) + 1, ""))
            if (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
                taken.insert(at, (s, e, kind))
    return taken


# --- rewriting ---------------------------------------------------------------
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def with_placeholders(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for s, e, kind in found:
        parts += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*parts, text[at:]])


DIGITS = "0123456789"
#: Letters are replaced by letters of the same of these kinds; ß and ÿ have no capital of their length.
KINDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "õäöü", "àáâãåæèéêëìíîïòóôøùúûý", "çðñþšž", "ß", "ÿ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", DIGITS)
KIND_OF = {c: kind for kind in KINDS for c in kind}
SPELT_DOT = re.compile(r"\s?(?:\[dot\]|\(dot\)|\{dot\})\s?")
GERMAN_STREET = re.compile(r"(?<=.)(?:straße|strasse|str|gasse|weg|allee|ufer|platz|damm|ring|graben|steig)\Z")
KIND_OF_STREET = re.compile(
    r"tn|tänav|tee|pst|puiestee|mnt|maantee|vald|Straße|Weg|Allee|Platz|Gasse|Ufer|Road|Street|Lane|Close|Avenue|Terrace|Way|Drive|Square|Row|Court|Crescent|Place|Gardens|Hill"
)
ADDRESS_PART = re.compile(r"(?P<word>[^\W\d_]{2,})|(?P<number>\d+)(?P<unit>[A-Za-z](?![^\W\d_]))?")


@lru_cache(4096)
def alphabet_of(c: str) -> str:
    """The letters that may stand for a letter: those of its kind, or of its script's neighbourhood; another character stays."""
    if c in KIND_OF or not c.isalnum():
        return KIND_OF.get(c, c)
    near = map(chr, range(ord(c) // 32 * 32, ord(c) // 32 * 32 + 32))
    return "".join(x for x in near if x.isalnum() and x not in KIND_OF and (x.isalpha(), x.islower(), x.isupper()) == (c.isalpha(), c.islower(), c.isupper()))


LATIN_F, CYRILLIC_F = [x for x in COMMON_F if x.isascii() or not CYRILLIC.search(x)], [x for x in COMMON_F if CYRILLIC.search(x)]
LATIN_M, CYRILLIC_M = [x for x in COMMON_M if x.isascii() or not CYRILLIC.search(x)], [x for x in COMMON_M if CYRILLIC.search(x)]
NAME_POOLS = ("f", "m", "f-cyrillic", "m-cyrillic", "surname")


class Surrogates:
    """Keyed, deterministic replacements; one object serves all texts under one key."""

    def __init__(self, key: str):
        self.key = key.encode()
        pools = {"f": [*GIVEN_F, *LATIN_F], "m": [*GIVEN_M, *LATIN_M], "f-cyrillic": CYRILLIC_F, "m-cyrillic": CYRILLIC_M, "surname": SURNAMES, "street": STREETS, "place": PLACES}
        self.pools = {salt: self.shuffled(sorted(x.lower() for x in pool), salt) for salt, pool in pools.items()}
        self.at = {salt: {x: k for k, x in enumerate(pool)} for salt, pool in self.pools.items()}
        self.orders: dict[tuple[str, str], list[str]] = {}
        self.word = lru_cache(1 << 16)(self.word)

    def number(self, *parts: str) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), key=self.key[:64], digest_size=8).digest(), "big")

    def shuffled(self, items: Sequence[str], salt: str) -> list[str]:
        return sorted(items, key=lambda x: self.number("order", salt, x))

    def cycled(self, value: str, alphabets: list[str], salt: str) -> str:
        """The next of all strings over these alphabets in one keyed cycle: distinct for distinct strings, and never the string itself.

        Four Feistel rounds on two halves give the keyed order; they are undone, one is added, and they are done again.
        """
        order = [self.order(x, salt) for x in alphabets]
        moving = [k for k, x in enumerate(alphabets) if len(x) > 1]
        if not moving:
            return value
        halves = moving[: len(moving) // 2], moving[len(moving) // 2 :]
        sizes = [prod(len(order[k]) for k in half) for half in halves]
        x = [0, 0]
        for side, half in enumerate(halves):
            for k in half:
                x[side] = x[side] * len(order[k]) + order[k].index(value[k])
        shape = f"{salt}/{'/'.join(map(str, sizes))}"
        rounds = (0, 1, 0, 1) if halves[0] else ()
        for n in reversed(range(len(rounds))):
            x[rounds[n]] = (x[rounds[n]] - self.number(shape, str(n), str(x[1 - rounds[n]]))) % sizes[rounds[n]]
        carry, x[1] = divmod(x[1] + 1, sizes[1])
        x[0] = (x[0] + carry) % sizes[0]
        for n in range(len(rounds)):
            x[rounds[n]] = (x[rounds[n]] + self.number(shape, str(n), str(x[1 - rounds[n]]))) % sizes[rounds[n]]
        new = list(value)
        for side, half in enumerate(halves):
            for k in reversed(half):
                x[side], i = divmod(x[side], len(order[k]))
                new[k] = order[k][i]
        return "".join(new)

    def order(self, alphabet: str, salt: str) -> list[str]:
        if (alphabet, salt) not in self.orders:
            if len(self.orders) > 10_000:
                self.orders.clear()
            self.orders[alphabet, salt] = self.shuffled(alphabet, salt)
        return self.orders[alphabet, salt]

    def digits(self, value: str, salt: str, lead: bool = False) -> str:
        """A keyed permutation of all digit strings of one length; with `lead`, of those that start with 0 and of the others."""
        new = value
        while value:
            new = self.cycled(new, [DIGITS] * len(new), salt)
            if not lead or len(value) == 1 and new != "0" or len(value) > 1 and (new[0] == "0") == (value[0] == "0"):
                break
        return new

    def same_format(self, value: str, salt: str, keep: int = 0) -> str:
        """Other digits in the same places; the first `keep` digits and everything else as they are."""
        figures = [c for c in value if c.isdigit()]
        new = iter(figures[:keep] + list(self.digits("".join(figures[keep:]), salt)))
        return "".join(next(new) if c.isdigit() else c for c in value)

    def letters(self, low: str, salt: str) -> str:
        """Other letters and digits of the same kinds in the same places; distinct for distinct values."""
        return self.cycled(low, [alphabet_of(c) for c in low], salt)

    @staticmethod
    def cased(new: str, like: str) -> str:
        if len(new) != len(like):
            return new.upper() if like.isupper() and len(like) > 1 else new.lower() if like.islower() else new[:1].upper() + new[1:].lower()
        return "".join(x.upper() if c.isupper() and len(x.upper()) == 1 else x for x, c in zip(new, like))

    def word(self, low: str, pools: tuple[str, ...], salt: str) -> str:
        """A word of a list becomes the next one of its list in keyed order; any other word other letters, and no word of a list."""
        for pool in pools:
            if (k := self.at[pool].get(low)) is not None:
                return self.pools[pool][(k + 1) % len(self.pools[pool])]
        new = self.letters(low, salt)
        while any(new in self.at[pool] for pool in pools):
            new = self.letters(new, salt)
        return new

    def part(self, word: str, step: int = 0) -> str:
        new = self.word(lowered(word), NAME_POOLS, "name")
        for _ in range(step):
            new = self.word(new, NAME_POOLS, "name")
        low = word.lower()
        if any(low in self.at[pool] for pool in NAME_POOLS) and not word.isupper() and not word.islower():
            return new[:1].upper() + new[1:]
        return new.upper() if word.isupper() and len(word) > 1 else self.cased(new, word)

    def email(self, value: str) -> str:
        """Keyed by the whole address, however it is spelt; one domain stays one domain, under .example."""
        mark = AT.search(value)
        local, domain = lowered(value[: mark.start()]), lowered(value[mark.end() :])
        dot = SPELT_DOT.search(domain)
        domain = SPELT_DOT.sub(".", domain)
        new = f"{self.letters(domain, 'domain')}.example"
        return self.letters(local, f"email/{domain}") + mark[0] + (new.replace(".", dot[0]) if dot else new)

    def address(self, value: str) -> str:
        """Every street, place and number; the words for kinds of streets, parishes and flats stay."""

        def one(m: re.Match) -> str:
            if m["number"]:
                return self.digits(m["number"], "number", lead=True) + (self.cased(self.letters(m["unit"].lower(), "unit"), m["unit"]) if m["unit"] else "")
            word, after = m["word"], value[m.end() : m.end() + 2]
            if KIND_OF_STREET.fullmatch(word) and (word.islower() or m.start() and value[m.start() - 1] in " \n\xa0" and value[m.start() - 2].isalpha() and not (after[:1] in ("-", " ", "\xa0") and after[1:].isupper())):
                return word
            if word == "Flat" and not m.start() and after[1:].isdigit():
                return word
            kept = ""
            if not m.start(1) and (end := GERMAN_STREET.search(word)) and (after[:1] == "." or after[1:].isdigit()):
                word, kept = word[: end.start()], word[end.start() :]
            new = self.word(lowered(word), ("street", "place"), "address")
            return (new[:1].upper() + new[1:] if not word.isupper() and len(new) != len(word) else self.cased(new, word)) + kept

        return ADDRESS_PART.sub(one, value)

    def replace(self, kind: str, value: str) -> str:
        if kind == "name":
            return re.sub(r"[^\W\d_]+(?!\.)", lambda m: self.part(m[0]) if len(m[0]) > 1 else m[0], value)
        if kind == "email":
            return self.email(value)
        if kind == "phone":
            return self.same_format(value, kind, keep=max(0, sum(c.isdigit() for c in value) - 7))
        if kind == "id_number":
            return self.same_format(value, kind, keep=0 if value[0].isalpha() else 1)
        return self.address(value)

    def rewrite(self, text: str | None, found: list[tuple[int, int, str]]) -> str | None:
        if not found:
            return text
        parts, at = [], 0
        for s, e, kind in found:
            parts += [text[at:s], self.replace(kind, text[s:e])]
            at = e
        return "".join([*parts, text[at:]])


def find_mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, start_pos, end_pos) of each mention; positions in code points, ends exclusive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, kind, s, e) for k, t in zip(pdf["key"], pdf["text"]) for s, e, kind in mentions(t)]
            yield pd.DataFrame(rows, columns=["key", "pii_type", "start_pos", "end_pos"])

    kind = dict(documents.dtypes)[key]
    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    return out.mapInPandas(run, f"key {kind}, pii_type string, start_pos int, end_pos int").withColumnRenamed("key", key)


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", secret: str | None = None) -> DataFrame:
    """(key, n_mentions, clean_text): the text with typed placeholders, or with surrogates under `secret`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surrogates = Surrogates(secret) if secret else None
        for pdf in batches:
            found = [mentions(t) for t in pdf["text"]]
            write = surrogates.rewrite if surrogates else with_placeholders
            yield pd.DataFrame({"key": pdf["key"], "n_mentions": [len(x) for x in found], "clean_text": [write(t, x) for t, x in zip(pdf["text"], found)]})

    kind = dict(documents.dtypes)[key]
    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return out.mapInPandas(run, f"key {kind}, n_mentions int, clean_text string").withColumnRenamed("key", key)
