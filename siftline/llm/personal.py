"""Problem 6: personal values in free text, by weak supervision.

Patterns propose spans; four labelers vote on each (+, 0 or -): its form, its check digits, gazetteers (given names,
patronymics, surnames seen beside given names anywhere in the corpus, street words) and the words around it.
Expectation-maximisation over the vote patterns of all spans estimates how reliable each labeler is for each category,
and a logistic span classifier is fitted to the resulting probabilities. Vote patterns are few (at most 81 a category),
so only their counts reach the driver; they are exact over all data.

Values may run over a line end and may be written with full-width or invisible characters. Masked values (with asterisks)
are none. Null and empty texts have no spans; the placeholder text of a null is null. Repeated rows give repeated spans;
extra columns are left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import map_rows

CATEGORIES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
LABELERS = 4
#: Share of all found names from which a surname belongs to the learned gazetteer (so it has at most 1e5 entries).
SURNAME_SHARE = 1e-5

#: Common given names: fixed values, in Russian and Ukrainian, then in English, German and Czech.
GIVEN_CYRILLIC = """
александр алексей анатолий андрей антон аркадий артём богдан борис вадим валентин валерий василий виктор виталий владимир
владислав вячеслав геннадий георгий глеб григорий данила денис дмитрий евгений егор захар иван игорь илья кирилл константин
лев леонид макар максим марк матвей михаил никита николай олег павел пётр платон прохор родион роман руслан савелий семён
сергей станислав степан тарас тимофей тимур фёдор филипп эдуард юрий яков ярослав
агата алёна алина алиса алла анастасия анна антонина валентина валерия варвара вера вероника виктория галина дарья ева
евгения екатерина елена елизавета жанна зинаида зоя инга инна ирина кира клавдия ксения лариса лидия лилия любовь людмила
майя маргарита марина мария марта надежда наталья нина оксана ольга полина раиса римма светлана софья таисия тамара
татьяна ульяна фаина эмма юлия яна
андрій василь віктор володимир дмитро євген іван ігор микола михайло олександр олексій петро сергій юрій ганна ірина
катерина наталія олена тетяна
""".split()
GIVEN_LATIN = """
adam albert alice amanda amy andrew anna anthony arthur barbara benjamin brian carl caroline catherine charles clara conrad
daniel david dennis diana dorothy edith edward eleanor elizabeth ella emily emma eric felix florence frank frederick george
grace hannah harold harry helen henry hugo ivy jack james jane jason jennifer joan john jonathan joseph julia karen kate
kenneth kevin laura lena leonard linda lucas lucy margaret maria mark martha martin mary matthew max mara michael miriam
nancy nicholas nora oliver oscar otto patricia paul peter petra philip rachel ralph raymond rebecca richard robert roger
ruth samuel sarah scott sharon simon sophie stephen susan theodore thomas timothy tobias vera victor victoria vincent
walter william
anke bernd birgit brigitte dieter erika ernst franz fritz gabriele gerhard gisela günter hans heike heinz helga horst ingrid
jens jürgen karin klaus kurt lukas manfred monika petra renate rolf sabine stefan ulrike ursula uwe werner wolfgang
alena david eva hana ivana jakub jan jana jaroslav jiří josef kateřina lenka lucie marek marie miroslav ondřej pavel petr
tomáš václav věra zdeněk
""".split()
_ENDINGS = ("", "а", "у", "ом", "ем", "ём", "е", "я", "ю", "ы", "и", "ой", "ей", "ою", "ью", "ий", "ія", "ія", "ії", "ию", "ии", "ия", "ію", "ієм", "ием", "ь", "й", "о", "ею")


def _stems() -> set[str]:
    out = set()
    for name in GIVEN_CYRILLIC:
        stem = re.sub("(?:ий|ій|ия|ія|ья|а|я|й|ь|о)$", "", name)
        out |= {stem + e for e in _ENDINGS} if len(stem) > 2 else {name, *(stem + e for e in ("а", "у", "ом", "е", "и", "ю", "ой", "ей", "я", "ы"))}
    return out | {"льва", "льву", "львом", "льве", "павла", "павлу", "павлом", "петра", "петру", "петром", "софьи", "софье", "софью", "софьей", "дарьи", "дарье", "дарью", "натальи", "наталье", "наталью", "марьи"}


GIVEN = _stems() | set(GIVEN_CYRILLIC) | set(GIVEN_LATIN)
PATRONYMIC = re.compile(r"\w+(?:ович|евич|ьевич|овна|евна|ична|івн|ївн)(?:а|у|ем|ы|е|ой|ою|і)?$")
SURNAME_C = re.compile(r"\w{2,}(?:[оеёє]в|[иы]н|ьов)(?:а|у|ым|им|ой|е|ою|і|ої|ій)?$|\w{3,}(?:ск|цк)(?:ий|ая|ого|ому|им|ой|ую)$|\w{2,}(?:енко|чук|юк|як|ян|дзе|швили)(?:а|у|ом|ем)?$")
U, L = "A-ZА-ЯЁЇІЄҐÄÖÜÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "a-zа-яёїієґäöüßáčďéěíňóřšťúůýž'’"
W = f"[{U}][{U}{L}-]+"
#: In text set in lines a space may be a line end; a word may also be cut there.
S = r"[ \t]*\n?[ \t]*"
G = r"(?:[ \t]+\n?[ \t]*|\n[ \t]*)"
INITIAL = f"[{U}]\\."
NAME = re.compile(
    rf"(?<![\w.])(?:(?P<full>{W}(?:,?{G}{W}){{1,2}})(?:{G}(?P<tail>{INITIAL}))?|(?P<mid>{W}{G}{INITIAL}{G}{W})|(?P<back>{W},?{G}{INITIAL}(?:{S}{INITIAL})?)|(?P<front>{INITIAL}(?:{S}{INITIAL})?{S}{W}))(?!\w)"
)
NAME_LOW = re.compile(rf"(?<!\w)(?:ФИО|ПІБ|ф\.?\s?и\.?\s?о\.?):?{G}(\w+{G}\w+(?:{G}\w+)?)", re.I)
EMAIL = re.compile(
    rf"(?<![\w.+*-])(?P<user>\w[\w.+-]*?)(?P<at>{S}(?:@|[\[({{<]{S}(?:at|собака|ет|dog|zavináč){S}[\])}}>]){S})(?P<host>\w[\w-]*(?:(?:\.|{S}[\[({{]{S}(?:dot|точка|крапка|punkt|tečka){S}[\])}}]{S})\w[\w-]*)+)", re.I
)
DIGIT_SEP = r"(?:[ \t]?\n?[ .\-–‐/()]{0,3}\n?)"
PHONE = re.compile(
    r"(?<![\w.+*-])(?:(?:\+|00)[1-9]\d{0,2}" + rf"(?:{DIGIT_SEP}\d){{8,11}}" + rf"|[78](?:{DIGIT_SEP}\d){{10}}" + r"|\(\d{3}\)[ \n.-]{1,2}\d{3}[ \n.-]\d{4}|\d{3}([.\- ])\d{3}\1\d{4})(?![\w*]|[-–.]\d)"
)
ID = re.compile(
    r"(?<![\w.+*-])(?:(?P<card>\d{4}([ -]?)\n?\d{4}\2\n?\d{4}\2\n?\d{4}(?:\2\d{1,3})?|\d{4}(?:[ \n]\d{4}){3})|(?P<snils>\d{3}[- \n]?\d{3}[- \n]?\d{3}[- \n]{0,2}\d{2})|(?P<inn>\d{12})"
    rf"|(?P<passport>\d{{2}}[ \n]?\d{{2}}{S}(?:№|номер|серия|N)?{S}\d{{6}})|(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}}))(?![\w*]|-\d)", re.I
)
_TYPE = r"(?:улиц[аыеу]|ул|вулиц[яію]|вул|переул(?:ок|ка|ку)|пер|провулок|пров|проспект[ау]?|пр-т|просп|пр|набережная|наб|шоссе|бульвар|б-р|площадь|пл|проезд|тупик|аллея)"
_STREET = f"[{U}{L}][{U}{L}\\d-]*(?:{G}[{U}][{U}{L}-]+)?"
_HOUSE = rf"(?:{S}(?:дом|д|буд(?:инок)?|влад|корп)\b\.?)?{S}№?{S}\d+\s?(?:[а-я](?![\w])|[-/]\d+)?"
_CITY = rf"(?:\d{{5,6}},{G})?(?:(?:г\.|город|гор\.|м\.|місто|пос\.|с\.|п\.){S})?[{U}][{L}]+(?:-[\w]+)*(?:{G}[{U}][{L}]+)?,{G}"
ADDRESS = re.compile(
    rf"(?P<city>(?<!\w){_CITY})?(?<!\w)(?:{_TYPE}\b\.?{S}{_STREET},?{_HOUSE}|{W}{G}{_TYPE}\b\.?,?{_HOUSE})(?:,?{S}(?:корп(?:ус)?|к|стр|кв(?:артира)?|оф|под)\b\.?{S}\d+){{0,3}}"
    rf"|(?<!\w)(?:(?:flat|apt\.?|unit|suite){G}\d+,{G})?\d+[a-z]?(?:-\d+)?{G}(?:{W}{G}){{1,2}}(?:Lane|Ln|Road|Rd|Street|St|Avenue|Ave|Drive|Dr|Court|Ct|Square|Sq|Way|Close|Hill|Boulevard|Blvd|Place|Row|Terrace)\b\.?"
    rf"|(?<!\w)[{U}][{L}-]*(?:straße|strasse|str\.|weg|allee|platz|gasse){G}\d+[a-z]?(?!\w)"
    rf"|(?<!\w)(?:ulice|ulici|ul\.|náměstí|nám\.|třída|tř\.){G}{W}(?:{G}[{U}{L}]+)?,?{G}\d+(?:/\d+)?", re.I
)
#: What every address (e-mail or postal) holds; an e-mail is matched from the beginning of the word before it on.
EMAIL_SIGN = re.compile(r"@|[\[({<][ \t\n]*(?:at|собака|ет|dog|zavináč)[ \t\n]*[\])}>]", re.I)
STREET_SIGN = re.compile(
    r"(?i:(?<!\w)(?:улиц|ул[.\s]|вул|пер[.\s]|переул|провул|пров(?!\w)|просп|пр-т|набер|наб\.|шосс|бульв|б-р|площ|пл\.|проезд|тупик|аллея))|(?<!\w)(?:ulic|ul\.|nám|třída|tř\.)"
    r"|(?<=\s)(?:Lane|Ln|Road|Rd|Street|St|Avenue|Ave|Drive|Dr|Court|Ct|Square|Sq|Way|Close|Hill|Boulevard|Blvd|Place|Row|Terrace)(?!\w)|(?:straße|strasse|str\.|weg|allee|platz|gasse)(?=\s+\d)"
)
#: What a text with a sign of a street holds: pieces in lower case, pieces as they are, and the short forms.
STREET_LOW = ("улиц", "вул", "переул", "провул", "просп", "пр-т", "набер", "наб.", "шосс", "бульв", "б-р", "площ", "пл.", "проезд", "тупик", "аллея")
STREET_AS_IS = ("ulic", "ul.", "nám", "třída", "tř.", "straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "Lane", "Ln", "Road", "Rd", "Street", "St", "Avenue", "Ave", "Drive", "Dr", "Court", "Ct", "Square", "Sq", "Way", "Close", "Hill", "Boulevard", "Blvd", "Place", "Row", "Terrace")
STREET_SHORT = re.compile(r"(?:ул|пер)[.\s]|пров(?!\w)")


def may_have_street(text: str, low: str) -> bool:
    """Whether STREET_SIGN can match at all; much cheaper than looking for it."""
    return any(x in low for x in STREET_LOW) or (("ул" in low or "пер" in low or "пров" in low) and STREET_SHORT.search(low) is not None) or any(x in text for x in STREET_AS_IS)


#: Words before and behind the sign of a street that its pattern can reach, of any length.
BEFORE, BEHIND = 8, 16
GAP, WORD_END = re.compile(r"\s+"), re.compile(r"[\s.,]")
#: Words before a value that speak for a category, and those that speak for goods, files, devices and organisations.
FOR = {
    "phone": re.compile(r"тел|phone|call|звон|связь|contact|моб|перезвон|получател|recipient|volejte|anruf|rufen|дзвон|зв.?яз", re.I),
    "id_number": re.compile(r"снилс|страхов|инн|паспорт|удостоверен|посвідчен|social security|карт[аыеу]?\b|card|ssn|tax id|passport|снілс|іпн|identity|identif", re.I),
    "name": re.compile(r"фио|фамил|имя|name|заявител|владел|получател|recipient|подпис|signed|ответств|in charge|поруч|согласован|next to|владельц|прізвищ|одержувач|zuständig|unterschr|podeps|příjem|empfänger|ім.?я", re.I),
    "address": re.compile(r"адрес|прожива|достав|получател|recipient|deliver|lives|address|unterlagen|wohn|adres|bydl|doruč|мешка", re.I),
    "email": re.compile(r"адрес|почт|mail|ответ|answer|writ|wrote|копия|copy|duplicate|связь|contact|adres|antwort|odpov", re.I),
}
AGAINST = re.compile(r"парти[ия]|накладн|инвентар|учёта|учета|inventory|lot number|waybill|сборк|build|узел|node|верси|version|артикул|счёт-фактур|серийн|serial|устройств|device|заявке|request|описи|огрн|кпп|партії|накладна|обліку|order|charge|bestand|šarže|položk|inventář|los\b", re.I)
#: Words right before a name, and what may stand between.
LABEL = re.compile(r"(?<!\w)(?:фио|піб|ф\.и\.о\.|заявитель|заявник|владелец|власник|получатель|одержувач|подписал[аи]?|подписано|підписав|ответственн\w+|name|full name|signed by|contact|recipient|applicant|owner|unterschrieben von|empfänger|jméno|podepsal[aiy]?|příjemce)[ \t]*[:–—-]?[ \t]*$", re.I)
#: Words with capitals that stand behind such a word and are part of no name.
NO_NAME = frozenset("the our your this that all any team board office department support group service company der die das unser ihr abteilung gruppe firma oddělení skupina".split())
#: Words that name a record of things although one of them alone could name a personal number.
THINGS = re.compile(r"inventory card|карточк\w+ уч[её]та|картк\w+ обліку", re.I)
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
ODD = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\uff01-\uff5e\u00a0\u2000-\u200a\u202f\u205f\u3000]")
DIGITS = re.compile(r"\d")


#: Letters of two alphabets with one look: fixed values.
_C, _L = "аеорсухіјѕАВЕКМНОРСТХІЈЅУ", "aeopcyxijsABEKMHOPCTXIJSY"
TO_CYRILLIC, TO_LATIN = str.maketrans(_L + "οΟαΑΒΕΗΚΜΡΤΧ", _C + "оОаАВЕНКМРТХ"), str.maketrans(_C + "οΟαΑΒΕΗΚΜΡΤΧ", _L + "oOaABEHKMPTX")
MIXED = re.compile("[Ѐ-ӿ][A-Za-zΑ-ω]|[A-Za-zΑ-ω][Ѐ-ӿ]")
MIXED_WORD = re.compile("[A-Za-zÀ-ɏΑ-ωЀ-ӿ]*(?:[Ѐ-ӿ][A-Za-zΑ-ω]|[A-Za-zΑ-ω][Ѐ-ӿ])[A-Za-zÀ-ɏΑ-ωЀ-ӿ]*")


def _one_alphabet(m: re.Match) -> str:
    """A word of mixed letters in the alphabet of those of its letters that have no look-alike."""
    word = m[0]
    return word.translate(TO_CYRILLIC if any("Ѐ" <= c <= "ӿ" and c not in _C for c in word) else TO_LATIN)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0 and len(set(digits)) > 1


def insurance(digits: str) -> bool:
    """Check digits of a personal insurance number: weights 9 to 1, modulo 101, 100 counts as 0."""
    return sum(int(d) * (9 - k) for k, d in enumerate(digits[:9])) % 101 % 100 == int(digits[9:])


def taxpayer(digits: str) -> bool:
    """Both check digits of a person's 12-digit tax number."""
    a, b = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    return all(sum(w * int(d) for w, d in zip(ws, digits, strict=False)) % 11 % 10 == int(digits[len(ws)]) for ws in (a, b))


def stem(surname: str) -> str:
    """A surname without its ending of case or gender."""
    return re.sub("(?<=[вн])(?:а|у|ым|им|ой|е|ою|і|ої|ій)$", "", surname)


def _parts(value: str) -> list[str]:
    return re.findall(rf"[{U}{L}-]+", value)


def unlisted(full: list[tuple[str, int, int]], fathers: list, text: str) -> tuple[str, str, str, tuple[int, int]] | None:
    """A full name whose given name no list has: known by its patronymic, or by a word right before it that names go with."""
    rest = [w for w in full if w not in fathers]
    low, high = full[0][1], full[-1][2]
    if fathers:
        near = [w for w in rest if abs(full.index(w) - full.index(fathers[0])) <= 2]
        surnames = [w for w in near if SURNAME_C.match(w[0])]
        if len(near) < 2 or not surnames:
            return None
        return "+", "+", stem(surnames[0][0]), (min(near[0][1], fathers[0][1]), max(near[-1][2], fathers[0][2]))
    if len(full) != 2 or "\n" in text[low:high] or not LABEL.search(text[max(0, low - 40) : low]):
        return None
    if full[0][0][0] >= "Ѐ":
        surnames = [w for w in full if SURNAME_C.match(w[0])]
        return ("0", "?", stem(surnames[0][0]), (low, high)) if surnames else None
    # No list speaks for or against it.
    return ("0", "0", stem(full[1][0]), (low, high)) if not any(w[0] in NO_NAME for w in full) else None


def name_votes(m: re.Match, text: str) -> tuple[str, str, str, tuple[int, int]] | None:
    """(form, gazetteer vote, surname, span) of a proposed name; None if it cannot be one."""
    a, b = m.span()
    words = [(x.group().lower(), x.start() + a, x.end() + a) for x in re.finditer(rf"[{U}][{U}{L}-]*", m[0])]
    kind = m.lastgroup if m.lastgroup != "tail" else "full"
    full = [w for w in words if len(w[0]) > 1]
    given = [w for w in full if w[0] in GIVEN]
    fathers = [w for w in full if PATRONYMIC.match(w[0]) and w not in given]
    rest = [w for w in full if w not in given and w not in fathers]
    if kind == "full" and not given:
        return unlisted(full, fathers, text)
    if kind in ("full", "mid"):
        if not given:
            return None
        cyrillic = given[0][0][0] >= "Ѐ"
        at = full.index(given[0])
        # The surname stands beside the given name (or its patronymic); other capitals are the sentence around it.
        near = [w for w in rest if SURNAME_C.match(w[0]) or not cyrillic]
        near = [w for w in near if abs(full.index(w) - at) <= 1 + (kind == "full" and bool(fathers))]
        if not near and len(given) > 1:
            near = [w for w in given[1:]]
        if not near:
            return None
        # Before the given name a comma belongs to "Surname, Given"; after it a comma ends the name.
        best = min(near, key=lambda w: (abs(full.index(w) - at), w[1] < given[0][1]))
        used = [given[0], best, *fathers]
        low, high = min(w[1] for w in used), max(w[2] for w in used)
        if best[1] > given[0][2] and "," in text[given[0][2] : best[1]]:
            return None
        if m.lastgroup == "tail" and high == full[-1][2]:
            high = b
        return "+", "+", stem(best[0]), (low, high)
    surname = rest or full
    if not surname or len(surname[-1][0]) < 3:
        return None
    word = surname[-1][0]
    if "," in m[0] and not SURNAME_C.match(word):
        return None
    if word[0] >= "Ѐ" and not SURNAME_C.match(word):
        return None
    return "0", "?", stem(word), (a, b)


def propose(text: str, hint: str = "") -> Iterator[tuple[str, int, int, str, str]]:
    """(category, start, end, votes, surname) of every span that a pattern proposes; votes: form, check, gazetteer, context.

    A gazetteer vote of ``?`` is settled later by the learned surnames. ``hint`` is what is known of the value besides the text.
    """
    taken: list[tuple[int, int]] = []

    def around(category: str, a: int, b: int) -> str:
        before = text[max(0, a - 60) : a]
        cut = max(before.rfind("."), before.rfind("|"), before.rfind(";"))
        before = before if category in ("name", "phone") and cut < len(before) - 12 else before[cut + 1 :] if cut >= 0 and len(before) - cut > 6 else before
        if category in ("phone", "id_number") and THINGS.search(before[-32:]):
            return "-"
        own = FOR[category].search(before) or category in hint
        other = AGAINST.search(before[-32:]) if category in ("phone", "id_number") else None
        return "-" if other and not FOR[category].search(before[other.start() - 32 if other.start() else 0 :][other.end() :]) else "+" if own else "0"

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def emails() -> Iterator[re.Match]:
        """E-mail addresses, from left to right: each begins with the word that stands before its sign."""
        done = 0
        for x in EMAIL_SIGN.finditer(text):
            if x.start() < done:
                continue
            a = x.start()
            while a > done and text[a - 1] in " \t\n":
                a -= 1
            while a > done and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
                a -= 1
            at = EMAIL.match(text, a)
            if at is not None:
                done = at.end()
                yield at

    def addresses() -> Iterator[re.Match]:
        """Postal addresses around each sign of a street, from left to right."""
        done, gaps = 0, None
        for x in STREET_SIGN.finditer(text):
            if x.start() < done:
                continue
            gaps = gaps if gaps is not None else [m.end() for m in GAP.finditer(text)]
            k = bisect_left(gaps, x.start())
            low = max(done, gaps[k - BEFORE] if k >= BEFORE else 0)
            high = gaps[k + BEHIND] if k + BEHIND < len(gaps) else len(text)
            if not DIGITS.search(text, low, high):
                continue  # every address has a number
            at = ADDRESS.search(text, low, high)
            while at is not None and at.end() <= x.start():
                at = ADDRESS.search(text, at.end(), high)
            if at is not None and at.start() <= x.end():
                done = at.end()
                yield at

    low = text.lower()
    if "@" in text or "[at" in low or "(at" in low or "собака" in low or "zavin" in low or "(ет" in low:
        for m in emails():
            a, b = m.start("user"), m.end("host")
            taken.append((a, b))
            yield "email", a, b, ("+" if m["at"].strip() == "@" else "0") + "0" + ("+" if re.search(r"\w{2,}$", m["host"]) else "-") + around("email", a, b), ""
    if DIGITS.search(text):
        for m in addresses() if may_have_street(text, low) else ():
            a, b = m.span()
            city = m["city"]
            if city and (any(w.lower() in GIVEN or PATRONYMIC.match(w.lower()) for w in _parts(city)) or re.search(r"\b\w\.", city.replace("г.", "").replace("м.", "")) or re.search(rf"{INITIAL}\s?$", text[max(0, a - 4) : a])):
                a = m.end("city")
            while city and a < m.end("city") and (x := re.match(rf"(?!(?:г|гор|город|м|місто|пос|с|п)\b)[{L}]+\s+", text[a : m.end("city")])):
                a += x.end()  # a word of the sentence, not of the city's name
            street = text[a:b]
            if not re.search(rf"[{U}]", street) and not re.search(r"(?i)\b(?:ул|вул|пер|пр)\b", street):
                continue
            if free(a, b):
                taken.append((a, b))
                yield "address", a, b, "+0+" + around("address", a, b), ""
        for m in ID.finditer(text):
            a, b = m.span()
            kind = next(k for k in ("card", "snils", "inn", "passport", "ssn") if m[k])
            digits = "".join(c for c in m[0] if c.isdigit())
            context = around("id_number", a, b)
            if kind == "snils":
                right = insurance(digits)
                if not right and digits == m[0] and digits[0] in "78" and context != "+":
                    continue  # a phone number written together
                check = "+" if right else "-"
                if right and digits == m[0] and digits[0] in "78" and context != "+":
                    continue
            elif kind == "passport":
                # Ten digits in a row are anything; the kind has no check digits, so its words must stand by.
                near = text[max(0, a - 60) : a].lower()
                check, context = "0", "+" if re.search("паспорт|удостоверен|passport|personalausweis|pas\\b|občansk", near) or hint == "passport" else "-"
            elif kind == "ssn":
                check = "0"
            else:
                check = "+" if (luhn(digits) if kind == "card" else taxpayer(digits)) else "-"
            if free(a, b):
                if check != "-" and context != "-":
                    taken.append((a, b))
                yield "id_number", a, b, "+" + check + "0" + context, ""
        for m in PHONE.finditer(text):
            a, b = m.span()
            digits = "".join(c for c in m[0] if c.isdigit())
            if free(a, b) and 10 <= len(digits) <= 14:
                taken.append((a, b))
                strict = m[0][0] in "+(" or len(digits) == 11 or m[0].startswith("00")
                # Digits written together are a phone number only as the national form; other lengths are codes.
                form = "-" if digits == m[0] and len(digits) != 11 else "+" if strict else "0"
                yield "phone", a, b, form + "00" + around("phone", a, b), ""
    if "фио" in low or "ф.и.о" in low or "піб" in low:
        for m in NAME_LOW.finditer(text):
            words = [w.lower() for w in _parts(m[1])]
            if any(w in GIVEN for w in words) and any(SURNAME_C.match(w) and w not in GIVEN for w in words):
                taken.append(m.span())
                surname = next(w for w in words if SURNAME_C.match(w) and w not in GIVEN)
                yield "name", m.start(1), m.end(1), "+0+" + around("name", m.start(), m.end()), stem(surname)
    at = 0
    while (m := NAME.search(text, at)) is not None:
        found = name_votes(m, text)
        if found is None:
            # Go on behind the first word, as a name may begin within the match.
            nxt = WORD_END.search(text, m.start() + 1)
            at = nxt.end() if nxt else m.end()
            continue
        form, gazetteer, surname, (a, b) = found
        at = max(b, m.start() + 1)
        if free(a, b):
            taken.append((a, b))
            yield "name", a, b, form + "0" + gazetteer + ("+" if LABEL.search(text[max(0, a - 40) : a]) else around("name", a, b)), surname


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible and full-width characters, and the place of each of its characters in the original."""
    if MIXED.search(text):  # look-alikes of the other alphabet, letter for letter
        text = MIXED_WORD.sub(_one_alphabet, text)
    if not ODD.search(text):
        return text, None
    kept = [k for k, c in enumerate(text) if not HIDDEN.match(c)]
    made = "".join(text[k] for k in kept).translate(PLAIN)
    return MIXED_WORD.sub(_one_alphabet, made) if MIXED.search(made) else made, [*kept, len(text)]


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and a logistic classifier fitted to its probabilities."""

    def __init__(self, counts: dict[tuple[str, str], int], surnames: set[str]) -> None:
        self.surnames = surnames
        self.reliability: dict[str, np.ndarray] = {}
        soft: dict[tuple[str, str], float] = {}
        for category in CATEGORIES:
            own = [(v, n) for (c, v), n in counts.items() if c == category]
            if own:
                soft |= {(category, v): p for (v, _), p in zip(own, self._em(category, own), strict=True)}
        self.weights = self._fit(soft, counts)

    def _em(self, category: str, own: list[tuple[str, int]]) -> np.ndarray:
        votes = np.array([["-0+".index(x) for x in v] for v, _ in own])
        n = np.array([n for _, n in own], float)
        # Priors say only that a labeler is right more often than wrong; they count as a hundredth of the spans.
        strength = max(4.0, 0.01 * n.sum())
        prior = np.array([[0.5, 0.35, 0.15], [0.1, 0.3, 0.6]]) * strength
        score = (votes - 1).sum(1)
        p = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
        table = np.zeros((LABELERS, 2, 3))
        for _ in range(40):
            share = float(np.clip((p * n).sum() / n.sum(), 0.02, 0.98))
            for k in range(LABELERS):
                for c, w in ((0, 1 - p), (1, p)):
                    table[k, c] = prior[c] + np.bincount(votes[:, k], w * n, 3)
            table /= table.sum(2, keepdims=True)
            ratio = np.log(table[:, 1] / table[:, 0])
            logit = math.log(share / (1 - share)) + sum(ratio[k][votes[:, k]] for k in range(LABELERS))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.reliability[category] = table
        return p

    @staticmethod
    def _features(category: str, votes: str) -> list[float]:
        one = [1.0 if c == category else 0.0 for c in CATEGORIES]
        own = [1.0 if v == x else 0.0 for v in votes for x in "-+"]
        return [*one, *own, *(a * b for a in one for b in own)]

    def _fit(self, soft: dict[tuple[str, str], float], counts: dict[tuple[str, str], int]) -> np.ndarray:
        if not soft:
            return np.zeros(len(self._features(CATEGORIES[0], "0" * LABELERS)))
        x = np.array([self._features(*k) for k in soft])
        y = np.array(list(soft.values()))
        w = np.array([math.sqrt(counts[k]) for k in soft])
        w /= w.sum()
        beta = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (w * (p - y)) + 1e-3 * beta
            hess = (x * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
            beta -= np.linalg.solve(hess, grad)
        return beta

    def settle(self, votes: str, surname: str) -> str:
        return votes.replace("?", "+" if surname in self.surnames else "0" if surname and surname[0] >= "Ѐ" else "-")

    def probability(self, category: str, votes: str) -> float:
        return float(1 / (1 + math.exp(-float(np.clip(np.dot(self._features(category, votes), self.weights), -30, 30)))))

    def accepts(self, category: str, votes: str) -> bool:
        """Check digits must hold where there are any (an exact rule); the classifier decides on the rest."""
        return votes[1] != "-" and self.probability(category, votes) >= 0.5


#: What the category of a finding says of its examples.
HINTS = {"passport_rf": "passport", "identity_document": "id_number", "snils": "id_number", "inn_person": "id_number", "bank_card": "id_number", "fio": "name", "phone": "phone", "email": "email", "address": "address"}


def pieces(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """(rec_table, rec_id, first_line, hint, text): texts of blocks, and each example of the findings as a line of its own."""
    own = blocks.where("text is not null and text <> ''").select(F.lit("text_blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), F.lit(0).cast("long").alias("first_line"), F.lit("").alias("hint"), "text")
    names = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    examples = findings.select(F.lit("findings").alias("rec_table"), F.col("finding_id").alias("rec_id"), F.coalesce(F.try_element_at(names, F.col("category")), F.lit("")).alias("hint"), F.posexplode("examples").alias("k", "text"))
    examples = examples.where("text is not null and text <> ''").select("rec_table", "rec_id", F.col("k").cast("long").alias("first_line"), "hint", "text")
    return own.unionByName(examples)


def _cased(text: str, hint: str) -> str:
    """An example that is known to be a name, with capitals where it has none."""
    made = text.title() if hint == "name" and text.islower() else text
    return made if len(made) == len(text) else text


#: A text of a record, told apart from other texts under its id.
TEXT_KEY = ("rec_table", "rec_id", "first_line", "text_key")


def spans(texts: DataFrame) -> DataFrame:
    """A row for each proposed span: rec_table, rec_id, first_line and text_key of its text, line_no, from_char, to_char, category, votes, surname."""

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for table, key, line, text_key, hint, text in rows:
                body, places = plain(_cased(text, hint))
                for category, a, b, votes, surname in propose(body, hint):
                    x, y = (a, b) if places is None else (places[a], places[b - 1] + 1)
                    yield table, key, line, text_key, line + (body.count("\n", 0, a) if table == "text_blocks" else 0), x, y, category, votes, surname

        return step

    text, number = pa.string(), pa.int64()
    return map_rows(
        texts.select("rec_table", "rec_id", "first_line", F.xxhash64("text").alias("text_key"), "hint", "text"), make,
        "rec_table string, rec_id bigint, first_line bigint, text_key bigint, line_no bigint, from_char bigint, to_char bigint, category string, votes string, surname string",
        [("rec_table", text), ("rec_id", number), ("first_line", number), ("text_key", number), ("line_no", number), ("from_char", number), ("to_char", number), ("category", text), ("votes", text), ("surname", text)],
    )


def fit(found: DataFrame) -> SpanModel:
    """The span model from all proposed spans: counts of surnames and of vote patterns are exact, both bounded."""
    full = found.where("category = 'name' and votes like '__+_' and surname <> ''")
    counted = full.groupBy("surname").agg(F.count("*").alias("n"))
    total = full.count()
    known = counted.where(F.col("n") >= max(1, SURNAME_SHARE * total)).select("surname", F.lit(True).alias("known"))  # at most 1 / SURNAME_SHARE
    surnames = {r.surname for r in known.collect()}
    open_votes = F.col("votes").contains("?")
    judged = found.join(F.broadcast(known), "surname", "left")
    patterns = judged.groupBy("category", "votes", F.when(open_votes, F.coalesce("known", F.lit(False))).alias("known"), F.when(open_votes, F.substring("surname", 1, 1) >= "Ѐ").alias("cyrillic"))
    counts: dict[tuple[str, str], int] = defaultdict(int)
    for r in patterns.agg(F.count("*").alias("n")).collect():
        counts[r.category, r.votes.replace("?", "+" if r.known else "0" if r.cyrillic else "-")] += r.n
    return SpanModel(dict(counts), surnames)


def accepted(found: DataFrame, model: SpanModel) -> DataFrame:
    """The spans that the model takes for personal values, without votes and surname."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        held = sent.value
        known: dict[tuple[str, str], bool] = {}

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for *own, category, votes, surname in rows:
                pattern = category, held.settle(votes, surname)
                if pattern not in known:
                    known[pattern] = held.accepts(*pattern)
                if known[pattern]:
                    yield *own, category

        return step

    text, number = pa.string(), pa.int64()
    chosen = found.select(*TEXT_KEY, "line_no", "from_char", "to_char", "category", "votes", "surname")
    return map_rows(
        chosen, make, "rec_table string, rec_id bigint, first_line bigint, text_key bigint, line_no bigint, from_char bigint, to_char bigint, category string",
        [("rec_table", text), ("rec_id", number), ("first_line", number), ("text_key", number), ("line_no", number), ("from_char", number), ("to_char", number), ("category", text)],
    )


def redact(texts: DataFrame, found: DataFrame, model: SpanModel) -> DataFrame:
    """(rec_table, rec_id, first_line, clean_text): the texts with typed placeholders, all else unchanged; repeated deliveries once.

    The spans found before are cut out; a text meets its own spans only.
    """
    cuts = accepted(found, model).groupBy(*TEXT_KEY).agg(F.collect_set(F.struct("from_char", "to_char", "category")).alias("cuts"))
    once = texts.select("rec_table", "rec_id", "first_line", F.xxhash64("text").alias("text_key"), "text").dropDuplicates(list(TEXT_KEY))

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for table, key, line, text, own in rows:
                out, done = [], 0
                for cut in sorted(own or (), key=lambda c: (c["from_char"], -c["to_char"])):
                    if cut["from_char"] >= done:
                        out += [text[done : cut["from_char"]], PLACEHOLDERS[cut["category"]]]
                        done = cut["to_char"]
                yield table, key, line, "".join([*out, text[done:]])

        return step

    text, number = pa.string(), pa.int64()
    joined = once.join(cuts.hint("shuffle_merge"), list(TEXT_KEY), "left").select("rec_table", "rec_id", "first_line", "text", "cuts")
    return map_rows(joined, make, "rec_table string, rec_id bigint, first_line bigint, clean_text string", [("rec_table", text), ("rec_id", number), ("first_line", number), ("clean_text", text)])
