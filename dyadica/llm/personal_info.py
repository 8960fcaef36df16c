"""Personal information inside free text: proposed by patterns, confirmed by checks and context.

Every pattern proposes spans with a starting score. Checksums (Luhn for card numbers, mod 97
for bank accounts) and words close by raise or lower it; spans at or above the threshold
count. Where spans overlap, the higher score wins, then the longer span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
THRESHOLD = 0.5

# Common given names of several languages, as they start a full name.
GIVEN = """
Adam Agnes Ahmed Aisha Albert Alexander Alice Amir Ana Andrea Anna Anouk Antonio Arthur Astrid Aylin Beatriz Ben
Bram Camille Carla Carlos Célia Charlotte Chen Clara Daniel Dario David Diego Elena Elin Emil Emily Emma Erik
Esmé Eva Farid Fatima Felix Filip Frida George Giulia Greta Hannah Hans Harriet Hassan Håkon Helena Henry Hugo
Ibrahim Ida Imani Ines Ingrid Irina Isabel Ivan Jack James Jan Jane Javier Joanna John Jonas Jorun José Julia
Jürgen Karin Kaspar Keiko Kenji Klara Lars Laura Layla Lena Leo Leopold Li Lina Livia Luca Lucas Lucía Luis
Magnus Marco Maren María Marie Marta Martin Mary Mateo Max Maya Mei Michael Mila Milo Mirela Mohammed Nadia
Nina Noah Noé Nora Odette Olga Oliver Olivia Olu Omar Oskar Pablo Paul Pedro Peter Petra Pierre Priya Quinn
Rafa Raj Robert Rosa Ruben Samir Sara Sarah Sofia Sophie Stefan Sven Talia Tariq Thomas Tobias Ulla Uma Viggo
Viktor Wanda Wei William Ximena Yara Yuki Yusuf Zora
""".split()

# Capitalised words that start sentences or name things, not people.
ORDINARY = """
A About After All Also Am An And Any Are As Ask At Be Because Been Before Being Best Both But By Call Can Come
Could Dear Did Do Does Everybody Everyone Flight For From Give Good Had Has Have He Hello Her Here Hi His How I If
In Is It Its Just Keep Lake Last Let Like Many Maybe Me Most My Neither Never Next No Nobody Not Nothing Now Of
On Once One Only Or Other Our Part Passport People Perhaps Please Reach Regards Room Seat Set She Should Since
So Some Somebody Someone Sorry Table Take Tell Thank Thanks That The Their Then There These They This Thoughts
Those Ticket To Today Try Under Version Was We Were What When Where Which While Who Why Will With Work Would Yes
Afterwards Again Although Eventually Finally However Instead Later Meanwhile Often Soon Sometimes Still Suddenly Though Unless
Until Usually Yesterday You Your Monday Tuesday Wednesday Thursday Friday Saturday Sunday
""".split()

# Words of firms, and of places, that make a capitalised pair no person.
FIRM = r"(?:Bakery|Ltd|Limited|Inc|LLC|LLP|GmbH|AG|Corp|Co|Sons|Partners|Bank|Group|Holdings|Caf[eé]|Restaurant|Hotel|Shop|Store|Press|Books|Motors|Foundation|University|School|College|Hospital)"
BODY = rf"(?:{FIRM}|Nations|Union|States|Kingdom|Republic|Council|Committee|Commission|Party|Church|Court|Association|Society|Club|Team|Police|Army|Department|Ministry|Office|Museum|Library|Airport|Station|Airlines?|Street|Road|Park|Bridge|Tower|Palace|Cup|League|Festival|Day|Eve|Week|Year)"
PLACE = r"(?:Lake|Mount|Mt|Saint|St|Port|Fort|Cape|River|Isle|Bay|Castle)"

TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Dame|Herr|Frau|Monsieur|Madame|Señora?|Signora?)"
PARTICLE = r"(?:van der|van den|van|von|de la|de|da|di|del|bin|al|ter|le|la)"
CAP = r"(?:\p{Lu}[\p{Ll}’']+(?:\p{Lu}\p{Ll}+)?|\p{Lu}{2,})"
WORD = rf"{CAP}(?:-{CAP})?"
LAST = rf"(?!(?i:(?:{'|'.join(map(str, ORDINARY))})\b)){WORD}"
FIRST = rf"(?:{'|'.join(sorted({*GIVEN, *(g.upper() for g in GIVEN)}, key=len, reverse=True))})"
INITIAL = r"\p{Lu}\."
# Words that a single letter follows.
LETTERED = r"(?i:plan|vitamin|option|part|section|appendix|grade|class|hepatitis|team|group|type|point|step|exhibit|item|unit|page|row|model|size|answer|question|and|or)"
NAMES = [
    # (pattern, score): full names, whose first part is known
    (re.compile(rf"\b{FIRST}(?:-{FIRST})?(?: (?:{INITIAL}|{FIRST}))* (?:(?i:{PARTICLE}) )?{LAST}\b"), 0.7),
    (re.compile(rf"\b{FIRST} {INITIAL}(?! ?\p{{Lu}}\.)(?!\w)"), 0.6),
    (re.compile(rf"\b{LAST}, {FIRST}(?: {INITIAL})?(?![\w-])"), 0.65),
    # titles
    (re.compile(rf"\b{TITLE}\.? (?:(?:{INITIAL}|{LAST}) ){{0,2}}(?:{PARTICLE} )?{LAST}(?! \p{{Lu}}\p{{Ll}}+ (?:{FIRM}))"), 0.7),
    # initials: inside a sentence they speak for themselves, at its start they need context
    (re.compile(rf"(?<=\p{{Ll}},? )(?<!\b{LETTERED} )(?:{INITIAL} ?)+(?:{PARTICLE} )?{LAST}\b"), 0.5),
    (re.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{INITIAL} ?)+(?:{PARTICLE} )?{LAST}\b"), 0.3),
    # two or more capitalised words; context has to speak for them
    (re.compile(rf"\b{LAST}(?: {INITIAL})?(?: (?:{PARTICLE} )?{LAST}){{1,2}}\b"), 0.15),
    (re.compile(rf"\b{LAST}\b"), 0.05),
]
# What people are introduced with, and what they do; both speak for a name.
NAME_BEFORE = re.compile(
    r"(?i:\bmy name is|\bname’?s?:?|\bnames:|\bthis is|\bsigned(?: by)?,?|\b(?:spoke|speak|talked|talk|wrote|written|met|lunch|dinner) (?:to|with)|\b(?:best|kind|warm|many) regards,?|\byours (?:sincerely|truly|faithfully),?"
    r"|\bsincerely,?|\bcheers,|\b(?:dear|hello|hi),?|\b(?:asked|told|met|thanked|married|named|called|phoned|emailed|invited)|\b(?:neighbou?r|friend|colleague|cousin|brother|sister|uncle|aunt|boss|manager|teacher|doctor|landlord|flatmate|roommate),?"
    r"|\bich hei(?:ß|ss)e|\bje m['’]appelle|\b(?:me|mi) (?:llamo|chiamo)|\b(?:meu|mi) n?ome (?:é|e)|\bme chamo|\bmi nombre es|\bcontact(?: person)?:?) ?$"
)
NAME_AFTER = re.compile(
    r"^,? (?:who|whom|whose|says?|said|tells?|told|asks?|asked|calls?|called|phoned|rang|came|comes|showed up|arrived|left|went|wrote|replied|answered|laughed|cried|agreed|refused|promised|knocked|offered|invited|thinks|thought|wants|wanted|knows|knew|and (?:I|his|her|their|my) )\b"
)
# A single word counts as a name only after these.
SINGLE_CUE = re.compile(
    r"(?i:\bmy name is|\bname’?s?:?|\bnames:|\bsigned(?: by)?,?|regards,?|\byours \w+,?|sincerely,?|\bich hei(?:ß|ss)e|appelle|llamo|chiamo|\bome (?:é|e)|\bnome (?:é|e)|chamo|nombre es|contact(?: person)?:?) ?$"
)

AT = r"(?:\s?[@＠]\s?|\s?[(\[{]\s?(?i:at)\s?[)\]}]\s?|(?<=\w) (?i:at) (?=[\w-]+ (?i:dot) ))"
DOT = r"(?:\.| \. |\s?[(\[{]\s?(?i:dot)\s?[)\]}]\s?| (?i:dot) )"
EMAIL = re.compile(rf"(?i:mailto:)?[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*{AT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*(?:{DOT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*)*{DOT}\p{{L}}{{2,24}}\b")

EDGE, STOP = r"(?<![\p{L}\p{N}]|\p{N}[.,/-])", r"(?![\p{L}\p{N}]|[./-]\p{N})"
# Shapes of telephone numbers, with the score each has by itself.
PHONES = [
    (re.compile(rf"{EDGE}\+\d{{1,3}}[ .-]?(?:\(0\)[ .-]?)?(?:\(?\d{{1,5}}\)?[ .-]?){{2,6}}\d{STOP}"), 0.8),
    (re.compile(rf"{EDGE}00\d{{2}}(?:[ .-]\d{{2,5}}){{2,4}}{STOP}"), 0.6),
    (re.compile(rf"{EDGE}(?:1[ .-])?\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?: ?(?i:ext\.?|x) ?\d+)?{STOP}"), 0.8),
    (re.compile(rf"{EDGE}(?:1-)?\d{{3}}-\d{{3}}-\d{{4}}{STOP}"), 0.6),
    (re.compile(rf"{EDGE}\d{{3}}\.\d{{3}}\.\d{{4}}{STOP}"), 0.6),
    (re.compile(rf"{EDGE}\d{{3}} \d{{3}} \d{{4}}{STOP}"), 0.45),
    (re.compile(rf"{EDGE}0\d(?:[. ]\d\d){{4}}{STOP}"), 0.6),
    (re.compile(rf"{EDGE}0\d{{2,4}}[/ ]\d{{5,8}}{STOP}"), 0.6),
    (re.compile(rf"{EDGE}\d{{3}}[ -]\d{{4}} ?(?i:ext\.?|x) ?\d{{1,5}}{STOP}"), 0.7),
    (re.compile(rf"{EDGE}\d{{3}}-\d{{4}}{STOP}"), 0.3),
    (re.compile(rf"{EDGE}\d{{10,11}}{STOP}"), 0.35),
]
# Shapes of personal numbers.
IDS = [
    (re.compile(rf"{EDGE}\d{{3}}-\d{{2}}-\d{{4}}{STOP}"), 0.5),
    (re.compile(rf"{EDGE}\d{{3}} \d{{2}} \d{{4}}{STOP}"), 0.45),
    (re.compile(rf"{EDGE}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{STOP}"), 0.6),
    (re.compile(rf"{EDGE}[XYZ]-?\d{{7}}(?:-\d{{2}})?-?[A-Z]{STOP}"), 0.6),
    (re.compile(rf"{EDGE}(?:19|20)\d{{6}}-\d{{4}}{STOP}"), 0.5),
    (re.compile(rf"{EDGE}\d{{6}}-\d{{2}}/\d{{4}}{STOP}"), 0.5),
    (re.compile(rf"{EDGE}\d{{6}}[-/]\d{{3,4}}{STOP}"), 0.35),
    (re.compile(rf"{EDGE}\d{{2}}-\d{{7}}{STOP}"), 0.4),
    (re.compile(rf"{EDGE}[A-Z]{{1,2}}\d{{6,8}}{STOP}"), 0.35),
    (re.compile(rf"{EDGE}\d{{8,11}}{STOP}"), 0.25),
    (re.compile(rf"{EDGE}\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}{STOP}"), 0.6),
]
CARD = re.compile(rf"{EDGE}(?:\d[ -]?){{12,18}}\d{STOP}")
IBAN = re.compile(rf"{EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{11,30}}{STOP}")
PHONE_WORDS = re.compile(
    r"(?i)\b(?:tel|phone|call(?:ed)?|mobile|cell|text(?:ed)?|rang|ring|dial|whatsapp|fax|reach me|ruf|tel[eé]fono|téléphone|appelle|mon numéro|n[uú]mero|telefone?|handy|celular|cellulare|ligue|chiamami)\b"
)
ID_WORDS = re.compile(
    r"(?i)\b(?:passport|licen[cs]e|tax|social security|insurance|personal|identity|id|ssn|national|dni|nif|cpf|steuer\w*|ausweis\w*|personalausweis|sécu|fiscale?|identificación|documento)\b(?: (?:no\.?|number|nr\.?|#|as|is))*"
)
OTHER_NUMBER = re.compile(r"(?i)\b(?:order|invoice|article|ticket|flight|version|seat|room|table|run|seed|item|product|serial|tracking|booking|reference|score)\b(?: (?:number|no\.?|was|is|says))*")

STREET = r"(?:street|str|st|road|rd|lane|ln|avenue|ave|crescent|cres|court|ct|terrace|drive|dr|way|place|square|sq|boulevard|blvd|close|gardens|grove|mews|parade|highway|hwy)"
NOT_STREET = r"(?!(?i:the|a|an|of|in|on|at|to|for|and|or|is|are|was|were|my|your|our|his|her|their|its|this|that|by|from|people|weeks?|days?|months?|years?|hours?|minutes?|min|times|miles|km|euros?|dollars|pounds|items|lines|guests|old|new|more|degrees|percent)\b)"
UNIT = r"(?:(?i:flat|apt\.?|apartment|unit|suite) \w{1,5},? )"
TOWN = r"(?:,? (?i:apt\.?|flat|unit|suite|#) ?\w{1,5})?(?:, (?:\d{4,6} )?\p{Lu}[\p{L}’'-]+(?: \p{Lu}[\p{L}’'-]+(?=[,.\d]| \d))?(?: \d{4,6})?(?![\p{L}\p{N}]))?"
ADDRESSES = [
    (re.compile(rf"{EDGE}{UNIT}\d{{1,5}}[a-zA-Z]?,? (?:{NOT_STREET}\p{{L}}[\p{{L}}’'-]+ ){{1,3}}(?i:{STREET})\b\.?{TOWN}"), 0.6),
    (re.compile(rf"{EDGE}\d{{1,5}}[a-zA-Z]?,? (?:{NOT_STREET}\p{{L}}[\p{{L}}’'-]+ ){{1,3}}(?i:{STREET})\b\.?{TOWN}"), 0.6),
    (re.compile(rf"(?i:\bp\.? ?o\.? ?box|\bpostfach|\bapartado(?: de correos)?|\bcaixa postal|\bcasella postale|\bbo[iî]te postale) \d{{1,6}}\b{TOWN}"), 0.9),
    (re.compile(rf"{EDGE}\d{{1,5}}(?: ?bis| ?ter)?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai)(?: (?:de la|de l’|de l'|de|des|du|d’|d'))? ?{CAP}(?: {CAP})?{TOWN}"), 0.8),
    (re.compile(rf"(?i:\bcalle|\bavenida|\bplaza|\bpaseo|\brua|\bvia|\bviale|\bcorso|\bpiazza|\btravessa)(?: (?i:del|de la|de los|de las|de|da|do|dos|das|della|dei|degli))? {CAP}(?: {CAP}){{0,2}},? \d{{1,5}}(?:, \d{{1,2}}º ?\w?)?{TOWN}"), 0.8),
    (re.compile(rf"\b\p{{Lu}}[\p{{L}}-]*(?i:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee|ufer|damm|ring) \d{{1,4}} ?[a-z]?\b{TOWN}"), 0.8),
    (re.compile(rf"\b(?:{CAP} ){{1,2}}(?i:straat|laan|gata|gatan|vej) \d{{1,4}}\b{TOWN}"), 0.7),
]
WINDOW = 40

# What a text must hold for a group of patterns to be worth trying.
MAYBE_EMAIL = ("@", "＠", "at)", "at]", "at}", "at )", "at ]", "at }", " dot ")
MAYBE_NUMBER = re.compile(r"\d[\d ./()-]{4,}[\dA-Z]")
MAYBE_PLACED = re.compile(r"\d")
MAYBE_INITIAL = re.compile(r"(?<!\p{L})\p{Lu}\. ?\p{L}")
MAYBE_PAIR = re.compile(r"\p{Lu}[\p{L}’'.-]*(?: \p{L}[\p{L}’'.-]*){0,3} \p{Lu}")
NAMED_PARTS = ("name", "signed", "heiß", "heis", "appelle", "llamo", "chiamo", "nome", "chamo", "nombre", "contact", "regards", "sincerely", "yours")
UNITS = ("flat", "apt", "apartment", "unit", "suite")
CAPITALS = re.compile(r"\p{Lu}\p{L}+")
GIVEN_SET = frozenset({*GIVEN, *(g.upper() for g in GIVEN)})
TITLE_SET = frozenset("Mr Mrs Ms Miss Mx Dr Prof Professor Sir Dame Herr Frau Monsieur Madame Señor Señora Signor Signora".split())


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check digits of international bank account numbers."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _numbers(text: str) -> Iterator[tuple[float, int, int, str]]:
    for kind, shapes, words in (("phone", PHONES, PHONE_WORDS), ("id_number", IDS, ID_WORDS)):
        for shape, base in shapes:
            for m in shape.finditer(text):
                before = text[max(0, m.start() - WINDOW) : m.start()]
                near = before[max(before.rfind(". "), before.rfind("? "), before.rfind("\n")) + 1 :] if not re.search(r"(?i)\b(?:no|nr|tel)\. +$", before) else before
                score = base
                ours, others = list(words.finditer(near)), list(OTHER_NUMBER.finditer(near))
                rival = list((ID_WORDS if kind == "phone" else PHONE_WORDS).finditer(near))
                mine = ours[-1].end() if ours else -1
                score += 0.35 if ours else 0
                score -= 0.5 if others and others[-1].end() > mine else 0
                score -= 0.35 if rival and rival[-1].end() > mine else 0
                yield score, m.start(), m.end(), kind
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1:
            yield 0.75, m.start(), m.end(), "id_number"
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield 0.95, m.start(), m.end(), "id_number"


def _persons(text: str, low: str) -> Iterator[tuple[float, int, int, str]]:
    capitals = set(CAPITALS.findall(text))
    known, titled = not capitals.isdisjoint(GIVEN_SET), not capitals.isdisjoint(TITLE_SET)
    initial, pair, named = MAYBE_INITIAL.search(text), MAYBE_PAIR.search(text), any(x in low for x in NAMED_PARTS)
    tries = (known, known, known, titled, initial, initial, pair, named)
    for (pattern, base), worth in zip(NAMES, tries):
        if not worth:
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
            if re.match(rf" ?& \p{{Lu}}| {FIRM}\b", after) or re.search(rf"(?:\p{{L}} & |\b{PLACE} |@)$", before):
                continue
            if base < 0.3 and re.search(rf"\b{BODY}$", m.group()):
                continue  # what such a word ends is no person
            introduced = NAME_BEFORE.search(before)
            if base < 0.1 and not (introduced and SINGLE_CUE.search(before)):
                continue  # one word alone has to be called a name
            score = base + 0.5 if introduced else base + 0.4 if NAME_AFTER.match(after) else base
            yield score, start, end, "name"


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the personal information of a text, in order, apart."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(x in low for x in MAYBE_EMAIL):
        found += [(0.95, m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if MAYBE_NUMBER.search(text):
        found += _numbers(text)
    if MAYBE_PLACED.search(text):
        for shape, base in ADDRESSES if any(x in low for x in UNITS) else ADDRESSES[1:]:
            found += [(base, m.start(), m.end(), "address") for m in shape.finditer(text)]
    found += _persons(text, low)
    kept: list[tuple[int, int, str, float]] = []
    taken: list[tuple[int, int]] = []
    for score, a, b, kind in sorted((f for f in found if f[0] >= THRESHOLD), key=lambda f: (-min(f[0], 0.9), f[1] - f[2], f[1])):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            kept.append((a, b, kind, round(score, 2)))
    return sorted(kept)


def redact(text: str | None) -> str | None:
    """The text with each span as a typed placeholder such as [EMAIL], all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind, _ in find_spans(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = [t if t is None else t.decode("utf-8", "replace") for t in part.column(part.num_columns - 1).to_pylist()]
            spans = [[dict(zip(("start", "end", "kind", "score"), s)) for s in find_spans(t)] for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
            clean = []
            for t, own in zip(texts, spans):
                pieces, last = [], 0
                for s in own:
                    pieces += [t[last : s["start"]], f"[{s['kind'].upper()}]"]
                    last = s["end"]
                clean.append(t if t is None else "".join([*pieces, t[last:]]))
            columns = [part.column(k) for k in range(part.num_columns - 1)]
            names = [*part.schema.names[:-1], "redacted", "spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(clean, pa.string()), pa.array(spans, kind)], names=names)


def scan_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, redacted, spans array<struct<start, end, kind, score>>) of every row.

    Null texts stay null and empty ones empty, both without spans; whole texts are read,
    however long. Positions count characters. Repeated rows stay repeated; other columns are
    dropped, whatever their names.
    """
    lean = spread(df.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.col(text).cast("string").cast("binary").alias("_text")))
    schema = ", ".join(f"`{k}` {lean.schema[k].dataType.simpleString()}" for k in keys)
    return lean.mapInArrow(_scan, f"{schema}, redacted string, spans array<struct<start: int, end: int, kind: string, score: double>>")


def message_texts(personas: DataFrame, prompts: DataFrame) -> DataFrame:
    """(source_table, owner_type, owner_id, msg_index, text): all texts of both tables, once each."""
    said = personas.select("persona_type", "persona_id", F.posexplode("messages").alias("i", "m"))
    a = said.select(F.lit("personas").alias("source_table"), F.col("persona_type").alias("owner_type"), F.col("persona_id").alias("owner_id"), F.col("i").cast("long").alias("msg_index"), F.col("m.content").alias("text"))
    b = prompts.select(F.lit("prompts").alias("source_table"), F.col("prompt_type").alias("owner_type"), F.col("prompt_id").alias("owner_id"), F.lit(0).cast("long").alias("msg_index"), "text")
    return a.unionByName(b)


TEXT_KEYS = ["source_table", "owner_type", "owner_id", "msg_index"]


def kinds_found(personas: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row for each text and each kind of personal information in it."""
    found = scan_texts(message_texts(personas, prompts), TEXT_KEYS, "text")
    return found.select(*TEXT_KEYS, F.explode(F.array_distinct(F.col("spans.kind"))).alias("kind")).distinct()
