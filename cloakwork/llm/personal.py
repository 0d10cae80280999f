"""Problem 2: personal information inside free text.

The corpus tells what discloses a person. Terms - words of names, shapes of numbers, kinds of mail
domains and streets - are counted where the type of a whole field is known, and words of names
everywhere; how much oftener a term stands in protected fields than elsewhere is its disclosure, in
bits. Patterns and a name grammar only propose: a proposal comes with a prior, the corpus adds what its
term discloses, and what reaches the threshold is generalised to a typed placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.filters import normal_label
from cloakwork.llm import bloom
from cloakwork.llm.names import LEGAL, TITLES, person
from cloakwork.session import one_of_each, stored

#: Bits of disclosure from which a word counts as part of a name.
NAMES_BITS = 1.0
#: Bits for or against a type from which a shape counts, and what it then weighs; fields that a shape
#: has for and against any type before it is seen. Shares decide, whatever the size of the corpus.
SHAPE_BITS, EVIDENCE, SMOOTH = 2.0, 4.0, 1.0
#: Prior bits: of a form that nothing else has (a mail address, a street after a number), of a pattern,
#: of a word before a number that names its type, of one that names another, and of any other number.
EVIDENT, PATTERN, CUE, OTHERWISE, ANY = 6.0, 3.0, 3.0, -6.0, -3.0

# What is found in fields of these types, as `functions.filters` names them, is protected.
PROTECTED = {"PERSON": "NAME", "PHONE_NUMBER": "PHONE", "SSN": "ID_NUMBER", "US_SSN": "ID_NUMBER", "US_ITIN": "ID_NUMBER", "US_PASSPORT": "ID_NUMBER", "US_DRIVER_LICENSE": "ID_NUMBER", "EMAIL_ADDRESS": "EMAIL", "LOCATION": "STREET_ADDRESS"}

# Words before a number that say that it isn't a person's.
NOT_PERSONAL = set("npi ein fein policy pol claim clm cla file serial lot batch inv invoice job account acct member group cpt icd code reference ref meter reading rev form order certificate authorization report provider plate rev. no.policy tin vin po case ticket".split())
# Kinds of streets, in English after the name, in the Romance languages before it, and as
# endings of German and Dutch street names.
AFTER = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Ter|Circle|Cir|Parkway|Pkwy|Highway|Hwy|Trail|Trl|Square|Sq|Loop|Alley|Row|Crescent|Close|Walk|Commons"
BEFORE = "Calle|Avenida|Av|Avda|Paseo|Plaza|Camino|Carrera|Ronda|Rua|Travessa|Praça|Praca|Alameda|Estrada|Via|Viale|Corso|Piazza|Vicolo|Largo|Strada|Beco|Ladeira"
FRENCH = "rue|avenue|allée|allee|boulevard|place|chemin|impasse|quai|route|cours|square|sentier|passage"
ENDINGS = "straße|strasse|str\\.|allee|gasse|platz|ring|grund|ufer|damm|garten|chaussee|steig|weg|straat|laan|gracht|plein|kade|dijk|singel|dreef|hof|pad|park"
# Words that no name ends with.
NO_SURNAME = set("the and or of to in on at for from by with is was are has had street road avenue inc llc ltd gmbh corp company medical center clinic insurance claims claim policy patient insured driver name email phone please contact call copies number date page see was statement reported living wrote says".split()) | LEGAL

_D = r"[0-9O]"
_email = re.compile(
    r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*\s?(?:@|[\[(]at[\])])\s?[A-Za-z0-9-]+(?:(?:\.|\s\.\s|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+", re.I
)
_phone = re.compile(
    rf"(?<![\w#$@/-])(?:\+[1-9]{_D}{{0,2}}(?:[\s.-]?\(?{_D}{{2,5}}\)?){{2,4}}|(?:1[\s.-])?(?:\({_D}{{3}}\)\s?|{_D}{{3}}[\s.-]?){_D}{{3}}[\s.-]?{_D}{{4}}|{_D}{{3}}\s{_D}{{3}}\s{_D}{{2}}\s{_D}{{2}})(?:\s?(?i:x|ext\.?)\s?\d{{1,5}})?(?![\w-]|\.\d)"
)
_social = re.compile(rf"(?<![\w#$@/.-]){_D}{{3}}(?:-{_D}{{2}}-|\.{_D}{{2}}\.|\s{_D}{{2}}\s){_D}{{4}}(?![\w-]|\.\d)")
_number = re.compile(rf"(?<![\w$@/-])(?:[A-Z]{_D}{{3}}-{_D}{{4}}-{_D}{{4}}|[A-Z]{_D}{{2}}[A-Z]{_D}{{5}}|[A-Z]{_D}{{7,8}}|{_D}{{9}})(?![\w-]|\.\d)")
_cue = re.compile(r"(?:s\.?\s?s\.?\s?n\b\.?|\bss\s?#|social\s+security(?:\s+(?:no|number|num|nr)\b\.?)?|\bitin\b|tax(?:payer)?\s+id\w*|passport(?:\s+(?:no|number|num|nr)\b\.?)?|\bdl\s?#|driver'?s?\s+licen[sc]e(?:\s+(?:no|number)\b\.?)?|licen[sc]e\s+(?:no|number)\b\.?)\s*[:#.]?\s*$", re.I)
_cap = r"[A-ZÀ-Ý][\w'’-]*"
_address = [
    re.compile(rf"(?<![\w#$.,/-])(?<!\d )[\dO]{{1,5}}\s+(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?\s+)?(?:(?!(?i:and|level|or|of)\b){_cap}\s+){{1,4}}(?i:{AFTER})\b\.?(?!\s+(?i:level|parking|ruling))"),
    re.compile(rf"(?<![\w#$.,/-])\d{{1,4}}(?:\s(?:bis|ter|quater)\b)?,?\s+(?i:{FRENCH})\s+(?:(?:(?i:de|des|du|la|le|les|aux?)\s+|(?i:d['’]|l['’])\s?)*{_cap}\s?){{1,4}}"),
    re.compile(rf"\b(?i:{BEFORE})\.?\s+(?:(?:(?i:de|del|la|las|los|el|das|dos|do|da|dei|della|delle|degli|del|dell['’]|di)\s+)*{_cap}\s*){{1,4}},?\s*(?:(?i:nº|n°|n\.|no\.|núm\.|num\.)\s*)?\d{{1,4}}(?:\s?[a-z]\b)?(?![\d/-]|\.\d)"),
    re.compile(rf"\b(?:{_cap}\s+){{0,2}}[A-ZÄÖÜ][\w'’-]*(?i:{ENDINGS})\s+\d{{1,4}}(?:-\d{{1,3}}|\s?[a-zA-Z])?\b(?![\d/-]|\.\d)"),
    re.compile(rf"\b(?i:am|an der|im|zum|zur|auf der|auf dem|in der)\s+{_cap}\s+\d{{1,4}}\s?[a-z]?\b(?![\d/-]|\.\d)"),
]
#: What a text in lower case, its white space as blanks, must hold for the address pattern of the same
#: place to be worth trying.
_hint = [
    tuple(f" {w.lower()}" for w in AFTER.split("|")),
    tuple(w.lower() for w in FRENCH.split("|")),
    tuple(f"{w.lower()}" for w in BEFORE.split("|")),
    tuple(w.lower().replace("\\", "") for w in ENDINGS.split("|")),
    ("am ", "an der ", "im ", "zum ", "zur ", "auf der ", "auf dem ", "in der "),
]
_at = re.compile(r"[\[(][aA][tT][\])]")
_digits = re.compile(r"\d")
_word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_camel = re.compile(r"([A-Z][a-z]{2,})([A-Z][a-z]{2,})$")
_near = re.compile(r"\.?\s+$")
_comma = re.compile(r"\s*,\s*$")
_licence = re.compile(r"[A-Z].{3}-")
_extension = re.compile(r"(?:x|ext).*", re.I | re.S)


#: Any number, and a house number with capitalised words after it.
_any = re.compile(r"(?<![\w#$@/.+-])[A-Z]{0,3}[0-9][0-9OA-Z]*(?:[-. ][0-9][0-9O]*){0,4}(?![\w-]|\.\d)")
_house = re.compile(rf"(?<![\w#$.,/-])(?<!\d )\d{{1,5}}\s+(?:(?:[NSEW]{{1,2}}\.|{_cap})\s+){{1,4}}(?P<kind>{_cap})")
_mail = re.compile(r"[^\s@]+\s?@\s?[^\s@]+")


def shape(text: str) -> str:
    """Digits as 9, letters as A, white space as one blank."""
    return re.sub(r"\s+", " ", re.sub(r"[A-Z]", "A", re.sub(r"[0-9O]", "9", text.upper())))


def before(text: str, start: int) -> str:
    """The word before a place, in lower case, if it stands on the same line of thought."""
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 25) : start])
    return words[-1].lower() if words else ""


def digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def numbers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, str, float]]:
    """Proposals of e-mail and street addresses, identity and phone numbers: (type, start, end, term,
    prior bits). Of a number that fits no pattern every type is proposed."""

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    if "@" in text or _at.search(text):
        for m in _email.finditer(text):
            taken.append(m.span())
            yield "EMAIL", m.start(), m.end(), f"@{m.group().rpartition('.')[2].strip(' )]').lower()}", EVIDENT
        for m in _mail.finditer(text):
            if free(*m.span()):
                taken.append(m.span())
                yield "EMAIL", m.start(), m.end(), f"@{m.group().rpartition('.')[2].lower()}", ANY
    if not _digits.search(text):
        return
    for m in _social.finditer(text):
        if free(*m.span()) and digits(m.group()) >= 5:
            taken.append(m.span())
            cue = CUE if _cue.search(text[max(0, m.start() - 40) : m.start()]) else OTHERWISE if before(text, m.start()) in NOT_PERSONAL else 0
            yield "ID_NUMBER", m.start(), m.end(), shape(m.group()), PATTERN + cue
    for m in _number.finditer(text):
        cue = CUE if _cue.search(text[max(0, m.start() - 40) : m.start()]) else 0 if _licence.match(m.group()) else OTHERWISE
        if free(*m.span()) and digits(m.group()) >= 4 and cue >= 0:
            taken.append(m.span())
            yield "ID_NUMBER", m.start(), m.end(), shape(m.group()), PATTERN + cue
    for m in _phone.finditer(text):
        own = _extension.sub("", m.group()).rstrip()
        if free(*m.span()) and digits(m.group()) >= 6 and 9 <= sum(c.isdigit() or c == "O" for c in own) <= 14:
            taken.append(m.span())
            yield "PHONE", m.start(), m.end(), shape(own), PATTERN + (OTHERWISE if _other(text, m.start()) else 0)
    lowered = re.sub(r"\s", " ", text.lower())
    for kind, pattern in enumerate(_address):
        for m in pattern.finditer(text) if any(h in lowered for h in _hint[kind]) else ():
            if free(*m.span()):
                taken.append(m.span())
                yield "STREET_ADDRESS", m.start(), m.start() + len(m.group().rstrip()), f"~{kind}", EVIDENT
    for m in _house.finditer(text):
        if free(*m.span()):
            taken.append(m.span())
            yield "STREET_ADDRESS", m.start(), m.end(), f"~{m['kind'].lower()}", ANY
    for m in _any.finditer(text):
        if free(*m.span()) and digits(m.group()) >= 4:
            term, other = shape(m.group()), OTHERWISE if _other(text, m.start()) else 0
            for kind in ("ID_NUMBER", "PHONE"):
                yield kind, m.start(), m.end(), term, ANY + other


def _other(text: str, start: int) -> bool:
    """Whether the word right before a number says that it is of another kind."""
    word = before(text, start)
    return word in NOT_PERSONAL and text[max(0, start - 12) : start].rstrip(" .:#\n").lower().endswith(word)


class Lexicon:
    """Terms that the corpus found to disclose: words of names, and shapes of numbers."""

    def __init__(self, terms: bloom.Bloom):
        self.terms = terms

    def given(self, word: str) -> bool:
        return f"g:{word}" in self.terms

    def surname(self, word: str) -> bool:
        return f"s:{word}" in self.terms

    def names(self, terms: list[str]) -> bool:
        """Whether one of a name's words discloses a person by itself."""
        return any(f"!{t}" in self.terms for t in terms)

    def bits(self, kind: str, term: str) -> float:
        """What a term of a number or an address says for a type, or against it."""
        return EVIDENCE * ((f"+{kind}|{term}" in self.terms) - (f"-{kind}|{term}" in self.terms))


def named(text: str, lexicon: Lexicon, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, list[str]]]:
    """Persons' names: given name and surname in either order, joined, or a surname with initials."""
    tokens = [(m.group(), m.start(), m.end()) for m in _word.finditer(text) if all(m.end() <= a or m.start() >= b for a, b in taken)]
    low = [t[0].lower() for t in tokens]
    givens = [len(w) > 1 and lexicon.given(w) and w not in TITLES for w in low]
    surnames = [len(w) > 2 and lexicon.surname(w) and w not in NO_SURNAME for w in low]
    count, i = len(tokens), 0

    def gap(k: int) -> str:
        return text[tokens[k][2] : tokens[k + 1][1]] if k + 1 < count else "\0"

    def is_initial(k: int) -> bool:
        return k < count and len(tokens[k][0]) == 1 and tokens[k][0].isupper()

    def given(k: int) -> bool:
        return k < count and givens[k]

    def surname(k: int) -> bool:
        return k < count and surnames[k]

    while i < count:
        word, start, _ = tokens[i]
        end, terms, used = -1, [], 0
        if given(i):
            j = i + 1
            while is_initial(j) and j - i <= 2 and _near.match(gap(j - 1)):
                j += 1
            if j < count and _near.match(gap(j - 1)) and len(low[j]) > 2 and low[j] not in NO_SURNAME and (surname(j) or tokens[j][0][0].isupper() and not given(j)):
                if surname(j) or tokens[j][0].isupper() == word.isupper():
                    end, terms, used = tokens[j][2], [f"g:{low[i]}", f"s:{low[j]}"], j - i + 1
        if end < 0 and (m := _camel.match(word)) and lexicon.given(m.group(1).lower()):
            end, terms, used = tokens[i][2], [f"g:{m.group(1).lower()}", f"s:{m.group(2).lower()}"], 1
        if end < 0 and surname(i) and word[0].isupper():
            if _comma.match(gap(i)) and (given(i + 1) or is_initial(i + 1)) and "\n\n" not in gap(i):
                j = i + 1
                while is_initial(j + 1) and j - i <= 2 and _near.match(gap(j)):
                    j += 1
                if not (is_initial(i + 1) and surname(i + 2)):
                    end, terms, used = tokens[j][2], [f"s:{low[i]}"] + ([f"g:{low[i + 1]}"] if given(i + 1) else []), j - i + 1
            elif given(i + 1) and _near.match(gap(i)) and not (surname(i + 2) and _near.match(gap(i + 1))):
                j = i + 1
                while is_initial(j + 1) and j - i <= 2 and _near.match(gap(j)):
                    j += 1
                end, terms, used = tokens[j][2], [f"s:{low[i]}", f"g:{low[i + 1]}"], j - i + 1
            elif is_initial(i + 1) and gap(i) == " " and not (surname(i + 2) and _near.match(gap(i + 1))):
                rest = text[tokens[i + 1][2] :]
                if re.match(r"\.?\s*(?:$|[,;:)\n]|-|\s[a-z(]|\s\s|\s[+(\d])|\.\s", rest):
                    end, terms, used = tokens[i + 1][2], [f"s:{low[i]}"], 2
        if end < 0 and len(word) > 4 and word[0].isupper() and low[i] not in NO_SURNAME and _comma.match(gap(i)) and given(i + 1) and not (i and _near.match(gap(i - 1)) and tokens[i - 1][0][0].isupper()):
            # a surname that no protected field holds: only where nothing after the given name could be one
            j = i + 1
            while is_initial(j + 1) and j - i <= 2 and _near.match(gap(j)):
                j += 1
            if not (_near.match(gap(j)) and tokens[j + 1][0][0].isupper()):
                end, terms, used = tokens[j][2], [f"s:{low[i]}", f"g:{low[i + 1]}"], j - i + 1
        if end < 0 and word.isupper() and len(word) <= 2 and low[i] not in {"dr", "mr", "ms"}:
            j = i + 1
            while len(word) == 1 and is_initial(j) and j - i <= 2 and _near.match(gap(j - 1)):
                j += 1
            if surname(j) and _near.match(gap(j - 1)) and tokens[j][0][0].isupper():
                end, terms, used = tokens[j][2], [f"s:{low[j]}"], j - i + 1
        if end > 0:
            yield "NAME", start, end, terms
            i += used
        else:
            i += 1


def find(text: str, lexicon: Lexicon, threshold: float = 0.0) -> list[tuple[str, int, int]]:
    """(type, start, end) of all items in a text, none overlapping another, in order. threshold: bits of
    prior and disclosure together from which a proposal is an item."""
    out, found = [], []
    for kind, start, end, term, prior in numbers(text, []):
        if prior + lexicon.bits(kind, term) >= threshold and (not out or out[-1][1:] != (start, end)):
            out.append((kind, start, end))
            found.append((start, end))
    out += [(kind, a, b) for kind, a, b, terms in named(text, lexicon, found) if lexicon.names(terms)]
    return sorted(out, key=lambda x: x[1])


def parts_of_names(text: str) -> list[str]:
    """Terms of a protected field that holds one person's name: g:word and s:word."""
    parsed = person(text)
    if not parsed:
        return []
    surname, given = parsed
    return [f"s:{surname}"] + [f"g:{g}" for g in given if len(g) > 1]


def _kind(kind: Column) -> Column:
    """The protected type that the type of a field stands for, "" for another type, null for none."""
    known = F.create_map(*[F.lit(x) for k in PROTECTED.items() for x in k])
    return F.when(kind.isNotNull(), F.coalesce(known[normal_label(kind)], F.lit("")))


def name_words(fields: DataFrame) -> DataFrame:
    """term, bits: the words of names in fields that are typed as persons' and read as names.

    bits = log2(share of the word's places that such fields hold / share of all words' places that they
    hold), over the whole corpus; g: before given names and s: before surnames.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"term": [t for text in pdf["text"] for t in parts_of_names(text)]}, dtype=object)

    persons = fields.filter(_kind(F.col("kind")) == "NAME").select("src", "row_id", "text").dropDuplicates(["src", "row_id"])
    own = persons.select("text").mapInPandas(parsed, "term string").groupBy("term").agg(F.count("*").alias("own"))
    own = stored(own.withColumn("word", F.substring("term", 3, 1 << 20)))
    parts = F.regexp_extract_all(F.regexp_replace("text", "(?<=[a-z])(?=[A-Z])", " "), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))
    words = stored(fields.select(F.explode(parts).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")))
    total, held = words.agg(F.sum("n")).first()[0] or 1, own.agg(F.sum("own")).first()[0] or 0
    base = min(1.0, max(held, 1) / total)
    return own.join(words, "word").select("term", F.log2(F.col("own") / F.greatest("n", "own") / F.lit(base)).alias("bits"))


def shapes(fields: DataFrame) -> DataFrame:
    """kind, term, bits: shapes of numbers, ends of mail addresses and kinds of streets in fields that are
    nothing but one value of a known type.

    bits = log2 of the fields of the kind that have the term against those of other types that have it.
    Each field counts once.
    """
    typed = fields.withColumn("own", _kind(F.col("kind"))).filter("own is not null and own <> 'NAME'").dropDuplicates(["src", "row_id"])
    value = F.regexp_replace(F.regexp_replace(F.trim("text"), r"(?is)(?<=\d)\s?(?:x|ext\.?)\s?\d{1,5}$", ""), r"\s+", " ")
    number = F.when(value.rlike(r"^[+(]?[A-Z]{0,3}\(?[0-9O][0-9OA-Z ().+-]*$") & ~value.rlike("[A-Z]{4}"), F.regexp_replace(F.regexp_replace(F.upper(value), "[0-9O]", "9"), "[A-Z]", "A"))
    mail = F.when(value.rlike(r"^\S+\s?@.*\.\s?[A-Za-z0-9]+$"), F.concat(F.lit("@"), F.lower(F.regexp_extract(value, r"([A-Za-z0-9]+)$", 1))))
    street = F.nullif(F.lower(F.regexp_extract(value, r"^\d{1,5} (?:[^\s,]+ ){1,5}(\p{L}+)\.?(?:,|$)", 1)), F.lit(""))
    terms = F.array_compact(F.array(mail, number, F.concat(F.lit("~"), street)))
    counts = typed.select("own", F.explode(terms).alias("term")).groupBy("term", "own").agg(F.count("*").alias("n")).groupBy("term").agg(F.collect_list(F.struct("own", "n")).alias("by"), F.sum("n").alias("all"))
    kinds = F.array(*[F.lit(k) for k in sorted({*PROTECTED.values()} - {"NAME"})])
    each = counts.select("term", "by", "all", F.explode(kinds).alias("kind"))
    own = F.aggregate("by", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["own"] == F.col("kind"), x["n"]).otherwise(0))
    return each.select("kind", "term", F.log2((own + SMOOTH) / (F.col("all") - own + SMOOTH)).alias("bits"))


def lexicon(fields: DataFrame, names_bits: float = NAMES_BITS, shape_bits: float = SHAPE_BITS) -> bloom.Bloom:
    """The terms that disclose, or speak against a type, as a filter of bounded size.

    Words of names are in it as they are, for the grammar, and with "!" if they disclose by themselves;
    shapes with the sign of their bits.
    """
    words = name_words(fields).select(F.explode(F.when(F.col("bits") >= names_bits, F.array("term", F.concat(F.lit("!"), "term"))).otherwise(F.array("term"))).alias("word"))
    telling = shapes(fields).filter(F.abs("bits") >= shape_bits)
    return bloom.build(words.unionByName(telling.select(F.concat(F.when(F.col("bits") > 0, "+").otherwise("-"), "kind", F.lit("|"), "term").alias("word"))))


def items(fields: DataFrame) -> DataFrame:
    """src, row_id, pii_type, start, end of every item of personal information.

    fields(src, row_id, kind, text): kind is the type of the hit whose text this is, or null. Each
    (src, row_id) once; null ids and null texts have no items; texts are read whole, and never shuffled.
    Offsets are 0-based code points, end exclusive.
    """
    fields = fields.filter("text is not null and src is not null and row_id is not null")
    shared = fields.sparkSession.sparkContext.broadcast(lexicon(fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Lexicon(shared.value)
        for pdf in batches:
            rows = [(src, row_id, *item) for src, row_id, text in zip(pdf["src"], pdf["row_id"], pdf["text"]) for item in find(text, terms)]
            yield pd.DataFrame(rows, columns=["src", "row_id", "pii_type", "start", "end"])

    found = fields.select("src", "row_id", "text").mapInPandas(run, "src string, row_id long, pii_type string, start int, end int")
    return found.dropDuplicates(["src", "row_id", "start"])


def sanitised(fields: DataFrame, found: DataFrame) -> DataFrame:
    """src, row_id, text with every item replaced by its type in brackets, the rest unchanged."""
    spans = found.groupBy("src", "row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, own in zip(pdf["text"], pdf["spans"]):
                if own is not None:
                    for s in reversed(list(own)):
                        text = text[: s["start"]] + f"[{s['pii_type']}]" + text[s["end"] :]
                texts.append(text)
            yield pdf[["src", "row_id"]].assign(text=texts)

    fields = one_of_each(fields.select("src", "row_id", "text"), "src", "row_id")
    return fields.join(spans, ["src", "row_id"], "left").mapInPandas(run, "src string, row_id long, text string")
