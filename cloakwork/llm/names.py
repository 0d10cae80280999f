"""Problem 6: spellings of persons and organisations that name the same one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.components import components
from cloakwork.session import stored, tasks

#: Least Jaro-Winkler similarity of two spellings of a word.
ALIKE = 0.84
#: Letters of a surname or a word of a firm's name from which any one of them may be another letter.
LONG = 6

# Nicknames and the given names that they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "al": "albert alfred alan alexander", "alec": "alexander", "alex": "alexander alexandra",
    "sandy": "alexander alexandra sandra", "xander": "alexander", "andy": "andrew", "drew": "andrew", "annie": "anne ann anna", "tony": "anthony",
    "art": "arthur", "gus": "augustine august gustav", "augie": "augustine august", "bart": "bartholomew", "bea": "beatrice", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin",
    "beth": "elizabeth bethany", "betsy": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "ellie": "eleanor ellen", "nell": "eleanor ellen", "nora": "eleanor", "lena": "eleanor helena",
    "liz": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth", "lisa": "elizabeth", "bess": "elizabeth", "carrie": "caroline", "cathy": "catherine", "cate": "catherine",
    "charlie": "charles charlotte", "chuck": "charles", "chas": "charles", "chris": "christopher christine christina", "kit": "christopher katherine", "topher": "christopher", "chrissy": "christine christina",
    "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy",
    "don": "donald", "doug": "douglas", "ed": "edward edwin edmund", "eddie": "edward edwin", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "fran": "frances francesca francis", "frankie": "frances francesca frank", "frank": "francis franklin", "chesca": "francesca", "cesca": "francesca",
    "fred": "frederick alfred", "freddie": "frederick", "freddy": "frederick", "gabe": "gabriel", "gene": "eugene", "geoff": "geoffrey", "gerry": "gerald", "jerry": "gerald jerome", "ginny": "virginia", "greg": "gregory", "gwen": "gwendolyn", "wendy": "gwendolyn", "memo": "guillermo", "guille": "guillermo",
    "hal": "harold henry", "harry": "harold henry", "hank": "henry", "nan": "hannah nancy", "hanna": "hannah", "nacho": "ignacio", "iggy": "ignacio", "inga": "ingrid", "inge": "ingrid", "izzy": "isidora isabel", "isa": "isidora isabel", "dora": "isidora theodora", "jack": "john", "jackie": "jacqueline", "jake": "jacob", "jim": "james", "jimmy": "james", "jamie": "james",
    "jan": "janet", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "jonny": "jonathan", "josh": "joshua", "judy": "judith",
    "kat": "katherine katarina", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "katya": "katarina", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "lou": "lourdes louis louise", "lulu": "lourdes", "mal": "malcolm",
    "maggie": "margaret", "marge": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "rita": "margaret", "daisy": "margaret", "max": "maximilian maxwell", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "mitch": "mitchell", "nat": "nathaniel natalie", "nate": "nathaniel nathan", "nathan": "nathaniel",
    "nick": "nicholas", "nicky": "nicholas nicole", "ossie": "oskar oscar", "oz": "oskar oscar", "ottie": "ottilie", "tilly": "ottilie matilda", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "penny": "penelope", "nel": "penelope", "pete": "peter", "phil": "philip", "pippa": "philippa", "pip": "philippa philip",
    "quin": "quentin", "quinn": "quentin", "ray": "raymond", "becca": "rebecca", "becky": "rebecca", "reba": "rebecca", "dickie": "richard", "rich": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "bob": "robert", "bobby": "robert", "bert": "robert albert", "robbie": "robert", "ron": "ronald", "roz": "rosalind", "ros": "rosalind", "rosie": "rosalind rose", "linda": "rosalind",
    "sam": "samantha samuel", "sasha": "alexander alexandra", "sammy": "samantha samuel", "steph": "stephanie", "stevie": "stephanie", "steve": "stephen steven", "sue": "susan", "susie": "susan", "suzy": "susan", "sly": "sylvester", "vester": "sylvester", "syl": "sylvester", "tabby": "tabitha", "terry": "theresa terence", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "ulla": "ursula", "urs": "ursula", "ursa": "ursula",
    "val": "valerie", "vic": "victoria victor", "vicky": "victoria", "tori": "victoria", "vin": "vincent", "vince": "vincent", "vinny": "vincent", "bill": "william", "billy": "william", "liam": "william", "will": "william", "willy": "william", "mina": "wilhelmina", "minnie": "wilhelmina", "billie": "wilhelmina", "willa": "wilhelmina", "yoli": "yolanda", "yola": "yolanda", "zach": "zachary", "zack": "zachary", "zac": "zachary",
}
# Titles before names, letters after names, legal forms, shortened words of firms' names,
# and entries in name fields that name nobody.
TITLES = set("dr prof mr mrs ms miss mx sir dame rev hon".split())
LETTERS_AFTER = set("rn md phd esq jr sr ii iii cpa dds do dvm pa np lpn".split())
LEGAL = set("inc incorporated llc ltd limited gmbh corp corporation llp lp plc ag co company sa bv kg".split())
SHORTENED = {
    "fms": "farms", "fm": "farms", "mgmt": "management", "mgt": "management", "ins": "insurance", "wks": "works", "fam": "family",
    "frt": "freight", "grp": "group", "gp": "group", "sys": "systems", "sup": "supply", "labs": "laboratories", "lab": "laboratories", "svcs": "services", "svc": "services",
    "srvs": "services", "serv": "services", "ctr": "center", "cntr": "center", "centre": "center", "intl": "international", "int": "international", "assoc": "associates",
    "assocs": "associates", "assn": "association", "bldg": "building", "matls": "materials", "mat": "materials", "mtls": "materials", "tech": "technical", "inst": "institute", "med": "medical",
    "prop": "property", "props": "property", "res": "research", "sec": "security", "ldry": "laundry", "brkrs": "brokers", "brok": "brokers", "clin": "clinic", "roofg": "roofing",
    "cater": "catering", "catrg": "catering", "mar": "marine", "orch": "orchard", "hosp": "hospital", "univ": "university", "natl": "national", "dept": "department", "mfg": "manufacturing", "sid": "siding",
}
NOBODY = {"same as above", "not applicable", "see above", "n a", "as above", "to be advised", "not stated"}


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).replace("’", "'").replace(" ", " ")


def person(text: str) -> tuple[str, tuple[str, ...]] | None:
    """(surname, given names or initials) in lower case; None where the text names no person.

    A surname comes before a comma, first in capitals before other words, first before a lone initial,
    else last.
    """
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", plain(text))
    if " ".join(re.findall(r"[a-z]+", text.lower())) in NOBODY or re.search(r"[\d@/]", text):
        return None
    parts = [[w for w in re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", p) if w] for p in text.split(",")]
    if sum(w.lower() not in TITLES for p in parts for w in p) > 1:
        parts = [[w for w in p if w.lower() not in TITLES] for p in parts]
    parts = [p for k, p in enumerate(parts) if p and not (k and all(w.lower() in LETTERS_AFTER for w in p))]
    if not parts:
        return None
    if len(parts) > 1:
        last, given = parts[0], [w for p in parts[1:] for w in p]
    else:
        words = [w for w in parts[0] if w.lower() not in LETTERS_AFTER or w.islower() is False and len(w) < 3 and w.lower() not in {"md", "rn"}]
        if len(words) < 2:
            return None
        mixed = any(not w.isupper() for w in words if len(w) > 2)
        if (len(words[0]) > 2 and all(len(w) == 1 for w in words[1:])) or (mixed and len(words[0]) > 2 and words[0].isupper() and not words[-1].isupper()):
            last, given = words[:1], words[1:]
        else:
            last, given = words[-1:], words[:-1]
    out: list[str] = []
    for w in given:
        if len(w) == 2 and w.isupper() or len(w) == 2 and not re.search(r"[aeiouy]", w.lower()):
            out += list(w.lower())
        else:
            out.append(re.sub(r"[^a-z]", "", w.lower()))
    surname = re.sub(r"[^a-z]", "", "".join(last).lower())
    out = [g for g in out if g]
    return (surname, tuple(out)) if len(surname) > 1 and out else None


def firm(text: str) -> tuple[str, ...] | None:
    """The words of an organisation's name, sorted, without article, joining words and legal form;
    None if none is left."""
    text = plain(text).lower().replace("&", " and ")
    text = re.sub(r"\b(?:[a-z]\.\s?){2,}[a-z]?\b", lambda m: re.sub(r"[^a-z]", "", m.group()) + " ", text)
    text = text.replace("autobody", "auto body")
    words = [SHORTENED.get(w, w) for w in re.findall(r"[a-z]+", text.replace("'s", ""))]
    kept = [w for w in words if w not in LEGAL and w not in {"the", "and", "of"}]
    return tuple(sorted(kept)) if kept else None


@lru_cache(100_000)
def code(word: str) -> str:
    """A phonetic code: letters that sound alike are one, doubles and vowels after the first sound go."""
    w = word
    for a, b in (("ph", "f"), ("ck", "k"), ("sch", "s"), ("tz", "s"), ("th", "t"), ("qu", "kv")):
        w = w.replace(a, b)
    w = w.translate(str.maketrans("cqwyzjx", "kkvisis"))
    w = re.sub(r"(.)\1+", r"\1", w[:1] + w[1:].replace("h", ""))
    first = "a" if w[:1] in "aeiou" and w else w[:1]
    return first + re.sub(r"[aeiou]", "", w[1:])


def around(c: str) -> set[str]:
    """The code and the codes with one sound less; words one slip apart share one of them."""
    return {c} | {c[:k] + c[k + 1 :] for k in range(len(c)) if len(c) > 2}


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    window = max(len(a), len(b)) // 2 - 1
    used, matched_a = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                matched_a.append(x)
                break
    m = len(matched_a)
    if not m:
        return 0.0
    matched_b = [y for y, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(matched_a, matched_b)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def slip(a: str, b: str) -> bool:
    """One letter more, one less, two neighbours swapped, or letters of one sound taken for each other."""
    if a == b:
        return True
    if code(a) == code(b) and abs(len(a) - len(b)) <= 1:
        return sum(x != y for x, y in zip(a, b)) <= 2 if len(a) == len(b) else True
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1]
    return len(b) - len(a) == 1 and a[k:] == b[k + 1 :]


@lru_cache(200_000)
def alike(a: str, b: str) -> bool:
    """Two words as spellings of one: similar by Jaro-Winkler, and no more than one slip apart."""
    if a == b:
        return True
    return min(len(a), len(b)) >= 4 and jaro_winkler(a, b) >= ALIKE and slip(a, b)


@lru_cache(200_000)
def alike_surnames(a: str, b: str) -> bool:
    """Surnames, or words of firms' names, as spellings of one: long ones may also have any one letter taken for another."""
    return alike(a, b) or len(a) == len(b) >= LONG and sum(x != y for x, y in zip(a, b)) == 1 and jaro_winkler(a, b) >= ALIKE


@lru_cache(50_000)
def stands_for(given: str) -> frozenset[str]:
    """The given names that a name may stand for, itself included."""
    return frozenset(NICKNAMES.get(given, "").split()) | {given}


def same_given(a: str, b: str) -> bool:
    """Given names that may be one person's: alike, or nicknames of a common name. Initials match the
    first letter of any name that the other stands for."""
    if len(a) == 1 or len(b) == 1:
        return bool({x[0] for x in stands_for(a)} & {x[0] for x in stands_for(b)})
    return any(alike(x, y) for x in stands_for(a) for y in stands_for(b))


def same_person(a: str, b: str) -> bool:
    """Keys of persons, "surname|given given": same surname, first name and no other middle initial."""
    (s, g), (t, h) = ((k.split("|")[0], k.split("|")[1].split()) for k in (a, b))
    if not alike_surnames(s, t) or not same_given(g[0], h[0]):
        return False
    return all(x[0] == y[0] for x, y in zip(g[1:], h[1:]))


def same_firm(a: str, b: str) -> bool:
    """Keys of firms, their words: each word has its like on the other side; one may differ by a slip."""
    x, y = a.split(), b.split()
    rest = list(y)
    for w in x:
        if w in rest:
            rest.remove(w)
    left = list(x)
    for w in y:
        if w in left:
            left.remove(w)
    return not left and not rest or len(left) == 1 and len(rest) == 1 and alike_surnames(left[0], rest[0])


def keyed(strings: DataFrame) -> DataFrame:
    """strings(kind, text) to (text, kind, key, letters).

    key: the parsed name; of persons "surname|given" and the initials of further names, as no comparison
    looks at more. letters: the first letters of the names that a person's given name stands for. Strings
    that name nobody have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, text in zip(pdf["kind"], pdf["text"]):
                if kind == "PERSON":
                    if parsed := person(text):
                        surname, given = parsed
                        rows.append((text, kind, f"{surname}|{given[0]} {''.join(g[0] for g in given[1:])}".rstrip(), "".join(sorted({x[0] for x in stands_for(given[0])}))))
                elif words := firm(text):
                    rows.append((text, kind, " ".join(words), ""))
            yield pd.DataFrame(rows, columns=["text", "kind", "key", "letters"])

    return strings.mapInPandas(run, "text string, kind string, key string, letters string")


#: How words of names are compared, by the role that they have.
ROLES = {"given": same_given, "surname": alike_surnames, "firm": alike_surnames}


def spellings(words: DataFrame) -> DataFrame:
    """words(role, word) to (role, a, b, sound): words that may be spellings of one, both ways and each with
    itself. sound: whether they, or names that they stand for, have one phonetic code.

    Different words meet in the blocks of their phonetic codes and of these with one sound less, and are
    compared by Jaro-Winkler, single slips and the nickname table. A block holds the spellings of a sound
    once each, however many names have them.
    """

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for role, word in zip(pdf["role"], pdf["word"]):
                codes = {code(w) for w in (stands_for(word) if role == "given" else (word,))}
                rows.append((role, word, sorted({x for c in codes for x in around(c)})))
            yield pd.DataFrame(rows, columns=["role", "word", "blocks"])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for role, a, b in zip(pdf["role"], pdf["a"], pdf["b"]):
                if ROLES[role](a, b):
                    x, y = ({code(w) for w in (stands_for(v) if role == "given" else (v,))} for v in (a, b))
                    rows.append((role, a, b, not x.isdisjoint(y)))
            yield pd.DataFrame(rows, columns=["role", "a", "b", "sound"])

    different = words.select("role", "word").distinct()
    blocks = stored(different.mapInPandas(coded, "role string, word string, blocks array<string>").select("role", "word", F.explode("blocks").alias("block")))
    meet = blocks.withColumnRenamed("word", "a").join(blocks.withColumnRenamed("word", "b"), ["role", "block"]).filter("a < b").select("role", "a", "b").distinct()
    alike = meet.repartition(tasks(words.sparkSession), "a", "b").mapInPandas(compared, "role string, a string, b string, sound boolean")
    alike = stored(alike)
    itself = different.select("role", F.col("word").alias("a"), F.col("word").alias("b"), F.lit(True).alias("sound"))
    return stored(alike.union(alike.select("role", F.col("b").alias("a"), F.col("a").alias("b"), "sound")).union(itself))


def linked(strings: DataFrame) -> DataFrame:
    """strings(kind, text), kind PERSON or ORG, to (kind, text, entity): spellings of one entity share
    the entity, the smallest key among them. Each string has one row per kind.

    Strings that parse to the same name are one class. Their words are compared, each different word
    once (`spellings`), and classes whose words are spellings of each other are joined on these words by
    equality: no two names are compared only because they share a block, so a surname that very many
    have is no hot group. Connected components of these links are the entities. A name with initials
    only joins the one entity that it fits, through nicknames only if it fits none without; if it fits
    several, it stays by itself.
    """
    distinct = strings.filter("text is not null and kind is not null").select("kind", "text").distinct()
    names = stored(keyed(distinct))
    classes = names.groupBy("kind", "key").agg(F.first("letters").alias("letters"))
    rest = F.substring_index("key", "|", -1)
    persons = classes.filter("kind = 'PERSON'").select("key", F.substring_index("key", "|", 1).alias("s"), F.substring_index(rest, " ", 1).alias("g"), F.when(rest.contains(" "), F.substring_index(rest, " ", -1)).otherwise("").alias("m"), "letters")
    persons = stored(persons)
    whole, short = persons.filter("length(g) > 1"), persons.filter("length(g) = 1")
    # firms: each word with the firm's other words
    words = F.split("key", " ")
    firms = classes.filter("kind <> 'PERSON'").select("kind", "key", F.posexplode(words).alias("k", "word"), words.alias("all"))
    firms = stored(firms.select("kind", "key", "word", F.array_join(F.filter("all", lambda w, k: k != F.col("k")), " ").alias("others")).distinct())

    used = persons.select(F.lit("surname").alias("role"), F.col("s").alias("word")).union(whole.select(F.lit("given"), "g")).union(firms.select(F.lit("firm"), "word"))
    alike = spellings(used)
    surnames = alike.filter("role = 'surname'").select(F.col("a").alias("s"), F.col("b").alias("t"), F.col("sound").alias("s_sound"))
    givens = alike.filter("role = 'given'").select(F.col("a").alias("g"), F.col("b").alias("h"), F.col("sound").alias("g_sound"))

    def compatible(x: str, y: str) -> Column:
        n = F.least(F.length(x), F.length(y))
        return F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n)

    other = whole.select(F.col("s").alias("t"), F.col("g").alias("h"), F.col("m").alias("n"), F.col("key").alias("b"))
    known = whole.select("s", "g").distinct()
    near = known.join(surnames, "s").join(givens, "g").filter("s_sound or g_sound").join(known.select(F.col("s").alias("t"), F.col("g").alias("h")), ["t", "h"])
    links = near.join(whole.select("s", "g", "m", F.col("key").alias("a")), ["s", "g"]).join(other, ["t", "h"]).filter(F.col("a") < F.col("b")).filter(compatible("m", "n"))
    links = links.select(F.lit("PERSON").alias("kind"), "a", "b")
    like = alike.filter("role = 'firm' and a <> b").select(F.col("a").alias("word"), F.col("b").alias("instead"))
    twins = firms.select("kind", "others", F.col("word").alias("instead"), F.col("key").alias("b"))
    links = links.union(firms.join(like, "word").join(twins, ["kind", "others", "instead"]).filter("key < b").select("kind", F.col("key").alias("a"), "b"))

    def node(kind: str | Column, key: str) -> Column:
        return F.concat_ws("\u0001", kind, key)

    edges = links.distinct().select(node("kind", "a").alias("a"), node("kind", "b").alias("b"))
    one_letter = short.select(node(F.lit("PERSON"), "key").alias("a"))
    alone = classes.select(node("kind", "key").alias("a"), node("kind", "key").alias("b"))
    full = stored(components(edges.union(alone.join(one_letter, "a", "left_anti"))))
    # names with initials against full names, by surname and letter
    lettered = whole.select(F.col("s").alias("t"), F.explode(F.split("letters", "")).alias("letter"), F.substring("g", 1, 1).alias("first"), F.col("m").alias("n"), F.col("key").alias("b"))
    initials = short.select("s", F.col("g").alias("letter"), "m", F.col("key").alias("a")).join(surnames, "s")
    fits = initials.join(lettered, ["t", "letter"]).filter(compatible("m", "n")).select(node(F.lit("PERSON"), "a").alias("a"), node(F.lit("PERSON"), "b").alias("node"), (F.col("letter") == F.col("first")).alias("plainly"))
    fits = fits.distinct().join(full, "node")
    fits = stored(
        fits.withColumn("own", F.when(F.col("plainly"), F.col("root"))).groupBy("a").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.min("root").alias("root"), F.max("root").alias("other"))
    )
    one = fits.filter("coalesce(low = high, root = other)").select("a", F.coalesce("low", "root").alias("b"))
    # initials that fit no full name are spellings of each other
    free = initials.withColumn("node", node(F.lit("PERSON"), "a")).join(fits.select(F.col("a").alias("node")), "node", "left_anti")
    loose = free.select(F.col("s").alias("t"), "letter", F.col("m").alias("n"), F.col("node").alias("b")).distinct()
    among = free.select("t", "letter", "m", F.col("node").alias("a")).join(loose, ["t", "letter"]).filter("a < b").filter(compatible("m", "n")).select("a", "b").distinct()
    roots = components(full.select(F.col("node").alias("a"), F.col("root").alias("b")).union(one).union(among).union(alone))
    return names.select("kind", "text", node("kind", "key").alias("node")).join(roots, "node").select("kind", "text", F.col("root").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """name_a < name_b (by code point) for all different strings of one entity; each pair once."""
    a = entities.select("entity", F.col("text").alias("name_a"))
    b = entities.select("entity", F.col("text").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
