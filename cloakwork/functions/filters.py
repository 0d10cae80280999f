"""Which spans name organisations and persons, and what kinds of form fields there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.text import blank, strip, words

# Role words and labels that are taken for organisations.
ROLES = (
    "client", "vendor", "service provider", "service providers", "contractor", "subcontractor", "counterparty", "counterparties",
    "party", "parties", "provider", "providers", "supplier", "suppliers", "recipient", "recipients", "grantee", "grantor",
    "lessor", "lessee", "borrower", "lender", "creditor", "debtor", "payer", "payee", "issuer", "obligor",
    "customer service", "customer support", "support", "department", "division", "branch", "unit", "group",
    "healthcare service", "healthcare services", "property", "utilities", "service", "services",
    "report", "report - renewal options", "summary", "agreement", "contract", "policy",
    "sender wallet", "sender country", "receiver wallet", "swapdetails", "tradedetails",
    "ai", "pii", "api", "edi", "xml", "fpml",
)
# Terms one of which must stand near a short name of an organisation.
FINANCIAL = (
    "employer", "employed", "employment", "employee", "workplace", "works at", "worked at", "working at", "place of employment",
    "lender", "borrower", "bank", "banking", "financial institution", "policyholder", "insured", "insurer", "insurance company",
    "inc.", "llc", "ltd.", "corp.", "gmbh", "s.a.", "plc", "hb", "inc,", "llc,", "ltd,",
)
# Legal forms, as words of long spans and as endings of short ones.
LEGAL_WORDS = ("inc", "llc", "ltd", "corp", "gmbh", "plc", "hb", "sa", "s.a", "co")
LEGAL_ENDINGS = ("inc.", "llc", "ltd.", "corp.", "gmbh", "s.a.", "plc", "hb", " inc", " llc", " ltd", " corp", " co")
# Single words that are taken for persons.
NOT_PERSONS = (
    "email", "phone", "address", "date", "name", "vendor", "client", "provider", "department", "service", "agent",
    "admin", "user", "customer", "contact", "manager", "officer", "director", "representative", "rep", "staff", "team",
)
# Labels of fields whose values must be redacted, and of fields that name institutions.
HIGH_VALUE = (
    "employer", "employer name", "employer's name", "place of employment", "patient name", "patient's name", "insured name",
    "insured's name", "policyholder", "claimant", "claimant name", "subscriber", "guarantor", "responsible party",
    "guarantor name", "referring physician", "attending physician", "rendering provider name", "employee", "insured",
    "patient", "claimant's name", "member name", "employee name",
)
LOW_VALUE = (
    "insurer", "insurance company", "payer", "payer name", "court", "agency", "department", "issuing authority",
    "insurance plan", "plan name", "carrier", "carrier name", "group name",
)
# Entity types by the names that other label sets give them.
LABELS = {
    "NAME": "PERSON", "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON", "COMPANY": "ORG", "STREET_ADDRESS": "LOCATION",
    "LOCAL_LATLNG": "LOCATION", "PHONE_NUMBER": "PHONE_NUMBER", "EMAIL": "EMAIL_ADDRESS", "DATE": "DATE_TIME",
    "DATE_OF_BIRTH": "DATE_TIME", "DATE_TIME": "DATE_TIME", "SSN": "US_SSN", "BANK_ROUTING_NUMBER": "US_BANK_NUMBER",
    "ROUTING_NUM": "US_BANK_NUMBER", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "CREDIT_CARD_SECURITY_CODE": "CREDIT_CARD_SECURITY_CODE",
    "SWIFT_BIC_CODE": "SWIFT_BIC_CODE", "BBAN": "BBAN", "ACCOUNT_PIN": "ACCOUNT_PIN", "PASSWORD": "PASSWORD", "API_KEY": "NRP",
    "USER_NAME": "NRP", "ZIP": "ZIP_CODE", "IPV4": "IP_ADDRESS", "IPV6": "IP_ADDRESS", "EIN": "NRP", "NPI": "NRP",
    "TIME": "DATE_TIME", "IBAN": "IBAN_CODE", "PASSPORT_NUMBER": "US_PASSPORT", "DRIVER_LICENSE_NUMBER": "US_DRIVER_LICENSE",
    "CUSTOMER_ID": "NRP", "EMPLOYEE_ID": "NRP", "PERSON": "PERSON", "ORG": "ORG", "ORGANIZATION": "ORG", "LOC": "LOCATION",
    "DEM": "NRP", "CODE": "NRP", "DATETIME": "DATE_TIME", "QUANTITY": "NRP", "MISC": "NRP",
}
# Labels of receipts, by two data sets.
RECEIPT_LABELS = {"company": "ORG", "date": "DATE_TIME", "address": "LOCATION", "total": "TOTAL"}
TILL_LABELS = {"store_name": "ORG", "store_addr": "LOCATION", "total_price": "TOTAL", "tax_price": "DATE_TIME"}
# Entity types of the prompts put to a zero-shot model.
PROMPTS = {
    "person name": "PERSON", "patient name": "PERSON", "insured name": "PERSON", "employer organization": "ORG",
    "employer organization name": "ORG", "social security number": "US_SSN", "ssn": "US_SSN", "date of birth": "DATE_TIME",
    "phone number": "PHONE_NUMBER", "email address": "EMAIL_ADDRESS", "insurance policy number": "POLICY_NUM",
    "policy number": "POLICY_NUM", "street address": "LOCATION", "patient address": "LOCATION",
    "national provider identifier": "NPI", "npi": "NPI", "employer identification number": "EIN", "ein": "EIN",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for key, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def normal_label(label: Column) -> Column:
    upper = F.upper(label)
    return F.coalesce(lookup(LABELS, upper), upper)


def any_of(texts: tuple[str, ...], test) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | test(t)
    return out


def is_org(span: Column, context: Column | None = None) -> Column:
    """Whether a span reads as an organisation's name; never null.

    Not: blanks, role words, acronyms of two to six capitals, technical text, a lower-case start, more
    than six words without a legal form. Up to two words without a legal ending need a financial term in
    the context, if there is a context.
    """
    s = strip(F.coalesce(span, F.lit("")))
    low, w = F.lower(s), words(s)
    ctx = F.lower(F.coalesce(context, F.lit(""))) if context is not None else F.lit("")
    long_ok = F.exists(w, lambda x: F.regexp_replace(F.lower(x), ",+$", "").isin(*LEGAL_WORDS))
    ending = any_of(LEGAL_ENDINGS, lambda e: low.endswith(e))
    near = any_of(FINANCIAL, lambda t: ctx.contains(t))
    bad = (
        (s == "")
        | low.isin(*ROLES)
        | s.rlike(r"^[A-Z]{2,6}$")
        | s.rlike(r"[=<>{}/\\@]")
        | s.rlike(r"(?i)https?://|xsi:|xmlns:|schemaLocation")
        | s.rlike(r"^\p{Ll}")
        | ((F.size(w) > 6) & ~long_ok)
        | (~ending & (F.size(w) <= 2) & (ctx != "") & ~near)
    )
    return ~bad


def is_person(span: Column) -> Column:
    """Whether a span may be a person's name: no blank, no single label word, no lower-case start."""
    s = strip(F.coalesce(span, F.lit("")))
    return (s != "") & ~((F.size(words(s)) == 1) & F.lower(s).isin(*NOT_PERSONS)) & ~s.rlike(r"^\p{Ll}")


def looks_like_name(text: Column) -> Column:
    """2 to 60 letters, blanks, hyphens, points and apostrophes, with a capital first; no label word."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.length(s).between(2, 60) & s.rlike(r"^\p{Lu}") & s.rlike(r"^[A-Za-z\s\-.']+$") & ~F.lower(s).isin(*NOT_PERSONS)


def high_value(label: Column) -> Column:
    return strip(F.lower(F.coalesce(label, F.lit("")))).isin(*HIGH_VALUE)


def low_value(label: Column) -> Column:
    return strip(F.lower(F.coalesce(label, F.lit("")))).isin(*LOW_VALUE)


def sane_model_hit(span: Column, entity: Column) -> Column:
    """Whether a model's hit has the format of its type."""
    s = strip(F.coalesce(span, F.lit("")))
    return (s != "") & (
        F.when(entity == "EMAIL_ADDRESS", s.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"))
        .when(entity == "PHONE_NUMBER", F.length(F.regexp_replace(s, r"\D", "")) >= 7)
        .when(entity == "US_SSN", s.rlike(r"\d{3}[-\s]?\d{2}[-\s]?\d{4}"))
        .when(entity.isin("NPI", "EIN"), s.rlike(r"\d"))
        .otherwise(F.lit(True))
    )


# The commonest short words of languages whose texts meet in one corpus.
COMMON = {
    "en": "the of and to in is was for that on with by as at it from this be are have not or an has were will which his her their our your",
    "es": "el la los las un una de del y en es fue por para que se con no lo su como pero este esta sin sobre entre cuando hay",
    "fr": "le la les un une de des du et au aux en est par pour que qui se sur avec ne pas ce cette son sa ses dans ou nous vous",
    "de": "der die das den dem des ein eine einen und zu in im ist war wurde hat auf von mit nicht als an am bei nach noch aus sich es sie",
    "it": "il lo la gli le un una di del della dei e al alla in nel per che si con non su ci come da dal dalla sono",
    "pt": "o os as um uma de do da dos das e em no na para que se com não ao por mais foi como seu sua quando",
    "nl": "de het een van en in is was te op voor met niet aan er dat die zijn wordt heeft door om bij als of maar naar",
}


def english(context: Column) -> Column:
    """Whether a text reads as English: of the commonest words of each language, no other language has more
    in it. Texts under ten characters, and texts without words, pass."""
    w = words(F.lower(context))

    def among(common: str) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*common.split())))

    count = {k: among(v) for k, v in COMMON.items()}
    others = F.greatest(*[n for k, n in count.items() if k != "en"])
    return blank(context) | (F.length(context) < 10) | (F.size(w) == 0) | (count["en"] >= others)
