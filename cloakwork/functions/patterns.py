"""Pattern recognizers: what to look for, how sure a hit is, and which words nearby make it surer."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """A regular expression of a recognizer. check names a function of `checks`, or is empty."""

    entity: str
    name: str
    regex: str
    score: float
    check: str = ""


# Entity types, expressions and scores.
PATTERNS = (
    Pattern("SSN", "ssn_dashes", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.85),
    Pattern("SSN", "ssn_nodashes", r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b", 0.50),
    Pattern("NPI", "npi_10digit", r"\b[12]\d{9}\b", 0.65),
    Pattern("EIN", "ein_standard", r"\b(?!00)\d{2}-\d{7}\b", 0.75),
    Pattern("ICD10_CODE", "icd10_full", r"\b[A-TV-Z][0-9][0-9AB](?:\.[0-9A-TV-Z]{1,4})?\b", 0.70),
    Pattern("CPT_CODE", "cpt_5digit", r"\b[0-9]{5}(?:-[A-Z0-9]{2})?\b", 0.60),
    Pattern("POLICY_NUM", "policy_pol_prefix", r"\bPOL-[A-Z0-9]{7,}\b", 0.90),
    Pattern("POLICY_NUM", "policy_generic", r"\b[A-Z]{2,4}[0-9]{6,10}\b", 0.55),
    Pattern("US_BANK_NUMBER", "routing_9digit", r"\b(?:0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-2]|7[1-2])\d{7}\b", 0.70, "aba"),
    Pattern("ADJUSTER_ID", "adjuster_adj_prefix", r"\bADJ-?[A-Z0-9]{4,10}\b", 0.85),
    Pattern("ADJUSTER_ID", "adjuster_generic", r"\b[A-Z]{1,3}\d{5,8}\b", 0.50),
    Pattern("CLAIM_REF", "claim_clm_prefix", r"\b(?:CLM|CLA|CLAIM)-[A-Z0-9]{6,15}\b", 0.90),
    Pattern("CLAIM_REF", "claim_numeric", r"\b\d{10,14}\b", 0.45),
    Pattern("DEA_NUM", "dea_standard", r"\b[A-Z]{2}\d{7}\b", 0.75),
    Pattern("CREDIT_CARD", "cc_16_spaced", r"\b(?:\d[ -]?){12,18}\d\b", 0.65, "luhn"),
    Pattern("CREDIT_CARD", "cc_compact", r"\b\d{13,19}\b", 0.65, "luhn"),
    Pattern("SWIFT_BIC_CODE", "swift_bic_11", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}[A-Z0-9]{3}\b", 0.40),
    Pattern("SWIFT_BIC_CODE", "swift_bic_8", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}\b", 0.40),
    Pattern("CREDIT_CARD_SECURITY_CODE", "cvv_3_4_digit", r"\b\d{3,4}\b", 0.40),
    Pattern("PHONE_NUMBER", "phone_us_10digit", r"(?<![+:\w])(?:\+1[\s.\-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[\s.\-]?[2-9]\d{2}[\s.\-]?\d{4}(?!\d)", 0.65),
    Pattern("PHONE_NUMBER", "phone_international", r"(?<![a-zA-Z0-9])\+[1-9]\d{0,2}[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{2,4}[\s.\-]?\d{2,4}(?:[\s.\-]?\d{2,4})?(?!\d|:)\b", 0.60),
    Pattern("LOCATION", "us_street_address", r"\b\d{1,5}\s+(?:[A-Z][A-Za-z]*\s+){1,4}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl|Circle|Trail|Terrace|Parkway|Pkwy|Highway|Hwy|Square|Estates|Lodge|Plaza|Commons)\b", 0.65),
    Pattern("US_ITIN", "itin_dashes", r"\b9\d{2}-\d{2}-\d{4}\b", 0.65),
    Pattern("US_ITIN", "itin_spaces", r"\b9\d{2} \d{2} \d{4}\b", 0.55),
    Pattern("US_PASSPORT", "us_passport_letter_digits", r"\b[A-Z]\d{8}\b", 0.65),
    Pattern("US_PASSPORT", "us_passport_alphanumeric", r"\b[A-Z][A-Z0-9]{8}\b", 0.45),
)

# Words that make a hit of the entity surer.
CONTEXT = {
    "SSN": ("ssn", "social security", "social security number", "taxpayer", "tin", "tax id"),
    "NPI": ("npi", "national provider", "provider id", "provider identifier", "rendering provider", "billing provider"),
    "EIN": ("ein", "employer identification", "federal tax", "fein", "tax id", "employer id"),
    "ICD10_CODE": ("icd", "icd-10", "icd10", "diagnosis", "dx", "primary diagnosis", "secondary diagnosis", "principal diagnosis", "condition code"),
    "CPT_CODE": ("cpt", "procedure code", "procedure", "hcpcs", "service code", "billing code", "revenue code"),
    "POLICY_NUM": ("policy", "policy number", "policy no", "policy #", "pol no", "insurance policy", "policy id"),
    "US_BANK_NUMBER": ("routing", "routing number", "aba", "aba number", "aba routing", "bank routing", "transit number", "wire transfer"),
    "ADJUSTER_ID": ("adjuster", "adjuster id", "claims adjuster", "adjuster number", "assigned adjuster", "handling adjuster"),
    "CLAIM_REF": ("claim", "claim number", "claim no", "claim #", "claim ref", "claim reference", "clm", "loss ref", "file number"),
    "DEA_NUM": ("dea", "dea number", "dea registration", "drug enforcement", "prescriber", "controlled substance"),
    "CREDIT_CARD": ("credit", "debit", "card", "visa", "mastercard", "maestro", "amex", "discover", "payment", "card number", "cc", "cvv"),
    "SWIFT_BIC_CODE": ("swift", "bic", "swift code", "bic code", "bank identifier", "international transfer", "wire", "iban", "bank code"),
    "CREDIT_CARD_SECURITY_CODE": ("cvv", "cvc", "cvc2", "cvv2", "cid", "security code", "card verification", "card security"),
    "PHONE_NUMBER": ("phone", "mobile", "cell", "tel", "telephone", "fax", "contact", "call", "number", "ph", "ph.", "ext"),
    "LOCATION": ("address", "addr", "street", "residence", "located at", "resides at", "home address", "mailing address", "billing address"),
    "US_ITIN": ("itin", "individual taxpayer", "tax id", "taxpayer identification", "taxpayer id", "irs", "w-7", "form w7"),
    "US_PASSPORT": ("passport", "passport number", "passport no", "passport #", "us passport", "american passport", "travel document"),
}

#: Types that general recognizers add: mail and network addresses, account numbers, dates.
GENERAL = (
    Pattern("EMAIL_ADDRESS", "email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 1.0),
    Pattern("IP_ADDRESS", "ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.6),
    Pattern("IBAN_CODE", "iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5, "iban"),
    Pattern("DATE_TIME", "date", r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 0.6),
    Pattern("MAC_ADDRESS", "mac", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 0.6),
    Pattern("US_DRIVER_LICENSE", "license", r"\b[A-Z]\d{3}-\d{4}-\d{4}\b", 0.4),
)

_by_name = {p.name: p.regex for p in PATTERNS}
#: The plain baseline: every match of every expression counts, without scores, checks or context.
BASELINE = (
    Pattern("SSN", "base_ssn", _by_name["ssn_dashes"], 1.0),
    Pattern("SSN", "base_ssn_plain", _by_name["ssn_nodashes"], 1.0),
    Pattern("PHONE_NUMBER", "base_phone", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 1.0),
    Pattern("EMAIL", "base_email", GENERAL[0].regex, 1.0),
    Pattern("DATE", "base_date", GENERAL[3].regex, 1.0),
    Pattern("DATE_OF_BIRTH", "base_birth", r"\b(?:DOB|D\.O\.B|born)\s*:?\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", 1.0),
    Pattern("ZIP", "base_zip", r"\b\d{5}(?:-\d{4})?\b", 1.0),
    Pattern("NPI", "base_npi", _by_name["npi_10digit"], 1.0),
    Pattern("EIN", "base_ein", _by_name["ein_standard"], 1.0),
    Pattern("ICD10_CODE", "base_icd10", _by_name["icd10_full"], 1.0),
    Pattern("DEA_NUM", "base_dea", _by_name["dea_standard"], 1.0),
    Pattern("POLICY_NUM", "base_policy", _by_name["policy_pol_prefix"], 1.0),
    Pattern("CLAIM_REF", "base_claim", _by_name["claim_clm_prefix"], 1.0),
    Pattern("BANK_ROUTING_NUMBER", "base_routing", _by_name["routing_9digit"], 1.0),
    Pattern("IPV4", "base_ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 1.0),
)


_ATOM = r"(?:[A-Za-z0-9_]|\\d|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9_])+\])(?:\?|\*|\+|\{\d+(?:,\d*)?\})?"
_WORD = re.compile(rf"\\b((?:{_ATOM}|\(\?:(?:{_ATOM}|\|)+\)(?:\?|\*|\+|\{{\d+(?:,\d*)?\}})?)+)\\b")


def word_only(regex: str) -> str:
    """What stands between the two word boundaries of an expression whose matches are whole words: letters,
    digits and underscores only. Empty for any other expression."""
    found = _WORD.fullmatch(regex)
    return found[1] if found else ""


_FIRST = re.compile(r"(\\d|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9_])+\]|[A-Za-z0-9_])(?![?*]|\{0)")


def firsts(regex: str) -> str:
    """The characters with which a match may begin, where an expression shows them plainly: a word boundary,
    then a digit, letter, underscore or class of these, or a group of such beginnings. Empty for any other."""
    group = re.match(r"\\b\(\?:([^()]*)\)(?![?*]|\{0)", regex)
    rest = re.sub(r"\\.|\[[^\]]*\]", "", regex)
    while (inner := re.sub(r"\([^()]*\)", "", rest)) != rest:
        rest = inner
    found = [_FIRST.match(x) for x in (group[1].split("|") if group else [regex[2:]])]
    if not regex.startswith(r"\b") or "|" in rest or not all(found):
        return ""
    own = re.compile("|".join(m[1] for m in found), re.ASCII)
    return "".join(c for c in string.digits + string.ascii_letters + "_" if own.fullmatch(c))


def ahead(*regexes: str) -> str:
    """A look at the next character, to be put before expressions: it takes less time than a word boundary
    and changes no match. Empty where one of them doesn't show how its matches begin."""
    some = [firsts(r) for r in regexes]
    chars = "".join(sorted(set("".join(some)))) if all(some) else ""
    for run in (string.digits, string.ascii_uppercase, string.ascii_lowercase):
        chars = chars.replace(run, f"{run[0]}-{run[-1]}")
    return f"(?=[{chars}])" if chars else ""


class Registry:
    """An immutable set of patterns; `add` and `remove` give new ones."""

    def __init__(self, patterns: tuple[Pattern, ...] = PATTERNS + GENERAL):
        self.patterns = tuple(patterns)

    def add(self, *patterns: Pattern) -> Registry:
        return Registry(self.patterns + patterns)

    def remove(self, *entities: str) -> Registry:
        return Registry(tuple(p for p in self.patterns if p.entity not in entities))

    def only(self, *entities: str) -> Registry:
        return Registry(tuple(p for p in self.patterns if p.entity in entities))

    def entities(self) -> list[str]:
        return sorted({p.entity for p in self.patterns})
