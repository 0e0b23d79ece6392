"""Names of agents as registries write them, brought to one spelling.

A name is cut into parts at `+`, `/`, `and`, `plus`. Doses, forms, arms and acronyms go; a part that names only what is done
beside the agent goes; the others are joined as one combination. Null, and a text that names no agent, give null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.text import given

# The words, units and spellings of the names, as the results need them.
UNITS = ("mg", "mcg", "µg", "ug", "g", "ml", "iu", "%")
PER = ("kg", "ml", "dl", "day", "hr", "hour", "dose", "m2")
FORMS = (
    "capsules?", "tablets?", "(?<!triple )pills?", "granules?", "gel", "ointment", "oral", "sublingual", "intravenous", "iv",
    r"(?:for\s+)?injections?", "solutions?", "suspensions?", "sustained-release", "extended-release", "dropping",
    "prescription", "daily", r"once\s+daily", "qd", "bid", "tid", "xl", "cr", "sr", "tabs?",
)
ARM_DOSES = ("high", "low", "medium", "standard", "intensive")
BESIDE = (
    "therapy", "therapies", "treatment", "training", "rehabilitation", "exercise", "counselling", "counseling", "education",
    "care", "management", "regimen", "recommendations?", "group", "placebos?",
)
ARM_WORDS = (
    "the", "a", "an", "regular", "usual", "standard", "conventional", "background", "routine", "active", "control",
    "comparator", "best", "supportive", "basic", "intensive", "normal", "sham",
)
ABBREVIATIONS = {"ismn": "isosorbide mononitrate", "asa": "acetylsalicylic acid", "nbp": "butylphthalide"}
BRANDS = {
    "zydena (udenafil)": "Udenafil",
    "akatinol memantine": "Memantine",
    "donepezil hydrochloride (aricept)": "Donepezil",
}
SALTS = {
    "donepezil hydrochloride": "Donepezil",
    "donepezil hcl": "Donepezil",
    "lidocaine hydrochloride": "Lidocaine",
    "atorvastatin calcium": "Atorvastatin",
    "galantamine hydrobromide": "Galantamine",
    "n acetylcysteine": "Acetylcysteine",
}

# End of fixed values.

_FLAGS = "(?iU)"
_DOSE = rf"{_FLAGS}\b\d+(?:\.\d+)?\s*(?:{'|'.join(UNITS)})(?!\w)(?:\s*/\s*(?:\d+(?:\.\d+)?\s*)?(?:{'|'.join(PER)})\b)?"
_FORM = rf"{_FLAGS}\b(?:soft\s+)?(?:{'|'.join(FORMS)})\b"
_ARM = rf"{_FLAGS}^(?:very\s+)?(?:{'|'.join(ARM_DOSES)})\s+dose\s+(?:group\s+)?(?:of\s+)?"
_HEAD = rf"{_FLAGS}\s*\b(?:{'|'.join(BESIDE)})\b\s*$"
_ACRONYM = r"(?U)\s*\([A-Z0-9][A-Z0-9-]{0,11}\)\s*$"
_SPLIT = rf"{_FLAGS}\s*(?:\+|/|\band\b|\bplus\b)\s*"
_EDGE = r"(?U)^[\s,;:+/-]+|[\s,;:+/-]+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _mapped(c: Column, words: Mapping[str, str]) -> Column:
    """The entry of a lower-case text, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), F.lower(c))


def _first(c: Column, case) -> Column:
    """The first letter in another case, if the first word has no capital behind it."""
    word = F.regexp_extract(c, r"(?U)^(\S*)", 1)
    return F.when(F.substr(word, F.lit(2)).rlike(r"\p{Lu}"), c).otherwise(F.concat(case(F.substring(c, 1, 1)), F.substr(c, F.lit(2))))


def _cleaned(part: Column) -> Column:
    stem = F.trim(F.regexp_replace(part, _ACRONYM, ""))
    named = F.when(stem == "", part).otherwise(stem)
    for pattern, by in ((_ARM, ""), (_DOSE, " "), (_FORM, " "), (r"(?U)\s{2,}", " ")):
        named = F.regexp_replace(named, pattern, by)
    return given(_trim(named), lambda x: F.coalesce(_mapped(x, ABBREVIATIONS), x))


def _agent(part: Column) -> Column:
    """The agent of a part; null if it names what is done beside one: only words of arms, or several without a capital or digit."""

    def judged(rest: Column) -> Column:
        words = F.split(F.lower(rest), r"(?U)\s+")
        generic = F.forall(words, lambda w: w.isin(*ARM_WORDS))
        return F.when((rest != "") & ~generic & ((F.size(words) == 1) | rest.rlike("[A-Z0-9]")), rest)

    expanded = F.lower(part).isin(*ABBREVIATIONS.values())
    return F.when(expanded | ~part.rlike(_HEAD), part).otherwise(given(_trim(F.regexp_replace(part, _HEAD, "")), judged))


def agent_name(c: Column) -> Column:
    """`a, b and c` for a combination, with a capital; listed salts and brands by their ingredient.

    Of agents behind the first the first letter is lowered, unless the word has a capital of its own further on.
    """

    def joined(agents: Column) -> Column:
        tail = F.transform(agents, lambda x, i: F.when(i == 0, x).otherwise(_first(x, F.lower)))
        n = F.size(tail)
        listed = F.when(n < 2, F.array_join(tail, "")).otherwise(F.concat(F.array_join(F.slice(tail, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(tail, -1)))
        folded = given(listed, lambda x: F.coalesce(_mapped(x, BRANDS), _mapped(x, SALTS), _first(x, F.upper)))
        return F.when(n > 0, folded)

    parts = F.filter(F.split(_trim(F.regexp_replace(c, _DOSE, " ")), _SPLIT), lambda x: x != "")
    agents = F.transform(F.filter(F.transform(parts, _cleaned), lambda x: x != ""), _agent)
    return given(F.filter(agents, lambda x: x.isNotNull()), joined)
