"""Fixed values that the results depend on: word lists, patterns and replacement rules of each profile.

Profiles: P production, C two-model ensemble, V6 older pipeline, L basic.
"""

from __future__ import annotations

# Legal suffixes, by profile.
_LEGAL_COMMON = (
    "pvt private ltd limited inc incorporated corp corporation llc llp co company enterprises enterprise industries group "
    "services solutions technologies holdings assoc associates plc bv gmbh sa sarl"
).split()
LEGAL = {
    "L": _LEGAL_COMMON,
    "V6": _LEGAL_COMMON + "eurl sas sci snc".split(),
    "C": _LEGAL_COMMON + "sas eurl sci snc gie sca scs".split(),
    "IDF": _LEGAL_COMMON + "sas eurl sci snc gie sca scs selarl".split(),
    "P": _LEGAL_COMMON + "sas sasu eurl sci snc gie sca scs fils".split(),
}

# Generic business words, by profile.
_GENERIC_COMMON = (
    "store stores shop mart market supermarket agency agencies traders trading hotel restaurant cafe bazaar jewellers jewellery "
    "textiles pharmacy chemist auto garage consultants consultancy logistics transports centre center foods retail wholesale "
    "supply supplies commercial"
).split()
_GENERIC_FRENCH = (
    "agence agences societe societes boulangerie coiffure boucherie epicerie atelier ateliers commerce commerces batiment "
    "menuiserie plomberie electricite tabac"
).split()
GENERIC = {
    "L": [],
    "V6": _GENERIC_COMMON,
    "C": _GENERIC_COMMON + _GENERIC_FRENCH,
    "P": _GENERIC_COMMON + _GENERIC_FRENCH + "ecole club amicale".split(),
}

# Stop words of profile L, and words that make no address key in profile P.
STOPWORDS = "and & of the in at for by near opp opposite".split()
KEY_STOPWORDS = "street road avenue boulevard lane drive apt suite".split()

# Patterns. All are applied to text folded to ASCII.
DOMAIN_COMPAT = r"(?i)(https?://)?(www\.)?([a-zA-Z0-9\-]+)(\.com|\.in|\.org|\.net|\.co|\.fr|\.io|\.biz|\.info|\.edu|\.gov)(/[^\s]*)?"
DOMAIN_STRICT = r"(?i)(https?://)?(www\.)?([a-zA-Z0-9\-]+)(\.com|\.info|\.in|\.org|\.net|\.co|\.fr|\.io|\.biz|\.edu|\.gov)\b(/[^\s]*)?"
DOMAIN_STRIP = r"(?i)(\.com|\.in|\.org|\.net|\.co|\.fr|\.io|\.biz|\.info|www\.)"
DOOR = r"\b([A-Za-z]{0,3})[-/]?0*(\d{1,5})([A-Za-z]?)\b"
PIN = r"\b(\d{5,6})\b"
PHONE = r"\b\d{7,10}\b"
CEDEX = r"(?i)\bcedex\s*\d*\b"
DIGITS = r"\b\d{3,6}\b"

# Spellings that transliteration produces, in the order of application.
PHONETIC = [
    (r"\b(praaivett\s+limittedd|praivet\s+limited|praaivet\s+limiteed)\b", "pvt ltd"),
    (r"\b(elelpii|elelpi)\b", "llp"),
    (r"\b(elelsii|elelsi)\b", "llc"),
    (r"\b(limittedd|limiteed)\b", "ltd"),
    (r"\b(praaivett|praivet)\b", "pvt"),
    (r"\b(innnvesttmenntts|investmennts|invesstment)\b", "investments"),
    (r"\b(pronprttiij|prapartiij|properrties)\b", "properties"),
    (r"\b(vencrs|vennchars|venchers)\b", "ventures"),
    (r"\b(ennttrrpraaizej|entrpraij)\b", "enterprises"),
    (r"\b(saolyuushnns|solyushans)\b", "solutions"),
    (r"\b(ttteknnolaojiij|teknolaji)\b", "technologies"),
]
CORPORATE = [
    (r"\bprivate\s+limited\b", "pvt ltd"),
    (r"\bincorporated\b", "inc"),
    (r"\bcorporation\b", "corp"),
    (r"\bcompany\b", "co"),
    (r"\blimited\b", "ltd"),
]

# Address abbreviations, by profile.
_ADDRESS_COMMON = {
    "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "apt": "apartment", "ste": "suite", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "sq": "square", "pkwy": "parkway", "cir": "circle", "hwy": "highway", "opp": "opposite", "nr": "near", "sec": "sector", "sect": "sector",
    "ph": "phase", "flr": "floor", "fl": "floor", "col": "colony", "mrg": "marg", "bldg": "building", "cplx": "complex", "bd": "boulevard", "bld": "boulevard",
    "av": "avenue", "imp": "impasse", "all": "allee", "rte": "route", "ch": "chemin",
}
ADDRESS = {
    "P": _ADDRESS_COMMON | {"r": "rue"},
    "V6": _ADDRESS_COMMON,
    "L": {k: _ADDRESS_COMMON[k] for k in ("st", "rd", "ave", "blvd", "apt")},
    "C": {},
}

# Latin letters with marks and the letters they fold to; letters that fold to two.
ACCENTS = (
    "ÀÁÂÃÄÅàáâãäåĀāĂăĄąÇçĆćČčĎďĐđÈÉÊËèéêëĒēĖėĘęĚěĞğÌÍÎÏìíîïĪīĮįİıŁłÑñŃńŇňÒÓÔÕÖØòóôõöøŌōŐőŘřŚśŞşŠšŢţŤťÙÚÛÜùúûüŪūŮůŰűŲųÝýŸÿŹźŻżŽž",
    "AAAAAAaaaaaaAaAaAaCcCcCcDdDdEEEEeeeeEeEeEeEeGgIIIIiiiiIiIiIiLlNnNnNnOOOOOOooooooOoOoRrSsSsSsTtTtUUUUuuuuUuUuUuUuYyYyZzZzZz",
)
LIGATURES = {"ß": "ss", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "’": "'", "‘": "'", "–": "-", "—": "-"}

# Latin spelling at each offset of an Indic script block (Devanagari, Bengali, Tamil, Telugu and Kannada
# lay out their letters alike). Consonants carry no vowel of their own.
INDIC_BLOCKS = [0x0900, 0x0980, 0x0B80, 0x0C00, 0x0C80]
INDIC = {
    0x01: "n", 0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "r", 0x0C: "l", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "c", 0x1B: "ch",
    0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "tt", 0x20: "tth", 0x21: "dd", 0x22: "ddh", 0x23: "nn", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh",
    0x28: "n", 0x29: "nnn", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "rr", 0x32: "l", 0x33: "ll", 0x34: "lll",
    0x35: "v", 0x36: "sh", 0x37: "ss", 0x38: "s", 0x39: "h", 0x3C: "", 0x3D: "", 0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "r",
    0x44: "rr", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: "",
}


def indic_to_first_block() -> tuple[str, str]:
    """Letters and digits of the other blocks, and those at the same place of the first one."""
    places = [*INDIC, *range(0x66, 0x70)]
    return tuple("".join(chr(b + k) for block in INDIC_BLOCKS[1:] for k in places for b in [block if side == 0 else INDIC_BLOCKS[0]]) for side in (0, 1))


def indic_letters() -> dict[str, str]:
    """Letter of the first block -> spelling, digits included."""
    return {chr(INDIC_BLOCKS[0] + k): v for k, v in INDIC.items()} | {chr(INDIC_BLOCKS[0] + 0x66 + d): str(d) for d in range(10)}
