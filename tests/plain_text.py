"""Plain Python forms of text operators, written from their rules, for tests by value."""

import re
import unicodedata

from sifterra.functions.text import ANSWER_LETTERS, ANSWER_PATTERNS, CHARACTER_MAP, ERROR_PREFIXES, LRI, PDI

SCRIPT = "[؀-ۿݐ-ݿ]"


def characters(x):
    if x is None or x.isascii():
        return x
    folded = unicodedata.normalize("NFKC", x)
    return unicodedata.normalize("NFC", "".join(CHARACTER_MAP.get(c, c) for c in folded))


def isolates(x):
    if x is None or LRI in x or PDI in x or not re.search("[A-Za-z0-9]", x):
        return x
    if not re.search(SCRIPT, x):
        return LRI + x + PDI
    out = ""
    for part in re.split(f"({SCRIPT})", x):
        if re.search("[A-Za-z0-9]", part) and not re.fullmatch(SCRIPT, part):
            core = part.strip()
            at = part.index(core)
            part = part[:at] + LRI + core + PDI + part[at + len(core) :]
        out += part
    return out


def parse_key(x):
    text = (x or "").strip()
    if not text or text.startswith(ERROR_PREFIXES):
        return None
    letters = "".join(ANSWER_LETTERS)
    patterns = [p.replace("(K)", f"([ABCD{letters}])") for p in ANSWER_PATTERNS]
    patterns.append(f"(?:^|[\\s(\\[.,:;])([{letters}])(?:[\\s).,:;\\-]|$)")
    for i, p in enumerate(patterns):
        found = re.search(p, text, 0 if i == len(patterns) - 1 else re.IGNORECASE)
        if found:
            return ANSWER_LETTERS.get(found[1], found[1].upper())
    return None
