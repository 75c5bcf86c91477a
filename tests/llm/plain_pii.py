"""Personal data in plain Python: the same detection rules and surrogates, text by text."""

import hashlib

import regex

from sifterra.llm import pii

WHOLE = {k: regex.compile("(?:" + p.replace(r"(?<![\d.])", "").replace(r"(?<!\p{L})", "") + ")", regex.ASCII) for k, p in pii.PATTERNS.items()}
FIND = regex.compile(pii.DETECT, regex.ASCII)
HEAD = regex.compile(r"""^[^=:]*[=:]\s{0,3}(?:\\?["'])?""")
COUNTRY = regex.compile(r"^[+](?:1(?=[^0-9]?[(]?[0-9]{3}[^0-9]?[0-9]{3}[^0-9]?[0-9]{4}$)|[0-9]{1,3}(?=[ .(-])|)")


def _permuted(value, alphabets, salt):
    chars = list(value)
    for r in range(6):
        others = "".join(c for i, c in enumerate(chars) if i % 2 != r % 2)
        digest = hashlib.sha256(f"{salt}|{r}|{len(chars)}|{others}".encode()).hexdigest()
        for i, c in enumerate(chars):
            alphabet = next((a for a in alphabets if c in a), None)
            if i % 2 == r % 2 and alphabet:
                at = i * 4 % 60
                chars[i] = alphabet[(alphabet.index(c) + int(digest[at : at + 4], 16) + i) % len(alphabet)]
    return "".join(chars)


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def _hex(v):
    return 1 if regex.fullmatch("[0-9a-f]+", v) else 2 if regex.fullmatch("[0-9A-F]+", v) else 0


def surrogate(m, key=pii.DEFAULT_KEY):
    kind = next((k for k, p in WHOLE.items() if p.fullmatch(m)), "card")
    digits, front = regex.sub("[^0-9]", "", m), ""
    rule = {"card": _luhn, "phone": lambda v: bool(regex.match("[2-9][0-9]{2}[2-9]", v)), "secret": _hex}.get(kind, lambda v: 1)
    core = digits
    if kind == "secret":
        front = HEAD.match(m)[0]
        core = m[len(front) :]
    elif kind == "iban":
        core = m[4:]
    elif kind == "phone":
        front = COUNTRY.match(m)[0] if COUNTRY.match(m) else ""
        core = regex.sub("[^0-9]", "", m[len(front) :])
    elif kind == "person":
        *words, core = m.split(" ")
        for group, names in pii.FIRST_NAMES.items():
            turn = 1 + int(hashlib.sha256(f"{key}|{group}".encode()).hexdigest()[:8], 16) % (len(names) - 1)
            words = [f"\0{names[(names.index(w) + turn) % len(names)]}" if w in names else w for w in words]
        front = "".join(w.lstrip("\0") + " " for w in words)
    elif kind == "email":
        core = m[: m.rindex(".")]
    elif kind == "ip":
        core = "".join(f"{int(x):02x}" for x in m.split("."))
    hexed = kind == "ip" or kind == "secret" and _hex(core)
    alphabets = pii.CLASSES if not hexed else ["0123456789abcdef" if kind == "ip" or _hex(core) == 1 else "0123456789ABCDEF"]
    want, v = rule(core), core
    for _ in range(pii.WALK):
        v = _permuted(v, alphabets, f"{key}|{kind}")
        if rule(v) == want:
            break
    if kind in ("secret", "person"):
        return kind, front + v
    if kind == "iban":
        off = int(m[2:4]) - right_check(m[:2], m[4:])
        return kind, f"{m[:2]}{(right_check(m[:2], v) + off) % 100:02d}{v}"
    if kind == "email":
        return kind, v + m[m.rindex(".") :]
    if kind == "ip":
        return kind, ".".join(str(int(v[i : i + 2], 16)) for i in range(0, 8, 2))
    fill = iter(v)
    return kind, front + "".join(next(fill) if "0" <= c <= "9" else c for c in m[len(front) :])


def right_check(country, rest):
    """Check digits of an account number: 98 less the remainder of all digits by 97."""
    digits = "".join(str(int(c, 36)) for c in f"{rest}{country}00".replace(" ", ""))
    return 98 - int(digits) % 97


def replaced(text):
    """(text, kinds) of one text."""
    found = [(m.span(), m[0], *surrogate(m[0])) for m in FIND.finditer(text)]
    names = {}
    for _, value, kind, new in found:
        if kind == "person":
            for a, b in zip(value.split(" "), new.split(" "), strict=True):
                if a != b:
                    names.setdefault(a, b)

    def mention(m):
        word = m[0]
        base = regex.sub("['’]s$", "", word)
        return names[word] if word in names else names[base] + word[len(base) :] if base in names else word

    out, at = "", 0
    for (lo, hi), _, _, new in [*found, ((len(text), len(text)), "", "", "")]:
        out += regex.sub(r"[\p{L}'’\-]+", mention, text[at:lo]) + new
        at = hi
    return out, [kind for _, _, kind, _ in found]
