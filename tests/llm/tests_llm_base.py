"""Plain expressions that the tests compare with."""

import re

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(c if i % 2 == 0 else c * 2 // 10 + c * 2 % 10 for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def base_of(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    holds = {"email": lambda v: True, "ip": lambda v: all(int(x) <= 255 for x in v.split(".")), "card": lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15}
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if holds[kind](m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]
