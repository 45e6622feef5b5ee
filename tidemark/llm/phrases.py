"""Made phrases of personal data and look-alikes, in three sets that share no template: to train on, to calibrate on, to measure with.

A template is a function of a random generator that gives a kind ('' for a look-alike), a span and its text around it. The
sets differ in the forms of the numbers and addresses, in their look-alikes and in the sentences.
"""

from __future__ import annotations

import random
from collections.abc import Callable

Phrase = tuple[str, str, str, str]  # kind or '', text before, span, text after
Template = Callable[[random.Random], str]


def digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def form(rng: random.Random, pattern: str) -> str:
    """The pattern with d as any digit and z as one from 2 to 9."""
    return "".join(digits(rng, 1) if c == "d" else digits(rng, 1, "23456789") if c == "z" else c for c in pattern)


def word(rng: random.Random, least: int = 2) -> str:
    return "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(least, 9)))


def forms(*patterns: str) -> list[Template]:
    return [lambda rng, p=p: form(rng, p) for p in patterns]


def card(rng: random.Random, sep: str, valid: bool = True, cuts: tuple[int, ...] = (4, 8, 12)) -> str:
    from .pii import luhn

    x = digits(rng, cuts[-1] + (3 if cuts[-1] == 12 else 4), "3456")
    x += next(c for c in "0123456789" if luhn(x + c) == valid)
    return sep.join(x[a:b] for a, b in zip((0, *cuts), (*cuts, None), strict=True))


def address(at: str, dot: str, tops: str, labels: tuple[int, int] = (1, 1), name: str = "w") -> Template:
    def made(rng: random.Random) -> str:
        local = {"w": word(rng), "wn": word(rng) + digits(rng, 2), "w.w": f"{word(rng)}.{word(rng)}", "w_w": f"{word(rng)}_{word(rng)}", "W": word(rng).capitalize()}[name]
        site = dot.join(word(rng) for _ in range(rng.randint(*labels)))
        return f"{local}{at}{site}{dot}{rng.choice(tops.split())}"

    return made


def octets(sep: str) -> Template:
    return lambda rng: sep.join(str(rng.randint(0, 255)) for _ in range(4))


def groups6(left: tuple[int, int], right: tuple[int, int], least: int = 0) -> Template:
    """An IPv6 address of some groups, a double colon and some groups; eight groups if there are none on the right."""
    part = lambda rng, n: [f"{rng.randint(least, 65535):x}" for _ in range(n)]

    def made(rng: random.Random) -> str:
        a = ":".join(part(rng, rng.randint(*left)))
        return a + "::" + ":".join(part(rng, rng.randint(*right))) if right != (0, 0) else a

    return made


def date(order: str, sep: str) -> Template:
    def made(rng: random.Random) -> str:
        part = {"y": str(rng.randint(1900, 2035)), "m": f"{rng.randint(1, 12):02}", "d": f"{rng.randint(1, 28):02}"}
        return sep.join(part[c] for c in order)

    return made


Templates = dict[str, list[Template]]

TRAIN: Templates = {
    "email": [address(" at ", " dot ", "com org net de", (1, 2)), address("[at]", ".", "com fr io", (1, 2), "w.w"), address(" (at) ", " (dot) ", "net example edu", name="wn"), address(" AT ", " DOT ", "COM org es"), address(" [at] ", "[dot]", "com uk", name="W"), address("(at)", ".", "de org", (1, 2))],
    "ip": [octets("[.]"), octets(" . "), groups6((8, 8), (0, 0), 256), groups6((1, 4), (1, 3)), groups6((2, 2), (1, 1), 4096)],
    "card": [lambda rng: card(rng, "."), lambda rng: card(rng, "/"), lambda rng: card(rng, ".", cuts=(4, 10))],
    "phone": forms("(zdd) zdd-dddd", "(zdd)zdd-dddd", "zdd-zdd-dddd", "01dd ddddddd", "0z dd dd dd dd", "0z.dd.dd.dd.dd", "00zd ddd ddd ddd", "(+zd) ddd ddd ddd", "(0zd) dddd dddd", "0zdd ddd dddd", "(0zdd) dddddd", "(0)zd dddddd"),
    "": [
        date("ymd", "-"), date("dmy", "."), date("dmy", "/"),
        lambda rng: card(rng, ".", False), lambda rng: digits(rng, rng.randint(13, 19)), lambda rng: card(rng, " ", False),
        lambda rng: ".".join(digits(rng, rng.choice([1, 2, 3])) for _ in range(rng.randint(2, 5))),
        lambda rng: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
        lambda rng: "[.]".join(str(rng.randint(200, 999)) for _ in range(4)),
        lambda rng: ":".join(f"{rng.randint(0, 255):02x}" for _ in range(6)),
        lambda rng: f"{rng.randint(10, 23)}:{form(rng, 'dd:dd:dd')}",
        *forms("ddd-d-dd-dddddd-d", "zd-dddd", "zdd - zddd", "zd zddd", "d.ddd.ddd", "zd.ddd.ddd", "zdddd-zd", "zddd/zd", "zd ddd", "d ddd ddd", "zd.dd.dd", "zdd dd ddd", "zd-zd zd-zd", "19dd-20dd", "zdd zddd z zd"),
        lambda rng: f"{word(rng)} at {word(rng)} dot {word(rng, 5)}", lambda rng: f"{word(rng)} (at) {word(rng)}-{word(rng)}.{word(rng, 5)}",
    ],
}

CALIBRATE: Templates = {
    "email": [address("(at)", "(dot)", "com nl org"), address(" at ", " dot ", "it info net", name="w_w"), address("[AT]", "[DOT]", "com eu"), address("{at}", ".", "ch com", (2, 2)), address(" @ ", ".", "com net")],
    "ip": [octets("(.)"), octets(" [.] "), groups6((1, 1), (1, 5)), groups6((8, 8), (0, 0), 16), groups6((3, 3), (2, 2))],
    "card": [lambda rng: card(rng, "_"), lambda rng: card(rng, "/", cuts=(4, 10))],
    "phone": forms("zdd.zdd.dddd", "0zdd/dddddd", "06 dd dd dd dd", "0dddd dddddd", "0z dddddddd", "(0)zdd ddddddd", "00zd zd ddddddd", "(zdd)-zdd-dddd", "01dd dddd dddd"),
    "": [
        date("ymd", "."), date("ymd", "/"), date("mdy", "-"),
        lambda rng: card(rng, "_", False), lambda rng: card(rng, "/", False, (4, 10)),
        lambda rng: "(.)".join(str(rng.randint(150, 999)) for _ in range(4)),
        lambda rng: f"{rng.randint(0, 12)}:{form(rng, 'dd:dd:dd')}",
        *forms("zd.dddd zd.dddd", "zdd/zdd", "zd ddd ddd", "zdddd zdddd", "20dd-dddd-dddd", "ddd ddd ddd ddd", "zd - zd - zd", "zddd.dd", "zd-zd-zd", "dddd dddd", "zd/zd zd/zd", "zd.ddd,dd"),
        lambda rng: f"{word(rng)} at {word(rng)} dot {word(rng, 4)}{word(rng)}",
    ],
}

MEASURE: Templates = {
    "email": [address(" AT ", " DOT ", "org com"), address(" [at] ", " [dot] ", "pt com", (1, 2)), address("<at>", ".", "com at"), address(" (at) ", ".", "com org", name="w.w"), address("[at]", "[dot]", "se com", (2, 2), "wn")],
    "ip": [octets("{.}"), octets("[.] "), groups6((4, 4), (3, 3)), groups6((1, 1), (4, 4), 4096), groups6((8, 8), (0, 0), 1)],
    "card": [lambda rng: card(rng, " - "), lambda rng: card(rng, "_", cuts=(4, 10))],
    "phone": forms("07ddd ddd ddd", "020 dddd dddd", "06-dddddddd", "(0zddd) ddd ddd", "(0z) dddd dddd", "0zd-dddd dddd", "0176 dddd dddd", "zdd zdd dddd", "1-zdd-zdd-dddd", "(0)zd ddd ddd", "(zdd).zdd.dddd"),
    "": [
        date("mdy", "/"), date("dmy", "-"), date("ym", "-"),
        lambda rng: card(rng, ".", False, (4, 10)), lambda rng: card(rng, "_", False),
        lambda rng: "{.}".join(str(rng.randint(180, 999)) for _ in range(4)),
        lambda rng: ":".join(form(rng, "dd") for _ in range(5)),
        *forms("978-d-dd-dddddd-d", "zd,ddd,ddd", "zd ddd ddd ddd", "zddd zddd", "zdd-zdd", "z/zd zd", "zdd.zd.z", "zd.z - zd.z", "20dd/dd/ddd", "zddddd-zd", "zddd ddd-z"),
        lambda rng: f"{word(rng)} at {word(rng)} dot {word(rng, 6)}",
    ],
}

#: Sentences around a span; those of the second place tell the kind, and those of the third place tell that it is none.
_PLAIN = (("they had {} in it", "the {} was there", "{}", "and then {} again", "see {} below"), ("we found {} there", "it says {} twice", "{} stands on it"), ("somebody left {} behind", "that is {} now", "a note with {} lay there"))
_TELLING = (
    {"email": ("mail {} now", "contact: {}", "write to {}"), "ip": ("server {} is up", "ping {}"), "card": ("card {} ok", "visa: {}", "pay with {}"), "phone": ("call {} today", "tel: {}", "phone {}")},
    {"email": ("e-mail: {}", "schreiben an {}"), "ip": ("host {}", "gateway: {}"), "card": ("credit card {}", "karte {}"), "phone": ("mobile {}", "fax: {}")},
    {"email": ("correo {}", "my address: {}"), "ip": ("login from {}", "ip {}"), "card": ("debit {}", "tarjeta {}"), "phone": ("ring {}", "telefon {}")},
)
_AGAINST = (("order {} came", "version {} of it", "on {} we met", "number {}", "it cost {} then"), ("invoice {}", "build {} is out", "until {} at noon", "between {} of them"), ("ref {}", "page {}", "date: {}", "about {} people"))
SETS = (TRAIN, CALIBRATE, MEASURE)


def phrase(rng: random.Random, which: int, kind: str | None = None) -> Phrase:
    """A phrase of the set `which` (a place in SETS): of `kind`, or else half of them look-alikes and a kind by chance."""
    templates = SETS[which]
    if kind is None:
        kind = rng.choice(("email", "ip", "card", "phone", "phone")) if rng.random() < 0.5 else ""
    span = rng.choice(templates[kind])(rng)
    if kind:
        around = rng.choice(_TELLING[which][kind] if rng.random() < 0.5 else _PLAIN[which])
    else:
        telling = rng.choice(_TELLING[which][rng.choice(("email", "ip", "card", "phone"))])
        around = rng.choice((rng.choice(_AGAINST[which]),) * 4 + (rng.choice(_PLAIN[which]),) * 5 + (telling,))
    before, after = f"{word(rng)} {around} {word(rng)}".split("{}")
    return kind, before, span, after
