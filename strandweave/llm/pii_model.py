"""Candidates of personal data, their features, and the boosted trees that score them. No Spark.

The generators here are the ones that pii runs as SQL functions; candidates()
proposes what they propose, so a model can be trained, calibrated and checked
on plain strings.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np

from . import boosting

KINDS = ("email", "ip", "card", "phone", "secret")
#: Precision on calibration candidates from which a threshold is taken.
PRECISION = 0.98
#: Characters of context on either side.
CONTEXT = 24
#: Digit groups of a number candidate at most; its characters and digits.
GROUPS = 5
NUMBER_CHARS, NUMBER_DIGITS = (7, 30), (7, 19)
LOCAL = "A-Za-z0-9._%+-"

#: High-recall patterns, the same for Java and Python; quantifiers are possessive or bounded.
GENERATORS = {
    "email": rf"(?<![{LOCAL}@])[{LOCAL}]{{1,64}}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{{1,63}}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    # A whole run of digit groups and, if one follows at once, a letter; number_parts proposes parts of it.
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9][0-9() .-]*+[A-Za-z]?+",
    # A token of eight characters or more with a digit in it.
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+={0,2}+",
}
#: Words before a candidate and after it, lower-cased. Fixed values.
LEFT = {
    "l_phone": r"tel|phone|call|fax|mobile|contact|dial|sms|reach", "l_card": r"card|visa|credit|debit|pay|account|iban", "l_mail": r"mail|write|contact|send",
    "l_ip": r"ip|host|server|addr|ping", "l_secret": r"token|secret|key|passw|pwd|auth|bearer|credential", "l_sum": r"commit|sha|md5|hash|checksum|rev|digest|etag",
    "l_other": r"order|invoice|isbn|issn|page|version|serial|tracking|article|item|total|sum|vol|since|from|between|no\.? ?$|nr\.? ?$|# ?$|[$€£] ?$", "l_digit": r"[0-9][ .-]?$", "l_quote": r"[\"'`] ?$", "l_assign": r"[=:] ?[\"'`]?$",
}
RIGHT = {"r_unit": r"^ ?(?:[%€$£°]|km|kg|eur|usd|people|years|times|items|pages|ms|kb|mb|bytes)", "r_date": r"^(?:t[0-9]|:[0-9]| ?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))", "r_digit": r"^[ .-]?[0-9]", "r_quote": r"^[\"'`]"}
FORMAT = ("digits", "length", "others", "luhn", "at_sign", "at_word", "dots", "groups", "paren", "colons", "plus", "letters", "uppers", "hex", "dashes")
FEATURES = (*FORMAT, *LEFT, *RIGHT)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(s: str) -> str:
    return s.translate(_LOWER)


def luhn(digits: str) -> bool:
    doubled = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
    return bool(digits) and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def features_of(m: str, left: str, right: str) -> list[int]:
    """Features of a candidate with the lower-cased text before and after it."""
    d = re.sub("[^0-9]", "", m)
    letters, uppers = (len(re.sub(f"[^{c}]", "", m)) for c in ("A-Za-z", "A-Z"))
    shape = [
        len(d), len(m), len(m) - len(d), int(luhn(d)), int("@" in m), int(bool(re.search(r"\(at\)|\[at\]| at ", m))), m.count("."), len(re.split("[^0-9]+", m)), m.count("("), m.count(":"),
        m.count("+"), letters, uppers, int(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", m))), m.count("-"),
    ]
    return [*shape, *[int(bool(re.search(p, left))) for p in LEFT.values()], *[int(bool(re.search(p, right))) for p in RIGHT.values()]]


def number_parts(m: str) -> list[tuple[int, int]]:
    """Parts (start, end) of a run: up to GROUPS digit groups from each group on, overlapping, with the sign or bracket before the first."""
    groups = [g.span() for g in re.finditer("[0-9]+", m)]
    out = []
    for i, (a, _) in enumerate(groups):
        start = a - (a > 0 and m[a - 1] in "(+")
        for _, end in groups[i : i + GROUPS]:
            part = m[start:end]
            sizes = NUMBER_CHARS[0] <= len(part) <= NUMBER_CHARS[1] and NUMBER_DIGITS[0] <= len(re.sub("[^0-9]", "", part)) <= NUMBER_DIGITS[1]
            if sizes and not re.match("[A-Za-z]", m[end:]) and not re.search("[() .-]{4}", part):
                out.append((start, end))
    return out


def candidates(text: str) -> list[tuple[str, int, int, str, str, str]]:
    """(generator, start, end, match, text before, text after); context ends at the generator's other matches."""
    found = []
    for g, pattern in GENERATORS.items():
        spans = [x.span() for x in re.finditer(pattern, text)]
        edges = [0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)]
        for k, (s, e) in enumerate(spans):
            left, right = lower(text[max(edges[0][k], s - CONTEXT) : s]), lower(text[e : min(edges[1][k + 1], e + CONTEXT)])
            if g != "number":
                found.append((g, s, e, text[s:e], left, right))
                continue
            run = text[s:e]
            for a, b in number_parts(run):
                found.append((g, s + a, s + b, run[a:b], (left + lower(run[:a]))[-CONTEXT:], (lower(run[b:]) + right)[:CONTEXT]))
    return found


def kind_of(generator: str, m: str) -> str:
    """Numbers of thirteen digits or more are cards, others telephones."""
    if generator == "number":
        return "card" if len(re.sub("[^0-9]", "", m)) >= 13 else "phone"
    return generator


def mixed(m: str) -> bool:
    return bool(re.search("[0-9] [0-9]", m) and re.search("[0-9][.-][0-9]", m))


def best(scored: list[tuple[float, int, int, str, bool]]) -> list[tuple[str, int, int]]:
    """Non-overlapping spans of (score, s, e, kind, mixed): those of one separator first, then by score, the longer, the first."""
    kept: list[tuple[str, int, int]] = []
    for _, s, e, kind, _ in sorted(scored, key=lambda x: (x[4], -x[0], x[1] - x[2], x[1], x[2], KINDS.index(x[3]))):
        if not any(a < e and s < b for _, a, b in kept):
            kept.append((kind, s, e))
    return kept


def added_spans(text: str, base: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """What the model adds to base spans."""
    found = models()
    scored = []
    for g, s, e, m, left, right in candidates(text):
        trees, cut = found[g]
        score = sum((boosting.predict_one(t, features_of(m, left, right)) for t in trees), 0.0) - cut
        if score >= 0 and not any(a < e and s < b for a, b in base):
            scored.append((score, s, e, kind_of(g, m), mixed(m)))
    return best(scored)


# training --------------------------------------------------------------------------------------

_FILLER = ("the ", "and so ", "we saw it there ", "it was late when ", "in the morning ", "as they said, ", "")
_AFTER = (" and then", ".", ", as usual", " in the hall", "", "\nNext", " was there")


Texts = list[tuple[str, list[tuple[int, int]]]]


def examples(seed: int, n: int) -> Texts:
    """Sentences made by rule, with the span that is personal: what people write, and look-alikes."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))

    def card(k: int) -> str:
        d = digits(k - 1)
        return next(d + x for x in "0123456789" if luhn(d + x))

    def grouped(d: str) -> str:
        return r.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, e = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{e}", f"{a}-{b}-{e}", f"{a}.{b}.{e}", f"{a} {b} {e}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)}-{digits(6)}", f"+{digits(2)} {a} {e}"])

    calls, cards, mails, hosts = ["call me at ", "tel. ", "phone: ", "fax ", "mobile ", "dial "], ["card ", "visa no. ", "credit card: ", "account "], ["mail ", "write to ", "e-mail: "], ["ip ", "host ", "server ", "addr "]
    keys = ["token = \"", "api_key=", "secret: ", "password: ", "auth token ", "bearer ", "key = '"]
    sums = ["commit ", "sha1 ", "md5 ", "rev ", "checksum: "]
    other = ["order ", "invoice no. ", "isbn ", "version ", "tracking ", "since ", "total ", "page ", "item ", "serial "]
    mixed_case = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    made: list[tuple[str, str, str, int]] = []
    for _ in range(n):
        fill = r.choice(_FILLER)
        date = f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"
        at, dot = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), (" at ", ".")])
        hexes = lambda k: ":".join(chars("0123456789abcdef", r.randint(2, 4)) for _ in range(k))
        bracket = at if "(" in at or "[" in at else " (at) "
        made += [
            (fill + r.choice(calls), phone(), r.choice(_AFTER), 1), (r.choice(calls), phone(), f" {phone()}", 2), (r.choice(calls), phone(), f" {date}", 1), (r.choice(calls), phone(), f" {digits(2)}.{digits(2)}", 1),
            (fill, f"({digits(3)}) {digits(3)}-{digits(4)}", r.choice(_AFTER), 1),
            (fill + r.choice(cards), grouped(card(r.choice([13, 14, 15, 16]))), r.choice(_AFTER), 1), (fill, grouped(digits(16)), r.choice(_AFTER), 1), (fill + r.choice(cards), grouped(digits(16)), r.choice(_AFTER), 1),
            (fill + r.choice(other), grouped(digits(r.choice([8, 10, 12, 13, 16]))), r.choice(_AFTER), 0), (fill, digits(r.choice([7, 8, 9, 10, 11, 12, 13, 17, 18, 19])), r.choice(_AFTER), 0),
            (fill + r.choice(["on ", "", "since "]), date, r.choice([*_AFTER, "T12:00", " 12:30"]), 0), (fill + r.choice(["", "between "]), f"{digits(4)} - {digits(4)}", r.choice(_AFTER), 0),
            (fill, f"{digits(3)} {digits(3)} {digits(3)}", r.choice([" km", " people", " EUR", " items"]), 0), (fill + r.choice(other), f"{digits(3)}.{digits(3)}.{digits(2)}", r.choice(_AFTER), 0),
            (fill, f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}", r.choice(_AFTER), 0), (fill + r.choice(other), phone().lstrip("+("), r.choice(_AFTER), 0),
            (r.choice(mails), f"{name()}.{name()}{at}{name()}{dot}{r.choice(['com', 'org', 'net'])}", r.choice(_AFTER), 1), (fill, f"{name()}{bracket}{name()}{dot}{r.choice(['com', 'org', 'de'])}", r.choice(_AFTER), 1),
            (fill, f"{name()} at {name()}.{name()}", r.choice(_AFTER), 0), (fill, f"{name()} at {name()} dot {name()}", r.choice(_AFTER), 0),
            (r.choice(hosts) if r.random() < 0.7 else fill, hexes(8), r.choice(_AFTER), 1), (r.choice(hosts), hexes(r.randint(5, 7)), r.choice(_AFTER), 1),
            (fill, ":".join(digits(2) for _ in range(4)), r.choice(_AFTER), 0), (fill, hexes(4), r.choice(_AFTER), 0),
            (fill + r.choice(keys), chars("0123456789abcdef", r.choice([32, 40, 64])), r.choice(['"', "'", "", " and"]), 1), (fill + r.choice(keys), chars(mixed_case, r.randint(10, 44)) + digits(1), r.choice(['"', "'", "", "\n"]), 1),
            (fill, r.choice(["sk_live_", "ghp_", "AKIA", "xoxb-"]) + chars(mixed_case, r.randint(16, 36)) + digits(2), r.choice(_AFTER), 1),
            (fill + r.choice(sums), chars("0123456789abcdef", r.choice([32, 40, 64])), r.choice(_AFTER), 0), (fill + r.choice(sums), chars("0123456789abcdef", r.choice([8, 10, 12])), r.choice(_AFTER), 0),
            (fill, f"{name()}_{name()}_{digits(2)}", r.choice(_AFTER), 0), (fill + r.choice(["see ", "in ", ""]), f"{name()}-{digits(4)}-{name()}", r.choice(_AFTER), 0), (fill, f"{name()}{digits(3)}{name()}", r.choice(_AFTER), 0),
            (fill, f"{name().upper()[:4]}-{digits(4)}-{name()}", r.choice(_AFTER), 0), (fill + r.choice(["see ", ""]), f"{name().upper()[:3]}_20{digits(6)}_{digits(6)}", r.choice(_AFTER), 0),
            (fill + r.choice(["mac ", "", "at "]), ":".join(chars("0123456789abcdef", 2) for _ in range(6)), r.choice(_AFTER), 0), (fill + "password: ", name() + digits(1) + name() + digits(1), r.choice(["", ".", "\n"]), 1),
            (fill + r.choice(["key ", "the key "]), f"{name()}{digits(2)}{name()}", r.choice([" is lost", " was there"]), 0), (fill, chars("0123456789abcdef", r.choice([32, 40])), r.choice(_AFTER), 0),
        ]
    # With 2 what follows after a blank is personal too.
    spans = lambda a, b, c, y: [(len(a), len(a + b)), (len(a + b) + 1, len(a + b + c))][:y]
    return [(a + b + c, spans(a, b, c, y)) for a, b, c, y in made]


def _right(g: str, m: str, span: tuple[int, int], right: list[tuple[int, int]]) -> bool:
    """Whether a candidate is one of the right spans, and of the generator whose kind the span is."""
    secret = bool(re.fullmatch(r"[A-Za-z0-9_+/-]{8,}={0,2}", m)) and not re.fullmatch(r"[0-9-]+", m)
    return span in right and secret == (g == "secret")


def labelled(texts: Texts) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Candidates of texts by generator: features, and whether each is right."""
    sets: dict[str, list[tuple[list[int], int]]] = {g: [] for g in GENERATORS}
    for text, right in texts:
        for g, s, e, m, before, after in candidates(text):
            sets[g].append((features_of(m, before, after), int(_right(g, m, (s, e), right))))
    return {g: (np.array([x for x, _ in v], float).reshape(len(v), len(FEATURES)), np.array([y for _, y in v], float)) for g, v in sets.items()}


def chosen(texts: Texts, trees: dict[str, list[boosting.Tree]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By generator, scores of the candidates that none overlaps with a better one, and whether each is right."""
    sets: dict[str, list[tuple[float, int]]] = {g: [] for g in GENERATORS}
    for text, right in texts:
        scored: dict[str, dict] = {g: {} for g in GENERATORS}
        for g, s, e, m, before, after in candidates(text):
            x = features_of(m, before, after)
            scored[g][s, e] = sum((boosting.predict_one(t, x) for t in trees[g]), 0.0), m
        for g, found in scored.items():
            for _, s, e in best([(v, s, e, kind_of(g, m), mixed(m)) for (s, e), (v, m) in found.items()]):
                v, m = found[s, e]
                sets[g].append((v, int(_right(g, m, (s, e), right))))
    return {g: (np.array([x for x, _ in v], float), np.array([y for _, y in v], float)) for g, v in sets.items()}


#: Hand-written lines for calibration, what is personal in braces; none is made by the rules above. Fixed values.
CALIBRATION = (
    "You can reach Dr. Ames on {020 7946 0958} before noon.", "Her mobile is {07700 900123}, the landline {(0131) 496 0421}.", "Fax: {555-014-2998}", "Tel {030 901820-45} (Zimmer 12)",
    "Population in 1990 was 1 234 567 people.", "ISBN 978-3-16-148410-0 is out of print.", "The order 4481 2230 1977 shipped on 2021-03-14.", "It ran from 1914 - 1918 and again 1939-1945.", "Lottery: 04 11 19 23 38 42", "pi is 3.14159265358979",
    "charge it to my card {3782 822463 10005} please", "account {4539 1488 0343 6461}", "He read out {6011000990139424} over the radio.", "timestamp 1617181723123 in the log", "EAN 4006381333931", "serial 8812-4471-0093-1", "The total was 120 450 000 EUR.",
    "mail {jane.roe (at) example (dot) org} for a copy", "write to {kim [at] uni-x.edu}", "we met at noon at cafe.dot", "she arrived at berlin dot on time", "look at this.example", "contact: {bob at mail.example.com}",
    "server {2001:db8:85a3:8d3:1319:8a2e:370:7348} is down", "at 10:22:31:07 it stopped", "host {fe80:0:0:0:204:61ff:fe9d:f156}", "mac 00:1b:44:11:3a:b7", "ratio 16:9:4:3",
    'api_key = "{f3b2a9c04d5e6f708192a3b4c5d6e7f8}"', "password: {hunter2hunter2}", "export TOKEN={ghp_16C7e42F292c6912E7710c838347Ae178B4a}", "Authorization: Bearer {abCD1234efGH5678ijKL90}", "secret={c2VjcmV0LXZhbHVlLTEyMw==}",
    "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixes it", "sha256 e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "see RFC-2616-section4", "the file report_2019_final is missing", "IMG_20190412_101500", "covid19-related closures", "md5 d41d8cd98f00b204e9800998ecf8427e",
    "utf8mb4_general_ci", "python3-setuptools", "room A12B-2201-west",
)


def marked(line: str) -> tuple[str, list[tuple[int, int]]]:
    """A line with braces -> the line without, and the spans that they held."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{([^{}]*)\}", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m.group(1))))
        text += m.group(1)
        at = m.end()
    return text + line[at:], spans


@functools.cache
def models(seed: int = 11, n: int = 120) -> dict[str, tuple[list[boosting.Tree], float]]:
    """Per generator, its trees and threshold.

    Trained on sentences made by rule, calibrated on others and on hand-written
    lines, of what would be chosen; the higher threshold counts.
    """
    trees = {g: boosting.train(x, y) for g, (x, y) in labelled(examples(seed, n)).items()}
    cuts = dict.fromkeys(GENERATORS, 0.0)
    for texts in (examples(seed + 1, n), [marked(x) for x in CALIBRATION]):
        for g, (scores, y) in chosen(texts, trees).items():
            cut = boosting.calibrate(scores, y, PRECISION) if len(y) else 0.0
            cuts[g] = max(cuts[g], cut if cut != float("inf") else 0.0)
    return {g: (trees[g], cuts[g]) for g in GENERATORS}
