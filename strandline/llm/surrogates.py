"""Personal data replaced by keyed surrogates of the same type and form.

Detected: e-mail addresses, telephone numbers, payment cards (with a right check digit), IPv4 and IPv6 addresses, IBANs,
social security numbers, access keys, tokens and passwords, and personal names after a title.  Each gets a
replacement of its own type: digits stay digits in the same places, cards keep their issuer digit and a right check digit,
telephone numbers keep country code, addresses stay in documentation ranges where one fits, letters keep case, and names keep
gender, script, case and the number of their parts.

The replacement follows from a secret key and the entity alone, whatever the form of a mention, so an entity has one replacement
in every document (coreference).  The key has no default.  The collision check finds, over the whole table, entities whose
replacements coincide with each other's or with an entity that really occurs; all but the first by hash are given the next
attempt, and again until none is left.  The few that needed one are counted: up to ``MAX_SENT`` are broadcast and texts are
rewritten where they are read; if there are more, they are joined to the documents that hold them.

A name is two entities.  Its last part is a family name, which has one replacement with or without given names before it, under
every title; the given parts have one for each whole name, so people of one family stay apart.  The gender of given names is
that of the list or of the titles found with the name anywhere in the table; where titles of both kinds are, it is female.

* Titles may stand one after another, the first that tells a gender counts; particles such as "van der" stay as they are.
* Numbers next to each other are told apart: a chain of digits that is no card is searched for cards, then for all else.
* Case, spaces and punctuation of a number or name do not make another entity, nor does a genitive 's or the feminine ending of
  a Cyrillic family name; the form of each mention is kept.
* What follows "secret:" and the like counts if it does not read as a word: with a digit, a symbol inside, or long and in mixed case.
* IPv6 addresses count in full or with ``::``, the latter where addresses are given out (so not ::1), and not the examples of
  2001:db8::/64.  Both forms are one entity.  Names without a title stay: a word after a greeting is not told from a name.
* Null texts stay null; empty texts and texts without entities are returned as they are, byte for byte; very long texts are
  searched whole.  Repeated rows are rewritten alike; no ties arise.  An empty table gives an empty result.
* Extra columns pass through, whatever their names; a column named like the output ``pii_kinds`` is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, fresh, session, small_batches

MAX_ATTEMPTS = 40
MAX_SENT = 200_000

#: Titles and the gender they tell; fixed values.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f",
    "Madame": "f", "Mme": "f", "Mlle": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Doña": "f", "Dr": "n", "Prof": "n",
    "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f", "κύριος": "m", "Κύριος": "m", "κυρία": "f", "Κυρία": "f",
}
#: Given names by script and gender, and family names by script; fixed values.
GIVEN = {
    ("latin", "m"): "Adam Albert Bruno Carl Daniel David Edgar Felix Gabriel Hugo Isaac Jonas Julian Karl Leon Lucas Marco Martin Max Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Amelia Anna Bella Carla Clara Diana Elena Emma Eva Flora Greta Hanna Irene Julia Karla Laura Lena Maria Nora Olivia Paula Rosa Sara Sofia Vera".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Григорий Дмитрий Иван Максим Николай Олег Павел Сергей".split(),
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Елена Ирина Мария Надежда Ольга Светлана Татьяна".split(),
    ("greek", "m"): "Αλέξανδρος Γιάννης Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
FAMILY = {
    "latin": "Abbott Alder Baker Barlow Becker Brandt Calder Carver Dalton Decker Ellis Falk Fischer Garner Hale Harper Keller Lang Lindner Marlow Mercer Norton Palmer Quinn Reed Sander Tanner Vogel Walker Weber".split(),
    "cyrillic": "Белов Волков Зайцев Козлов Лебедев Морозов Новиков Орлов Павлов Соколов".split(),
    "greek": "Αγγέλου Γεωργίου Δήμου Ιωάννου Λάμπρου Νικολάου Παύλου Στεφάνου".split(),
}
SYLLABLES = {"latin": "ba ce di fo ga he ki lo ma ne po ra si to vu we".split(), "cyrillic": "ба ве ди го жа ке ли мо на пе ра со ту фи ха це".split(), "greek": "βα γε δι ζο θα κε λι μο να πε ρα σο τι φα χε ψι".split()}

TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
NAME_PART = r"\p{Lu}[\p{L}'’-]+"
#: What stands in lower case before a family name and stays as it is; fixed values.
PARTICLES = frozenset("van von de der den dem del della di da do dos das du la le ten ter zu zur zum bin ibn al el af av".split())
PARTICLE = "(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + ") "
#: Digits with single spaces and hyphens: a card, or several numbers that stand next to each other.
CARD = r"(?P<card>(?<![\w+-])\d(?:[ -]?\d){12,}(?![\w-]))"
HEX = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
SHORT_IP6 = rf"(?:{HEX}{{0,6}})?::(?:(?:[0-9A-Fa-f]{{1,4}}:){{0,5}}(?:\d{{1,3}}\.){{3}}\d{{1,3}}|{HEX}{{0,6}})?"
#: Where addresses are given out: global, private, of a link or site, of groups, and those that hold an IPv4 address.
NETS6 = [ipaddress.ip_network(n) for n in ("2000::/3", "fc00::/7", "fe80::/9", "ff00::/8", "::ffff:0:0/96", "64:ff9b::/96")]
EXAMPLES6 = ipaddress.ip_network("2001:db8::/64")
OTHERS = (
    r"(?P<email>(?<![\w.+-])[\w+-][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
    r"|(?P<secret>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp|gho|ghs)_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b)"
    r"|\b(?i:token|secret|password|passwd|api_?key|access_?key)\s{0,2}[=:]\s{0,2}[\"']?(?P<value>[^\s\"'<>,;]{8,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|" + SHORT_IP6 + r")(?!\w|:[\w:]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))"
    r"|%s"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|\b(?i:SSN|social\ssecurity(?:\s(?:number|no\.?))?)(?:\s?[:#]\s?|\s)(?P<ssn>\d{3} \d{2} \d{4}(?![\w-]))"
    r"|\b(?P<title>(?:" + TITLE + r")(?:\.?\s(?:" + TITLE + r")(?=\.?\s))*+)\.?\s(?P<name>(?:" + PARTICLE + r"){0,3}" + NAME_PART + r"(?: (?:" + PARTICLE + r"){0,3}" + NAME_PART + r"){0,2})"
)
PATTERN, NO_CARD = regex.compile(OTHERS.replace("%s", CARD)), regex.compile(OTHERS.replace("%s", "(?P<card>(?!))"))
GENITIVE = re.compile(r"(?:['’]s|['’-])$")
GROUP = re.compile(r"[0-9]+|\d+")
#: Digits by group in which cards are written.
SHAPES = {(n,) for n in range(13, 20)} | {(4, 4, 4, n) for n in range(1, 5)} | {(4, 4, 4, 4, n) for n in range(1, 4)} | {(4, 6, 5), (4, 6, 4)}
#: A cheap look at what every entity needs, so that most texts are read once only.
HINT = re.compile(r"[\d@=:]")


RARE = (*TITLES, "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-")
HINT_RARE = re.compile(r"\b(?:" + TITLE + r")\b|AKIA|ASIA|gh[pos]_|sk-")
MARGIN = 128
#: From a title, what can be more titles and a name of three parts with particles, however long they are.
NAMED = re.compile(r"\S*(?:\s\S*){0,20}")


def windows(text: str) -> list[tuple[int, int]]:
    """Where entities can be: around each hint, out to white space.  Of what has white space inside, chains of digits are all
    hints, names go on for three parts, and the rest is shorter than the margin."""
    spots = [(m.start(), m.start() + MARGIN) for m in HINT.finditer(text)]
    if any(t in text for t in RARE):
        spots = sorted(spots + [(m.start(), max(m.start() + MARGIN, NAMED.match(text, m.start()).end())) for m in HINT_RARE.finditer(text)])
    out: list[tuple[int, int]] = []
    for p, far in spots:
        if out and far <= out[-1][1]:
            continue
        a, b = max(0, p - MARGIN), min(len(text), far)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


#: Endings of Cyrillic family names that women bear; fixed values.
FEMININE = re.compile(r"(?:ова|ева|ёва|ина|ына)$")
#: Country codes of one and of two digits; all others have three.  Fixed values.
CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
SYMBOL = re.compile(r"[!$%&*+/@^~=#](?=.)")
KINDS = ("email", "secret", "value", "iban", "ip6", "ip", "card", "phone", "ssn", "name")
DIGITS = regex.compile(r"\D")


def luhn(digits: str) -> int:
    """The check digit that these digits want."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def canonical(kind: str, found: str) -> str:
    """What makes two mentions one entity; a number of ten digits is the same with country code 1 and without."""
    if kind == "phone" and (m := regex.fullmatch(r"\+1(\d{10})", "+" * found.startswith("+") + DIGITS.sub("", found))):
        return m[1]
    if kind in ("card", "phone", "ssn"):
        return "+" * (kind == "phone" and found.startswith("+")) + DIGITS.sub("", found)
    if kind == "family":
        low = found.casefold()
        return low[:-1] if FEMININE.search(low) else low
    if kind == "name":
        *given, family = found.casefold().split(" ")
        return " ".join([*given, canonical("family", family)])
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(found).compressed
    return found.lower() if kind == "email" else found


def is_ip6(found: str) -> bool:
    """A full address, or a short one that can be somebody's: not code like a::b, and not of the documents' first network."""
    if "::" not in found:
        return True
    try:
        address = ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return address not in EXAMPLES6 and any(address in net for net in NETS6)


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits[:-1]) == int(digits[-1])


def is_secret(value: str) -> bool:
    """Whether a value reads as no word."""
    core = value.rstrip(".!?:)]}")
    mixed = len(core) >= 16 and any(c.isupper() for c in core[1:]) and any(c.islower() for c in core)
    return any(c.isdigit() for c in core) or mixed or bool(SYMBOL.search(core))


def alone(text: str, groups: list[tuple[int, int]]) -> bool:
    """Whether groups have one separator, and are not tied to others by a hyphen if theirs is a space."""
    between = {text[i[1] : j[0]] for i, j in zip(groups, groups[1:])}
    tied = "-" in (text[groups[0][0] - 1 : groups[0][0]], text[groups[-1][1] : groups[-1][1] + 1])
    return not between or len(between) == 1 and (between == {"-"} or not tied)


def card_runs(text: str, groups: list[tuple[int, int]], shaped: bool) -> list[tuple[int, int]]:
    """Runs of whole groups of digits that are cards, leftmost and longest first, none over another; shaped: in a card's usual
    groups, else of any with a right check digit."""
    out, k = [], 0
    while k < len(groups):
        sizes, best = [], 0
        for e in range(k, len(groups)):
            sizes.append(groups[e][1] - groups[e][0])
            if sum(sizes) > 19:
                break
            digits = "".join(text[i:j] for i, j in groups[k : e + 1])
            if is_card(digits) and (not shaped or tuple(sizes) in SHAPES and alone(text, groups[k : e + 1])):
                best = e + 1
        if best:
            out.append((groups[k][0], groups[best - 1][1]))
        k = best or k + 1
    return out


def side_by_side(text: str, a: int, b: int, end: int) -> tuple[list[tuple[int, int, str, str, str]], int]:
    """What a chain of digits from a to b holds that is no card as a whole, and where to go on: cards in their usual groups, then
    all else that is found between them, then cards in other groups in what is left."""
    groups = [m.span() for m in GROUP.finditer(text, a, b)]
    taken = [(i, j, "card", text[i:j], "n") for i, j in card_runs(text, groups, True)]
    go_on, at, others = b, a, []
    for stop in [*(t[0] for t in taken), None]:
        for m in NO_CARD.finditer(text, at, end if stop is None else stop):
            if m.start() >= b:
                break
            if m.start("ip6") >= 0 and not is_ip6(m.group("ip6")) or m.start("value") >= 0 and not is_secret(m.group("value")):
                continue
            others.append(mention(m))
            go_on = max(go_on, m.end())
        at = next((t[1] for t in taken if t[0] == stop), b)
    taken = sorted(taken + others)
    free: list[list[tuple[int, int]]] = [[]]
    k = 0
    for g in groups:
        while k < len(taken) and taken[k][1] <= g[0]:
            k += 1
            free.append([])
        if k == len(taken) or g[1] <= taken[k][0]:
            free[-1].append(g)
    taken += [(i, j, "card", text[i:j], "n") for part in free for i, j in card_runs(text, part, False)]
    return sorted(taken), go_on


def mention(m: regex.Match) -> tuple[int, int, str, str, str]:
    kind = next(k for k in KINDS if m.start(k) >= 0)
    found, gender = m.group(kind), "n"
    if kind == "name":
        told = [TITLES.get(t.rstrip("."), "n") for t in m.group("title").split()]
        gender = next((g for g in told if g != "n"), "n")
        found = GENITIVE.sub("", found)
    return m.start(kind), m.start(kind) + len(found), "secret" if kind == "value" else kind, found, gender


def mentions(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, kind, found, gender) of the entities of a text, in order."""
    if not text:
        return []
    out = []
    for a, b in windows(text):
        while m := PATTERN.search(text, a, b):
            found, a = mention(m), m.end()
            if found[2] == "card" and not is_card(DIGITS.sub("", found[3])):
                several, a = side_by_side(text, m.start(), a, b)
                out += several
            elif found[2] == "ip6" and not is_ip6(found[3]):
                a = m.start() + 1
            elif m.start("value") >= 0 and not is_secret(found[3]):
                a = m.start("value")
            else:
                out.append(found)
    return out


class Stream:
    """Numbers that follow from the key, an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.head, self.n, self.pool = key, f"{kind}\0{attempt}\0{entity}".encode("utf-8", "surrogatepass"), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 96:
            self.pool = self.pool << 256 | int.from_bytes(hmac.digest(self.key, self.head + self.n.to_bytes(4, "big"), hashlib.sha256), "big")
            self.n, self.left = self.n + 1, self.left + 256
        self.left -= 64
        x = self.pool >> self.left
        self.pool &= (1 << self.left) - 1
        return x % n


def like(form: str, digits: str) -> str:
    """These digits in the places of the form's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def scrambled(r: Stream, s: str, hexadecimal: bool) -> str:
    out = []
    for c in s:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[r.below(16)])
        elif c.isdigit():
            out.append("0123456789"[r.below(10)])
        elif "a" <= c <= "z":
            out.append(chr(97 + r.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + r.below(26)))
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, found: str, gender: str, attempt: int, key: bytes) -> str:
    """The replacement of a mention; that of a name is its given parts'."""
    entity = canonical(kind, found)
    r = Stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, _ = entity.partition("@")
        letters = scrambled(r, local, False)
        return f"{letters}@mail{r.below(100)}.example.org" if len(local) > 7 else f"{letters}.{r.below(10**6):06d}@mail{r.below(100)}.example.org"
    if kind == "card":
        body = entity[0] + "".join(str(r.below(10)) for _ in entity[2:])
        return like(found, body + str(luhn(body)))
    if kind == "phone":
        digits = entity.lstrip("+")
        shown = DIGITS.sub("", found)
        before = shown[: len(shown) - len(digits)]  # a country code that is not the entity's
        code = next((n for n in (1, 2) if digits[:n] in CODES), 3) if entity[0] == "+" else 0
        rest = len(digits) - code
        if rest == 10 and digits[:code] in ("", "1"):  # area, 555, line
            return like(found, before + digits[:code] + str(2 + r.below(8)) + f"{r.below(100):02d}" + (str(200 + r.below(800)) if attempt > 2 else "555") + f"{r.below(10000):04d}")
        return like(found, digits[:code] + "".join(str(1 + r.below(9) if i == 0 else r.below(10)) for i in range(rest)))
    if kind == "ssn":
        return like(found, f"9{r.below(100):02d}{1 + r.below(99):02d}{1 + r.below(9999):04d}")
    if kind == "ip":
        if entity.startswith(("10.", "192.168.")):
            return f"10.{r.below(256)}.{r.below(256)}.{1 + r.below(254)}"
        if attempt > 1:  # the range for tests is full: the reserved one
            return f"{240 + r.below(15)}.{r.below(256)}.{r.below(256)}.{1 + r.below(254)}"
        return f"{('198.18', '198.19')[r.below(2)]}.{r.below(256)}.{1 + r.below(254)}"
    if kind == "ip6":
        return "2001:db8:" + ":".join(f"{r.below(65536):x}" for _ in range(6))
    if kind == "iban":
        body = entity[:2] + "00" + scrambled(r, entity[4:], False)
        turned = "".join(str(int(c, 36)) for c in body[4:] + body[:4])
        body = body[:2] + f"{98 - int(turned) % 97:02d}" + body[4:]
        it = iter(body)
        return "".join(c if c == " " else next(it) for c in found)
    if kind == "family":
        return family_like(r, found, 2 + attempt // 2)
    if kind == "name":
        return " ".join(part if part in PARTICLES else given_like(r, part, gender, attempt // 3) for part in found.split(" ")[:-1])
    prefix = regex.match(r"AKIA|ASIA|gh[pos]_|sk-|", found).group()
    rest = found[len(prefix) :]
    return prefix + scrambled(r, rest, bool(regex.fullmatch(r"[0-9a-f]+", rest)))


def cased(new: str, form: str) -> str:
    return new.upper() if form.isupper() and len(form) > 1 else new[0].upper() + new[1:]


def syllables(r: Stream, script: str, n: int) -> str:
    return "".join(SYLLABLES[script][r.below(len(SYLLABLES[script]))] for _ in range(n))


def family_like(r: Stream, form: str, n: int) -> str:
    """Of the same script, with syllables of its own so that the list does not bound how many people can be told apart; a
    Cyrillic one keeps its feminine ending."""
    script = script_of(form)
    name, more = FAMILY[script][r.below(len(FAMILY[script]))], syllables(r, script, n)
    new = more + name.lower() if script == "cyrillic" else name + more
    return cased(new + "а" * bool(script == "cyrillic" and FEMININE.search(form.casefold())), form)


KNOWN = {n.casefold(): g for (_, g), names in GIVEN.items() for n in names}


def given_like(r: Stream, form: str, gender: str, n: int) -> str:
    """Of the same script and gender; the given name's own, if the lists have it."""
    script, gender = script_of(form), KNOWN.get(form.casefold(), gender)
    names = GIVEN[script, gender] if gender in "mf" else GIVEN[script, "m"] + GIVEN[script, "f"]
    return cased(names[r.below(len(names))] + syllables(r, script, n), form)


def given(found: str) -> str:
    """What stands before the family name, empty if that is particles only."""
    before = found.rpartition(" ")[0]
    return before if any(p not in PARTICLES for p in before.split(" ")) else ""


def entities_of(kind: str, found: str, gender: str) -> list[tuple[str, str, str]]:
    """(kind, entity, gender) of all that a mention tells of."""
    if kind != "name":
        return [(kind, canonical(kind, found), "n")]
    family = found.rpartition(" ")[2]
    return [("family", canonical("family", family), "n"), *([("name", canonical("name", found), gender)] if given(found) else [])]


def replacement(kind: str, found: str, gender: str, known: dict, key: bytes, make: Callable) -> str:
    """known: (kind, entity) -> (attempt, gender), of those that are not at their first attempt or have several genders."""

    def made(kind: str, found: str, gender: str = "n") -> str:
        attempt, own = known.get((kind, canonical(kind, found)), (0, gender)) if known else (0, gender)
        return make(kind, found, own, attempt, key)

    if kind != "name":
        return made(kind, found)
    before, _, family = found.rpartition(" ")
    return " ".join([*([made("name", found, gender) if given(found) else before] if before else []), made("family", family)])


def rewritten(text: str, known: dict, key: bytes, make: Callable = surrogate) -> tuple[str, list[str]]:
    """The text with replacements, and the kinds of its mentions; known as in replacement."""
    out, last, kinds = [], 0, []
    for a, b, kind, found, gender in mentions(text):
        out += [text[last:a], replacement(kind, found, gender, known, key, make)]
        last = b
        kinds.append(kind)
    return ("".join([*out, text[last:]]), kinds) if kinds else (text, kinds)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, entity, gender of the distinct entities of the whole table, and whether mentions differ in gender (mixed)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {e for t in batch.column(0).to_pylist() for _, _, *m in mentions(t) for e in entities_of(*m)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in seen], pa.string()) for i in range(3)], names=["kind", "entity", "gender"])

    small_batches(session(docs))
    found = docs.select(text).mapInArrow(find, "kind string, entity string, gender string")
    # f before m before n
    return found.groupBy("kind", "entity").agg(F.min("gender").alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed"))


def replaced(key: bytes, make: Callable):
    """What must not coincide: the replacement, and of a name its given parts with the family that it has."""

    @F.arrow_udf("string")
    def run(kind: pa.Array, entity: pa.Array, gender: pa.Array, attempt: pa.Array) -> pa.Array:
        out = []
        for k, e, g, n in zip(*(c.to_pylist() for c in (kind, entity, gender, attempt))):
            new = canonical("email" if k == "name" else k, make(k, e, g, n, key))
            out.append(f"{new} {e.rpartition(' ')[2]}" if k == "name" else new)
        return pa.array(out, pa.string())

    return run


def later_attempts(docs: DataFrame, key: bytes, text: str = "text", make: Callable = surrogate) -> DataFrame:
    """kind, entity, attempt, gender of the entities whose first replacement is taken, by another entity or by a real one, and of
    those whose mentions differ in gender."""
    state = cut(entities(docs, text).withColumn("attempt", F.lit(0)), "entities")
    real = state.select(F.col("kind").alias("_k"), F.col("entity").alias("_e"))
    new = replaced(key, make)
    for _ in range(MAX_ATTEMPTS):
        state = state.withColumn("new", new(F.col("kind"), F.col("entity"), F.col("gender"), F.col("attempt")))
        clash = state.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("attempt")).alias("a"), F.xxhash64("entity").alias("h"), "entity")).alias("first"))
        clash = clash.join(real, (F.col("kind") == F.col("_k")) & (F.col("new") == F.col("_e")), "left").filter("n > 1 or _e is not null")
        clash = clash.select(F.col("kind").alias("_k"), F.col("new").alias("_n"), F.when(F.col("_e").isNull(), F.col("first.entity")).alias("keeps"))
        clash = cut(clash, "clashes")
        if not clash.limit(1).count():
            return state.filter("attempt > 0 or mixed").select("kind", "entity", "attempt", "gender")
        moved = state.join(clash, (F.col("kind") == F.col("_k")) & (F.col("new") == F.col("_n")), "left")
        again = F.col("_n").isNotNull() & ~F.col("entity").eqNullSafe(F.col("keeps"))
        state = cut(moved.select("kind", "entity", "gender", "mixed", (F.col("attempt") + again.cast("int")).alias("attempt")), "entities")
    raise RuntimeError("replacements still coincide")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", kinds: str | None = "pii_kinds", make: Callable = surrogate) -> DataFrame:
    """docs with the text rewritten and, unless it is None, a column of the kinds of its entities, in order; ``make`` takes a
    mention's kind, form, gender, attempt and key and gives its replacement."""
    small_batches(session(docs))
    if kinds:
        docs = docs.drop(kinds)
    later = cut(later_attempts(docs, key, text, make), "attempts")
    few = later.limit(MAX_SENT + 1).count() <= MAX_SENT
    (row,) = fresh(docs, "rewritten")
    wanted = pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))])

    def column(rewrites) -> pa.Array:
        return pa.array([{"text": t, "kinds": k} for t, k in rewrites], wanted)

    if few:
        sent = session(docs).sparkContext.broadcast({(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in later.collect()})

        @F.arrow_udf("text string, kinds array<string>")
        def plain(texts: pa.Array) -> pa.Array:
            return column(rewritten(t, sent.value, key, make) if t is not None else (None, []) for t in texts.to_pylist())

        out = docs.withColumn(row, plain(F.col(text)))
    else:
        mark, held = fresh(docs, "mark", "later")

        @F.arrow_udf("array<struct<kind: string, entity: string>>")
        def listed(texts: pa.Array) -> pa.Array:
            pairs = [sorted({e[:2] for _, _, *m in mentions(t) for e in entities_of(*m)}) for t in texts.to_pylist()]
            return pa.array([[{"kind": k, "entity": e} for k, e in p] for p in pairs], pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())])))

        @F.arrow_udf("text string, kinds array<string>")
        def again(texts: pa.Array, found: pa.Array) -> pa.Array:
            known = [{(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in f or []} for f in found.to_pylist()]
            return column(rewritten(t, k, key, make) if t is not None else (None, []) for t, k in zip(texts.to_pylist(), known))

        marked = docs.withColumn(mark, F.xxhash64(F.coalesce(text, F.lit("")), F.length(text)))
        each = marked.select(mark, F.explode(listed(F.col(text))).alias("x")).select(mark, "x.*").distinct()
        need = each.join(later, ["kind", "entity"]).groupBy(mark).agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias(held))
        out = marked.join(need, mark, "left").withColumn(row, again(F.col(text), F.col(held))).drop(mark, held)
    out = out.withColumn(text, F.col(f"{row}.text"))
    if kinds:
        out = out.withColumn(kinds, F.col(f"{row}.kinds"))
    return out.drop(row)
