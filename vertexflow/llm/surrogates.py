"""Replacement of personal data and secrets by surrogates.

Detected entities (e-mail addresses, IP addresses of both versions, telephone, card, account and social security numbers, access
keys, credentials, street addresses, dates of birth, persons after a title or a phrase that announces a name) are replaced by values
drawn from a keyed hash of (type, value, attempt): digits stay digits, letters letters of the same case and script, separators,
prefixes, country codes, check digits (Luhn, IBAN) and address classes stay valid; dates move by a keyed number of days, which keeps
them distinct; names get names of the same script and gender.

The key is an argument, else the session's `spark.vertexflow.surrogates.key`, else a random one that is drawn once a call and forgotten:
without the key a surrogate can't be searched for by hashing guesses.

Coreference: a surrogate depends on the type and the normalised value alone, so one entity has one surrogate in all
documents. The parts of a person's name are entities of their own, whatever their title, place or case, and are also replaced where they
recur in the document. A first name's gender is what most titles before it tell in the whole corpus, else its ending.
Distinctness: all distinct entities of the corpus get their surrogates in a table of their own; one that equals another
surrogate or any real entity of its type moves on to its next attempt, until no two collide. Values with few others of their
format get longer with the attempt, so this ends. Entities that moved, or whose gender isn't that of their ending, travel to the
documents in the closure while they are few (a checked bound), else by a join on the entities of each document; all others need no lookup.

Texts are searched twice: once for the table of entities, which is written, once to be rewritten.

Null texts stay null, empty ones empty, with 0 entities; texts of any length are searched whole. Repeated rows get equal
results. Other columns are carried along by `replace`; n_chars, if there, follows the new text. `counted` may not name a column of
the table. Tables may be empty. Masks (one sign repeated, as in ********) are no secrets and stay.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import string
import unicodedata
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow_batch, arrow_rows, drop, lean, stash, text_map

KEY_SETTING = "spark.vertexflow.surrogates.key"

#: Titles that announce a person, and the gender they tell.
TITLES = {
    "Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Dr.": "", "Prof.": "",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr.": "m", "Sra.": "f", "Don": "m", "Doña": "f", "Г-н": "m", "Г-жа": "f", "господин": "m", "госпожа": "f",
}
#: Syllables of made-up names, with endings by gender.
SYLLABLES = {
    "Latin": ("ba be bo da de do fa fe ga go ha he ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa".split(), {"m": "n r s t l d".split(), "f": "a ia na la".split(), "": "in el en on er".split()}),
    "Cyrillic": ("ба бе бо да де до ва ве га го жа ка ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то".split(), {"m": "н р с т л д".split(), "f": "а ия на ла".split(), "": "ин ев ов ер".split()}),
    "Greek": ("βα δε δο κα κε λα λε λι μα με μι να νε νι πα πε ρα ρε ρι σα σε τα τε τι".split(), {"m": "ος ης ας".split(), "f": "α η ια".split(), "": "ου ακη ιδη".split()}),
}
_SCRIPT = (("Cyrillic", "Ѐ", "ӿ"), ("Greek", "Ͱ", "Ͽ"))

#: Fixed value: signs for credentials without letters and digits.
_SIGNS = "!#$%&*+-./:?@^_~="

_WORD = r"[^\W\d_]"
_NAME = rf"(?!(?:{'|'.join(map(re.escape, TITLES))})\b){_WORD}[\w'’-]*"
_DETECT = re.compile(
    r"(?P<email>[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9](?:[\w-]*\.)+[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?P<key>AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[A-Za-z0-9-]{20,})(?![A-Za-z0-9])"
    r"|(?:(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key))[\"']?\s*[:=]\s*[\"']?)(?P<credential>[^\s\"',;]{6,})"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?<![\w.(])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}|\+\d{8,15}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4})(?!\w)"
)
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\s+(?P<name>{_NAME}(?:[ ]{_NAME}){{0,2}})")
#: What texts with entities hold: cheap tests before the patterns. The words are looked for in lower case.
_DIGIT = re.compile("[0-9@]")
_SECRET_HINTS = ("akia", "token", "passw", "pwd", "secret", "key", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_BORN_HINTS = ("born", "birth", "dob", "née le", "né le", "geboren", "nacid", "родил")
_CUE_HINTS = ("name", "contact p", "attn", "signed", "sincerely", "regards", "grüßen", "cordialement", "atentamente", "appelle", "heiße", "llamo", "nombre", "зовут", "уважением", "from:", "to:", "cc:")
_STREET_HINTS = (" Street", " St", " Road", " Rd", " Ave", " Lane", " Ln", " Drive", " B", " Court", " Square", "straße ", "strasse ", "weg ", "platz ", "allee ", "gasse ", " rue ", " avenue ", " boulevard ", " place ", " chemin ")
#: Phrases after which a person's name stands.
_CUE = re.compile(
    rf"(?:\b(?i:my name is|name|contact person|attn\.?|signed|signed by|sincerely|best regards|kind regards|mit freundlichen grüßen|cordialement|atentamente|je m['’]appelle|ich heiße|mein name ist|me llamo|mi nombre es|меня зовут|с уважением)\s*[:,]?|^(?:From|To|Cc):)\s+(?P<name>{_NAME}(?:[ ]{_NAME}){{1,2}})", re.M
)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_BORN = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|dob|née? le|geboren am|nacid[oa] el|родил(?:ся|ась)))[: ]+(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?!\d)")
#: Words of street names.
_STREET = re.compile(
    r"(?<![\w.])(?:\d{1,5} (?:[A-Z][\w'’-]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)\b"
    r"|[A-ZÄÖÜ][\w-]*(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}\b|\d{1,4},? (?:rue|avenue|boulevard|place|chemin) (?:(?:de|du|des|la|le) )*[A-ZÉ]\w+)"
)
_STREET_WORDS = set("Street St Road Rd Avenue Ave Lane Ln Drive Boulevard Blvd Court Square".split())
_TITLE_HINTS = [t for t in TITLES if not any(o in t for o in TITLES if o != t)]
_STREET_END = re.compile("(?:straße|strasse|weg|platz|allee|gasse)$")


def _kind(kind: str, value: str) -> tuple[str, str]:
    """The entity: type and normalised value."""
    if kind in ("email", "iban"):
        return kind, value.lower() if kind == "email" else value.replace(" ", "")
    if kind in ("phone", "card", "ssn"):
        return kind, ("+" if value[0] == "+" else "") + "".join(filter(str.isdigit, value))
    return kind, value


def own_gender(name: str) -> str:
    """What the ending of a normalised name tells."""
    return "f" if name[-1:] in "aяаη" or name.endswith(("elle", "ette", "ine", "ια")) else "m" if name[-1:] in "nrstldkoнрстлдкςй" else ""


def _persons(text: str, lower: str):
    """(start, end, normalised part, told gender) of the parts of announced names, and the same parts where they recur."""
    parts: dict[str, str] = {}
    announced = [(m["name"], TITLES[m["title"]]) for m in _TITLED.finditer(text)] if any(t in text for t in _TITLE_HINTS) else []
    if any(h in lower for h in _CUE_HINTS):
        announced += [(m["name"], "") for m in _CUE.finditer(text) if all(n[0].isupper() for n in m["name"].split(" "))]
    for name, gender in announced:
        names = [n for n in name.split(" ") if n[0].isupper()]
        for k, n in enumerate(names):
            told = gender if k < len(names) - 1 else ""  # a title tells the gender of a first name
            parts[n] = parts.get(n) or told
    if parts:
        for m in re.finditer(rf"\b(?:{'|'.join(sorted(map(re.escape, parts), key=len, reverse=True))})\b", text):
            yield m.start(), m.end(), m.group().casefold(), parts[m.group()]


def _parsed(written: str) -> tuple[date, str] | None:
    """A date and its order: year first, day first or month first (where both fit and slashes part them)."""
    x, y, z = re.split("[-/.]", written)
    order = "ymd" if len(x) == 4 else "mdy" if "/" in written and int(x) <= 12 else "dmy"
    at = dict(zip(order, map(int, (x, y, z))))
    try:
        return date(at["y"], at["m"], at["d"]), order
    except ValueError:
        return None


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normalised value) of the entities of a text, in order, without overlaps."""
    return [x[:4] for x in mentions(text)]


def mentions(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """find() with the gender that a title tells."""
    if not text:
        return []
    found: list[tuple[int, int, str, str, str]] = []
    lower, numbered = text.lower(), _DIGIT.search(text) is not None
    if numbered or any(h in lower for h in _SECRET_HINTS):
        for m in _DETECT.finditer(text):
            if m.lastgroup == "credential" and len(set(m["credential"])) == 1 and not m["credential"][0].isalnum():
                continue  # a mask such as ******** is no secret
            found.append((*m.span(m.lastgroup), *_kind(m.lastgroup, m[m.lastgroup]), ""))

    def more(pattern, kind, group, value):
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if not any(a < y and x < b for x, y, *_ in found) and (normal := value(m[group])) is not None:
                found.append((a, b, kind, normal, ""))

    if text.count(":") > 1:
        more(_IPV6, "ipv6", 0, _v6)
    if numbered and any(h in lower for h in _BORN_HINTS):
        more(_BORN, "birth", 1, lambda v: f"{p[0]:%Y-%m-%d}" if (p := _parsed(v)) else None)
    if numbered and any(h in text for h in _STREET_HINTS):
        more(_STREET, "street", 0, lambda v: v)
    taken = found[:]
    for a, b, value, gender in _persons(text, lower):
        if not any(a < y and x < b for x, y, *_ in taken):
            found.append((a, b, "name", value, gender))
    return sorted(found)


def _v6(written: str) -> str | None:
    try:
        return ipaddress.IPv6Address(written).exploded
    except ValueError:
        return None


class Draw:
    """An endless keyed stream of numbers for (type, value, attempt)."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.n = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest(), 0

    def below(self, most: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.blake2b(self.n.to_bytes(4, "big"), key=self.seed, digest_size=8).digest(), "big") % most

    def pick(self, of):
        return of[self.below(len(of))]


def _same_class(ch: str, draw: Draw) -> str:
    if "0" <= ch <= "9":
        return draw.pick(string.digits)
    if "a" <= ch <= "z":
        return draw.pick(string.ascii_lowercase)
    if "A" <= ch <= "Z":
        return draw.pick(string.ascii_uppercase)
    return draw.pick(_alphabet(ch)) if ch > "\x7f" and ch.isalnum() else ch


@lru_cache(10_000)
def _alphabet(ch: str) -> str:
    """Letters or digits of the character's kind in its block of 64 code points; at least itself."""
    first, kind = ord(ch) & ~63, unicodedata.category(ch)
    return "".join(c for c in map(chr, range(first, first + 64)) if unicodedata.category(c) == kind)


def _luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        n = int(ch) * (2 if k % 2 == 0 else 1)
        total += n - 9 * (n > 9)
    return -total % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int, gender: str = "") -> str:
    """A value of the same type and format that isn't `value`, for all but finitely many attempts; a function of its arguments alone."""
    if kind == "birth":
        days = 30 + Draw(key, "days", "", 0).below(3000)
        at = date.fromisoformat(value)
        return (at - timedelta(days)).isoformat() if at.toordinal() > days else (at + timedelta(days)).isoformat()
    draw = Draw(key, kind, value, attempt)
    # values with few others of their format grow, so that the search for a free one ends
    more = "".join(draw.pick(string.ascii_lowercase) for _ in range(attempt // 8)) if kind in ("email", "credential") else ""
    if kind == "street":
        made = lambda: "".join(draw.pick(SYLLABLES["Latin"][0]) for _ in range(2 + attempt // 4)).capitalize()

        def word(w: str) -> str:
            end = _STREET_END.search(w)
            if w.rstrip(",").isdigit():
                return str(1 + draw.below(9)) + "".join(draw.pick(string.digits) for _ in w.rstrip(",")[1:]) + "," * w.endswith(",")
            return made() + end[0] if end else made() if w[0].isupper() and w not in _STREET_WORDS else w

        return " ".join(map(word, value.split(" ")))
    if kind == "ipv6":
        first = int(value.split(":")[0], 16)
        head = first if first >> 13 != 1 else 0x2000 + draw.below(0x2000)  # loopback, link-local and other classes stay
        return ":".join(f"{x:04x}" for x in (head, *(draw.below(1 << 16) for _ in range(7))))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        within = Draw(key, "domain", domain, 0)
        return "".join(_same_class(c, draw) for c in local) + more + "@" + "".join(_same_class(c, within) for c in host) + "." + top
    if kind == "ip":
        first = int(value.split(".")[0])
        head = first if first in (0, 10, 127) or first >= 224 else 1 + draw.below(223)
        while head in (10, 127) and first not in (10, 127):
            head = 1 + draw.below(223)
        return ".".join(map(str, (head, draw.below(256), draw.below(256), 1 + draw.below(254))))
    if kind == "card":
        body = value[0] + "".join(draw.pick(string.digits) for _ in value[1:-1])
        return body + (str(_luhn(body)) if int(value[-1]) == _luhn(value[:-1]) else draw.pick(string.digits))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "phone":
        plus = value.startswith("+")
        digits = value.lstrip("+")
        kept = len(digits) - 10 if plus and len(digits) > 10 else 2 if plus else 0
        out = digits[:kept] + "".join(draw.pick("23456789" if k == 0 else string.digits) for k in range(len(digits) - kept))
        return "+" * plus + out
    if kind == "iban":
        body = "".join(_same_class(c, draw) for c in value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return value[:2] + f"{98 - number % 97:02d}" + body
    if kind in ("key", "credential"):
        head = re.match(r"AKIA|gh[pousr]_|sk-|", value)[0]
        hexa = not set(value[len(head) :].lower()) - set(string.hexdigits)
        if kind == "credential" and not any(map(str.isalnum, value[len(head) :])):
            return head + "".join(draw.pick(_SIGNS) for _ in value[len(head) :]) + more
        lower = value[len(head) :] == value[len(head) :].lower()
        letters = string.hexdigits[:16] if lower else "0123456789ABCDEF"
        return head + "".join(draw.pick(letters) if hexa else _same_class(c, draw) for c in value[len(head) :]) + more
    script = next((s for s, a, b in _SCRIPT if a <= value[0] <= b), "Latin")
    syllables, endings = SYLLABLES[script]
    many = 1 + (len(value) > 4) + (len(value) > 7) + attempt // 4
    return "".join(draw.pick(syllables) for _ in range(many)) + draw.pick(endings[gender or own_gender(value)])


def formatted(original: str, kind: str, new: str) -> str:
    """`new` with the separators and the case of this mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(new)
        return "".join(c if c in " .-()" else next(rest) for c in original) + "".join(rest)
    if kind == "name":
        return new.upper() if original.isupper() and len(original) > 1 else new.capitalize()
    if kind == "email" and original != original.lower():
        return "".join(b.upper() if a.isupper() else b for a, b in zip(original, new)) + new[len(original) :]
    if kind == "ipv6":
        short = new if len(original) == 39 else ipaddress.IPv6Address(new).compressed
        return short.upper() if original != original.lower() else short
    if kind == "birth":
        order = _parsed(original)[1]
        at = dict(zip("ymd", new.split("-")))
        parts = [at[k] if k == "y" or len(o) > 1 else str(int(at[k])) for k, o in zip(order, re.split("[-/.]", original))]
        return re.sub("[^-/.]+", lambda _, it=iter(parts): next(it), original)
    return new


def key_of(spark: SparkSession, key: bytes | None) -> bytes:
    """The given key, else the session's, else a random one."""
    named = spark.conf.get(KEY_SETTING, None)
    return key or (named.encode() if named else secrets.token_bytes(32))


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (kind, value, gender) of all whole texts; a gender only where the mentions tell one that the ending doesn't."""
    told = pa.schema([("kind", pa.string()), ("value", pa.string()), ("m", pa.int64()), ("f", pa.int64())])

    def run(batches):
        for (texts,) in arrow_rows(batches, "text"):
            seen: dict[tuple, list[int]] = {}
            for t in texts:
                for _, _, kind, value, gender in mentions(t):
                    votes = seen.setdefault((kind, value), [0, 0])
                    if gender:
                        votes[gender == "f"] += 1
            rows = [(*k, *v) for k, v in sorted(seen.items())]
            yield arrow_batch(told, *(zip(*rows) if rows else [[]] * 4))

    ending = text_map(lambda: lambda kind, value: (own_gender(value) if kind == "name" else "",), pa.schema([("own", pa.string())]), "kind", "value")
    voted = docs.select("text").mapInArrow(lean(run), "kind string, value string, m long, f long").groupBy("kind", "value").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    most = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("")
    voted = voted.withColumn("most", most).withColumn("ending", ending)
    return voted.select("kind", "value", F.when(F.col("most") == F.col("ending.own"), "").otherwise(F.col("most")).alias("gender"))


def assign(found: DataFrame, key: bytes, draw=surrogate) -> DataFrame:
    """(kind, value, gender, attempt, surrogate) of distinct entities: no surrogate twice within a type, none equal to a real entity of it.

    Dates of birth move together and need no check among themselves; they may meet other real dates."""
    make = text_map(lambda: lambda *x: (draw(key, *x),), pa.schema([("new", pa.string())]), "kind", "value", "attempt", "gender")

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("_made", make).withColumn("surrogate", F.col("_made.new")).drop("_made")

    real = found.select("kind", F.col("value").alias("surrogate")).withColumn("is_real", F.lit(True))
    now = stash(numbered(found.withColumn("attempt", F.lit(0).cast("long"))), "surrogates")
    while True:
        owners = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("owner"))
        seen = now.join(owners, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("kind") != "birth") & (F.coalesce("is_real", F.lit(False)) | (F.struct("attempt", "value") != F.col("owner")))
        moved = stash(seen.select(*now.columns, clash.alias("clash")), "collisions")
        if moved.where("clash").isEmpty():
            drop(moved)
            return now
        again = numbered(moved.where("clash").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")))
        after = stash(moved.where("NOT clash").select(*now.columns).unionByName(again), "surrogates")
        drop(now, moved)
        now = after


def _rewriter(key: bytes, draw, moved: dict):
    """The function (text, own moved entities) -> (new text, replaced mentions)."""
    chosen = Memo(lambda x: draw(key, *x), 50_000).__getitem__

    def rewrite(text: str | None, own: list | None = None) -> tuple[str | None, int]:
        found = mentions(text)
        if not found:
            return text, 0
        here = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in own} if own else moved
        out, at = [], 0
        for a, b, kind, value, _ in found:
            out += [text[at:a], formatted(text[a:b], kind, chosen((kind, value, *here.get((kind, value), (0, "")))))]
            at = b
        return "".join(out) + text[at:], len(found)

    return rewrite


def replace(docs: DataFrame, key: bytes | None = None, few: int = 10_000, draw=surrogate, counted: str | None = None) -> DataFrame:
    """docs with surrogates in `text`; `counted` names a new column for the number of replaced mentions."""
    if counted in docs.columns:
        raise ValueError(f"there is a column {counted!r} already")
    key = key_of(docs.sparkSession, key)
    found = stash(entities(docs), "entities")
    given = assign(found, key, draw)
    moved = stash(given.where("attempt > 0 OR gender <> ''").select("kind", "value", "attempt", "gender"), "moved")
    drop(found, given)
    rows = moved.limit(few + 1).collect()
    result = pa.schema([("text", pa.string()), ("n", pa.int64())])
    if len(rows) <= few:
        table = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in rows}
        done = docs.withColumn("__vf_new", text_map(lambda: _rewriter(key, draw, table), result, "text"))
    else:
        # a document's own entities that moved, looked up by the digest of its text

        def listed(batches):
            schema = pa.schema([("__vf_digest", pa.string()), ("kind", pa.string()), ("value", pa.string())])
            for (texts,) in arrow_rows(batches, "text"):
                own = [(hashlib.sha256(t.encode()).hexdigest(), k, v) for t in texts if t for k, v in sorted({x[2:] for x in find(t)})]
                yield arrow_batch(schema, *(zip(*own) if own else [[]] * 3))

        own = docs.select("text").mapInArrow(lean(listed), "__vf_digest string, kind string, value string").distinct().join(moved, ["kind", "value"])
        own = own.groupBy("__vf_digest").agg(F.collect_list(F.struct("kind", "value", "attempt", "gender")).alias("__vf_moved"))
        done = docs.withColumn("__vf_digest", F.sha2(F.col("text"), 256)).join(own, "__vf_digest", "left")
        done = done.withColumn("__vf_new", text_map(lambda: _rewriter(key, draw, {}), result, "text", "__vf_moved"))
    columns = {"text": F.col("__vf_new.text"), "n_chars": F.length("__vf_new.text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    kept = [columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns]
    return done.select(*kept, *([F.col("__vf_new.n").alias(counted)] if counted else []))
