"""PII surrogates: keyed replacements of the same type, format, script and gender, one to one."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Common given names by script and gender, titles, and words that a name follows.
GIVEN = {
    "latin female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Laura Julia Sophie Marie Camille Claire Louise Katharina Sabine Heike Ursula Petra Lucia Carmen Pilar Elena Isabel Rosa Olga Natalia Irina Tatiana Svetlana Katarzyna Agnieszka Zofia Fatima Aisha Layla Zainab Priya Anjali Sunita Lakshmi Mei Xiu Ling".split(),
    "latin male": "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Peter Hans Klaus Jürgen Wolfgang Dieter Stefan Pierre Jean Philippe Nicolas Antoine Carlos José Miguel Javier Pedro Luis Diego Ivan Dmitri Sergei Vladimir Piotr Tomasz Krzysztof Ahmed Mohammed Omar Hassan Khalid Yusuf Rahul Amit Sanjay Vijay Wei Jun Ming Hao Jian".split(),
    "cyrillic female": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Людмила Галина".split(),
    "cyrillic male": "Иван Дмитрий Сергей Алексей Андрей Николай Михаил Владимир Александр Павел Олег Виктор".split(),
}
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split())
CUES = "name is|name was|named|call me|dear|hello|hi|signed|sincerely|regards|contact|name:|patient|ich heiße|hallo|liebe|lieber|je m'appelle|cher|chère|me llamo|estimado|estimada|querido|querida|меня зовут"

#: Characters that stand for each other; a surrogate keeps the class of each character, and case apart.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüæœøå", "çñßšžčř",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: (k, i) for k, cs in enumerate(CLASSES) for i, c in enumerate(cs)}

_EMAIL = re.compile(r"[\w.+-]*\w@\w[\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?([A-Za-z0-9+/_\-]{8,})|\b([0-9a-f]{32,})\b")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+"
_RUN = re.compile(rf"\b{_CAP}(?:(?:\. |[ -]){_CAP})*\b")
_CUE = re.compile(rf"(?i:\b(?:{CUES}))[,:]? ({_CAP})(?: ({_CAP}))?\b")
_CUE_WORD = re.compile(rf"(?i)\b(?:{CUES})")
#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_WORD = re.compile(r"[^\W\d_]+")
_GENDER = {name: group for group, names in GIVEN.items() for name in names}
#: The same names in capitals too.
_CASED = {form: group for name, group in _GENDER.items() for form in (name, name.upper())}


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of all lists with values[i] < sizes[i]: an eight-round Feistel network over two mixed-radix halves."""
    if len(values) < 2:
        return [(v + _number(key, tweak, "one", n) % n) % n for v, n in zip(values, sizes)]
    half = len(values) // 2

    def pack(vs: list[int], ns: list[int]) -> tuple[int, int]:
        v, total = 0, 1
        for x, n in zip(vs, ns):
            v, total = v * n + x, total * n
        return v, total

    def unpack(v: int, ns: list[int]) -> list[int]:
        out = []
        for n in reversed(ns):
            v, x = divmod(v, n)
            out.append(x)
        return out[::-1]

    (a, na), (b, nb) = pack(values[:half], sizes[:half]), pack(values[half:], sizes[half:])
    shape = ",".join(map(str, sizes))
    for r in range(4):
        a = (a + _number(key, tweak, shape, r, "a", b)) % na
        b = (b + _number(key, tweak, shape, r, "b", a)) % nb
    return unpack(a, sizes[:half]) + unpack(b, sizes[half:])


def like(key: bytes, tweak: str, text: str) -> str:
    """The text with each character of a class replaced within its class; case, other characters and length stay. One to one."""
    at, values, sizes = [], [], []
    for i, c in enumerate(text):
        low = c.lower()
        if (found := _CLASS.get(low)) and (c == low or c == low.upper()):
            at.append(i)
            values.append(found[1])
            sizes.append(len(CLASSES[found[0]]))
    # the classes in their places are part of the permutation's name, and so stay apart
    shape = "".join(chr(97 + _CLASS[text[i].lower()][0]) for i in at)
    out = list(text)
    for i, v in zip(at, permute(key, f"{tweak}/{shape}", values, sizes)):
        low = text[i].lower()
        new = CLASSES[_CLASS[low][0]][v]
        up = new.upper()
        out[i] = up if text[i] != low and len(up) == 1 else new
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits(text: str, new: list[int]) -> str:
    """``text`` with its digits replaced in order; all else stays."""
    it = iter(new)
    return "".join(str(next(it)) if c.isdigit() else c for c in text)


def surrogate(key: bytes, kind: str, text: str, again: int = 0) -> str:
    """The replacement of one entity; equal entities get equal ones, different ones of a kind different ones.

    ``again`` numbers the further keys that entities take whose first surrogate another one has.
    """
    if again:
        key = hmac.new(key, b"again%d" % again, hashlib.sha256).digest()
    digits = [int(c) for c in text if c.isdigit()] if kind not in ("email", "secret", "iban") and not kind.startswith("given") else []
    if kind == "card":  # as far from a valid check digit as the original, so valid numbers stay valid
        new = permute(key, f"card{len(digits)}", digits[:-1], [10] * (len(digits) - 1))
        return _digits(text, [*new, (_luhn(new) + digits[-1] - _luhn(digits[:-1])) % 10])
    if kind == "ssn":
        return _digits(text, permute(key, "ssn", digits, [10] * 9))
    if kind == "ip":
        return ".".join(map(str, permute(key, "ip", [int(x) for x in text.split(".")], [256] * 4)))
    if kind == "phone":  # the country code stays, however the number is spaced
        code = len(m[0]) if text.startswith("+") and (m := _COUNTRY.match("".join(map(str, digits)))) else 0
        rest = digits[code:]
        return _digits(text, digits[:code] + permute(key, f"phone{digits[:code]}", rest, [10] * len(rest)))
    if kind == "iban":
        plain = text.replace(" ", "")
        body = like(key, "iban" + plain[:2], plain[4:])
        right = lambda of: 98 - int("".join(str(int(c, 36)) for c in of + plain[:2] + "00")) % 97
        check = (right(body) + int(plain[2:4]) - right(plain[4:])) % 100  # as far from valid as the original's
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{like(key, 'local', local)}@{like(key, 'host', host)}.{top}"
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", text):
        return "".join("0123456789abcdef"[v] for v in permute(key, f"hex{len(text)}", [int(c, 16) for c in text], [16] * len(text)))
    if kind.startswith("given "):  # the next name on the keyed circle of names of its script and gender
        names = _circle(key, kind[6:])
        new = names[(names.index(text.capitalize()) + 1) % len(names)]
        return new.upper() if text.isupper() else new
    return like(key, kind, text)


@lru_cache(64)
def _circle(key: bytes, group: str) -> tuple[str, ...]:
    return tuple(sorted(GIVEN[group], key=lambda n: _number(key, "circle", group, n)))


@dataclass(frozen=True)
class Entity:
    kind: str
    text: str
    start: int
    end: int


def find(text: str) -> list[Entity]:
    """Entities of a text, in order, not overlapping; more specific kinds win. Whole texts are searched."""
    taken: list[Entity] = []

    def add(kind: str, start: int, end: int) -> None:
        if start < end and not any(start < e.end and e.start < end for e in taken):
            taken.append(Entity(kind, text[start:end], start, end))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", *m.span())
    if re.search(r"\d|[Tt]oken|[Ss]ecret|[Pp]assw|[Kk]ey", text):
        for m in _SECRET.finditer(text):
            add("secret", *m.span(1 if m[1] else 2))
    if re.search(r"\d", text):
        for kind, pattern in (("iban", _IBAN), ("ip", _IP), ("ssn", _SSN), ("phone", _PHONE), ("card", _CARD)):
            for m in pattern.finditer(text):
                add(kind, *m.span())
    words = set(_WORD.findall(text))
    listed = not words.isdisjoint(_CASED) or not words.isdisjoint(TITLES)
    if listed or _CUE_WORD.search(text):
        givens: dict[str, str] = {}
        surnames: set[str] = set()

        def person(given: list[tuple[str, int]], family: list[tuple[str, int]]) -> None:
            for into, parts in ((givens, given), (surnames, family)):
                for word, at in parts:
                    kind = _CASED.get(word, "name") if into is givens else "surname"
                    kind = f"given {kind}" if kind not in ("name", "surname") else kind
                    add(kind, at, at + len(word))
                    givens.setdefault(word, kind) if into is givens else surnames.add(word)

        for m in _RUN.finditer(text) if listed else ():
            run = [(w[0], m.start() + w.start()) for w in _WORD.finditer(m[0])]
            k = 0
            while k < len(run):
                word = run[k][0]
                if word in TITLES and k + 1 < len(run) and run[k + 1][0] in TITLES:
                    k += 1
                elif word in TITLES and k + 1 < len(run):  # a title, perhaps given names, and a surname
                    rest = run[k + 1 : k + 4]
                    n = 0
                    while n < len(rest) - 1 and rest[n][0] in _CASED:
                        n += 1
                    person(rest[:n], rest[n : n + 1])
                    k += n + 2
                elif word in _CASED and k + 1 < len(run):  # given names, perhaps a middle one, and a surname
                    n = 1
                    while k + n + 1 < len(run) and run[k + n][0] in _CASED:
                        n += 1
                    person(run[k : k + n], run[k + n : k + n + 1])
                    k += n + 1
                else:
                    k += 1
        for m in _CUE.finditer(text):
            if m[1] not in TITLES:
                if m[2]:
                    person([(m[1], m.start(1))], [(m[2], m.start(2))])
                elif m[1] in _CASED:
                    person([(m[1], m.start(1))], [])
        again = {**dict.fromkeys(surnames, "surname"), **givens}
        if again:  # later mentions by one name alone
            for m in re.finditer(r"\b(?:" + "|".join(sorted(map(re.escape, again), key=len, reverse=True)) + r")\b", text):
                add(again[m[0]], *m.span())
    return sorted(taken, key=lambda e: e.start)


def canonical(kind: str, text: str) -> str:
    """Forms of one entity that differ in format only are one."""
    if kind in ("card", "ssn", "phone"):  # a number with a country code is none of the same digits without
        return "+" * text.startswith("+") * (kind == "phone") + re.sub(r"\D", "", text)
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind.startswith("given "):
        return text.capitalize()
    if kind in ("email", "surname", "name"):  # what ``like`` takes for one letter
        return "".join(low if (low := c.lower()) in _CLASS and c == low.upper() else c for c in text)
    return text.replace(" ", "").upper() if kind == "iban" else text


#: By kind and keyed digest of the canonical original: which further key it takes.
Retries = Mapping[tuple[str, str], int]


def digest(key: bytes, kind: str, original: str) -> str:
    return hashlib.sha256(b"|".join([key, kind.encode(), original.encode("utf-8", "surrogatepass")])).hexdigest()


def _again(key: bytes, kind: str, original: str, retries: Retries) -> int:
    return retries.get((kind, digest(key, kind, original)), 0) if retries else 0


def replace(key: bytes, text: str, retries: Retries = MappingProxyType({})) -> tuple[str, list[Entity]]:
    out, at = [], 0
    found = find(text)
    for e in found:
        out += [text[at : e.start], surrogate(key, e.kind, e.text, _again(key, e.kind, canonical(e.kind, e.text), retries))]
        at = e.end
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", retries: Retries | None = None) -> DataFrame:
    """One row per entity found: id, kind, original (canonical), surrogate (canonical), start, end (in characters)."""
    secret, kind_of_id, retries = key.encode(), docs.schema[id_col].dataType.simpleString(), dict(retries or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                for e in find(text.as_py() or ""):
                    own = canonical(e.kind, e.text)
                    rows.append((k, e.kind, own, canonical(e.kind, surrogate(secret, e.kind, e.text, _again(secret, e.kind, own, retries))), e.start, e.end))
            if rows:
                which, *cols = zip(*rows)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[id_col, "kind", "original", "surrogate", "start", "end"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind_of_id}, kind string, original string, surrogate string, start int, end int")


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, originals): surrogates that stand for more than one original, over the whole corpus."""
    once = found.groupBy("kind", "surrogate", "original").agg(F.count("*").alias("n"))
    return once.groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).filter("originals > 1")


def split(found: DataFrame) -> DataFrame:
    """(kind, original, surrogates): originals with more than one surrogate, over the whole corpus."""
    once = found.groupBy("kind", "original", "surrogate").agg(F.count("*").alias("n"))
    return once.groupBy("kind", "original").agg(F.count("*").alias("surrogates")).filter("surrogates > 1")


def settle(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", rounds: int = 20) -> dict[tuple[str, str], int]:
    """Which further key each (kind, digest of the original) takes so that no two originals of the corpus share a surrogate.

    Of the originals that share one the first keeps it and the others go on to their next key, until none is shared.
    """
    retries: dict[tuple[str, str], int] = {}
    for _ in range(rounds):
        # keyed digests, so that no original is written anywhere
        hidden = lambda c: F.sha2(F.concat_ws("|", F.lit(key), "kind", c).cast("binary"), 256).alias(c)  # noqa: E731  as ``digest``
        found = materialise(entities(docs, key, text_col, id_col, retries).select("kind", hidden("surrogate"), hidden("original")), "entities")
        if (torn := split(found).first()) is not None:
            raise RuntimeError(f"an original of kind {torn['kind']} has {torn['surrogates']} surrogates")
        shared = found.join(collisions(found).select("kind", "surrogate"), ["kind", "surrogate"], "left_semi").distinct().collect()
        if not shared:
            return retries
        firsts: dict[tuple[str, str], str] = {}
        for r in shared:
            firsts[r["kind"], r["surrogate"]] = min(r["original"], firsts.get((r["kind"], r["surrogate"]), r["original"]))
        for r in shared:
            if firsts[r["kind"], r["surrogate"]] != r["original"]:
                retries[r["kind"], r["original"]] = retries.get((r["kind"], r["original"]), 0) + 1
    raise RuntimeError(f"surrogates are still shared after {rounds} rounds")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", check: bool = True) -> DataFrame:
    """One row per input row: id, n_entities, kinds (sorted distinct, comma-joined), text with surrogates.

    Found are e-mail and IP addresses, phone, card, social-security and bank account numbers, secrets, and names: a known
    given name before another capitalised word, what follows a title, what follows words that introduce a name, and
    later mentions of either part in the same text. A given name that stands alone is none of these
    (Jean jackets). A surrogate comes from a keyed permutation of all entities of its format: equal entities get equal
    surrogates in every document (coreference) and different ones different surrogates (distinctness), without any table. Format, length, case, script, a given name's gender, country codes and check digits stay as they were. With
    ``check`` the whole corpus is searched first: originals that share a surrogate get others, by further keys (see
    ``settle``), and an original with two surrogates raises an error.

    Null text stays null with no entity; texts without entities come back unchanged. Repeated rows get equal results;
    extra columns are ignored; an empty table gives an empty result.
    """
    retries = settle(docs, key, text_col, id_col) if check else {}
    secret, kind_of_id = key.encode(), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                made = [(None, []) if (t := x.as_py()) is None else replace(secret, t, retries) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(e) for _, e in made], pa.int64()), pa.array([",".join(sorted({x.kind for x in e})) for _, e in made], pa.string()), pa.array([t for t, _ in made], pa.string())],
                    names=[id_col, "n_entities", "kinds", "text"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind_of_id}, n_entities long, kinds string, text string")
