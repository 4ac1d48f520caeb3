"""PII surrogates: each entity becomes another of its type, format and script, the same one wherever it stands.

Entities: e-mail addresses, IPv4 and IPv6 addresses, IBANs, card numbers, telephone numbers, hexadecimal secrets, keys of
known forms, values given to `password=` and the like, long numbers, street addresses, and names (after an honorific, or
known given names and the capitalised word behind them; then every word of such a name wherever it stands in that document).

A surrogate is a keyed bijection of the entity's canonical form within its class, so no table of entities is needed, one
pass over the texts does everything, and neither the plan nor the result depends on what else the corpus holds:

- The class is all that stays: the type, the length, which characters are digits, letters of which script, vowels or
  marks, and what the type fixes (an IBAN's country, a telephone number's first digit after +, a key's prefix). The other
  characters are a number below the class's size, and a Feistel network on that number, cycle-walked into the class, is a
  permutation P. The surrogate is P'(P(x) + 1): also a permutation, and one without fixed points, so an entity never
  stays as it is unless its class has no other member.
- Distinctness: different entities of one class have different surrogates, and check digits are recomputed (a valid card
  or IBAN stays valid, an invalid card number invalid by the same amount). Classes of other forms cannot meet. Names have
  classes that can: given names of a list may have the form of other names, and a name's ending may come out of its other
  letters. There each candidate is checked, and one that collides (it is on a list, or has another ending) is walked on
  from, so the permutation is one of what is left: no two names share a surrogate.
- Coreference: numbers are mapped without their marks, addresses and secrets without their case where it has no meaning,
  names word by word, each word by itself alone: not by its honorific, its place or its document. "Mr John Smith", "John
  Smith", "SMITH" and "Dr Smith" agree in every word, in every document.
- Names keep their script, their capitals and their number of words. A given name of GIVEN becomes another of its list,
  which has its gender. Another name keeps its pattern of vowels and the ending that tells its gender (ENDINGS), if it has one.

Values have any length: a long run is mapped in pieces of PIECE characters, each in its place. A value after a colon counts
if a digit follows on its line (`password: see below` is prose); a name counts after an honorific, or if it begins with
given names of GIVEN.

E-mail surrogates end in the reserved domain .example. Since surrogates of a class fill it, one may equal another entity
of the corpus; that entity has itself been replaced, so the mapping stays one to one.

Defined results: a null text stays null with no entities; texts without entities are unchanged; overlapping finds keep
the leftmost, then the type listed first; rows that repeat a doc_id or a text are each replaced, alike; a null doc_id stays
null; an empty table gives an empty result; other columns are not read. A batch of BATCH_ROWS texts is held at once.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

ROUNDS = 8
BATCH_ROWS = 256
#: Honorifics.
HONORIFICS = "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don Г-н Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Г-жа Dr Prof Professor".split()
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adrian Alan Albert Alexander Andrew Anton Arthur Bernard Brian Bruno Carl Carlos Charles Christian Daniel David Dennis Diego Edward Emil Erik Felix Francis Frank Frederic Gabriel George Gerard Harald Henry Hugo Ivan Jacob James John Jonas Jorge José Joseph Juan Jürgen Karl Klaus Kurt Leon Louis Luis Manuel Marcel Mark Martin Matthew Max Michael Miguel Nicolas Noel Oscar Otto Pablo Patrick Paul Pedro Peter Philip Pierre Ralph Richard Robert Simon Stefan Steven Thomas Tomas Victor Walter Werner William".split(),
    ("latin", "f"): "Alice Alma Amelia Andrea Angela Anna Barbara Beatrice Berta Camille Carla Carmen Caroline Catherine Cecilia Charlotte Christine Clara Claire Daniela Diana Dorothea Elena Elisabeth Elizabeth Emma Erika Eva Flora Florence Gabriela Greta Hanna Heidi Helen Ingrid Irene Isabel Jane Jennifer Julia Karen Karla Katharina Laura Lena Linda Louise Lucia Margaret Maria Marie Marta Mary Michelle Monica Nina Nora Olga Patricia Petra Renate Rosa Ruth Sabine Sandra Sara Sofia Sonja Susan Sylvie Teresa Tina Ursula Vera Victoria".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Антон Борис Виктор Владимир Глеб Денис Дмитрий Егор Иван Игорь Кирилл Лев Максим Михаил Николай Олег Павел Петр Роман Сергей Юрий".split(),
    ("cyrillic", "f"): "Алла Анна Валентина Вера Галина Дарья Екатерина Елена Жанна Зоя Инна Ирина Лидия Людмила Мария Наталья Нина Ольга Светлана Татьяна Юлия".split(),
}
_gender_of = {n.lower(): k for k, names in GIVEN.items() for n in names}
#: Endings that tell a name's gender.
ENDINGS = "ова ева ёва ина ына ская цкая ая яя ов ев ёв ин ын ский цкий ий ый а я ova eva ina skaya ov ev in sky ski ska a".split()
#: Characters that are mapped at once.
PIECE = 256
#: Alphabets of which one letter becomes another of the same.
PLAIN = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"]
EXACT = [*PLAIN[:1], PLAIN[1], PLAIN[1].upper(), PLAIN[2], PLAIN[2].upper()]
HEX = ["0123456789abcdef"]
SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "áàâäãåéèêëíìîïóòôöõøúùûüýÿ", "ñçßð"]
SPACE = r"[ \u00a0]"
UPPER, LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
WORD = rf"[{UPPER}][{LOWER}]+"
_title = "|".join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))
NAME = rf"\b(?P<title>{_title})\.?{SPACE}(?P<who>{WORD}(?:[ \u00a0-]{WORD}){{0,2}})"
#: Types in order of preference at one place.
TYPES = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("assigned", r"(?i:\b(?:password|passwd|pwd|passphrase|api[_-]?key|secret|access[_-]?token|token)[\"']?)[ \t]{0,3}(?:=|:(?=[^\n]{0,40}\d))[ \t]{0,3}[\"']?(?P<value>[^\s\"'<>,;]{4,})"),
    ("key", r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![0-9A-Za-z])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|:)(?:(?::[0-9A-Fa-f]{1,4}){1,6})?(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?:[ \u00a0]?[0-9A-Z]{4}){2,7}(?:[ \u00a0]?[0-9A-Z]{1,3})?(?!\w)"),
    ("secret", r"(?<![0-9A-Za-z])(?=[A-Fa-f]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{3}-\d{3}-\d{4}|\d{3}-\d{2}-\d{4}|0\d{2,4}[ /-]\d{5,8})(?!\w)"),
    ("card", r"(?<![\w])(?:\d{4}[ -]){3}\d{1,7}(?!\w)|(?<!\w)\d{13,19}(?!\w)"),
    ("number", r"(?<![\w.,])\d{8,12}(?!\w)"),
    ("address", rf"(?<!\w)\d{{1,5}}{SPACE}{WORD}(?:{SPACE}{WORD})?{SPACE}(?:Street|Avenue|Road|Lane|Drive|Boulevard|St\.|Ave\.|Rd\.|Blvd\.)(?!\w)|(?<!\w)[{UPPER}][{LOWER}]+(?:straße|strasse|gasse|platz|weg){SPACE}\d{{1,4}}(?!\w)|(?<!\w)\d{{1,4}},?{SPACE}(?:rue|avenue|boulevard|calle)(?:{SPACE}(?:de|du|des|la|le|del)){{0,2}}{SPACE}{WORD}"),
    ("name", NAME),
]
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in TYPES))
#: A capitalised word before another: a name if it is a given name; and the word behind it.
PAIR, BEHIND = re.compile(rf"({WORD})(?={SPACE}{WORD})"), re.compile(rf"{SPACE}({WORD})")
#: No match of FIND goes over a line's end, and each holds one of these: a digit, an @ or another head of a key, a title,
#: or a sign after a word for secrets. They start with characters that the search can skip to.
DIGIT, HEAD, SIGN = re.compile(r"\d"), re.compile("@|AKIA|ASIA|gh|sk-|xox|eyJ"), re.compile("[=:]")
TITLE = re.compile(rf"(?:{_title})\.?{SPACE}[{UPPER}]")
ASSIGNED = re.compile(r"(?i)(?:word|wd|phrase|key|secret|token)[\"']?[ \t]{0,3}\Z")


class Cipher:
    """Keyed permutations of the numbers below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _walk(self, label: bytes, n: int, x: int, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        seed = hashlib.shake_256(self.key + len(label).to_bytes(4, "big") + label + n.to_bytes((n.bit_length() + 7) // 8, "big"))

        def mixed(k: int, r: int) -> int:
            h = seed.copy()
            h.update(bytes([k]) + r.to_bytes(size, "big"))
            return int.from_bytes(h.digest(size), "big") & mask

        while True:
            a, b = x >> half, x & mask
            if back:
                for k in reversed(range(ROUNDS)):
                    a, b = b ^ mixed(k, a), a
            else:
                for k in range(ROUNDS):
                    a, b = b, a ^ mixed(k, b)
            x = a << half | b
            if x < n:
                return x

    def moved(self, label: str, n: int, x: int) -> int:
        """A permutation without fixed points of the numbers below n (n of 2 or more)."""
        if n < 2:
            return x
        raw = label.encode()
        return self._walk(raw, n, (self._walk(raw, n, x, False) + 1) % n, True)

    def text(self, kind: str, text: str, alphabets: list[str], keep: int = 0, tail: int = 0, free=None) -> str:
        """text with each letter of an alphabet moved within it, all at once; the first `keep`, the last `tail` and other marks
        stay. free(candidate): false for one that collides, which is walked on from. As the permutation is one cycle, what
        is left of it is one too, and no text stays as it is unless it is alone."""
        if len(text) > PIECE:
            cut = lambda k: self.text(f"{kind}\x02{k}", text[k : k + PIECE], alphabets, max(0, keep - k))
            return "".join(map(cut, range(0, len(text), PIECE)))
        end = len(text) - tail
        sets = [next((a for a in alphabets if c in a), "") if keep <= k < end else "" for k, c in enumerate(text)]
        form = "".join(chr(97 + alphabets.index(s)) if s else c + "\x00" for s, c in zip(sets, text, strict=True))
        n, x = 1, 0
        for s, c in zip(sets, text, strict=True):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)
        while True:
            x = self.moved(f"{kind}\x01{form}", n, x)
            out, rest = [], x
            for s, c in zip(reversed(sets), reversed(text), strict=True):
                if s:
                    rest, at = divmod(rest, len(s))
                    c = s[at]
                out.append(c)
            new = "".join(reversed(out))
            if free is None or free(new):
                return new


@lru_cache(4)
def cipher(key: bytes) -> Cipher:
    return Cipher(key)


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind in ("card", "phone", "number"):
        return "".join(str(int(c)) if c.isdecimal() else c for c in re.sub(r"[^\d+]", "", text))
    if kind == "iban":
        return re.sub(r"\s", "", text)
    if kind == "ipv6":
        return ipaddress.ip_address(text).exploded
    return text.lower() if kind in ("email", "secret") else re.sub(r"\s+", " ", text)


def luhn_digit(digits: str) -> int:
    """The digit that makes the number before it satisfy the Luhn check."""
    twice = [int(d) * 2 for d in digits[::-2]]
    return -(sum(map(int, digits[-2::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def _rest97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def valid_iban(text: str) -> bool:
    return _rest97(text[4:] + text[:4]) == 1


def _digits(c: Cipher, canon: str) -> str:
    """A number of the same length; a first digit other than 0 stays one, + and the digit after it stay."""
    keep = 2 if canon.startswith("+") else 0
    first = "123456789" if canon[keep : keep + 1] != "0" else "0"
    sets = [first, *["0123456789"] * (len(canon) - keep - 1)]
    n, x = 1, 0
    for s, d in zip(sets, canon[keep:], strict=False):
        n, x = n * len(s), x * len(s) + s.index(d)
    x, out = c.moved(f"digits\x01{canon[:keep]}\x01{len(canon)}\x01{first}", n, x), ""
    for s in reversed(sets[: len(canon) - keep]):
        x, at = divmod(x, len(s))
        out = s[at] + out
    return canon[:keep] + out


@lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, canon: str) -> str:
    """The canonical surrogate of an entity other than a name."""
    c = cipher(key)
    if kind == "email":
        return c.text("email", canon, PLAIN) + ".example"
    if kind == "ip":
        x = c.moved("ip", 1 << 32, int(ipaddress.ip_address(".".join(str(int(p)) for p in canon.split(".")))))
        return str(ipaddress.ip_address(x))
    if kind == "ipv6":
        return ipaddress.IPv6Address(c.moved("ipv6", 1 << 128, int(ipaddress.ip_address(canon)))).exploded
    if kind == "iban":
        new = c.text("iban" + canon[:2], canon[4:], EXACT[:1] + EXACT[2:3])
        if not valid_iban(canon):
            return canon[:2] + c.text("iban", canon[2:4], PLAIN[:1]) + new
        return f"{canon[:2]}{98 - _rest97(new + canon[:2] + '00'):02d}{new}"
    if kind == "card":
        new = _digits(c, canon[:-1])
        return new + str((luhn_digit(new) + int(canon[-1]) - luhn_digit(canon[:-1])) % 10)
    if kind == "secret":
        return c.text("hex", canon, HEX)
    if kind == "key":
        return c.text("key", canon, EXACT, len(re.match(r"AKIA|ASIA|gh._|sk-|xox.-|eyJ|", canon).group()))
    return _digits(c, canon)


def _ending(word: str) -> str:
    """The ending that tells a name's gender, if two letters or more stand before it."""
    if len(word) > PIECE:
        return ""
    return next((e for e in sorted(ENDINGS, key=len, reverse=True) if word.endswith(e) and len(word) > len(e) + 1), "")


@lru_cache(1 << 16)
def name_word(key: bytes, word: str) -> str:
    """The surrogate of a lower-case word of a name."""
    c = cipher(key)
    if word in _gender_of:
        names = GIVEN[_gender_of[word]]
        at = [n.lower() for n in names].index(word)
        return names[c.moved("given" + "".join(_gender_of[word]), len(names), at)].lower()
    ending = _ending(word)
    return c.text("name" + ending, word, SOUNDS, tail=len(ending), free=lambda new: new not in _gender_of and _ending(new) == ending)


def _cased(old: str, new: str) -> str:
    up = lambda x: "".join(u if len(u := c.upper()) == 1 else c for c in x)
    if old[1:] and up(old) == old:
        return up(new)
    return "".join(up(n) if o.isupper() else n for o, n in zip(old, new, strict=False)) + new[len(old) :]


def laid_out(kind: str, text: str, new: str) -> str:
    """The surrogate in the mention's own format: its marks, its case."""
    if kind in ("card", "phone", "number"):
        signs = iter(new.replace("+", ""))
        return "".join(chr(ord(c) - int(c) + int(next(signs))) if c.isdecimal() else c for c in text)
    if kind == "iban":
        signs = iter(new)
        return "".join(next(signs) if c.isalnum() else c for c in text)
    if kind == "email":
        return _cased(text, new)
    if kind == "ip":
        return new
    if kind == "ipv6":
        new = new if len(text) == 39 else ipaddress.ip_address(new).compressed
        return new.upper() if text.upper() == text and text.lower() != text else new
    if kind == "secret":
        return new.upper() if text.upper() == text else new
    return new


def _valid6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return len(re.findall("[0-9A-Fa-f]+", text)) > 2 and bool(DIGIT.search(text))


def _lines(text: str):
    """(begin, end) of the lines that FIND can match in, in order."""
    ends = [0]
    for pattern in (DIGIT, HEAD, TITLE, SIGN):
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if pattern is not SIGN or ASSIGNED.search(text, max(0, m.start() - 16), m.start()):
                end = text.find("\n", m.start())
                at = end + 1 if end >= 0 else len(text)
                ends.append(at)
                if end < 0:
                    break
    for end in sorted(set(ends))[1:]:
        yield text.rfind("\n", 0, end - 1) + 1, end


def mentions(text: str | None):
    """(kind, begin, end) of each entity that FIND names or that given names begin, left to right."""
    found = [f for begin, end in _lines(text or "") for f in _found(text, begin, end)]
    at = over = 0
    for m in PAIR.finditer(text or ""):
        begin, end, given = *m.span(), m.group(1)
        if begin < over or given.lower() not in _gender_of or text[begin - 1 : begin].isalnum():
            continue
        while given.lower() in _gender_of and (behind := BEHIND.match(text, end)):
            given, end = behind.group(1), behind.end()
        while at < len(found) and found[at][2] <= begin:
            at += 1
        if at == len(found) or end <= found[at][1]:
            found.insert(at, ("name", begin, end))
            over = end
    return found


def _found(text: str, begin: int, end: int):
    for m in FIND.finditer(text, begin, end):
        kind = next(k for k, _ in TYPES if m.group(k) is not None)
        if kind == "ipv6" and not _valid6(m.group()):
            continue
        if kind == "name":
            yield "name", *m.span("who")
        elif kind == "assigned":
            value = m.group("value")
            kind = "secret" if re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", value) else "key"
            yield kind, *m.span("value")
        else:
            yield kind, *m.span()


SPLIT = re.compile(r"([ \u00a0-])")


def _again(text: str, names: list[tuple[int, int]]) -> re.Pattern | None:
    """A pattern of the words of these names wherever they stand."""
    found = {w.lower() for begin, end in names for w in SPLIT.split(text[begin:end])[::2]}
    words = sorted({f for w in found if len(w) > 2 for f in (w.capitalize(), w.upper())}, key=lambda w: (-len(w), w))
    if not words:
        return None
    one = "|".join(map(re.escape, words))
    return re.compile(rf"(?<!\w)(?:{one})(?:[ \u00a0-](?:{one}))*(?!\w)")


def replaced(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """(text with surrogates, how many mentions of each type)."""
    found = [(begin, end, kind) for kind, begin, end in mentions(text)]
    if not found:
        return text, {}
    again = _again(text, [(begin, end) for begin, end, kind in found if kind == "name"])
    if again:
        taken, at = sorted(f[:2] for f in found), 0
        for m in again.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or m.end() <= taken[at][0]:
                found.append((*m.span(), "name"))
        found.sort()
    parts, at, counts = [], 0, {}
    for begin, end, kind in found:
        old = text[begin:end]
        if kind == "name":
            pieces = SPLIT.split(old)
            new = "".join(p if k % 2 else _cased(p, name_word(key, p.lower())) for k, p in enumerate(pieces))
        elif kind == "address":
            c = cipher(key)
            # Words that name the kind of street are its format.
            new = re.sub(
                rf"\d+|(?!Street|Avenue|Road|Lane|Drive|Boulevard|St\.|Ave\.|Rd\.|Blvd\.)[{UPPER}][{LOWER}]+?(?=(?:straße|strasse|gasse|platz|weg){SPACE}\d|\b)",
                lambda m: laid_out("number", m.group(), _digits(c, canonical("number", m.group()))) if m.group().isdecimal() else _cased(m.group(), c.text("street", m.group().lower(), SOUNDS)), old,
            )
        else:
            new = laid_out(kind, old, surrogate(key, kind, canonical(kind, old)))
        parts += [text[at:begin], new]
        at = end
        counts[kind] = counts.get(kind, 0) + 1
    return "".join(parts) + text[at:], counts


def anonymised(docs: DataFrame, key: bytes = b"tessera") -> DataFrame:
    """docs (doc_id, text) with n_entities, kinds (how many of each type, as a string) and the text with surrogates."""

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                n, kinds, out = [], [], []
                for text in part.column(1).to_pylist():
                    new, counts = replaced(text, key)
                    n.append(sum(counts.values()))
                    kinds.append(",".join(f"{kind}:{counts[kind]}" for kind in sorted(counts)))
                    out.append(new)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(kinds, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_entities", "kinds", "text"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_entities long, kinds string, text string")
