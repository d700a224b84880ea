"""Personal data: keyed, type-consistent surrogates for what a text reveals.

Everything runs on DataFrame functions.  Detected are e-mail addresses, telephone
numbers, IPv4 addresses, bank-account, payment-card and social-security numbers,
secrets such as tokens and passwords, and names that follow a title.  Names that
never follow a title, dates of birth and street addresses are not detected.

* A surrogate depends on a secret key, the type and the normalised value alone, so
  one person stays one person wherever the corpus names them (coreference).  In a
  text, the words of a name replaced once are replaced at all their mentions, with
  a title or without, and so are secrets.
* It has the form of its original: digits for digits, letters of the same script
  and case, the same separators, country code, bank country and top-level domain;
  secrets are found in either case, and hexadecimal ones are the same value in both;
  a card or account number stays valid or invalid; a given name gets one of the
  gender that a title shows, here or, after a title like Dr., elsewhere.
* Numbers and plain addresses are mapped by a keyed permutation of their format's
  space, without fixed points, so two values never share a surrogate, however dense
  they lie.  Other types draw from a space that grows with each attempt, and where
  two would share a surrogate all but the first draw again (distinctness).
* A surrogate that is a real value of the corpus is drawn again too.  Where a format
  holds so many values that no free one is found, a number keeps the permutation's
  image, which is another's real value but no other's surrogate.

Texts without personal data are passed on untouched and are not shuffled.  Values
travel without their texts; equal texts are treated once.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Table

#: The session setting that holds the key.
KEY_SETTING = "spark.tessella.pii.key"
ROUNDS = 20
#: Attempts after which a number keeps its first surrogate, and the longest value that is permuted.
PERMUTED_ATTEMPTS, LONGEST_PERMUTED = 6, 96

#: A word of a name; a final 's is no part of it.
_WORD = r"(?=[\p{Lu}\p{Lo}][\p{L}\p{M}'’-])[\p{L}\p{M}]{1,40}(?:['’-](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]{1,40}){0,3}"
#: Any such word in lower or upper case, or what is between two.
_PIECE = r"[\p{L}\p{M}]+(?:['’-](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]+)*|[^\p{L}\p{M}]+"
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "госпожа", "Κυρία", "السيدة")
_MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "господин", "Κύριος", "السيد")
_EITHER = ("Dr", "Prof", "Professor", "Doctor", "Доктор", "доктор", "Профессор", "профессор")
_any = lambda titles: "(?:" + "|".join(sorted(titles, key=lambda t: -len(t))) + ")"
#: One to three titles and up to two initials; the look at one letter makes most places fail at once.
_FIRST = "(?=[" + "".join(sorted({t[0] for t in _FEMALE + _MALE + _EITHER})) + "])"
_HEAD = rf"{_FIRST}(?:{_any(_FEMALE + _MALE + _EITHER)}\.? ){{1,3}}(?:\p{{Lu}}\. ?){{0,2}}"
#: Country codes of telephone numbers, by their first digits.
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

#: Such a secret is the same in either case.
_HEXADECIMAL = "^[0-9A-Fa-f]+$"
_BEFORE_SECRET = r"(?i:token|secret|password|passwd|api_key|apikey|access_key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"

#: Type and pattern; an earlier one wins.  All begin where no letter or digit is before.
#: Secrets have any length; their possessive runs never step back, so they stay linear.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,128}@[\p{L}\p{N}-]{1,64}(?:\.[\p{L}\p{N}-]{1,64}){1,8}",
    "secret": rf"(?:{_BEFORE_SECRET}[A-Za-z0-9_+/.~=-]{{8,}}+|" + r"(?:(?i:AKIA)[0-9A-Za-z]{16}|(?i:gh[pousr])_[A-Za-z0-9]{36}|(?i:sk)-[A-Za-z0-9]{20,}+|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})(?![\p{L}\p{N}]))",
    "phone": r"(?<!\.)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<!\.)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    "name": rf"{_HEAD}{_WORD}(?: {_WORD}){{0,2}}",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Every match holds a digit, an @, the start of a secret in any case or a title with what follows; cheap tests that most texts fail.
_SECRET_WORDS = "(?i)token|secret|passw|api_key|apikey|access_key"
_TITLES = [t for t in _FEMALE + _MALE + _EITHER if not any(u != t and u in t for u in _FEMALE + _MALE + _EITHER)]
_TITLE_HINT = rf"{_FIRST}{_any(_FEMALE + _MALE + _EITHER)}[ .]"


def hint(text: Column) -> Column:
    titled = text.contains(_TITLES[0])
    for title in _TITLES[1:]:
        titled = titled | text.contains(title)
    named = (text.contains(":") | text.contains("=")) & text.rlike(_SECRET_WORDS)
    bare = text.rlike("[aA][kK][iI][aA]") | (text.contains("_") & text.rlike("[gG][hH][pousrPOUSR]_")) | (text.contains("-") & text.rlike("[sS][kK]-")) | text.rlike("[a-fA-F]{40}")
    return text.rlike("[0-9@]") | (titled & text.rlike(_TITLE_HINT)) | named | bare


#: Letters that a letter of the same class may become.
_ALPHABETS = (
    ("[0-9]", "0123456789"),
    ("[aeiou]", "aeiou"),
    ("[a-z]", "bcdfghklmnprstvz"),
    ("[AEIOU]", "AEIOU"),
    ("[A-Z]", "BCDFGHKLMNPRSTVZ"),
    ("[а-яё]", "абвгдезиклмнопрстуфя"),
    ("[А-ЯЁ]", "АБВГДЕЗИКЛМНОПРСТУФЯ"),
    ("[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[Α-ΩΆ-Ώ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("[א-ת]", "אבגדהוזחטילמנספצקרשת"),
    ("[ء-ي]", "ابتجحدرزسشصطعفقكلمنهوي"),
    ("[ぁ-ゖ]", "あいうえおかきくけこさしすせそたちつてとなにの"),
    ("[ァ-ヺ]", "アイウエオカキクケコサシスセソタチツテトナニノ"),
    ("[ऀ-ॣ]", "कखगघचजटडतदनपबमयरलवसह"),
    ("[가-힣]", "가나다라마바사아자차카타파하고노도로모보"),
    ("[一-鿿]", "安白成春东方高光海和江金林明南平青山文新"),
    (r"\p{Lu}", "BCDFGHKLMNPRSTVZ"),
    (r"\p{L}", "bcdfghklmnprstvz"),
)
_ENDINGS = {
    ("latin", "f"): ("ina", "ela", "ara", "ia"),
    ("latin", "m"): ("an", "or", "ek", "us"),
    ("latin", "n"): ("el", "in", "is", "ay"),
    ("cyrillic", "f"): ("ина", "ела", "ара", "ия"),
    ("cyrillic", "m"): ("ан", "ор", "ек", "ил"),
    ("cyrillic", "n"): ("ей", "ай", "ис", "ин"),
}


def _pick(choices: str | tuple[str, ...], k: Column) -> Column:
    if isinstance(choices, str):
        return F.substring(F.lit(choices), F.pmod(k, F.lit(len(choices))).cast("int") + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, choices)), F.pmod(k, F.lit(len(choices))).cast("int") + 1)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) number from 0 to 65535 of a hexadecimal key stream, round and round."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(48)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letters(value: Column, stream: Column) -> Column:
    """Every letter and digit replaced by one of its class, everything else kept; in linear time, as secrets may be long."""

    def one(c: Column, i: Column) -> Column:
        k = _byte(stream, i)
        out = F.when(c.rlike(_ALPHABETS[0][0]), _pick(_ALPHABETS[0][1], k))
        for pattern, alphabet in _ALPHABETS[1:]:
            out = out.when(c.rlike(pattern), _pick(alphabet, k))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test; divisible by ten for a valid number."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def _mod97(chars: Column) -> Column:
    """Remainder of a bank account number in its checking order, letters counting 10 to 35."""

    def step(a: Column, i: Column) -> Column:
        c = F.substring(chars, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), step)


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Characters that a permutation replaces, by class; the order is that of their numbers.
_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _turned(numbers: Column, sizes: Column, seed: Column) -> Column:
    """A keyed permutation, without fixed points, of the arrays of numbers below `sizes`, all of them 2 or more.

    A Feistel network over even and odd places, undone, a step by one at the first place,
    and the network again: the step's conjugate moves every array.
    """

    def step(x: Column, s: Column) -> Column:
        k, sign = F.when(s < 0, -s - 1).otherwise(s), F.when(s < 0, -1).otherwise(1)
        mine = lambda i: F.pmod(i, F.lit(2)) == F.pmod(k, F.lit(2))
        other = F.array_join(F.transform(x, lambda v, i: F.when(~mine(i), v.cast("string"))), ",")
        stream = F.concat(*(F.sha2(F.concat(seed, k.cast("string"), F.lit(f"|{n}|"), other).cast("binary"), 256) for n in range(3)))
        size = lambda i: F.element_at(sizes, i + 1)
        moved = _bound(stream, lambda st: F.transform(x, lambda v, i: F.when(mine(i), F.pmod(v + sign * _byte(st, F.floor(i / 2)), size(i))).otherwise(v).cast("int")))
        shifted = F.transform(x, lambda v, i: F.when(i == 0, F.pmod(v + 1, size(i))).otherwise(v).cast("int"))
        return F.when(s == 9, shifted).otherwise(moved)

    return F.aggregate(F.array(*map(F.lit, (-4, -3, -2, -1, 9, 0, 1, 2, 3))), numbers, step)


def _is_permuted(kind: Column, norm: Column) -> Column:
    plain = (kind == "email") & (F.length(norm) <= LONGEST_PERMUTED) & norm.rlike("^[\\x21-\\x7e]+$")
    return kind.isin("phone", "ssn", "ip", "card", "iban") | plain


def _permuted(kind: Column, norm: Column, seed: Column) -> Column:
    """The permutation's image of a number or plain address, in its own format."""
    n = F.length(norm)
    top = n - F.length(F.substring_index(norm, ".", -1))
    country = F.length(F.regexp_extract(norm, r"^\+\d+ ", 0))
    low = F.when(kind == "phone", country).when(kind == "iban", 4).otherwise(0)
    high = F.when(kind == "card", n - 1).when(kind == "email", top).otherwise(n)

    def cell(c: Column, i: Column) -> Column:
        number, size = F.lit(0), F.lit(1)
        for chars in _CLASSES:
            number, size = F.when(F.instr(F.lit(chars), c) > 0, F.instr(F.lit(chars), c) - 1).otherwise(number), F.when(F.instr(F.lit(chars), c) > 0, len(chars)).otherwise(size)
        free = (i >= low) & (i < high)
        return F.struct(F.when(free, number).otherwise(0).cast("int").alias("x"), F.when(free, size).otherwise(1).cast("int").alias("r"), c.alias("c"))

    octet = lambda o: F.struct(F.when(o.cast("int").isin(0, 255), 0).otherwise(o.cast("int") - 1).alias("x"), F.when(o.cast("int").isin(0, 255), 1).otherwise(254).alias("r"), o.alias("c"))
    cells = F.when(kind == "ip", F.transform(F.split(norm, r"\."), octet)).otherwise(F.transform(F.split(norm, ""), cell))

    def char(c: Column, turned: Column) -> Column:
        v, out = F.try_element_at(turned, c["rank"]), c["c"]
        for chars in _CLASSES:
            out = F.when(F.instr(F.lit(chars), c["c"]) > 0, F.substring(F.lit(chars), v + 1, F.lit(1))).otherwise(out)
        return F.when(c["r"] == 1, c["c"]).otherwise(out)

    def image(cells: Column) -> Column:
        free = lambda cells: F.filter(cells, lambda c: c["r"] > 1)
        rank = F.transform(cells, lambda c, i: F.struct(c["c"].alias("c"), c["r"].alias("r"), F.greatest(F.lit(1), F.size(free(F.slice(cells, F.lit(1), i + 1)))).alias("rank")))
        turned = _bound(F.transform(free(cells), lambda c: c["r"]), lambda sizes: _turned(F.transform(free(cells), lambda c: c["x"]), sizes, seed))
        octet = lambda c, turned: F.when(c["r"] == 1, c["c"]).otherwise((F.try_element_at(turned, c["rank"]) + 1).cast("string"))
        joined = lambda one, by: _bound(turned, lambda turned: F.array_join(F.transform(rank, lambda c: one(c, turned)), by))
        return F.when(kind == "ip", joined(octet, ".")).otherwise(joined(char, ""))

    return _bound(_bound(cells, image), lambda new: F.when(kind == "card", _checked_card(norm, new)).when(kind == "iban", _checked_iban(norm, new)).otherwise(new))


def _checked_card(norm: Column, new: Column) -> Column:
    """The new number with a last digit as far from the Luhn digit as the old one's."""
    short = lambda number: F.substring(number, F.lit(1), F.length(number) - 1)
    check = lambda number: F.pmod(-_luhn(F.concat(short(number), F.lit("0"))), F.lit(10))
    off = F.substring(norm, F.length(norm), F.lit(1)).cast("int") - check(norm)
    return F.concat(short(new), F.pmod(check(new) + off, F.lit(10)).cast("string"))


def _checked_iban(norm: Column, new: Column) -> Column:
    """The new number with check digits as far from the right ones as the old one's."""
    land, account = F.substring(norm, 1, 2), lambda number: F.substring(number, F.lit(5), F.length(number))
    proof = lambda number: 98 - _mod97(F.concat(account(number), land, F.lit("00")))
    off = F.substring(norm, 3, 2).cast("int") - proof(norm)
    return F.concat(land, F.lpad(F.pmod(proof(new) + off, F.lit(100)).cast("string"), 2, "0"), account(new))


def _candidate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    seed = F.concat(F.lit(key + "\n"), kind, F.lit("\n"), attempt.cast("string"), F.lit("\n"))
    stream = F.concat(*(F.sha2(F.concat(seed, norm, F.lit(f"\n{k}")).cast("binary"), 256) for k in range(3)))
    return F.when(_is_permuted(kind, norm), _permuted(kind, norm, seed)).otherwise(_bound(stream, lambda s: _from_stream(kind, norm, attempt, s)))


def _from_stream(kind: Column, norm: Column, attempt: Column, stream: Column) -> Column:
    plain = _letters(norm, stream)
    top = F.substring_index(norm, ".", -1)
    email = F.concat(F.substring(plain, F.lit(1), F.length(norm) - F.length(top)), top)
    hexadecimal = F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: _pick("0123456789abcdef", _byte(stream, i - 1))), "")
    more = F.least(attempt, F.lit(15))
    syllables = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(0), more + 1), lambda i: F.concat(_pick(a, _byte(stream, i * 2)), _pick(b, _byte(stream, i * 2 + 1)))), "")
    cyrillic, latin = syllables("бвгдзклмнпрст", "аеиоу"), syllables("bdfgklmnprstv", "aeiou")
    is_cyrillic, is_latin = norm.rlike(r"^[\p{IsCyrillic}'’-]+$"), norm.rlike(r"^[\p{IsLatin}'’-]+$")
    given = F.when((kind == "surname") & is_latin, F.concat(latin, _pick("nrlskmt", _byte(stream, F.lit(41))))).when((kind == "surname") & is_cyrillic, F.concat(cyrillic, _pick("нрлскмт", _byte(stream, F.lit(41))))).otherwise(plain)
    for sex in "fmn":
        of = kind == f"given_{sex}"
        given = F.when(of & is_latin, F.concat(latin, _pick(_ENDINGS["latin", sex], _byte(stream, F.lit(40))))).when(of & is_cyrillic, F.concat(cyrillic, _pick(_ENDINGS["cyrillic", sex], _byte(stream, F.lit(40))))).otherwise(given)
    return (
        F.when(kind == "email", email)
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), hexadecimal)
        .when(kind.startswith("given") | (kind == "surname"), given)
        .otherwise(plain)
    )


def _kind(raw: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        if kind not in ("secret", "name"):
            test = raw.rlike(f"^(?:{pattern})$")
            out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.when(raw.rlike(f"^(?:{PATTERNS['name']})$"), "name").otherwise("secret")


def _parts(raw: Column, kind: Column) -> Column:
    """(kind, norm, word) of each part of a value that gets a surrogate of its own: the words of a name, else the whole; word: as a name's word stands."""
    head = F.regexp_extract(raw, f"^{_HEAD}", 0)
    has = lambda titles: head.rlike(rf"(?:^|[ .]){_any(titles)}[. ]")
    sex = F.when(has(_FEMALE), "f").when(has(_MALE), "m").otherwise("n")
    words = F.split(F.substring(raw, F.length(head) + 1, F.length(raw)), " ")
    names = F.transform(words, lambda w, i: F.struct(F.when(i < F.size(words) - 1, F.concat(F.lit("given_"), sex)).otherwise("surname").alias("kind"), F.lower(w).alias("norm"), w.alias("word")))
    raw = F.when(kind == "secret", F.regexp_replace(raw, f"^{_BEFORE_SECRET}", "")).otherwise(raw)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    apart, code = F.regexp_extract(raw, r"^\+(\d{1,3})[^0-9]", 1), F.regexp_extract(digits, f"^({_COUNTRY})", 1)
    land = F.when(apart != "", apart).otherwise(code)
    phone = F.when(raw.startswith("+"), F.concat(F.lit("+"), land, F.lit(" "), F.substring(digits, F.length(land) + 1, F.length(digits)))).otherwise(digits)
    norm = (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when((kind == "email") | ((kind == "secret") & raw.rlike(_HEXADECIMAL)), F.lower(raw))
        .otherwise(raw)
    )
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), F.lit(None).cast("string").alias("word"))))


def _like(raw: Column, surrogate: Column) -> Column:
    """The surrogate in the case of the original."""
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    first = F.substring(raw, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper, F.upper(surrogate)).when(capital, F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))).otherwise(surrogate)


def _rendered(raw: Column, kind: Column, parts: Column) -> Column:
    """A value's surrogate in the format of the value as it stands in the text; parts: (word, surrogate) in order."""
    one = F.element_at(parts, 1)["surrogate"]

    def spaced(kept: str) -> Column:
        """The surrogate's characters at the places of the kept ones, separators as they stand."""
        bare = F.regexp_replace(one, f"[^{kept}]", "")
        nth = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), f"[^{kept}]", ""))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(F.substring(raw, i, F.lit(1)).rlike(f"[{kept}]"), F.substring(bare, nth(i), F.lit(1))).otherwise(F.substring(raw, i, F.lit(1)))), "")

    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(F.substring(raw, i, F.lit(1)) == F.substring(F.lower(raw), i, F.lit(1)), F.substring(one, i, F.lit(1))).otherwise(F.upper(F.substring(one, i, F.lit(1))))), "")
    head = F.regexp_extract(raw, f"^{_HEAD}", 0)
    name = F.concat(head, F.array_join(F.transform(parts, lambda p: _like(p["word"], p["surrogate"])), " "))
    before = F.regexp_extract(raw, f"^({_BEFORE_SECRET})", 1)
    return F.when(kind == "secret", F.concat(before, _secret(raw, one))).when(kind.isin("phone", "card", "ssn"), spaced("0-9")).when(kind == "iban", spaced("A-Z0-9")).when(kind == "email", cased).when(kind == "name", name).otherwise(one)


def _bare_secret(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{_BEFORE_SECRET}", "")


def _secret(raw: Column, one: Column) -> Column:
    """A secret's surrogate without the words before it; a hexadecimal one in the case that the secret stands in."""
    own = _bare_secret(raw)
    mixed = F.array_join(F.zip_with(F.split(own, ""), F.split(one, ""), lambda a, b: F.when(a == F.lower(a), b).otherwise(F.upper(b))), "")
    hexadecimal = F.when(own == F.upper(own), F.upper(one)).otherwise(mixed)
    return F.when(own.rlike(_HEXADECIMAL) & (own != F.lower(own)), hexadecimal).otherwise(one)


def _mentions(raw: Column, kind: Column, parts: Column) -> Column:
    """(old, new, whole) of what else to replace in the text: a name's words, as they stand and in capitals, and a secret anywhere (whole)."""
    entry = lambda old, new, whole: F.struct(old.alias("old"), new.alias("new"), F.lit(whole).alias("whole"))
    words = F.flatten(F.transform(parts, lambda p: F.array(entry(p["word"], _like(p["word"], p["surrogate"]), False), entry(F.upper(p["word"]), F.upper(p["surrogate"]), False))))
    secret = F.array(entry(_bare_secret(raw), _secret(raw, F.element_at(parts, 1)["surrogate"]), True))
    return F.when(kind == "name", words).when(kind == "secret", secret)


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting; where there is none, one is drawn and set, so surrogates are consistent within this session only."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def _deal(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of costly expressions, dealt over all partitions of a shuffle, however few bytes they have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def surrogate_table(values: DataFrame, key: str, rounds: int = ROUNDS) -> Table:
    """(kind, norm, surrogate) for distinct (kind, norm), without two equal surrogates, and but for numbers in a full format without one that is a real value of its kind.

    A number's later attempts also keep off all numbers' first surrogates, so it can always return to its own.
    """
    first = _candidate(F.col("kind"), F.col("norm"), F.lit(0), key)
    start = _deal(values.select("kind", "norm"), "kind", "norm").withColumns({"attempt": F.lit(0), "settled": F.lit(False), "surrogate": first})
    table = Table(start.withColumn("base", F.when(_is_permuted(F.col("kind"), F.col("norm")), F.col("surrogate"))), "surrogates")
    taken = Table(table.df.select("kind", F.col("norm").alias("surrogate"), F.lit(0).alias("since")).unionAll(table.df.where("base is not null").select("kind", "base", F.lit(1))).groupBy("kind", "surrogate").agg(F.min("since").alias("since")), "taken")
    for _ in range(rounds):
        m = table.df
        keep = m.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm"))["norm"].alias("keeper"), F.count("*").alias("c")).where("c > 1").drop("c")
        twice = m.join(keep, ["kind", "surrogate"]).where("norm <> keeper").select("kind", "norm")
        hits = m.join(taken.df, ["kind", "surrogate"]).where("not settled and attempt >= since").select("kind", "norm")
        bad = Table(twice.unionAll(hits).distinct().withColumn("again", F.lit(True)), "clashes")
        if bad.rows == 0:
            bad.drop()
            taken.drop()
            return table
        marked = m.join(bad.df, ["kind", "norm"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
        back = F.col("again") & F.col("base").isNotNull() & (F.col("attempt") >= PERMUTED_ATTEMPTS)
        moved = marked.withColumns({"settled": F.col("settled") | back, "attempt": F.when(back, 0).otherwise(F.col("attempt") + F.col("again").cast("int"))})
        fresh = F.when(F.col("settled"), F.col("base")).when(F.col("again"), _candidate(F.col("kind"), F.col("norm"), F.col("attempt"), key)).otherwise(F.col("surrogate"))
        after = Table(_deal(moved, "kind", "norm").select("kind", "norm", "attempt", "settled", fresh.alias("surrogate"), "base"), "surrogates")
        bad.drop()
        table.drop()
        table = after
    raise RuntimeError(f"surrogates still clash after {rounds} rounds")


def _values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value) of all personal data, in the order of the text."""
    found = docs.where(hint(F.col("text"))).select("doc_id", F.explode(_values(F.col("text"))).alias("value"))
    return found.select("doc_id", _kind(F.col("value")).alias("kind"), "value")


def with_surrogates(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """The documents, all columns and rows, with surrogates for personal data in `text`.

    key: the secret; if not given, the session's setting KEY_SETTING, without which this
    is an error.  Null and empty texts stay as they are; repeated rows stay; other columns
    are kept, whatever their names.  count: name of an added column with the number of
    values found, further mentions not counted.  An empty table gives no rows.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"no key: give one or set {KEY_SETTING}")
    columns = docs.columns
    free = lambda base: next(n for k in range(10**6) if (n := f"{base}_{k}").lower() not in {c.lower() for c in columns})
    h, m, w, x = free("text_hash"), free("replacements"), free("words"), free("anywhere")
    text = F.col("text")
    some = F.coalesce(F.when(hint(text), text.rlike(PATTERN)), F.lit(False))
    marked = Table(docs.where(some), "marked").df
    values = marked.select(F.md5(text.cast("binary")).alias("h"), F.explode(F.array_distinct(_values(text))).alias("raw")).distinct()
    values = _deal(values, "h", "raw")
    values = values.withColumn("kind", _kind(F.col("raw")))
    values = Table(values.withColumn("parts", _parts(F.col("raw"), F.col("kind"))), "values")
    forms = values.df.groupBy("raw", "kind").agg(F.first("parts").alias("parts"))
    exploded = forms.select("raw", F.col("kind").alias("whole"), F.posexplode("parts").alias("i", "p")).select("raw", "whole", "i", "p.*")
    exploded = Table(exploded, "parts").df
    sexes = exploded.where("kind in ('given_f', 'given_m')").groupBy("norm").agg(F.min("kind").alias("known")).withColumn("kind", F.lit("given_n"))
    exploded = Table(exploded.join(sexes, ["norm", "kind"], "left").withColumn("kind", F.coalesce("known", "kind")).drop("known"), "kinds").df
    table = surrogate_table(exploded.select("kind", "norm").distinct(), key)
    named = exploded.join(table.df.select("kind", "norm", "surrogate"), ["kind", "norm"])
    rendered = named.groupBy("raw", "whole").agg(F.array_sort(F.collect_list(F.struct("i", "word", "surrogate", "kind"))).alias("p"))
    rendered = _deal(rendered, "raw").select("raw", _rendered(F.col("raw"), F.col("whole"), F.col("p")).alias("new"), _mentions(F.col("raw"), F.col("whole"), F.col("p")).alias("mentions"))
    rendered = Table(rendered, "rendered").df
    of = values.df.select("h", "raw").join(rendered, "raw")
    maps = of.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias(m))
    told = of.where("mentions is not null").select("h", F.explode("mentions").alias("x")).select("h", "x.*").groupBy("h", "old").agg(F.max(F.struct("whole", "new")).alias("x"))
    listed = lambda whole: F.collect_list(F.when(F.col("x.whole") == whole, F.struct("old", "x.new")))
    told = told.groupBy("h").agg(F.map_from_entries(listed(False)).alias(w), listed(True).alias(x))
    maps = Table(maps.join(told, "h", "left").withColumnRenamed("h", h), "maps").df
    found = _values(text)
    put = F.concat(F.transform(found, lambda v: F.coalesce(F.element_at(F.col(m), v), v)), F.array(F.lit("")))

    def mentioned(piece: Column) -> Column:
        """What stands between two values, with further mentions replaced."""
        swapped = F.aggregate(F.col(x), piece, lambda t, e: F.replace(t, e["old"], e["new"]))
        words = F.array_join(F.transform(F.regexp_extract_all(swapped, F.lit(_PIECE), F.lit(0)), lambda t: F.coalesce(F.element_at(F.col(w), t), t)), "")
        return F.when(F.size(w) > 0, words).otherwise(swapped)

    pieces = F.split(text, PATTERN, -1)
    pieces = F.when(F.col(w).isNull(), pieces).otherwise(F.transform(pieces, mentioned))
    new = F.array_join(F.flatten(F.zip_with(pieces, put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    extra = lambda n: [n.cast("long").alias(count)] if count else []
    changed = marked.withColumn(h, F.md5(text.cast("binary"))).join(maps, h).select(*(new.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns), *extra(F.size(found)))
    plain = docs.where(~some).select(*(F.col(f"`{c}`") for c in columns), *extra(F.lit(0)))
    return plain.unionAll(changed)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_surrogates(docs, session_key(spark), count="n_replaced")
