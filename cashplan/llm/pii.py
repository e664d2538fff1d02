"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Payment card numbers, IBANs, phone numbers, social security numbers, IPv4 addresses, calendar dates and e-mail addresses
are validated, numbered within the set of values of their format, and that number is permuted within the set. So a
pseudonym has the format of what it stands for and is valid as that was, different values get different pseudonyms, and
equal values get equal ones in every document. The key and the format choose the permutation; without the key it can't
be undone, with it ``undo`` does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from ipaddress import ip_address
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cashplan.llm.common import slices, texts

ROUNDS = 10
#: Signs that are permuted as one number; their halves fit into the 32 bytes that a round hashes.
SIGNS_AT_ONCE = 64
KINDS = ("email", "iban", "card", "date", "ssn", "ip", "phone")

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*?\.[A-Za-z]{2,24}+(?![\w-]))
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){2,7}(?:\ [A-Z0-9]{1,3})?)(?!\w))
    |(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))
    |(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4})(?!\w|-\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d))
    |(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)\ ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d))""",
    re.VERBOSE | re.ASCII,
)
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# The signs that a position of an e-mail name or an account number may hold.
_SIGNS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Permutation:
    """A keyed permutation of 0 to n - 1: an unbalanced Feistel network on the two digits of a number to the base of
    about the root of n, walked along its cycle until the number is below n."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.left = isqrt(max(0, n - 1)) + 1
        self.right = -(-n // self.left)
        self.secret = blake2b(tweak.encode(), key=blake2b(key, digest_size=32).digest()).digest()

    def _round(self, i: int, half: int, size: int) -> int:
        data = half.to_bytes(32, "big") + bytes([i])
        return int.from_bytes(blake2b(data, key=self.secret, digest_size=32).digest(), "big") % size

    def _once(self, x: int, undo: bool) -> int:
        a, b = divmod(x, self.right)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if i % 2:
                b = (b + sign * self._round(i, a, self.right)) % self.right
            else:
                a = (a + sign * self._round(i, b, self.left)) % self.left
        return a * self.right + b

    def __call__(self, x: int, undo: bool = False, allowed: Callable[[int], bool] = lambda _: True) -> int:
        """The number that x goes to, the walk going on until it is allowed, as x must be."""
        while True:
            x = self._once(x, undo)
            if x < self.n and allowed(x):
                return x


class Pseudonyms:
    """Replaces personal data in texts; equal values, under one key, by equal ones."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.permutation = lru_cache(maxsize=4096)(lambda tweak, n: Permutation(key, tweak, n))

    def _number(self, tweak: str, x: int, n: int, allowed=lambda _: True) -> int:
        return self.permutation(tweak, n)(x, self.undo, allowed)

    def _signs(self, tweak: str, text: str) -> str:
        """Letters and digits permuted among those of their kind, all places at once; other signs stay.

        A text of more than ``SIGNS_AT_ONCE`` signs is permuted in blocks: the first one under a digest of the rest, each other one
        under a digest of that outcome, then the first one once more under a digest of the others' outcome. Every place
        depends on all others, and the work grows with the length.
        """
        if len(text) <= SIGNS_AT_ONCE:
            return self._block(tweak, text)
        first, rest = text[:SIGNS_AT_ONCE], text[SIGNS_AT_ONCE:]
        tweak = f"{tweak} {len(text)}"
        first = self._block(f"{tweak} first {_digest(rest)}", first, keep=False)
        of_first = _digest(first)
        rest = "".join(
            self._block(f"{tweak} {at} {of_first}", rest[at : at + SIGNS_AT_ONCE], keep=False)
            for at in range(0, len(rest), SIGNS_AT_ONCE)
        )
        return self._block(f"{tweak} first {_digest(rest)}", first, keep=False) + rest

    def _block(self, tweak: str, text: str, keep: bool = True) -> str:
        """A few signs as one number, permuted. Permutations of tweaks that come but once are not kept."""
        signs = [next((s for s in _SIGNS if c in s), c) for c in text]
        n = prod(map(len, signs))
        x = 0
        for c, s in zip(text, signs, strict=True):
            x = x * len(s) + s.index(c)
        tweak = f"{tweak} {''.join(s[0] for s in signs)}"
        x = self._number(tweak, x, n) if keep else Permutation(self.key, tweak, n)(x, self.undo)
        out = []
        for s in reversed(signs):
            x, at = divmod(x, len(s))
            out.append(s[at])
        return "".join(reversed(out))

    def email(self, text: str) -> str:
        name, _, host = text.partition("@")
        return f"{self._signs('email', name)}@{host}"

    def card(self, text: str) -> str | None:
        digits = [c for c in text if c.isdigit()]
        number = "".join(digits)
        if luhn(number[:-1]) != number[-1] or len(set(number)) == 1:
            return None
        body = number[:-1]
        fresh = str(
            self._number(f"card {len(body)}", int(body), 10 ** len(body), lambda x: len(set(_checked(x, len(body)))) > 1)
        ).zfill(len(body))
        return _fill(text, fresh + luhn(fresh))

    def iban(self, text: str) -> str | None:
        number = text.replace(" ", "")
        if not 15 <= len(number) <= 34 or number[2:4] != iban_check(number[:2], number[4:]):
            return None
        fresh = self._signs("iban", number[4:])
        return _fill(text, number[:2] + iban_check(number[:2], fresh) + fresh, str.isalnum)

    def ssn(self, text: str) -> str | None:
        def allowed(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        x = int(text.replace("-", ""))
        return _fill(text, str(self._number("ssn", x, 10**9, allowed)).zfill(9)) if allowed(x) else None

    def ip(self, text: str) -> str | None:
        try:
            x = int(ip_address(text))
        except ValueError:
            return None
        return str(ip_address(self._number("ip", x, 1 << 32)))

    def phone(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        country, local = digits[:-10], digits[-10:]
        return _fill(text, country + str(self._number(f"phone {country}", int(local), 10**10)).zfill(10))

    def date(self, text: str) -> str | None:
        form = _date_form(text)
        if form is None:
            return None
        parse, show = form
        n = _LAST_DAY - _FIRST_DAY + 1

        def allowed(x: int) -> bool:
            """Read again, the date has this form, so that no other date gets the same text."""
            shown = show(date.fromordinal(_FIRST_DAY + x))
            return _date_form(shown, True) == _date_form(text, True)

        x = parse(text).toordinal() - _FIRST_DAY
        if not 0 <= x < n:
            return None
        return show(date.fromordinal(_FIRST_DAY + self._number(f"date {_date_form(text, True)}", x, n, allowed)))

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with its personal data replaced, and how many of each kind there were."""
        counts = dict.fromkeys(KINDS, 0)

        def pseudonym(match: re.Match) -> str:
            kind = match.lastgroup if match.lastgroup != "gap" else "card"
            found = getattr(self, kind)(match[0])
            if found is None:
                return match[0]
            counts[kind] += 1
            return found

        return (text and _PATTERN.sub(pseudonym, text)), counts


def _digest(text: str) -> str:
    return blake2b(text.encode(), digest_size=32).hexdigest()


def _fill(form: str, signs: str, is_place: Callable[[str], bool] = str.isdigit) -> str:
    """The signs in the places of a form, what else it has in between."""
    rest = iter(signs)
    return "".join(next(rest) if is_place(c) else c for c in form)


def luhn(body: str) -> str:
    """The check digit of a number."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _checked(x: int, length: int) -> str:
    body = str(x).zfill(length)
    return body + luhn(body)


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def _date_form(text: str, name: bool = False):
    """How to read and show a date; its name, if asked for. Day first where that is a date, else month first."""
    sign = next(c for c in text if not c.isdigit())
    parts = text.split(sign)
    orders = ("ymd",) if sign == "-" else ("dmy", "mdy") if sign == "/" else ("dmy",)
    padded = all(len(p) >= 2 for p in parts)
    for order in orders:

        def parse(shown: str, order=order) -> date:
            of = dict(zip(order, map(int, shown.split(sign)), strict=True))
            return date(of["y"], of["m"], of["d"])

        def show(day: date, order=order) -> str:
            of = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
            return sign.join(of[c] if padded else str(int(of[c])) for c in order)

        try:
            parse(text)
        except ValueError:
            continue
        return f"{sign}{order}{padded}" if name else (parse, show)
    return None


def _replaced(key: bytes, undo: bool, counts: bool, columns: list[str]):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key, undo)
        for batch in slices(batches):
            found = [pseudonyms.replace(text) for text in batch.column("text").to_pylist()]
            fresh = pa.array([text for text, _ in found], pa.string())
            out = [fresh if c == "text" else batch.column(c) for c in columns]
            if counts:
                out += [pa.array([n[kind] for _, n in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(out, [*columns, *(f"n_{kind}" for kind in KINDS)] if counts else columns)

    return replace


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: ``doc_id``, ``text`` with pseudonyms, and ``n_<kind>`` for what was replaced.

    Reads ``doc_id`` and ``text`` only. Null texts stay null and empty ones empty. Repeated rows each come back, ids may be
    null, an empty table gives an empty one. Texts, and names in them, may be of any length. Candidates that are not valid (a card number with a wrong check digit,
    the 31st of February) stay as they are. There is no shuffle and no table of pseudonyms: a value's pseudonym follows
    from the key.
    """
    schema = "doc_id long, text string, " + ", ".join(f"n_{kind} long" for kind in KINDS)
    return texts(docs).mapInArrow(_replaced(key, False, True, ["doc_id", "text"]), schema)


def pseudonymized(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """The documents with pseudonyms in ``text``, other columns as they are; with ``undo``, the other way round."""
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema])
    return docs.mapInArrow(_replaced(key, undo, False, docs.columns), schema)
