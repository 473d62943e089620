"""Personal data with spans in the source text, disguised identifiers included.

Four kinds are found as written: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers.
Then a transducer rewrites disguises (look-alike letters and digits of other scripts, invisible
characters, spelled digits, ``[at]`` and ``dot``) and keeps, for each character it writes, the source
characters it stands for. The same detectors run on its output, and what they find is mapped back.
Open spans always stay; a disguised one is added unless an open span of its kind covers it, so both the plain
remainder of a half-disguised identifier and the whole are reported. Redaction replaces overlapping spans as one.

Cases: a null or empty text has no spans; repeated rows give equal rows; other columns pass through,
except one with the name of the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.tables import arrow_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)

# Patterns start at the first digit of a run and never give digits back, so long runs cost linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: each ``@`` takes the whole run before it that no earlier match has used."""
    free, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        sign = text.find("@", sign + 1)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield m.span()


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Everything written openly, by kind and start."""
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)]
        found += [("card", *s) for s in cards(text)]
        found += [("phone", *s) for s in phones(text)]
    return found


def _alike() -> dict[str, str]:
    """Look-alike characters and what they stand for; an empty string for invisible ones."""
    table = dict(zip("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u051b\u051d", "aeopcyxijsdhqw"))
    table |= dict(zip("\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0423\u0425\u0406\u0408\u0405", "ABEKMHOPCTYXIJS"))
    table |= dict(zip("\u03b1\u03b9\u03ba\u03bd\u03bf\u03c1\u03c4\u03c5\u03c7", "aikvoptux"))
    table |= dict(zip("\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7", "ABEZHIKMNOPTYX"))
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        table[chr(code)] = chr(code - 0xFEE0)
    for code in range(0x1D400, 0x1D6A4):  # mathematical letters
        letter = unicodedata.normalize("NFKC", chr(code))
        if letter.isascii():
            table[chr(code)] = letter
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {chr(zero + i): str(i) for i in range(10)}
    table |= dict.fromkeys("\u3002\u2024", ".") | dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-")
    table |= dict.fromkeys("\u00a0\u2007\u202f", " ")
    table |= dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", "")
    return table


ALIKE = _alike()
#: Two short classes, those beyond 16 bits as one range: a class that lists them is slow to test.
_ALIKE = re.compile("[" + "".join(re.escape(c) for c in ALIKE if c <= "\uffff") + "]|[\U0001d400-\U0001d7ff]")
#: Spelled digits in English, German, French and Spanish.
_SPOKEN = (
    "zero oh null zéro cero", "one ein eins eine un une uno una", "two zwei zwo deux dos", "three drei trois tres",
    "four vier quatre cuatro", "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete",
    "eight acht huit ocho", "nine neun neuf nueve",
)
DIGITS = {word: str(i) for i, line in enumerate(_SPOKEN) for word in line.split()}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_PLUS = "plus|más|mas"
_DOT = "dot|punkt|point|punto"
_AT_SIGN = "klammeraffe|arobase|arrobase|arobas|arroba"
#: Digit words and numbers in a row, across blanks, commas, hyphens, brackets and dots. A dot before a new
#: sentence, and a comma beside a number of several digits, ends the row.
_BETWEEN = (
    rf"(?:[\s()\[\]-]|(?<![0-9][0-9]),(?!\s*[0-9][0-9])|\.(?!\s+(?-i:[A-Z]))|(?<=[\s()\[\]])(?:{_DOT})(?=[\s()\[\]]))*+"
)
_TOKEN = rf"(?:{_WORD}|[0-9]++)(?![^\W_])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_PLUS})[\s,-]*+(?=[0-9]|{_WORD}))?{_TOKEN}(?:{_BETWEEN}(?<![^\W_]){_TOKEN})+", re.I)
_DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:{_PLUS}|{_WORD}|{_DOT})(?![^\W_])|[0-9]|\.", re.I)
_ANY_DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:{_WORD})(?![^\W_])", re.I)
#: What the words of a text are made of, and two digits in a row, one of them spelled (see ``_may_spell``).
_WORDS = re.compile(r"[^\W_]+")
_ROW = re.compile(r"w\.*[wn]|n\.*w")
#: Blanks in front of the bracket go with it (``before``): to search for them would start anew at each blank.
_BRACKET = re.compile(rf"[\[({{<]\s*+(at|ät|à|{_AT_SIGN}|{_DOT}|@|\.)\s*+[\])}}>]\x20*+", re.I)
#: An address whose ``0`` and ``1`` are partly letters; two parts are numbers.
_LETTERED_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9OoIl]{1,3}(?:\.[0-9OoIl]{1,3}){3}(?![A-Za-z0-9]|\.[A-Za-z0-9])")
_ZERO_ONE = str.maketrans("OoIl", "0011")
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])\x20+dot\x20+(?=[A-Za-z0-9])", re.I)
#: A bare "at" counts only with a spelled dot behind the next word.
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9])\x20+at\x20+(?=[A-Za-z0-9-]+(?:\x20+dot\x20|\x20*[\[({<]\s*(?:dot|\.)\s*[\])}>]))", re.I)
#: Whole addresses with the other languages' words: "at" and "ät" need a spelled dot, names of the sign any dot.
#: Such words for dots are common ones, so they count only within an address (of at most 64 characters before the
#: sign) or a row of digits.
_SPOKEN_DOT = rf"(?:\x20+(?:{_DOT})\x20+|\.)"
_SPOKEN_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20+(?:{_DOT})\x20+[A-Za-z0-9._%+-]++){{0,31}}"
    rf"(?:\x20+(?:{_AT_SIGN})\x20+[A-Za-z0-9-]++(?:{_SPOKEN_DOT}[A-Za-z0-9-]++)+"
    r"|\x20+(?:at|ät)\x20+[A-Za-z0-9-]++(?:\x20+punkt\x20+[A-Za-z0-9-]++)+)", re.I,
)
_SPOKEN_PARTS = re.compile(rf"(?<!\x20)\x20++(at|ät|{_AT_SIGN}|{_DOT})\x20++", re.I)
_SPOKEN_WORDS = tuple(f" {word} " for word in ("at", "ät", *_AT_SIGN.split("|"), *_DOT.split("|")))
_DOTS = frozenset(_DOT.split("|"))


def _sign(word: str) -> str:
    return "." if re.fullmatch(rf"{_DOT}|\.", word, re.I) else "@"


class Tape:
    """A rewritten text; character ``i`` stands for source characters ``[start[i], end[i])``."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | None = None
        self.end: list[int] | None = None

    def rewrite(self, pattern: re.Pattern, put, before: str = "") -> None:
        """Replace matches by ``put(match)``; the new characters stand for the whole match.

        Characters ``before`` right in front of a match belong to it.
        """
        last, parts, edits = 0, [], []
        for m in pattern.finditer(self.text):
            new, start = put(m), m.start()
            while start > last and self.text[start - 1] == before:
                start -= 1
            if new != self.text[start : m.end()]:
                parts += [self.text[last:start], new]
                edits.append((start, m.end(), len(new)))
                last = m.end()
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        start, end, last = [], [], 0
        for a, b, size in edits:
            start += self.start[last:a] + [self.start[a]] * size
            end += self.end[last:a] + [self.end[b - 1]] * size
            last = b
        self.start, self.end = start + self.start[last:], end + self.end[last:]
        self.text = "".join(parts) + self.text[edits[-1][1] :]

    @staticmethod
    def _digit(m: re.Match) -> str:
        word = m[0].lower()
        if word == "." and (m.string[m.end() : m.end() + 1].isspace() or m.string[m.start() - 1 : m.start()].isspace()):
            return " "  # a full stop, as of a numbered list: no dot of an address
        return DIGITS.get(word) or (word if word.isdigit() else "+" if re.fullmatch(_PLUS, word) else ".")

    def spell(self) -> None:
        """Write rows of spelled digits as digits, each standing for its own word, and dots between them."""
        runs = []
        for m in _SPELLED.finditer(self.text):
            if _ANY_DIGIT_WORD.search(m[0]):
                found = [(w, self._digit(w)) for w in _DIGIT_WORD.finditer(m[0])]
                digits = "".join(new for _, new in found if new.isdigit())
                # A card number has no dots; fewer than four digits matter in addresses only.
                if 13 <= len(digits) <= 19 and not found[0][1] == "+" and luhn(digits):
                    found = [x for x in found if x[1] not in ". "]
                if len(digits) >= 4 or "@" in self.text:
                    runs.append((m.start(), found))
        if not runs:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        parts, start, end, last = [], [], [], 0
        for a, found in runs:
            parts.append(self.text[last:a])
            start += self.start[last:a] + [self.start[a + w.start()] for w, _ in found]
            end += self.end[last:a] + [self.end[a + w.end() - 1] for w, _ in found]
            parts += [new for _, new in found]
            last = a + found[-1][0].end()
        self.start, self.end = start + self.start[last:], end + self.end[last:]
        self.text = "".join(parts) + self.text[last:]


def _numbers(m: re.Match) -> str:
    plain = sum(part.isdigit() for part in m[0].split("."))
    return m[0].translate(_ZERO_ONE) if 2 <= plain < 4 else m[0]


def _may_spell(lower: str) -> bool:
    """Whether two digits stand side by side, one of them spelled: nothing else makes a row."""
    words = _WORDS.findall(lower)
    if DIGITS.keys().isdisjoint(words):
        return False
    return bool(_ROW.search("".join("w" if w in DIGITS else "n" if w.isdigit() else "." if w in _DOTS else " " for w in words)))


def uncover(text: str) -> Tape:
    """The text without disguises."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_ALIKE, lambda m: ALIKE.get(m[0], m[0]))
    lower = tape.text.lower()
    if any(c in lower for c in "[({<"):
        if " at " in lower:
            tape.rewrite(_WORD_AT, lambda m: "@")
        tape.rewrite(_BRACKET, lambda m: _sign(m[1]), before=" ")
    if " dot " in lower:
        tape.rewrite(_WORD_AT, lambda m: "@")
        tape.rewrite(_WORD_DOT, lambda m: ".")
    if any(word in lower for word in _SPOKEN_WORDS):
        tape.rewrite(_SPOKEN_ADDRESS, lambda m: _SPOKEN_PARTS.sub(lambda w: _sign(w[1]), m[0]))
    if _may_spell(lower):
        tape.spell()
    if "." in tape.text:
        tape.rewrite(_LETTERED_IP, _numbers)
    return tape


def personal_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, written openly)`` by kind and start."""
    plain = plain_spans(text)
    found = [(*s, True) for s in plain]
    tape = uncover(text)
    if tape.start is not None:
        for kind, a, b in plain_spans(tape.text):
            start, end = tape.start[a], tape.end[b - 1]
            if not any(kind == k and x <= start and end <= y for k, x, y in plain):
                found.append((kind, start, end, False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_personal_data(docs: DataFrame, text: str = "text", result: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, base), in code points of the source text."""
    arrow_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != result]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "base"), s)) for s in personal_spans(t)] if t else []
                for t in _texts(batch.column(text))
            ]
            columns = [batch.column(f.name) for f in kept] + [pa.array(spans, _ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), result])

    return docs.mapInArrow(mapped, T.StructType([*kept, T.StructField(result, SPANS)]))


def _texts(column: pa.Array) -> Iterator[str | None]:
    """One text at a time, not the whole batch as Python strings."""
    for value in column:
        yield value.as_py()


def merged(spans: list[tuple[str, int, int, bool]]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the unions of overlapping spans, each with the kind of its longest span."""
    out, longest = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b, _ in spans):
        if out and start < out[-1][1]:
            first, last, named = out[-1]
            out[-1] = (first, max(last, end), kind if end - start > longest else named)
            longest = max(longest, end - start)
        else:
            out.append((start, end, kind))
            longest = end - start
    return out


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null."""
    arrow_batches(docs.sparkSession)

    def clean(value: str | None) -> str | None:
        parts, last = [], 0
        for a, b, kind in merged(personal_spans(value)) if value else []:
            parts += [value[last:a], f"[{kind.upper()}]"]
            last = b
        return "".join(parts) + value[last:] if parts else value

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = pa.array([clean(t) for t in _texts(batch.column(at))], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(mapped, docs.schema)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row per document: openly written spans by kind and their digest, and all spans as text."""
    found = find_personal_data(docs.select("doc_id", "text"))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")
    )
