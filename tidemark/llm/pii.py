"""Personal-data spans, plain and disguised, with offsets into the untouched text.

Plain spans come from four patterns, leftmost and non-overlapping per kind. Disguised ones are found by
offset-preserving transducers: a one-to-one character map (homoglyphs, full-width forms, foreign digits), then a
rewriting pass (zero-width characters vanish, spelled digits become digits, at/dot disguises become ``@`` and
``.``) that records where each piece came from. The same detectors run on the normalised text and each new span
is mapped back to source code points. Only texts that hold a trigger are normalised, and the triggers are made of the rewriting
pass's own patterns; everything is per row, so there is no shuffle and no skew, and in time linear in the text.

Edge cases: null and empty text have no span; a text of any length is handled whole; a span found in the normalised text
counts only if some character in it was rewritten and it overlaps no plain span of its kind; where rewritings overlap, the one that starts first
counts, and of those that start alike the first of ``_RANK``; rows that repeat, also with one id, are judged one by one, null ids stay;
input columns other than id and text play no part in ``find_pii`` and are kept by ``redact``; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failed start inside a digit run fails from every later digit of that run too, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g",
    "\u2024": ".", "\u3002": ".", "\uff61": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-",
    "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
    "\u017f": "s", "\u212a": "K", "\u0130": "I",
}
# Digit words of the corpus languages.
_DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}


def _one_to_one() -> dict[int, str]:
    """Look-alikes, and every character whose compatibility form or digit value is one printable ASCII character."""
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    for block in (range(0x0660, 0x0E60), range(0x2070, 0x20A0), range(0x2460, 0x24EB), range(0xFE50, 0xFE70),
                  range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)):
        for cp in block:
            form = unicodedata.normalize("NFKC", chr(cp))
            digit = unicodedata.digit(chr(cp), None)
            if len(form) == 1 and "!" <= form <= "~":
                table.setdefault(cp, form)
            elif digit is not None:
                table.setdefault(cp, str(digit))
    return table


_CHARS = _one_to_one()
_ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
# Last labels of domains that may stand apart from their dot, and letters that pass for digits.
_TOP = "com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|it|nl|uk|us|ch|at|ca"
_DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "S": "5", "B": "8", "Z": "2"}
_LETTER_DIGIT = f"[0-9{''.join(_DIGIT_LETTERS)}]"
# Every pattern is linear: a run of spaces is entered only at its start and never given back.
_S = r"\s*+"
_AT = rf"(?<!\s){_S}(?:[\[({{<]{_S}(?:at|arroba|arobase|@){_S}[\])}}>]|&#(?:64|x40);|&commat;|(?<=\w)%40(?=\w)){_S}"
_DOT = rf"(?<!\s){_S}(?:[\[({{<]{_S}(?:dot|punto|punkt|point|\.){_S}[\])}}>]|&#(?:46|x2e);|&period;){_S}"
_GAP = rf"(?:\s++|{_S}[_*|~-]{{1,3}}+{_S})"
_BARE_AT, _BARE_DOT = rf"(?<!\s){_GAP}(?:at|arroba|arobase){_GAP}", rf"{_GAP}(?:dot|punto|punkt){_GAP}"
_DIGITS_GAP = rf"(?:{_S}[,.()-]{{1,2}}+{_S}|\s++(?:(?:dot|punto|punkt|point)\s++)?+)"
_PIECES = {
    "zero": rf"[{_ZERO_WIDTH}]+",
    "at": _AT,
    "dot": _DOT,
    "digits": rf"(?<!\w)(?:plus\s++|\+{_S})?(?:{_WORD}|[0-9]+)(?:{_DIGITS_GAP}(?:{_WORD}|[0-9]+)){{3,}}(?!\w)",
    "mixed": rf"(?<![\w+])\+?{_LETTER_DIGIT}(?:[\s().-]{{0,2}}{_LETTER_DIGIT}){{6,}}(?!\w)",
}
_RANK = {kind: k for k, kind in enumerate(("zero", "at", "dot", "digits", "bare", "wide", "mixed"))}
_REWRITE = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _PIECES.items()), re.IGNORECASE)
_AT_WORD, _DOT_WORD = re.compile(rf"{_AT}|{_BARE_AT}|(?<!\s){_S}@{_S}", re.IGNORECASE), re.compile(f"{_DOT}|{_BARE_DOT}", re.IGNORECASE)
_AT_SIGN = re.compile(f"{_AT}|@", re.IGNORECASE)
_ALNUM, _SPACES = re.compile(r"[A-Za-z0-9]++"), re.compile(r"\s*+")
_TOPS = frozenset(_TOP.split("|"))
_DIGIT_TOKEN = re.compile(rf"(?P<plus>plus\s+|\+\s*)|(?P<word>{_WORD})|(?P<num>[0-9]+)|(?P<dot>dot|punto|punkt|point|\.)", re.IGNORECASE)
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}|dot|punto|punkt|point)(?!\w)", re.IGNORECASE)


def _local(text: str, end: int, floor: int) -> int:
    """Where the local part of an address that ends at ``end`` starts."""
    while end > floor and (text[end - 1].isalnum() or text[end - 1] in "_.%+-"):
        end -= 1
    return end


def _labels(text: str, at: int, limit: int, spelled: bool) -> list[tuple[int, int, int, int]]:
    """The labels of a domain from ``at`` on: start and end of the separator before a label (equal for a plain dot), start and end of the label.

    Separators are dots and, if ``spelled``, words for them; else dots with spaces around. One pass, nothing is tried twice.
    """
    out, m, sep = [], _ALNUM.match(text, at, limit), (at, at)
    while m:
        start, end = m.start(), m.end()
        while True:  # labels may hold single hyphens, but "-dot-" parts them
            word = _DOT_WORD.match(text, end, limit) if spelled else None
            more = _ALNUM.match(text, end + 1, limit) if not word and text[end : end + 1] == "-" else None
            if not more:
                break
            end = more.end()
        out.append((*sep, start, end))
        gap = end if spelled else _SPACES.match(text, end, limit).end()
        if word:
            sep = word.span()
        elif text[gap : gap + 1] == "." and gap < limit:
            sep = (gap, gap + 1) if spelled else (end, _SPACES.match(text, gap + 1, limit).end())
        else:
            break
        m = _ALNUM.match(text, sep[1], limit)
    return out


Piece = tuple[int, int, str]


def _spelled_addresses(text: str) -> Iterator[tuple[int, int, list[Piece]]]:
    """Start, end and pieces (start, end, sign) of addresses with a sign or word for at and, last, a word for a dot."""
    found, floor = list(_AT_WORD.finditer(text)), 0
    for i, m in enumerate(found, 1):
        start, limit = _local(text, m.start(), floor), found[i].start() if i < len(found) else len(text)
        labels = _labels(text, m.end(), limit, True) if start < m.start() else []
        floor, done = m.end(), 0
        for k, (sa, sb, a, b) in enumerate(labels[1:], 1):
            if sb - sa > 1 and b - a >= 2 and text[a:b].isalpha():
                done = k
                after = labels[k + 1] if k + 1 < len(labels) else None
                if not (after and after[1] - after[0] > 1 and after[3] - after[2] >= 2 and text[after[2] : after[3]].isalpha()):
                    if text[b : b + 1] == "-" or text[b : b + 1] == "_" or text[b : b + 1].isalnum():
                        done = 0
                        continue
                    break
        if done:
            yield start, labels[done][3], [(m.start(), m.end(), "@"), *((a, b, ".") for a, b, _, _ in labels[1 : done + 1] if b - a > 1)]


def _spaced_addresses(text: str) -> Iterator[tuple[int, int, list[Piece]]]:
    """The same for addresses with spaces around the at sign or dots; the last label must be a common top domain."""
    found, floor = list(_AT_SIGN.finditer(text)), 0
    for i, m in enumerate(found, 1):
        end, limit = m.start(), found[i].start() if i < len(found) else len(text)
        while end > floor and text[end - 1].isspace():
            end -= 1
        start = _local(text, end, floor)
        after = _SPACES.match(text, m.end()).end()
        labels = _labels(text, after, limit, False) if start < end else []
        for k, (_, _, a, b) in enumerate(labels[1:], 1):
            if text[a:b].lower() in _TOPS and not (text[b : b + 1].isalnum() or text[b : b + 1] == "_"):
                yield start, b, [(end, after, "@"), *((x, y, ".") for x, y, _, _ in labels[1 : k + 1])]
                break
        floor = m.end()


def _class(chars: list[int]) -> str:
    runs: list[list[int]] = []
    for c in sorted(chars):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


def _re2(pattern: str) -> str:
    """``pattern`` in RE2 syntax, without its assertions and possessive signs: it matches wherever ``pattern`` does."""
    pattern = re.sub(r"(?<!\\)([*+?}])\+", r"\1", re.sub(r"\(\?<?[=!][^()]*\)", "", pattern))
    wide = {r"\w": r"\p{L}\p{N}_", r"\s": r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"}  # RE2's own are ASCII only
    out, bracket = [], False
    for part in re.findall(r"\\.|.", pattern):
        out.append(part if part not in wide else wide[part] if bracket else f"[{wide[part]}]")
        bracket = part == "[" or bracket and part != "]"
    return "".join(out)


_LETTER, _BETWEEN = f"(?-i:[{''.join(_DIGIT_LETTERS)}])", _re2(rf"(?:[\s().-]{{0,2}}[{''.join(_DIGIT_LETTERS)}])*[\s().-]{{0,2}}")
#: What such a piece must also hold for rewriting to change it: a letter with only its like between it and a digit.
_NEEDED = {"mixed": f"(?i)[0-9]{_BETWEEN}{_LETTER}|{_LETTER}{_BETWEEN}[0-9]"}
#: What makes a text worth normalising: a character to map, any piece of ``_REWRITE``, a word for at, or spaces at the sign or dot of an
#: address (RE2 syntax; linear time).
_TRIGGERS = [
    (f"[{_class([*_CHARS, *map(ord, _ZERO_WIDTH)])}]",),
    *((f"(?i){_re2(p)}", *([_NEEDED[kind]] if kind in _NEEDED else [])) for kind, p in _PIECES.items() if kind != "zero"),
    (f"(?i){_re2(_BARE_AT)}", f"(?i){_re2(f'{_DOT}|{_BARE_DOT}')}"),
    (f"(?i){_re2(rf'@{_S}[A-Za-z0-9.-]+{_BARE_DOT}')}",),
    (_re2(r"\s@|@\s|@[A-Za-z0-9.\s-]*(?:\s\.|\.\s)"),),
]

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the plain patterns, in order; a match that fails its check is dropped."""
    has_plus = "+" in text
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))],
        "card": _cards(text),
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
        if has_plus
        else [],
    }


def _mostly_digits(text: str) -> bool:
    """Some letters pass for digits in it, but at least half of its signs are digits."""
    digits, letters = sum("0" <= c <= "9" for c in text), sum(c in _DIGIT_LETTERS for c in text)
    return 0 < letters <= digits


class Normalised:
    """A rewritten text and, for each piece, where it came from."""

    def __init__(self, text: str) -> None:
        self.source = text
        mapped = text.translate(_CHARS)
        pieces: list[str] = []
        self.at: list[int] = []  # start of each piece in the normalised text
        self.src: list[int] = []
        self.len: list[int] = []  # source code points of a rewritten piece; -1: copied one to one
        done = size = 0

        def put(piece: str, src: int, src_len: int) -> None:
            nonlocal size
            self.at.append(size)
            self.src.append(src)
            self.len.append(src_len)
            pieces.append(piece)
            size += len(piece)

        def copy(a: int, b: int) -> None:
            if b > a:
                put(mapped[a:b], a, -1)

        for start, end, kind, what in self._changes(mapped):
            if start < done:
                continue
            copy(done, start)
            if kind == "zero":
                put("", start, end - start)
            elif kind in ("at", "dot"):
                put("@" if kind == "at" else ".", start, end - start)
            elif kind in ("bare", "wide"):
                inner = start
                for a, b, sign in what:
                    copy(inner, a)
                    put(sign, a, b - a)
                    inner = b
                copy(inner, end)
            elif kind == "mixed":
                for i, c in enumerate(mapped[start:end], start):
                    if c in _DIGIT_LETTERS:
                        put(_DIGIT_LETTERS[c], i, 1)
                    else:
                        copy(i, i + 1)
            else:
                for t in _DIGIT_TOKEN.finditer(mapped, start, end):
                    a = t.start()
                    if t.lastgroup == "num":
                        copy(a, t.end())
                    else:
                        put({"plus": "+", "dot": "."}.get(t.lastgroup) or _DIGIT_WORDS[t[0].lower()], a, t.end() - a)
            done = end
        copy(done, len(mapped))
        self.text = "".join(pieces)
        self.mapped = mapped

    @staticmethod
    def _changes(text: str) -> list[tuple[int, int, str, list[Piece]]]:
        """Start, end, kind and pieces of what is to be rewritten, leftmost first; of those that overlap the first counts."""
        out: list[tuple[int, int, str, list[Piece]]] = []
        for m in _REWRITE.finditer(text):
            kind = m.lastgroup
            if (kind != "digits" or _SPELLED.search(m[0])) and (kind != "mixed" or _mostly_digits(m[0])):
                out.append((m.start(), m.end(), kind, []))
        out += [(a, b, "bare", pieces) for a, b, pieces in _spelled_addresses(text)]
        out += [(a, b, "wide", pieces) for a, b, pieces in _spaced_addresses(text)]
        return sorted(out, key=lambda x: (x[0], _RANK[x[2]]))

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a normalised span, and whether any character in it was rewritten."""
        first = bisect.bisect_right(self.at, start) - 1
        last = bisect.bisect_right(self.at, end - 1) - 1
        a = self.src[first] + (start - self.at[first] if self.len[first] < 0 else 0)
        b = self.src[last] + (end - self.at[last] if self.len[last] < 0 else self.len[last])
        changed = any(n >= 0 for n in self.len[first : last + 1]) or self.mapped[a:b] != self.source[a:b]
        return a, b, changed


def added_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that show only after normalisation, in source code points, disjoint from plain ones of their kind."""
    norm = Normalised(text)
    out: dict[str, list[Span]] = {}
    for kind, spans in plain_spans(norm.text).items():
        out[kind] = []
        for s, e in spans:
            a, b, changed = norm.back(s, e)
            k = bisect.bisect_left(plain[kind], b, key=lambda x: x[0]) - 1  # the last plain span that starts before b
            if changed and not (k >= 0 and plain[kind][k][1] > a):
                out[kind].append((a, b))
    return out


def _join(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


_OUT = pa.schema([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
_NOTHING = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1).fill_null("")
        plain_hit = pc.match_substring_regex(text, "[0-9@]")
        disguised = functools.reduce(pc.or_, (functools.reduce(pc.and_, (pc.match_substring_regex(text, p) for p in t)) for t in _TRIGGERS))
        rows = [_NOTHING] * batch.num_rows
        for i in pc.indices_nonzero(pc.or_(plain_hit, disguised)).to_pylist():
            body = text[i].as_py()
            base = plain_spans(body)
            more = added_spans(body, base) if disguised[i].as_py() else {k: [] for k in KINDS}
            both = {k: base[k] + more[k] for k in KINDS}
            rows[i] = (
                *(len(base[k]) for k in KINDS),
                hashlib.sha256(_join(base).encode()).hexdigest(),
                _join(both),
                sum(map(len, more.values())),
            )
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _OUT]
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, _OUT, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *_OUT.names])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, plain spans counted by kind, SHA-256 of the plain spans, all spans, and how many were added.

    A span is written ``kind:start:end`` in code points of the whole source text, end exclusive.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("body")).mapInArrow(
        _scan, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    ).withColumnRenamed("id", id_col)


_TAGS = {k: f"<{k.upper()}>" for k in KINDS}


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by a tag of its kind; overlapping spans share the first's tag."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            base = plain_spans(text)
            more = added_spans(text, base)
            out, done = [], 0
            for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in base[k] + more[k]):
                if a >= done:
                    out += [text[done:a], _TAGS[kind]]
                done = max(done, b)
            return "".join([*out, text[done:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, clean(docs[text_col]))
