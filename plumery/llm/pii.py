"""Personal data: plain identifiers, and disguised ones found by offset-preserving deobfuscation.

A chain of small transducers rewrites a text while carrying, for each character written, the source characters it stands
for: look-alike letters, foreign digits and invisible characters; letters for digits and spelled digits; "at", "dot", "plus",
"underscore" and "dash" in words, "@" and "." in brackets or between blanks. The plain detectors then run over the rewritten
text, and what they find is mapped back to source positions. Only texts that hold a trigger, which is anything that a
transducer rewrites, are rewritten. Very long texts are worked on whole.

"We shop at a site dot com" has the form of an address. So a bare "at" counts only after what looks like a local part: one with a
digit, dot, underscore or the like; or a word that stands where addresses do: after a colon or another mark, at the start of
a line (in lower case, or with nothing else on it), or after words that speak of mail. And words of everyday language aren't
taken for a domain's labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumery.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

# --- plain detectors --------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the longest local part that ends at it: the leftmost match, without a search from every letter."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Emails, IPv4 addresses, card and phone numbers, leftmost and non-overlapping per kind, by start and kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- transducers ------------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter, by the Latin letter.
LOOK_ALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "r": "г", "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ",
    "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    ".": "。․‧∙⋅", "@": "﹫", "-": "‐‑‒–—−", "+": "﹢",
}
_ALIKE = {c: k for k, v in LOOK_ALIKES.items() for c in v}
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: The digits' English names.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT_OF = {w: str(n) for n, w in enumerate(DIGIT_WORDS)}

_FOREIGN = re.compile(f"[{_HIDDEN}{re.escape(''.join(_ALIKE))}！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")
_NAME = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:{_NAME}|oh(?=[\x20-](?:{_NAME}|oh)))(?:[\x20-](?:{_NAME}|oh))*\b", re.I)
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_DOT = re.compile(rf"{_OPEN}(?:dot|\.){_CLOSE}|(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9])", re.I)
#: Words that stand beside "at" and "dot" in plain sentences, and so are no label of a disguised domain.
EVERYDAY = frozenset(
    "a an the this that these those my our your his her its their one two some any all each every no not and or but so as if in on of to by for from with into over under "
    "is was are were be been it he she we you they there here then than when where which who what noon night home last first least most once".split()
)
_AT = re.compile(rf"{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9])\x20at\x20(?=((?:[A-Za-z0-9-]+[.\ue000])+)([A-Za-z]{{2,24}})(?![A-Za-z0-9-]))", re.I)
_LAST_WORD = re.compile("[A-Za-z0-9._%+\ue000-]+$")
#: A blank behind @, and perhaps around the dots of the domain, all of it in lower case.
_WIDE = re.compile(r"(?<=[A-Za-z0-9])\x20?@\x20([a-z0-9-]+(?:\x20?\.\x20?[a-z0-9-]+)*\x20?\.\x20?[a-z]{2,24})(?![A-Za-z0-9-])")
#: Marks before an address, and fixed values: words that speak of mail, some of the last four before it, or right before it.
_MARK_BEFORE = re.compile(r"[:;,=|<>(\[{\"'*/\u2022\u201c]\s?$")
_MAIL_BEFORE = re.compile(r"\b(?:e-?mails?|e-?mailed|mailto|mail|mails|mailed|inbox|address|contact|cc|bcc)\b\W+(?:[\w'-]+\W+){0,3}$|\b(?:write|reply|send|forward|ping)\W+(?:[\w'-]+\W+)?to\W+$|\bping\W+$", re.I)
_PLUS = re.compile(r"\bplus\x20(?=[0-9])", re.I)
_JOIN = re.compile(r"(?<=[A-Za-z0-9])\x20(underscore|dash|hyphen)\x20(?=[A-Za-z0-9])", re.I)
#: Letters that stand for a digit beside digits.
DIGIT_LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8"}
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OolISB]*[0-9])[0-9]*[OolISB][0-9OolISB]*(?![A-Za-z0-9])")
#: Words that a transducer may rewrite; they begin at a border as well, which is looked at afterwards.
_HINT = re.compile(rf"(?:{_NAME}|dot|plus|underscore|dash|hyphen)\b")
_MARKS = re.compile(r"[\[({<]\s?(?:[dD][oO][tT]|[aA][tT]|[.@])\s?[\])}>]|\ue000|\x20[aA][tT]\x20[A-Za-z0-9-]+\.[A-Za-z0-9-]")


def triggered(text: str) -> bool:
    """Whether any transducer might rewrite something: what it leaves out would stay as it is."""
    # re.I takes the long s and the i's with and without a dot for s and i.
    low = text.lower() if text.isascii() else text.lower().replace("ſ", "s").replace("ı", "i").replace("i\u0307", "i")
    return bool(
        (not text.isascii() and _FOREIGN.search(text))
        or _MARKS.search(text)
        or any(not (at := m.start()) or not (low[at - 1].isalnum() or low[at - 1] == "_") for m in _HINT.finditer(low))
        or (_DIGIT.search(text) and _MIXED.search(text))
        or ("@" in text and _WIDE.search(text))
    )


class Tape:
    """A rewritten text and, for each of its characters, the source characters [start, end) behind it."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, np.arange(len(text)), np.arange(1, len(text) + 1)
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], str]) -> None:
        """Write something else for each match; a match that is written as itself stays."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            new, (a, b) = write(m), m.span()
            if new == m[0]:
                continue
            if not new and b < len(self.changed):
                self.changed[b] = True  # what follows something left out
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.starts, self.ends, self.changed = (np.concatenate([*x, y[at:]]) for x, y in ((starts, self.starts), (ends, self.ends), (changed, self.changed)))


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in _HIDDEN:
        return ""
    if c in _ALIKE:
        return _ALIKE[c]
    flat = unicodedata.normalize("NFKC", c)
    if len(flat) == 1 and (digit := unicodedata.decimal(flat, None)) is not None:
        return str(digit)
    return flat if len(flat) == 1 and flat.isascii() else c


def _spelled(m: re.Match) -> str:
    # re.I takes the long s and the i's with and without a dot for s and i.
    words = [w.upper().replace("İ", "I").lower() for w in re.split("[ -]", m[0])]
    if "oh" in words and sum(w != "oh" for w in words) < 3:  # zero only among digits
        return m[0]
    return "".join(_DIGIT_OF.get(w, "0") for w in words)


def _at(m: re.Match) -> str:
    if m[1] is None:  # in brackets
        return "@"
    labels = [*re.split("[.\ue000]", m[1])[:-1], m[2]]
    before = _LAST_WORD.search(m.string, max(0, m.start() - 64), m.start())
    if before is None or ("\ue000" in m[1] and any(x.lower() in EVERYDAY for x in labels)):
        return m[0]
    if re.search("[0-9._+\ue000]", before[0]):
        return "@"
    if "\ue000" not in m[1] or before[0].lower() in EVERYDAY:
        return m[0]
    return "@" if _addressed(m.string, before.start(), m.end(2)) else m[0]


def _addressed(text: str, start: int, end: int) -> bool:
    """Whether a word from start on stands where an address does; end is that of what would be its domain."""
    before = text[max(0, start - 96) : start]
    if _MARK_BEFORE.search(before) or _MAIL_BEFORE.search(before):
        return True
    if before.strip(" \t") and not before.rstrip(" \t").endswith("\n"):
        return False
    return text[start].islower() or bool(re.match(r"[\x20\t]*(?:\n|$)", text[end : end + 8]))


def deobfuscated(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite(_FOREIGN, _plain)
    tape.rewrite(_MIXED, lambda m: "".join(DIGIT_LETTERS.get(c, c) for c in m[0]))
    tape.rewrite(_SPELLED, _spelled)
    tape.rewrite(_PLUS, lambda m: "+")
    tape.rewrite(_JOIN, lambda m: "_" if m[1].lower() == "underscore" else "-")
    tape.rewrite(_WIDE, lambda m: "@" + m[1].replace(" ", ""))
    tape.rewrite(_DOT, lambda m: "\ue000")  # marks a disguised dot: a bare "at" counts only before one
    tape.rewrite(_AT, _at)
    tape.rewrite(re.compile("\ue000"), lambda m: ".")
    return tape


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """base and the spans of disguised identifiers; one that overlaps a base span of its kind is left out."""
    if not triggered(text):
        return base
    tape = deobfuscated(text)
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
    found = list(base)
    for a, kind, b in base_spans(tape.text):
        if tape.changed[a:b].any():
            start, end = int(tape.starts[a]), int(tape.ends[b - 1])
            if all(e <= start or end <= s for s, e in taken[kind]):
                found.append((start, kind, end))
                taken[kind].append((start, end))
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- Spark ------------------------------------------------------------------------------------------------------------


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans and n_disguised of each row of docs.

    The counts are of plain identifiers; spans (``kind:start:end`` in code points, comma-joined) also has the disguised ones.
    Null and empty texts hold none. Rows repeat as they come; other columns play no part. A very long text is looked through whole; one
    with a trigger takes some 20 bytes a character while it is rewritten.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_disguised"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = all_spans(text, base)
                rows.append((*(sum(s[1] == k for s in base) for k in range(4)), written(base), written(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_disguised long")


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every identifier in ``text`` replaced by its kind in brackets, plain or disguised; other columns stay."""
    schema = docs.schema

    def masked(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, base_spans(text))):
            return text
        out, at = [], 0
        for a, k, b in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.schema.get_field_index("text")
            yield batch.set_column(n, "text", pa.array([masked(t.as_py()) for t in batch.column(n)], pa.string()))

    return small_batches(docs).mapInArrow(run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data of every document."""
    from pyspark.sql import functions as F

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"
    )


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many plain identifiers of each kind every document has."""
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in KINDS))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
SQL = {
    "pii_counts": rf"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
         regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+') AS card, regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]') AS phone
  FROM documents)
SELECT doc_id, len(email)::BIGINT AS n_email,
       len(list_filter(ip, lambda m: list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN 256 ELSE coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INTEGER), 0) END)) <= 255))::BIGINT AS n_ip,
       len(list_filter(card, lambda m: len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(regexp_extract_all(reverse({_DIGITS}), '[0-9]'), lambda d, i:
           CASE WHEN i % 2 = 1 THEN d::INTEGER WHEN d::INTEGER > 4 THEN 2 * d::INTEGER - 9 ELSE 2 * d::INTEGER END)) % 10 = 0))::BIGINT AS n_card,
       len(list_filter(phone, lambda m: len({_DIGITS}) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM found"""
}
