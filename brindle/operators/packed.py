"""Several values packed in one field: split them into rows, with their place kept.

Dialects are chosen by minimum description length. A dialect is a delimiter, the quotes it knows (none, double, single
or both) and whether a backslash escapes:

1. every field of the table is read with a first guess at its dialect, and values and delimiters are counted over the
   whole table (map-side counters, then one small shuffle of partial counts);
2. from these counts come all code lengths: of a value that occurs again (-log2 of its share, and its part of spelling
   it once in the code book), of a value that is spelled out (-log2 of its characters' shares among the values, and of
   the share of values that occur once), of a delimiter (-log2 of the share of fields it was guessed for);
3. every field is parsed with each dialect its characters allow, and the dialect whose values take the fewest bits wins.

Code lengths are whole 1024ths of a bit, so sums do not depend on their order. The table of codes that goes to the
executors has at most `max_codes` entries. Where more values than that occur again, it holds the most frequent, and fields
whose parse hangs on any other value ask for its count by a join with the written table of counts; the result
is the one that a table of all codes would give.

Plain fields (ASCII, one delimiter, quotes used plainly) are read a batch at a time with Arrow and numpy; those that another
dialect might read more cheaply, and all others, go one by one. Both ways give the same parse.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import free_name, materialize, spread

#: Fields (in lower case) that say "nothing".
PLACEHOLDERS = frozenset(["", "-", "--", "n/a", "na", "nan", "nil", "none", "null", "undefined"])
#: A list's opening and closing brackets.
BRACKETS = {"[": "]", "{": "}", "(": ")"}
#: Characters without width, which count as white space round a value (str.strip() knows the others).
ZERO_WIDTH = "\u200b\u2060\ufeff"
#: Escapes of one letter.
_LETTERS = {"n": "\n", "t": "\t", "r": "\r"}

MAX_CODES = 1 << 17
#: Units of a bit; what it costs to say whether a quote or the backslash is read as such, and that one more value follows.
BIT = 1024
FLAG = BIT
#: Different characters whose shares are learned; the others share what is left.
MOST_CHARS = 4096


@dataclass(frozen=True)
class Delimiter:
    """A mark, or a pattern that holds the mark. Plain marks may be mixed in fields joined by hand from several lists."""

    mark: str
    pattern: str = ""

    @property
    def mixes(self) -> bool:
        return not self.pattern and not self.mark.isspace()

    @property
    def regex(self) -> str:
        return self.pattern or re.escape(self.mark)


#: The delimiters known without being told, in the order of the first guess. White space round values goes anyway, so a
#: carriage return before a line feed needs no pattern. A slash stands apart; within a word it separates nothing.
DELIMITERS = (
    Delimiter("\n"), Delimiter("\t"), Delimiter("/", r"(?:(?<=\s)|(?<![\s\S]))/(?=\s|$)"), Delimiter("\x1f"), Delimiter("\x1e"), Delimiter("~"),
    Delimiter("^"), Delimiter("::"), Delimiter("•"), Delimiter("|"), Delimiter(";"), Delimiter(","),
)
WHOLE, ANY = "", "any"

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)


def _undo(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else m[2]


def _undo_quoted(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else _LETTERS.get(m[2], m[2])


def _unescape(s: str, undo=_undo) -> str:
    if "\\" not in s:
        return s
    s = _ESCAPE.sub(undo, s)
    if any("\ud800" <= c <= "\udfff" for c in s):  # pairs of escapes, as JSON writes characters beyond the basic plane
        s = s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return s


def strip(s: str) -> str:
    s = s.strip()
    while s and (s[0] in ZERO_WIDTH or s[-1] in ZERO_WIDTH):
        s = s.strip(ZERO_WIDTH).strip()
    return s


def unwrap(field: str) -> str:
    """The field without white space and brackets round the whole list; the closing bracket may have been cut off."""
    s = field.strip() if field.isascii() else strip(field)
    if not s:
        return s
    if s[0] in "\"'" and len(s) > 2 and s[-1] == s[0] and s[1] in BRACKETS and s[-2] == BRACKETS[s[1]]:
        s = s[1:-1].replace(s[0] * 2, s[0])
    if s[0] in BRACKETS:
        close = BRACKETS[s[0]]
        if s[-1] == close and len(s) > 1 and s.count(s[0]) <= s.count(close):
            return s[1:-1]
        if s[0] != "(":
            return s[1:]
    return s


def fold(value: str) -> str:
    """Lower case, each run of white space as one space."""
    return " ".join(value.lower().split())


def nothing(values: list[str]) -> bool:
    return not values or len(values) == 1 and values[0].lower() in PLACEHOLDERS


class Grammar:
    """How fields are read by each dialect."""

    def __init__(self, delimiters: Sequence[Delimiter | str] = DELIMITERS):
        self.delimiters = [Delimiter(d) if isinstance(d, str) else d for d in delimiters]
        self.marks = {d.mark: d.regex for d in self.delimiters}
        self.pattern = {d.mark: re.compile(d.pattern) for d in self.delimiters if d.pattern}
        self.mixing = [d.mark for d in self.delimiters if d.mixes]
        self.marks[ANY] = "|".join(map(re.escape, self.mixing))
        self.any = re.compile(self.marks[ANY]) if self.mixing else None
        code = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in s)
        #: For Arrow: a slot, by any mark, that begins with a quote behind white space.
        self.begins = "(?:^|" + "|".join(code(d.mark) for d in self.delimiters) + r""")[\s\pZ\x0b\x1c-\x1f\x{85}]*["']"""
        self.tokens: dict[tuple[str, str, bool], re.Pattern] = {}

    def found(self, body: str) -> list[str]:
        """The marks that occur as delimiters, in the order of the first guess."""
        out = [m for d in self.delimiters if (m := d.mark) in body and (not d.pattern or self.pattern[m].search(body))]
        if len(out) > 1 and sum(m in self.mixing for m in out) > 1:
            out.append(ANY)
        return out

    def token(self, mark: str, quotes: str, escapes: bool) -> re.Pattern:
        """One slot: a quoted value that ends before a delimiter, or raw text in which a backslash may shield a character."""
        if (p := self.tokens.get((mark, quotes, escapes))) is None:
            d = self.marks.get(mark)
            end = rf"\s*?(?={d}|\Z)" if d else r"\s*\Z"
            shield, other = (r"\\.|", r"\\") if escapes else ("", "")
            raw = rf"(?:{shield}(?!{d}).)*" if d else rf"(?:{shield}.)*"
            if len(mark) == 1 and not self.pattern.get(mark):
                raw = rf"(?:{shield}[^{re.escape(mark)}{other}])*"
            slots = "".join(rf"{q}((?:[^{q}{other}]|{q}{q}{'|' + shield[:-1] if escapes else ''})*){q}{end}|" for q in quotes)
            last = r"\\?\Z" if escapes else r"\Z"
            after = rf"(?:{d}|{last})" if d else last
            p = self.tokens[mark, quotes, escapes] = re.compile(rf"[\s\u200b\u2060\ufeff]*+(?:{slots}({raw})){after}", re.S)
        return p

    def between(self, body: str, quote: str, mark: str) -> list[str] | None:
        """The values where one kind of quote is used plainly: text outside the quotes begins and ends with a delimiter."""
        parts = body.split(quote)
        last = len(parts) - 1
        if last % 2:
            return None
        marks, out = self.mixing if mark == ANY else [mark], []
        for i, p in enumerate(parts):
            if i % 2:
                out.append(p)
            elif t := p.strip():
                if i and t[0] not in marks or i < last and t[-1] not in marks:
                    return None
                if len(t) > 1:
                    out += t.split(mark) if mark != ANY else self.any.split(t)
            elif 0 < i < last:
                return None
        return out

    def read(self, body: str, mark: str, quotes: str, escapes: bool) -> list[str]:
        """The values of a field without its brackets, by one dialect; empty slots are left out."""
        if quotes or escapes:
            parts = None
            if len(quotes) == 1 and not escapes and (mark == ANY or len(mark) == 1 and mark in self.mixing):
                parts = self.between(body, quotes, mark)
            if parts is None:
                parts = []
                for slot in self.token(mark, quotes, escapes).findall(body):
                    *quoted, raw = slot if quotes else (slot,)
                    if raw:
                        parts.append(_unescape(raw) if escapes else raw)
                        continue
                    for q, v in zip(quotes, quoted):
                        if v:
                            parts.append(_unescape(v.replace(q * 2, q), _undo_quoted) if escapes else v.replace(q * 2, q))
        elif not mark:
            parts = [body]
        elif mark == ANY:
            parts = self.any.split(body)
        elif p := self.pattern.get(mark):
            parts = p.split(body)
        else:
            parts = body.split(mark)
        if body.isascii() and not escapes:
            return [v for p in parts if (v := p.strip())]
        return [v for p in parts if (v := strip(p))]

    def dialects(self, body: str) -> tuple[list[str], list[str], list[bool]]:
        """Marks, sets of quotes and uses of the backslash that the body's characters allow; the first of each is the guess."""
        quotes = [q for q in "\"'" if q in body]
        sets = ["\"'", '"', "'", ""] if len(quotes) > 1 else [*quotes, ""]
        return self.found(body), sets, [True, False] if "\\" in body else [False]

    def guess(self, body: str) -> tuple[list[str], list[str]]:
        """The marks to count, and the values by the first of them. A mixture is never guessed first; fields that allow it count for it."""
        marks, quotes, escapes = self.dialects(body)
        mark = marks[0] if marks else WHOLE
        return [mark, ANY] if ANY in marks else [mark], self.read(body, mark, quotes[0], escapes[0])


@dataclass
class Counts:
    """What the first pass has learned. `counts` has the values with a code; all others occur at most `rest` times."""

    counts: dict[str, int]
    total: int
    values: int = 0
    single: int = 0
    chars: dict[str, int] = attribute(default_factory=dict)
    n_chars: int = 0
    marks: dict[str, int] = attribute(default_factory=dict)
    rest: int = 1

    @classmethod
    def of(cls, counts: dict[str, int], total: int) -> Counts:
        """From the counts of all values."""
        chars = Counter("".join(counts))
        return cls({k: n for k, n in counts.items() if n > 1}, total, len(counts), sum(n == 1 for n in counts.values()), dict(chars), chars.total())


class Coder:
    """Code lengths of values, and with them the cheapest parse of a field.

    `more`: counts of values that are in no code table (0 if a value is in neither), where they have been asked for."""

    def __init__(self, learned: Counts | dict[str, int], total: int = 0, grammar: Grammar | None = None, cache: int = 200_000):
        learned = learned if isinstance(learned, Counts) else Counts.of(learned, total)
        self.grammar, self.learned, self.cache = grammar or Grammar(), learned, cache
        n = max(learned.total, 1)
        new = (learned.single + 1) / (n + 2)
        self.seen, self.new = -math.log2(1 - new) if new < 1 else 1.0, -math.log2(new)
        symbols = learned.n_chars + learned.values + 0.5 * (len(learned.chars) + 2)
        self.char = {c: math.log2(symbols / (k + 0.5)) for c, k in learned.chars.items()}
        left = max(learned.n_chars - sum(learned.chars.values()), 0)
        self.rare, self.end = math.log2(symbols / (left / MOST_CHARS + 0.5)), math.log2(symbols / (learned.values + 0.5))
        self.least_char = min([*self.char.values(), self.rare])
        fields = sum(learned.marks.values())
        self.mark = {m: round(BIT * math.log2((fields + 0.5 * (len(self.grammar.marks) + 1)) / (learned.marks.get(m, 0) + 0.5))) for m in [WHOLE, *self.grammar.marks]}
        self.log_total = math.log2(n)
        # A code that holds a mark, or whose field holds a quote, may be a whole field that looks like several values.
        marks = re.compile("|".join([*(re.escape(d.mark) for d in self.grammar.delimiters), '"', "'"]))
        self.wholes = {k for k in learned.counts if marks.search(k)}
        self.longest_whole = max(map(len, self.wholes), default=0)
        self.known: dict[str, int] = {}
        self.more: dict[str, int] | None = None

    def spelled(self, k: str) -> float:
        get, rare = self.char.get, self.rare
        return self.end + sum([get(c, rare) for c in k])

    def bits(self, k: str, n: int) -> int:
        """Length of a folded value that occurs n times: by its code, or spelled out if that is shorter."""
        s = self.spelled(k)
        new = self.new + s
        return round(BIT * (new if n < 2 else min(new, self.log_total - math.log2(n) + self.seen + s / n)))

    def value(self, v: str) -> int:
        """Length of a value; that of one which may have a code elsewhere is the least it can have, and negative."""
        k = fold(v)
        if n := self.learned.counts.get(k):
            b = self.bits(k, n)
        elif self.learned.rest < 2:
            b = self.bits(k, 0)
        elif self.more is not None:
            return self.bits(k, self.more.get(k, 0))  # holds for one field; not kept
        else:
            b = -min(self.bits(k, 0), self.bits(k, self.learned.rest))
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[v] = b
        return b

    def cost(self, vs: list[str], most: float = math.inf) -> tuple[int, bool]:
        """Length of the values, or more than `most` as soon as it is exceeded; whether it is exact, not a lower bound."""
        total, exact, known = 0, True, self.known
        for v in vs:
            b = known.get(v)
            if b is None:
                b = self.value(v)
            if b < 0:
                b, exact = -b, False
            total += b + BIT
            if total > most:
                break
        return total, exact

    def readings(self, body: str) -> Iterator[tuple[int, list[str]]]:
        """Every dialect's own length, and its values. The guess comes first, the field as one value last."""
        g, marks_bits = self.grammar, self.mark
        marks, quotes, escapes = g.dialects(body)
        flags = FLAG * (len(quotes) - 1 + len(escapes) - 1)
        for m in marks:
            for q in quotes:
                for e in escapes:
                    yield marks_bits[m] + flags, g.read(body, m, q, e)
        for q in quotes:
            for e in escapes:
                yield marks_bits[WHOLE] + flags, g.read(body, WHOLE, q, e)

    def parse(self, field: str) -> tuple[int, list[str]] | None:
        """Length of the values, and the values, by the dialect that is cheapest with them; ties go to the first.

        None if that hangs on counts that have not been asked for."""
        body = unwrap(field)
        best, chosen, bits = math.inf, [], 0
        open_at = math.inf  # the least that a reading which is not exact may take
        for own, vs in self.readings(body):
            if not vs:  # nothing but marks, quotes and white space
                return 0, []
            b, exact = self.cost(vs, best - own)
            if exact:
                if own + b < best:
                    best, chosen, bits = own + b, vs, b
            elif own + b < open_at:
                open_at = own + b
        if open_at <= best:
            return None
        return (0, []) if nothing(chosen) else (bits, chosen)

    def asked(self, field: str) -> list[str]:
        """The folded values whose counts decide the parse and are in no code table."""
        body, counts = unwrap(field), self.learned.counts
        return sorted({k for _, vs in self.readings(body) for v in vs if (k := fold(v)) not in counts})


class Slots:
    """Values of some rows, one after the other: the texts, the row of each, and the number of rows."""

    def __init__(self, parts: pa.Array, row: np.ndarray, rows: int):
        text = pc.utf8_trim_whitespace(parts)
        full = pc.binary_length(text).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            text, row = text.filter(pa.array(full)), row[full]
        self.text, self.row, self.rows = text, row, rows
        self.n = np.bincount(row, minlength=rows)

    @classmethod
    def split(cls, body: pa.Array, mark: str, grammar: Grammar) -> Slots:
        if not mark:
            return cls(body, np.arange(len(body)), len(body))
        if mark in grammar.pattern:  # lookaround, which Arrow's expressions lack
            lists = [grammar.pattern[mark].split(b) for b in body.to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            return cls(pa.array([v for x in lists for v in x], pa.string()), np.repeat(np.arange(len(body)), n), len(body))
        parts = pc.split_pattern_regex(body, grammar.marks[ANY]) if mark == ANY else pc.split_pattern(body, mark)
        n = np.diff(parts.offsets.to_numpy())
        return cls(parts.flatten(), np.repeat(np.arange(len(body)), n), len(body))

    @classmethod
    def quoted(cls, body: pa.Array, quote: str, mark: str) -> tuple[Slots, np.ndarray]:
        """Values by a delimiter where quotes are used plainly (as `Grammar.between` reads them), and the rows where they are."""
        parts = pc.split_pattern(body, quote)
        n = np.diff(parts.offsets.to_numpy())
        row = np.repeat(np.arange(len(body)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        inside, flat = place % 2 == 1, parts.flatten()
        outer = pc.utf8_trim_whitespace(flat.filter(pa.array(~inside)))
        where, at = row[~inside], place[~inside]
        first, last = at == 0, at == n[where] - 1
        full = pc.binary_length(outer).to_numpy(zero_copy_only=False) > 0
        good = (first | last) & ~full
        if not mark:
            ok = (np.bincount(where, weights=~good, minlength=len(body)) == 0) & (n % 2 == 1)
            return cls(flat.filter(pa.array(inside)), row[inside], len(body)), ok
        if len(mark) == 1:
            good |= full & (first | pc.starts_with(outer, mark).to_numpy(zero_copy_only=False)) & (last | pc.ends_with(outer, mark).to_numpy(zero_copy_only=False))
        else:
            good |= pc.equal(outer, mark).to_numpy(zero_copy_only=False)
        ok = (np.bincount(where, weights=~good, minlength=len(body)) == 0) & (n % 2 == 1)
        some = np.nonzero(full & ~pc.equal(outer, mark).to_numpy(zero_copy_only=False))[0]
        if not some.size:
            return cls(flat.filter(pa.array(inside)), row[inside], len(body)), ok
        bare = pc.split_pattern(outer.take(pa.array(some)), mark)  # values without quotes among the others
        k = np.diff(bare.offsets.to_numpy())
        rows = np.concatenate([row[inside], np.repeat(where[some], k)])
        order = np.lexsort((np.concatenate([place[inside], np.repeat(at[some], k)]), rows))  # stable: parts stay in order
        return cls(pa.concat_arrays([flat.filter(pa.array(inside)), bare.flatten()]).take(pa.array(order)), rows[order], len(body)), ok

    def lengths(self, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
        """For every row: the length of its values, or the least it can be; whether it is exact."""
        coded = self.text.dictionary_encode()
        known, value = coder.known, coder.value
        own = [value(v) if (b := known.get(v)) is None else b for v in coded.dictionary.to_pylist()]
        own = np.array(own, np.int64)[coded.indices.to_numpy()]
        bits = np.bincount(self.row, weights=np.abs(own) + BIT, minlength=self.rows).astype(np.int64)
        return bits, np.bincount(self.row, weights=own < 0, minlength=self.rows) == 0

    def only(self, rows: np.ndarray) -> Slots:
        """The same without the values of the rows that are not marked."""
        out, keep = object.__new__(Slots), rows[self.row]
        out.text, out.row, out.rows, out.n = self.text.filter(pa.array(keep)), self.row[keep], self.rows, np.where(rows, self.n, 0)
        return out

    def nothing(self) -> np.ndarray:
        """Rows that say nothing: without values, or with a placeholder for one."""
        one = np.nonzero(self.n == 1)[0]
        out = self.n == 0
        if one.size:
            text = self.text.take(pa.array(np.searchsorted(self.row, one)))
            out[one[pc.is_in(pc.ascii_lower(text), _NOTHING).to_numpy(zero_copy_only=False)]] = True
        return out


_NOTHING = pa.array(sorted(PLACEHOLDERS), pa.string())


def _has(a: pa.Array, mark: str, data: bytes | None = None) -> np.ndarray:
    """Which texts hold the mark; `data` is what all of them hold together."""
    if data is not None and mark.encode() not in data:
        return np.zeros(len(a), bool)
    return pc.match_substring(a, mark).to_numpy(zero_copy_only=False)


def _data(a: pa.Array) -> bytes:
    return (a.buffers()[2] or b"") and a.buffers()[2].to_pybytes()


def plain(texts: pa.Array, grammar: Grammar) -> Iterator[tuple[np.ndarray, pa.Array, list[str], str]]:
    """Groups of plain fields: row numbers, bodies, the marks found as delimiters (as `Grammar.found` gives them), and the
    quote that occurs, if any. Fields must not be null.

    Plain are fields without backslash and characters of no width, with no more than one bracket at either end, and, if
    slots of theirs begin with quotes, with one kind of quote and of delimiter."""
    body = pc.utf8_trim_whitespace(texts)
    data = _data(texts)
    ok = ~_has(texts, "\\", data) & (pc.binary_length(body).to_numpy(zero_copy_only=False) > 0)
    wide = np.nonzero(~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False))[0]
    if wide.size:
        some = texts.take(pa.array(wide))
        for c in ZERO_WIDTH:
            ok[wide[_has(some, c, data)]] = False
    first, last = pc.utf8_slice_codeunits(body, 0, 1), pc.utf8_slice_codeunits(body, -1)
    for opened, close in BRACKETS.items():
        here = pc.equal(first, opened).to_numpy(zero_copy_only=False)
        if not here.any():
            continue
        at = np.nonzero(here)[0]
        some = body.take(pa.array(at))
        n_open, n_close = (pc.count_substring(some, b).to_numpy(zero_copy_only=False) for b in (opened, close))
        closed = pc.equal(last.take(pa.array(at)), close).to_numpy(zero_copy_only=False) & (n_close == 1) & (n_open == 1)
        cut = (n_close == 0) & (n_open == 1) & (opened != "(")
        ok[at[~(closed | cut)]] = False
        inner = pc.if_else(pa.array(closed), pc.utf8_slice_codeunits(some, 1, -1), pc.utf8_slice_codeunits(some, 1))
        body = pc.replace_with_mask(body, pa.array(here), inner)
    kinds = np.zeros(len(texts), np.int64)
    n_kinds = np.zeros(len(texts), np.int64)
    for i, d in enumerate(grammar.delimiters):
        there = _has(body, d.mark, data)
        if not there.any():
            continue
        if d.pattern:
            hold = np.nonzero(there)[0]
            there[hold] = [grammar.pattern[d.mark].search(b) is not None for b in body.take(pa.array(hold)).to_pylist()]
        kinds += there * (1 << i) if i < 60 else 0
        ok &= ~there if i >= 60 else True
        n_kinds += there
    double, single = _has(body, '"', data), _has(body, "'", data)
    # A quote with which no slot begins is a part of its value by every dialect.
    at = np.nonzero((double | single) & ok)[0]
    if at.size:
        begins = pc.match_substring_regex(body.take(pa.array(at)), grammar.begins).to_numpy(zero_copy_only=False)
        double[at[~begins]] = single[at[~begins]] = False
    quote = np.where(double, 1, np.where(single, 2, 0))
    patterns = sum(1 << i for i, d in enumerate(grammar.delimiters) if d.pattern and i < 60)
    ok &= (quote == 0) | ((n_kinds <= 1) & ~(double & single) & (kinds & patterns == 0))
    # A quote round a bracket belongs to the list.
    at = np.nonzero((quote > 0) & ok)[0]
    if at.size:
        some = body.take(pa.array(at))
        ok[at[pc.is_in(pc.utf8_slice_codeunits(some, 1, 2), pa.array(list(BRACKETS))).to_numpy(zero_copy_only=False)]] = False
    at = np.nonzero(ok)[0]
    group = kinds[at] * 3 + quote[at]
    order = np.argsort(group, kind="stable")
    for part in np.split(at[order], np.nonzero(np.diff(group[order]))[0] + 1):
        if part.size:
            bits = int(kinds[part[0]])
            marks = [d.mark for i, d in enumerate(grammar.delimiters) if i < 60 and bits >> i & 1]
            if len(marks) > 1 and sum(m in grammar.mixing for m in marks) > 1:
                marks.append(ANY)
            yield part, body.take(pa.array(part)), marks, ["", '"', "'"][quote[part[0]]]


def _fields(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and texts of the fields that are not null and not empty."""
    a = batch.column(column)
    rows = np.nonzero(pc.fill_null(pc.greater(pc.binary_length(a), 0), False).to_numpy(zero_copy_only=False))[0]
    return rows, a.take(pa.array(rows))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 40_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together, as groups of plain fields should not be too small; large ones as they are."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


VALUE, MARK = 0, 1
_coders: dict[str, Coder] = {}


def _coder(name: str, shared, delimiters: Sequence[Delimiter | str]) -> Coder:
    """The worker's coder of a table, made once a process; it keeps what it has learned of values from task to task."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(shared.value, grammar=Grammar(delimiters))
    return _coders[name]


def _count(batches: Iterator[pa.RecordBatch], grammar: Grammar, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Values and marks by the first guess, counted; a full table is passed on, so memory stays bounded."""

    def flush() -> pa.RecordBatch:
        kinds = [VALUE] * len(counts) + [MARK] * len(marks)
        out = pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "value": pa.array([*counts, *marks], pa.string()), "n": pa.array([*counts.values(), *marks.values()], pa.int64())})
        counts.clear()
        marks.clear()
        return out

    counts: Counter = Counter()
    marks: Counter = Counter()
    for batch in _gathered(batches):
        _, texts = _fields(batch, 0)
        done, raw = np.zeros(len(texts), bool), Counter()
        for rows, body, found, quote in plain(texts, grammar):
            good, mark = np.ones(len(rows), bool), found[0] if found else WHOLE
            if quote:
                slots, good = Slots.quoted(body, quote, mark)
            else:
                slots = Slots.split(body, mark, grammar)
            done[rows[good]] = True
            some = good & ~slots.nothing()
            for m in {mark, ANY} if ANY in found else {mark}:
                marks[m] += int(some.sum())
            found = slots.only(some).text.value_counts()
            for v, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                raw[v] += n
        for field in texts.filter(pa.array(~done)).to_pylist():
            guessed, vs = grammar.guess(unwrap(field))
            if not nothing(vs):
                marks.update(guessed)
                raw.update(vs)
        for v, n in raw.items():
            counts[fold(v)] += n
        if len(counts) > most:
            yield flush()
    if counts or marks:
        yield flush()


def learn(df: DataFrame, field: str, grammar: Grammar, max_codes: int = MAX_CODES) -> tuple[Counts, DataFrame]:
    """What is to be known of all values of the table, with the codes of at most `max_codes` of them; the table of all counts.

    All rows are counted. If at most `max_codes` values occur more than once, all of these get a code here."""
    partial = spread(df.select(F.col(field).cast("string").alias("field")).where("field is not null"))
    partial = partial.mapInArrow(lambda batches: _count(batches, grammar), "kind int, value string, n bigint")
    counted = materialize(partial.groupBy("kind", "value").agg(F.sum("n").alias("n")), "values")
    counts = counted.where(F.col("kind") == VALUE).select("value", "n")
    marks = {r["value"]: r["n"] for r in counted.where(F.col("kind") == MARK).collect()}  # one row per delimiter
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") == 1).alias("single"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    chars = counts.select(F.explode(F.split("value", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(MOST_CHARS)
    chars = {r["c"]: r["n"] for r in chars.collect() if r["c"]}
    again = n["all"] - n["single"]
    least = 2 if again <= max_codes else max(2, -(-n["total"] // max_codes))
    codes = {r["value"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}  # at most max_codes rows
    return Counts(codes, n["total"], n["all"], n["single"], chars, n["chars"], marks, least - 1), counts.where(F.col("n") >= 2)


def value_codes(df: DataFrame, field: str, max_codes: int = MAX_CODES, delimiters: Sequence[Delimiter | str] = DELIMITERS) -> tuple[dict[str, int], int]:
    """Counts of the values that get a code in the table for all tasks (at most `max_codes`), and the number of all values."""
    learned, _ = learn(df, field, Grammar(delimiters), max_codes)
    return learned.counts, learned.total


def _parse_batch(coder: Coder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(rows, lengths, values one row after the other, their numbers) of the fields that could be parsed, and the rows of the rest.

    Fields that say nothing have the length 0 and no values."""
    done = np.zeros(len(texts), bool)
    rows_, bits_, text_, n_ = [], [], [], []
    for rows, body, marks, quote in plain(texts, coder.grammar):
        mark = marks[0] if marks else WHOLE
        good = np.ones(len(rows), bool)
        if quote:
            slots, good = Slots.quoted(body, quote, mark)
            readings = [(mark, slots)]
        else:
            readings = [(m, Slots.split(body, m, coder.grammar)) for m in marks or [WHOLE]]
        # The cheapest of the readings whose length is known, the first of equals; it must beat what the others may take.
        best, chosen, bits, open_at = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        empty = np.zeros(len(rows), bool)
        for i, (m, slots) in enumerate(readings):
            b, exact = slots.lengths(coder)
            better = exact & (coder.mark[m] + b < best)
            best, bits = np.where(better, coder.mark[m] + b, best), np.where(better, b, bits)
            chosen[better] = i
            open_at = np.where(exact, open_at, np.minimum(open_at, coder.mark[m] + b))
            empty |= slots.n == 0
        sure = best < open_at
        if quote:  # the quotes may belong to the values
            other, _ = Slots.split(body, mark, coder.grammar).lengths(coder)
            sure &= bits <= other
        if marks or quote:  # it may all be one value
            # A spelled value costs this at least, a rare one that has a code elsewhere may cost less.
            size = pc.utf8_length(body).to_numpy(zero_copy_only=False)
            least = BIT * (coder.new + coder.end + size * coder.least_char)
            if coder.learned.rest > 1:
                least = np.minimum(least, BIT * (coder.log_total - math.log2(coder.learned.rest) + coder.seen))
            sure &= best <= coder.mark[WHOLE] + least
            if wholes := coder.wholes:
                # Folding changes letters, and white space where there is more of it than single spaces inside.
                spaced = pc.match_substring_regex(body, r"[\s\pZ][\s\pZ]|[^\S ]|[\x0b\x1c-\x1f\x{85}]|^[\s\pZ]|[\s\pZ]$").to_numpy(zero_copy_only=False)
                for at, key in ((np.nonzero(spaced)[0], fold), (np.nonzero(~spaced & (size <= coder.longest_whole))[0], str.lower)):
                    sure[at[np.fromiter((key(x) in wholes for x in body.take(pa.array(at)).to_pylist()), bool, len(at))]] = False
        good &= sure | empty
        done[rows[good]] = True
        for i, (_, slots) in enumerate(readings):
            mine = good & (chosen == i)
            none = mine & (slots.nothing() | empty)
            slots = slots.only(mine & ~none)
            bits[none] = 0
            rows_.append(rows[mine])
            bits_.append(bits[mine])
            n_.append(slots.n[mine])
            text_.append(slots.text)
    rest = np.nonzero(~done)[0]
    values, some, lengths, sizes, still = [], [], [], [], []
    for r, f in zip(rest.tolist(), texts.take(pa.array(rest)).to_pylist()):
        if (found := coder.parse(f)) is None:
            still.append(r)
        else:
            some.append(r)
            lengths.append(found[0])
            sizes.append(len(found[1]))
            values += found[1]
    join = lambda a, more: np.concatenate([*a, np.array(more, np.int64)]).astype(np.int64)
    text = pa.concat_arrays([*text_, pa.array(values, pa.string())])
    return join(rows_, some), join(bits_, lengths), text, join(n_, sizes), np.array(still, np.int64)


def _lists(text: pa.Array, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), text)


def folded(text: pa.Array) -> pa.Array:
    """Every value in lower case and with single spaces; each different one is folded once."""
    coded = text.dictionary_encode()
    return pa.array([fold(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _best_of_keys(key: pa.Array, bits: np.ndarray, n: np.ndarray, values: pa.ListArray) -> np.ndarray:
    """The rows to keep of a batch: of each key the one with values, the fewest bits and the first values in order."""
    coded = key.dictionary_encode()
    if len(coded.dictionary) == len(key):
        return np.arange(len(key))
    number = coded.indices.to_numpy()
    order = np.lexsort((bits, n == 0, number))
    start = np.concatenate([[True], np.diff(number[order]) > 0]) if len(order) else np.zeros(0, bool)
    if start.all():
        return np.arange(len(order))
    head = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    tie = (bits[order] == bits[order[head]]) & ((n == 0)[order] == (n == 0)[order[head]])
    keep = order[start]
    if (tie & ~start).any():
        tied = order[tie & ~start]
        some = np.unique(np.concatenate([tied, order[head[tie & ~start]]]))
        lists = dict(zip(some.tolist(), values.take(pa.array(some)).to_pylist()))
        best = dict(zip(number[keep].tolist(), keep.tolist()))
        for k, i in zip(number[tied].tolist(), tied.tolist()):
            if lists[i] < lists[best[k]]:
                best[k] = i
        keep = np.array(list(best.values()))
    return np.sort(keep)


def parsed(df: DataFrame, field: str, keep: list[str], bits: str = "bits", values: str = "values", max_codes: int = MAX_CODES, delimiters: Sequence[Delimiter | str] = DELIMITERS, best_by: str | None = None, fold_values: bool = False) -> DataFrame:
    """The kept columns of every row, the bits (1024ths) of its values and the list of them (empty for null and "nothing").

    With `fold_values` they are in lower case and with single spaces. `best_by` names a kept column: rows that another row of the same batch and key beats may then be left out. If all
    codes fit into the table for all tasks nothing is shuffled: each partition is parsed where it lies."""
    spark, grammar = df.sparkSession, Grammar(delimiters)
    learned, counts = learn(df, field, grammar, max_codes)
    shared = spark.sparkContext.broadcast(learned)  # at most max_codes entries
    names, name = [f"k{i}" for i in range(len(keep))], uuid.uuid4().hex
    by = keep.index(best_by) if best_by is not None else None
    source = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(field).cast("string").alias("f"))
    kept = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    out = ", ".join([*([kept] if kept else []), "b bigint", "v array<string>", "f string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared, delimiters)
        for batch in _gathered(batches):
            filled, texts = _fields(batch, len(names))
            rows, b, text, n, still = _parse_batch(coder, texts)
            empty = np.ones(batch.num_rows, bool)
            empty[filled] = False
            empty = np.nonzero(empty)[0]
            if empty.size:
                rows, b, n = np.concatenate([filled[rows], empty]), np.concatenate([b, np.zeros(len(empty), np.int64)]), np.concatenate([n, np.zeros(len(empty), np.int64)])
            else:
                rows = filled[rows]
            v = _lists(folded(text) if fold_values else text, n)
            columns = [c.take(pa.array(rows)) for c in batch.columns[: len(names)]]
            if by is not None:
                at = _best_of_keys(columns[by], b, n, v)
                if len(at) < len(rows):
                    columns, b, v = [c.take(pa.array(at)) for c in columns], b[at], v.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(b), v, pa.nulls(len(b), pa.string())], names=[*names, "b", "v", "f"])
            if still.size:
                columns = [c.take(pa.array(filled[still])) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(still), pa.int64()), pa.nulls(len(still), pa.list_(pa.string())), texts.take(pa.array(still))], names=[*names, "b", "v", "f"])

    done = spread(source).mapInArrow(run, out)
    if learned.rest > 1:
        done = _ask(materialize(done, "parsed"), counts, shared, delimiters, names, fold_values)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), F.col("b").alias(bits), F.col("v").alias(values))


def _ask(done: DataFrame, counts: DataFrame, shared, delimiters: Sequence[Delimiter | str], names: list[str], fold_values: bool) -> DataFrame:
    """Parses the fields that are still open (`f` is set) with the counts of their own values, each different field once."""
    fields = done.where("f is not null").select("f").distinct()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, grammar=Grammar(delimiters))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo in range(0, len(texts), 1000):
                asked = [(f, k) for f in texts[lo : lo + 1000] for k in coder.asked(f)]
                yield pa.RecordBatch.from_pydict({"f": pa.array([f for f, _ in asked], pa.string()), "value": pa.array([k for _, k in asked], pa.string())})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, grammar=Grammar(delimiters))
        for batch in batches:
            solved = []
            for f, keys, ns in zip(*(c.to_pylist() for c in batch.columns)):
                coder.more = dict(zip(keys or [], ns or []))
                solved.append(coder.parse(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in solved], pa.int64()), pa.array([[fold(x) for x in v] if fold_values else v for _, v in solved], pa.list_(pa.string()))], names=["f", "b", "v"])

    known = fields.mapInArrow(ask, "f string, value string").join(counts, "value").groupBy("f").agg(F.collect_list(F.struct("value", "n")).alias("found"))
    asked = fields.join(known, "f", "left").select("f", "found.value", "found.n")
    solved = materialize(asked.mapInArrow(solve, "f string, b bigint, v array<string>"), "solved")
    still = done.where("f is not null").select(*names, "f").join(solved, "f").select(*names, "b", "v")
    return done.where("f is null").select(*names, "b", "v").union(still)


def once_per_key(df: DataFrame, field: str, key: str, max_codes: int = MAX_CODES, values: str = "values", delimiters: Sequence[Delimiter | str] = DELIMITERS, fold_values: bool = False) -> DataFrame:
    """One row per key with the values of its cheapest parsed row: the same record may have come more than once, written
    in different ways. Rows without values give way to rows with some. Null keys are left out. `fold_values` as in `parsed`.

    The best row of a key is taken in every batch before the shuffle, so a key that holds a third of all rows sends one row
    a batch. Rows are then sorted once, behind the shuffle."""
    k = free_name("k", [])
    rows = parsed(df.where(F.col(key).isNotNull()), field, [key], "b", "v", max_codes, delimiters, key, fold_values).withColumnRenamed(key, k)
    best = rows.repartition(k).groupBy(k).agg(F.min(F.struct((F.size("v") == 0).alias("empty"), F.col("b"), F.col("v"))).alias("best"))
    return best.select(F.col(k).alias(key), F.col("best.v").alias(values))


def split_packed(df: DataFrame, field: str, keep: list[str], key: str | None = None, pos: str = "pos", item: str = "item", max_codes: int = MAX_CODES, delimiters: Sequence[Delimiter | str] = DELIMITERS) -> DataFrame:
    """One row per value of a packed field: the kept columns, the value's place from 1 (int) and the value as written.

    Args: `keep` columns to carry along; `key` if given, each of its values counts once, with its best readable row
    (then `keep` is the key alone). `pos` and `item` name the new columns; they get an underscore where a kept column
    has that name. `delimiters`: marks (or Delimiter with a pattern), those guessed first come first. Null, blank and
    "nothing" fields, and empty slots, give no row. Ties between dialects go to the first. An empty table gives an
    empty table. Repeated rows each give their values, unless `key` is set. Fields of any length are parsed whole."""
    pos = free_name(pos, keep)
    item = free_name(item, [*keep, pos])
    if key is not None:
        rows, keep = once_per_key(df, field, key, max_codes, "brindle_values", delimiters), [key]
    else:
        rows = parsed(df, field, keep, "brindle_bits", "brindle_values", max_codes, delimiters)
    return rows.select(*keep, F.posexplode("brindle_values").alias("brindle_pos", item)).select(*keep, (F.col("brindle_pos") + 1).alias(pos), item)
