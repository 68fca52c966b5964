"""Fields that pack several values into one string.

A parsing expression grammar reads each string from the left. At every position the
alternatives are tried in this order, and the first that fits is taken:

    field    <- gap* (value gap+)* value?
    value    <- known / quoted / bare
    known    <- a multi-part reference name, however it is typed, up to a gap or the end
    quoted   <- '"' ('""' / !'"' .)* '"' followed by a gap or the end
    bare     <- (bracket / !gap .)+
    bracket  <- '(' [^()]* ')' / '[' [^][]* ']' / '{' [^{}]* '}'
    gap      <- mark / blank+ joining_word blank+

A quote that does not close before a gap or the end fails the `quoted` alternative; the
parser goes back and reads it as an ordinary character of a bare value, with the flag
`malformed` set.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlore.functions.distance import osa_within

BLANKS = r"\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Marks that set values apart wherever they stand, and marks that do so only between blanks.
MARKS = ",;/|\\·、"
SPACED_MARKS = "+&"
# Words that join two artists.
ARTIST_WORDS = ("featuring", "feat.", "feat", "ft.", "ft", "versus", "vs.", "vs", "x")


@dataclass(frozen=True)
class Grammar:
    """How the values of one field are set apart.

    marks: characters that separate wherever they stand. spaced: characters that separate only
    between blanks. words: joining words, between blanks, in any case. lines: tabs and line ends
    separate too. names: reference names; those that hold separators themselves are kept whole
    however they are typed (case, blanks, punctuation, one slip of typing, two in long names),
    and two-part names also with the parts turned round at a comma.
    """

    marks: str = MARKS
    spaced: str = SPACED_MARKS
    words: tuple[str, ...] = ()
    lines: bool = False
    names: tuple[str, ...] = field(default=())

    @property
    def gap(self) -> str:
        """The regular expression of one gap, in the syntax that Java and Python share."""
        marks = "".join(re.escape(c) for c in self.marks) + ("\\t\\n\\r" if self.lines else "")
        spaced = "|".join(re.escape(w) for w in (*self.words, *self.spaced))
        parts = [f"[{marks}]"] if marks else []
        if spaced:
            parts.append(f"(?<=[{BLANKS}])(?:{spaced})(?=[{BLANKS}])")
        return "|".join(parts)


GENRES = Grammar(lines=True)
ARTISTS = Grammar(words=ARTIST_WORDS)


@dataclass(frozen=True)
class Value:
    pos: int
    value: str
    quoted: bool
    malformed: bool


def name_key(text: str) -> str:
    """Letters and digits only, lower case; 'and', 'n' and '&' between words count as nothing."""
    text = re.sub(r"(?<=[\s'])(?:and|n)(?=[\s'])", " ", text.casefold())
    return "".join(c for c in text if c.isalnum())


class Parser:
    """Reads one string by a Grammar. Made once a task; parse() keeps no state between strings."""

    def __init__(self, grammar: Grammar) -> None:
        self.gap = re.compile(grammar.gap, re.IGNORECASE)
        self.bare = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|" + f"(?P<gap>{grammar.gap})|.", re.IGNORECASE | re.DOTALL)
        self.quoted = re.compile('"((?:""|[^"])*)"' + f"(?=[{BLANKS}]*(?:{grammar.gap}|$))", re.IGNORECASE)
        self.blank = re.compile(f"[{BLANKS}]*")
        self.outer = re.compile(f"^[{BLANKS}]+|[{BLANKS}]+$")
        self.plain = re.compile(r'["(\[{]')
        self.known: dict[int, set[str]] = {}  # by length: a slip changes it by one
        self.turned: set[str] = set()
        self.spans = 1
        for name in grammar.names:
            pieces = [p for p in self.gap.split(name) if p and p.strip()]
            if len(pieces) > 1:
                key = name_key(name)
                self.known.setdefault(len(key), set()).add(key)
                self.spans = max(self.spans, len(pieces))
            words = name.split()
            if len(words) == 2 and all(w.isalpha() for w in words):
                self.turned.add(f"{words[1]},{words[0]}".casefold())
        if self.turned:
            self.spans = max(self.spans, 2)

    def is_known(self, text: str, pieces: int) -> bool:
        """Does a text of so many pieces spell one reference name?"""
        if pieces == 2 and re.sub(r"\s+", "", text.casefold()) in self.turned:
            return True
        key = name_key(text)
        if key in self.known.get(len(key), ()):
            return True
        for length in range(len(key) - 2, len(key) + 3):  # a slip may have eaten a separator, so the number of pieces does not decide
            slips = 0 if length < 6 else 1 if length < 12 else 2
            if abs(length - len(key)) <= slips and any(osa_within(key, name, slips) for name in self.known.get(length, ())):
                return True
        return False

    def atoms(self, text: str) -> list[tuple[int, int, str | None, bool]]:
        """(start, end, content when quoted, malformed) of every non-empty quoted or bare stretch."""
        found, at, n = [], 0, len(text)
        while at < n:
            at = self.blank.match(text, at).end()
            if at >= n:
                break
            malformed = False
            if text[at] == '"':
                if m := self.quoted.match(text, at):
                    found.append((at, m.end(), m[1].replace('""', '"'), False))
                    at = m.end()
                    at = self.blank.match(text, at).end()
                    if g := self.gap.match(text, at):
                        at = g.end()
                    continue
                malformed = True
            start = at
            while at < n:
                m = self.bare.match(text, at)
                if m["gap"] is not None:
                    break
                malformed = malformed or m[0] == '"'
                at = m.end()
            if text[start:at].strip():
                found.append((start, at, None, malformed))
            if at < n:
                at = self.gap.match(text, at).end()
        return found

    def parse(self, text: str | None) -> list[Value]:
        if not text or not text.strip():
            return []
        if not self.plain.search(text):  # no quote and no bracket: the gaps alone decide
            atoms, at = [], 0
            for m in self.gap.finditer(text):
                if text[at : m.start()].strip():
                    atoms.append((at, m.start(), None, False))
                at = m.end()
            if text[at:].strip():
                atoms.append((at, len(text), None, False))
        else:
            atoms = self.atoms(text)
        values, i = [], 0
        while i < len(atoms):
            take = 1
            for span in range(min(self.spans, len(atoms) - i), 1, -1):
                part = atoms[i : i + span]
                if all(a[2] is None for a in part) and self.is_known(text[part[0][0] : part[-1][1]], span):
                    take = span
                    break
            start, end, content, malformed = atoms[i][0], atoms[i + take - 1][1], atoms[i][2], any(a[3] for a in atoms[i : i + take])
            value = content if content is not None else text[start:end]
            value = self.outer.sub("", value)
            if value:
                values.append(Value(len(values) + 1, value, content is not None, malformed))
            i += take
        return values


@lru_cache(maxsize=16)
def parser(grammar: Grammar) -> Parser:
    return Parser(grammar)


def may_hold_several(text: Column, grammar: Grammar) -> Column:
    """True wherever a gap occurs at all: a cheap JVM test that keeps single values out of Python."""
    return text.rlike("(?i)" + grammar.gap)


OUT = "id string, field string, pos int, value string, quoted boolean, malformed boolean"


def split_values(df: DataFrame, id_col: str, grammars: dict[str, Grammar], several_only: bool = False, single_only: bool = False) -> DataFrame:
    """One row a value of every named field: id, field, pos, value, quoted, malformed.

    grammars: the Grammar of each field; the field's name is the column's name. several_only: only
    fields that hold two or more values; single_only: only those that hold one. No shuffle: the strings
    are parsed where they are read, each distinct string once a batch.

    Null, empty, blank and separator-only fields give no row. Repeated values stay, each with its
    position; repeated rows stay too. Texts of any length are read whole, in linear time. An empty
    table gives an empty table. Other columns of df, whatever their names, are not read.
    """
    stacked = df.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("text")) for name in grammars])).alias("f"),
    ).select("id", "f.field", "f.text")
    wanted = F.lit(False)
    for name, grammar in grammars.items():
        hit = may_hold_several(F.col("text"), grammar) if several_only else F.length(F.trim("text")) > 0
        wanted = wanted | ((F.col("field") == name) & hit)
    least, most = 2 if several_only else 1, 1 if single_only else float("inf")
    schema = pa.schema([("id", pa.string()), ("field", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("quoted", pa.bool_()), ("malformed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parsers = {name: parser(grammar) for name, grammar in grammars.items()}
        for batch in batches:
            cache: dict[tuple[str, str], list[Value]] = {}
            ids, names, pos, values, quoted, malformed = [], [], [], [], [], []
            for key, name, text in zip(batch["id"].to_pylist(), batch["field"].to_pylist(), batch["text"].to_pylist()):
                if (found := cache.get((name, text))) is None:
                    found = cache[name, text] = parsers[name].parse(text)
                if least <= len(found) <= most:
                    for v in found:
                        ids.append(key)
                        names.append(name)
                        pos.append(v.pos)
                        values.append(v.value)
                        quoted.append(v.quoted)
                        malformed.append(v.malformed)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, names, pos, values, quoted, malformed), schema.types)], schema=schema)

    return stacked.where(wanted).mapInArrow(run, OUT)
