"""Language of documents and of their stretches by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is bound into one vector: the
letters' vectors are rotated by their place and multiplied. A text's vector is the bundle (sum) of its
letter runs, a language's prototype the bundle of its training sentences, less what all languages have
in common. A sentence goes to the language with the highest cosine.

The vector of a text is never built for scoring: the product of a bundle and a prototype is the sum of
the products of its letter runs, and those are computed once a worker for each run. The length of a
text's vector follows from its counts, because vectors of different runs are orthogonal but for noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

DIMENSIONS = 4096
LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru")
#: Labelled documents for each language that the prototypes are made of, at most.
SAMPLE = 300
#: Letter runs whose products a worker remembers at most.
REMEMBERED = 1_500_000
#: Sentences of at most LONGEST letters whose language a worker remembers, about.
SENTENCES, LONGEST = 100_000, 400
#: The language of a document without sentences.
NONE = "und"
#: Size of the hash table over letter runs, as a power of two.
SLOT_BITS = 20
EPOCHS = 6
SHARPNESS = 60.0

_HIDDEN = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\xad\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]")
_ENDS = ".!?…。！？"
_LINES = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]+|[ \t\u00a0]{2,}")
_QUOTES = "[\"”’»)\\]]"
_STOP = re.compile(rf"[{_ENDS}]{_QUOTES}*(?:\s+|(?<=[。！？])(?![。！？{_QUOTES[1:]}))")
_END = re.compile(rf"[{_ENDS}][\"”’»)\]]*$")
_WORDS = re.compile(r"[\W\d_]*+(?:[^\W\d_]++[\W\d_]++){2}[^\W\d_]")
_WIDE = "[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af]"
_WIDE_LETTERS = re.compile(f"(?:{_WIDE}[^{_WIDE[1:]}*){{4}}")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in order. Lines of names, dates, numbers, files or signs are none:
    a sentence ends with a full stop, question or exclamation mark, and holds three words, or four wide letters."""
    if not text:
        return []
    found = []
    for line in _LINES.split(_HIDDEN.sub("", text)):
        at, ends = 0, [m.end() for m in _STOP.finditer(line)]
        for end in (*ends, len(line)):
            piece = line[at:end].strip()
            at = end
            if piece and _END.search(piece) and (_WORDS.match(piece) or _WIDE_LETTERS.search(piece)):
                found.append(piece)
    return found


class _Plain(dict):
    """A translation table, filled as letters occur, that turns all but letters into blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c if c.isalnum() and not c.isdecimal() else " "
        return out


_PLAIN = _Plain()


def letters(sentence: str) -> str:
    """Lower-case letters, each stretch of anything else one blank, a blank at either end."""
    return f" {' '.join(sentence.lower().translate(_PLAIN).split())} "


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): the keys of all runs of three letters, and where each text's begin. Every text has one at least."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    inside = np.ones(len(keys), bool)
    for back in (1, 2):
        over = ends[:-1] - back
        inside[over[over < len(keys)]] = False
    starts = np.concatenate([[0], np.cumsum(lengths - 2)[:-1]])
    return keys[inside], starts


class Letters:
    """The letters' random vectors, made from the code point alone so that every worker has the same."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions, self.known = dimensions, {}

    def vector(self, code: int) -> np.ndarray:
        if (v := self.known.get(code)) is None:
            v = self.known[code] = np.random.default_rng([7, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return v

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 a key: letters rotated by two, one and no places, multiplied."""
        out = np.empty((len(keys), self.dimensions), np.int8)
        mask = (1 << 21) - 1
        parts = [keys >> 42, keys >> 21 & mask, keys & mask]
        for turn, part in zip((2, 1, 0), parts):
            codes, where = np.unique(part, return_inverse=True)
            table = np.stack([np.roll(self.vector(int(c)), turn) for c in codes])
            if turn == 2:
                out[:] = table[where]
            else:
                out *= table[where]
        return out

    def products(self, keys: np.ndarray, prototypes: np.ndarray, step: int = 2048) -> np.ndarray:
        return np.concatenate([self.bound(keys[i : i + step]).astype(np.float32) @ prototypes.T for i in range(0, len(keys), step)]) if len(keys) else np.zeros((0, len(prototypes)), np.float32)

    def bundles(self, keys: np.ndarray, weights: np.ndarray, step: int = 2048) -> np.ndarray:
        total = np.zeros((len(weights), self.dimensions), np.float32)
        for i in range(0, len(keys), step):
            total += weights[:, i : i + step].astype(np.float32) @ self.bound(keys[i : i + step]).astype(np.float32)
        return total


@dataclass
class Profiles:
    """Language codes and their prototypes, unit rows."""

    languages: tuple[str, ...]
    prototypes: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _centred(bundles: np.ndarray, present: np.ndarray) -> np.ndarray:
    unit = _unit(bundles)
    return _unit(unit - unit[present].mean(axis=0)) * present[:, None]


def fit(labelled: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> Profiles:
    """Prototypes from (text, language) pairs, some of which may be wrong.

    All sentences are bundled by label first. Sentences that the prototypes give to another language than
    their label are then taken out as doubtful and the rest bundled anew; the epochs that follow add the
    sentences of least margin again.
    """
    texts, labels = [], []
    for text, language in labelled:
        for s in sentences(text):
            texts.append(letters(s))
            labels.append(languages.index(language))
    if not texts:
        return Profiles(languages, np.zeros((len(languages), dimensions), np.float32))
    space = Letters(dimensions)
    keys, starts = runs(texts)
    distinct, where = np.unique(keys, return_inverse=True)
    label = np.array(labels)
    of_text = np.repeat(np.arange(len(texts)), np.diff([*starts, len(keys)]))

    def weights(amount: np.ndarray, to: np.ndarray) -> np.ndarray:
        flat = np.bincount(to[of_text] * len(distinct) + where, amount[of_text], len(languages) * len(distinct))
        return flat.reshape(len(languages), len(distinct))

    def scores(prototypes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(space.products(distinct, prototypes)[where], starts, axis=0) / np.diff([*starts, len(keys)])[:, None]

    present = np.bincount(label, minlength=len(languages)) > 0
    bundle = space.bundles(distinct, np.log1p(weights(np.ones(len(texts)), label)))
    keep = np.ones(len(texts), bool)
    for epoch in range(epochs):
        found = scores(_centred(bundle, present))
        found[:, ~present] = -np.inf
        keep = found.argmax(axis=1) == label
        counted = weights(keep * 1.0, label)
        order = np.sort(found, axis=1)
        margin = order[:, -1] - order[:, -2] if present.sum() > 1 else np.ones(len(texts))
        hard = keep & (margin < np.quantile(margin[keep], 0.05 * (epoch + 1))) if keep.any() else keep
        bundle = space.bundles(distinct, np.log1p(counted + weights(hard * 2.0, label)))
    return Profiles(languages, _centred(bundle, present).astype(np.float32))


class Scorer:
    """Cosines of sentences with the prototypes; remembers the products of letter runs."""

    def __init__(self, profiles: Profiles) -> None:
        self.profiles, self.space = profiles, Letters(profiles.prototypes.shape[1])
        self.keys, self.values = np.zeros(0, np.int64), np.zeros((0, len(profiles.languages)), np.float32)
        self.table = np.zeros(1 << SLOT_BITS, np.int32)
        self.known: dict[str, tuple[str, float]] = {}

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each key stands, is it unknown): by the hash table, and by search where two keys share a slot."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        where = self.table[self.slots(keys)].astype(np.int64)
        other = np.nonzero(self.keys[where] != keys)[0]
        where[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
        return where, self.keys[where] != keys

    def cosines(self, texts: list[str]) -> np.ndarray:
        keys, starts = runs(texts)
        where, unknown = self.places(keys)
        if unknown.any():
            new = np.unique(keys[unknown])
            if len(self.keys) + len(new) > REMEMBERED:
                self.keys, self.values, new = self.keys[:0], self.values[:0], np.unique(keys)
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged)
            self.values = np.concatenate([self.values, self.space.products(new, self.profiles.prototypes)])[order]
            self.keys = merged[order]
            self.table[:] = 0
            self.table[self.slots(self.keys)] = np.arange(len(self.keys))
            where, _ = self.places(keys)
        rows, size = self.values, len(self.keys)
        dots = np.add.reduceat(rows[where], starts, axis=0)
        text_of = np.repeat(np.arange(len(texts)), np.diff([*starts, len(keys)]))
        pair, counts = np.unique(text_of * size + where, return_counts=True)
        square = np.bincount(pair // size, counts.astype(float) ** 2, len(texts))
        return dots / np.sqrt(square * self.space.dimensions)[:, None]


    def languages(self, texts: set[str]) -> dict[str, tuple[str, float]]:
        """(language, sureness) of each sentence; sentences that come again are scored once."""
        new = [t for t in texts if t not in self.known]
        if new:
            cosines = self.cosines([letters(t) for t in new])
            sure = 1 / np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True))).sum(axis=1)
            found = dict(zip(new, zip([self.profiles.languages[i] for i in cosines.argmax(axis=1).tolist()], sure.tolist())))
        else:
            found = {}
        out = found | {t: self.known[t] for t in texts if t not in found}
        if len(self.known) > SENTENCES:
            self.known = {}
        self.known.update((t, v) for t, v in found.items() if len(t) <= LONGEST)
        return out


_workers: dict[int, Scorer] = {}


def sample(df: DataFrame, id_col: str, text: str, label: str, languages: tuple[str, ...] = LANGUAGES, size: int = SAMPLE) -> list[tuple[str, str]]:
    """Up to `size` documents of each language whose label is exactly its code, by the order of a hash of the id."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    labelled = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label")).where(F.col("label").isin(*languages) & (F.length("text") > 0))
    picked = labelled.select("id", "label").withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).select("id")
    rows = labelled.join(F.broadcast(picked), "id", "left_semi").select("text", "label").collect()
    return sorted((r["text"], r["label"]) for r in rows)


def segments(df: DataFrame, id_col: str, text: str, profiles: Profiles, every: bool = False) -> DataFrame:
    """(id_col, seg, lang, confidence, sentences, chars): the stretches in one language of every text, numbered from 1.

    A stretch is a longest run of sentences that go to one language. Lines of names, dates, numbers, files
    or signs have no language and end no stretch. confidence is the mean over the stretch's sentences of
    the softmax of SHARPNESS times the cosines, between 0 and 1.

    Null, empty and blank texts and texts without sentences give no row; every: they give one of seg 0, lang
    'und' and confidence 0. A tie of cosines goes to the first
    language in the order of the profiles. Texts are read whole, whatever their length. Repeated rows come
    out repeated; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # one row of DIMENSIONS floats a language
    cut = df.select(F.col(id_col), F.col(text).cast("string").alias("text_"))
    cut = cut if every else cut.where(F.length("text_") > 0)
    schema = cut.select(id_col).schema
    for name, kind in (("seg", IntegerType()), ("lang", StringType()), ("confidence", DoubleType()), ("sentences", IntegerType()), ("chars", LongType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        profiles = shared.value
        key = hash(profiles.prototypes.tobytes())
        if key not in _workers:
            _workers.clear()
            _workers[key] = Scorer(profiles)
        scorer = _workers[key]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                pieces = [sentences(value) for value in batch["text_"].to_pylist()]
                scored = scorer.languages({s for some in pieces for s in some})
                out: list[list] = []
                for n, some in enumerate(pieces):
                    last, seg = None, 0
                    for s in some:
                        language, sureness = scored[s]
                        if language != last:
                            last, seg = language, seg + 1
                            out.append([n, seg, language, 0.0, 0, 0])
                        row = out[-1]
                        row[3] += sureness
                        row[4] += 1
                        row[5] += len(s)
                    if every and not some:
                        out.append([n, 0, NONE, 0.0, 0, 0])
                if out:
                    ids = batch[id_col].take(pa.array([r[0] for r in out], pa.int32()))
                    columns = [pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out]), pa.array([r[3] / max(r[4], 1) for r in out]), pa.array([r[4] for r in out], pa.int32()), pa.array([r[5] for r in out], pa.int64())]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_col, "seg", "lang", "confidence", "sentences", "chars"])

    return cut.mapInArrow(run, schema)


def documents(found: DataFrame, id_col: str) -> DataFrame:
    """(id_col, lang, confidence, languages, stretches) of segments(): the language with most letters (of a tie the first by name); rows of seg 0 count no language."""
    by = found.groupBy(id_col, "lang").agg(F.sum("chars").alias("chars"), F.sum(F.col("confidence") * F.col("sentences")).alias("sure"), F.sum("sentences").alias("sentences"), F.sum((F.col("seg") > 0).cast("int")).alias("stretches"))
    top = F.min(F.struct((-F.col("chars")).alias("rank"), "lang", F.coalesce(F.try_divide(F.col("sure"), F.col("sentences")), F.lit(0.0)).alias("confidence"))).alias("top")
    return by.groupBy(id_col).agg(top, F.sum((F.col("lang") != NONE).cast("int")).cast("int").alias("languages"), F.sum("stretches").cast("int").alias("stretches")).select(id_col, "top.lang", "top.confidence", "languages", "stretches")
