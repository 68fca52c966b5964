"""Byte-pair encoding of a whole corpus with a public tokenizer, by merge replay.

The texts of a block are cut into words once; the block's words that are new to the worker form one
array of symbols. An inverted index leads from each pair of neighbouring symbols to the positions where
it stands. Merges are then replayed in rank order over the whole block at a time: each rank visits the
positions of its pair, joins them and updates only the two touched neighbours. Words keep their ids for
the texts that follow, so a word is merged once a worker, however often it stands in the corpus.

A word's ids do not depend on other words, so replaying block by block gives the ids that one replay
over the corpus would give, without moving the text over the network.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

TOKENIZERS = "/opt/tokenizers"
#: Words that a worker remembers at most; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Texts of one replay are gathered up to so many characters.
BLOCK_CHARS = 4_000_000
# Fixed value: the pattern that cuts text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Replay:
    """A byte-level vocabulary with its merges; encode() gives the ids of words."""

    def __init__(self, definition: str) -> None:
        model = json.loads(definition)["model"]
        vocabulary: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocabulary[letter]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by one replay over all of them."""
        byte_id, merges = self.byte_id, self.merges
        symbols: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbols))
            symbols.extend([byte_id[b] for b in w.encode("utf-8", "replace")])
            symbols.append(-1)  # the end of a word meets nothing
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        ranks: list[tuple[int, int]] = []

        def note(pair: int, at: int) -> None:
            if (places := index.get(pair)) is not None:
                places.append(at)
            elif (merge := merges.get(pair)) is not None:
                index[pair] = [at]
                heapq.heappush(ranks, (merge[0], pair))

        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0:
                note(a << 32 | b, i)
        while ranks:
            _, pair = heapq.heappop(ranks)
            a, b, to = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
            for at in sorted(index.pop(pair)):
                right = after[at]
                if symbols[at] != a or right >= n or symbols[right] != b:
                    continue  # a neighbour of the same rank took one of the two
                symbols[at], symbols[right] = to, -2
                follow = after[right]
                after[at] = follow
                if follow < n:
                    before[follow] = at
                    if symbols[follow] >= 0:
                        note(to << 32 | symbols[follow], at)
                lead = before[at]
                if lead >= 0 and symbols[lead] >= 0:
                    note(symbols[lead] << 32 | to, lead)
        out = []
        for start in starts:
            ids, at = [], start
            while symbols[at] != -1:
                ids.append(symbols[at])
                at = after[at]
            out.append(ids)
        return out


_workers: dict[int, tuple[Replay, dict[str, list[int]]]] = {}


def _encoder(definition: str) -> tuple[Replay, dict[str, list[int]]]:
    """One Replay and its remembered words a worker process."""
    if (key := hash(definition)) not in _workers:
        _workers.clear()
        _workers[key] = Replay(definition), {}
    return _workers[key]


def read_definition(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> str:
    return Path(path).read_text(encoding="utf-8")


def _encoded(batches: Iterator[pa.RecordBatch], definition: str, column: str) -> Iterator[tuple[pa.RecordBatch, list[list[list[int]]]]]:
    """Each batch with, for each text, the ids of its words."""
    import regex

    cut = regex.compile(PATTERN).findall
    replay, known = _encoder(definition)
    held: list[tuple[pa.RecordBatch, list[list[str]]]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[list[list[int]]]]]:
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for _, texts in held for words in texts for w in words if w not in known})
        known.update(zip(new, replay.encode(new)))
        for batch, texts in held:
            yield batch, [[known[w] for w in words] for words in texts]

    for batch in batches:
        texts = [cut(t) if t else [] for t in batch[column].to_pylist()]
        held.append((batch, texts))
        size += batch[column].nbytes
        if size >= BLOCK_CHARS:
            yield from flush()
            held, size = [], 0
    yield from flush()


def encode(df: DataFrame, id_col: str, text: str, definition: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens.

    The strings of special tokens inside a text are ordinary text. Null and empty texts come out with an
    empty array, so every row has ids. Texts are encoded whole, whatever their length; repeated rows stay;
    an empty table gives an empty table; other columns are not read. No shuffle.
    definition: the tokenizer's JSON; the default reads byte_bpe_50k from TOKENIZERS.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(definition or read_definition())  # one vocabulary file, about 1.5 MB
    cut = df.select(F.col(id_col).alias(id_col), F.col(text).cast("string").alias("text_"))
    schema = cut.select(id_col).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, texts in _encoded(batches, shared.value, "text_"):
            flat, offsets = array("i"), array("i", [0])
            for words in texts:
                for ids in words:
                    flat.extend(ids)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch[id_col], lists], names=[id_col, "ids"])

    return cut.mapInArrow(run, schema.add("ids", ArrayType(IntegerType())))


def count_tokens(df: DataFrame, text: str, keep: list[str], definition: str | None = None) -> DataFrame:
    """The columns `keep` with n_tokens BIGINT, the number of ids that encode() gives; null and empty texts have 0."""
    shared = df.sparkSession.sparkContext.broadcast(definition or read_definition())
    cut = df.select(*keep, F.col(text).cast("string").alias("text_"))
    schema = cut.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, texts in _encoded(batches, shared.value, "text_"):
            counts = pa.array([sum(map(len, words)) for words in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], counts], names=[*keep, "n_tokens"])

    return cut.mapInArrow(run, schema.add("n_tokens", LongType()))
