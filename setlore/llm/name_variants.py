"""Variant spellings of names typed by people.

Values that differ in layout only share one key. A key is read as its words: lower case, without accents,
kinds of act and pet forms put to their full form, in no order. Small edit distances are found by a
symmetric-delete neighbourhood index over every word of every name: two names one slip apart agree in all
words but one, and those two words share a form that both reach by deleting at most one letter, so an
equi-join on (other words, form) meets every such pair and hardly another. Initials and abbreviations are
met by (first letters of all words, one whole word). Every candidate is confirmed by the assignment of
least cost between the two whole lists of words, and by what the table says about the two spellings. Links
are closed to components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
import xxhash

from setlore.functions.distance import osa_distance
from setlore.llm.layout_duplicates import letters_and_digits
from setlore.llm.unicode_form import clean_text
from setlore.operators.graph import components
from setlore.operators.multivalue import ARTISTS, Grammar, may_hold_several, split_values
from setlore.session import materialise

# Kinds of act and their short forms.
KINDS = {
    "orchestra": ("orch", "orchester", "orchestre", "orquesta"),
    "ensemble": ("ens",),
    "collective": ("coll", "kollektiv", "collectif", "colectivo"),
    "brothers": ("bros", "bro", "brs"),
    "quartet": ("4tet", "qrt", "qt", "quartett", "quartetto"),
    "project": ("prj", "proj", "projekt", "proyecto"),
    "department": ("dept", "dpt", "dep"),
    "laboratory": ("lab", "labs"),
    "soundsystem": ("soundsys", "ss"),
    "trio": (),
    "band": (),
}
# Given names and their short and pet forms.
PET_FORMS = {
    "alexander": ("alex", "sasha", "xander", "alec", "sandy", "lex"), "andrew": ("andy", "drew"), "anthony": ("tony",), "antonia": ("toni", "tonia", "nia", "antonie"), "bastien": ("basti", "bas"),
    "benjamin": ("ben", "benny", "benni", "benji"), "catherine": ("cathy", "cath"), "charles": ("charlie", "chuck"), "christopher": ("chris", "topher", "kit", "christo"), "daniel": ("danny", "dani"), "david": ("dave", "davy"),
    "deborah": ("debbie", "deb"), "edward": ("ed", "eddie", "ned"), "elisabeth": ("lisa", "betty", "liz", "elisa", "beth", "lisbeth", "lizzy", "bess"), "francisco": ("paco", "fran", "pancho", "cisco", "kiko", "frank"),
    "frederick": ("fred", "freddy", "freddie", "fredi", "rick"), "gabriela": ("gabi", "gaby", "ela"), "gregory": ("greg",), "isabella": ("bella", "isa", "izzy", "belle"), "james": ("jim", "jimmy", "jamie"),
    "jennifer": ("jenny", "jen"), "jonathan": ("jon", "jonny", "johnny", "nathan", "jonas"), "jose": ("pepe", "chepe", "josele"), "joseph": ("joe", "joey"), "josephine": ("josie", "jo", "fina", "josy", "sephine", "posy"),
    "joshua": ("josh",), "katharina": ("kat", "kathi", "kate", "katja", "kathy", "rina", "katha", "kati", "trina"), "kenneth": ("ken", "kenny"), "lawrence": ("larry",), "margarethe": ("maggie", "grete", "marga", "gretel", "meg"),
    "matthew": ("matt", "matty"), "maximilian": ("max", "maxi", "milian"), "michael": ("mike", "mick", "micky", "michi", "mickey", "misha"), "nikolai": ("niko", "nik", "kolya", "nick", "nico"), "patricia": ("patty", "trish"),
    "rebecca": ("becky", "becca", "becki", "reba"), "richard": ("dick", "ricky", "rich"), "robert": ("bob", "bobby", "rob", "robbie", "robby", "bert", "bobbie"), "ronald": ("ron", "ronnie"), "samuel": ("sam", "sammy", "sami"),
    "sebastian": ("seb", "basti", "bastian", "sebi", "wastl", "bas"), "stephen": ("steve", "stevie"), "susan": ("sue", "susie"), "tamara": ("tama", "mara", "tammy", "toma"), "theodora": ("dora", "thea", "teddy"),
    "thomas": ("tom", "tommy"), "timothy": ("tim", "timmy"), "valentina": ("tina", "val", "vale", "valen", "valya"), "victoria": ("vicky", "vicki", "tori", "vic", "vika", "toria"),
    "william": ("will", "bill", "billy", "willy", "liam", "willi", "wim"), "nadja": ("nadia",), "giulia": ("giuli", "giu"), "leonardo": ("leo",), "zachary": ("zach", "zack"),
}
# Pet forms that are given names in their own right; they stand for the full name only beside it.
OWN_RIGHT = {"margarethe": ("greta", "margot"), "theodora": ("theo",), "elisabeth": ("elsa", "ella"), "isabella": ("ella",), "william": ("liam",), "nikolai": ("nico",), "leonardo": ("leo",)}
#: Two spellings are words of their own if both stand in at least this many names, the rarer in this share of the commoner's.
OWN_NAMES, OWN_SHARE = 3, 0.25
#: In words of fewer letters one slip may well give another word, so two names of each and the share are enough, and a doubtful one links to none.
SHORT = 6
#: In names with more words that are pet forms each of them stands for its first full name only.
PETS_AT_ONCE = 4
#: Of joins whose sides grow with the table. Spark takes the size of a stored table for that of the many rows that a function or explode() makes of it, and would send them through the driver.
MERGE = "merge"
#: Values in one cell of the join that lists pairs.
CELL = 512

_KIND = {short: kind for kind, some in KINDS.items() for short in (kind, *some)}
_FULL: dict[str, list[str]] = {}
_OWN: dict[str, list[str]] = {}
for _table, _of in ((PET_FORMS, _FULL), (OWN_RIGHT, _OWN)):
    for _full, _some in _table.items():
        for _pet in _some:
            _of.setdefault(_pet, []).append(_full)

_SOUND_SYSTEM = re.compile(r"(?i)\bs\.\s?s\.|\bsound\s*sys(?:tem|\.|\b)")
_WORD = re.compile(r"[^\W_]+")
_CASE = re.compile(r"(?<=[^\W\d_])(?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower case, Latin letters without their accents, no combining marks."""
    out = []
    for c in text.lower():
        if c < "\x80":
            out.append(c)
        elif not unicodedata.category(c).startswith("M"):
            plain = unicodedata.normalize("NFD", c)[0]
            out.append(plain if plain.isascii() else c)
    return "".join(out)


def _run_together(name: str) -> str:
    """Words run together, cut where the case changes: 'OdinVale', 'oDINvALE'."""
    letters = [c for c in name if c.isalpha()]
    swapped = len(letters) > 1 and letters[0].islower() and letters[1].isupper()
    cut = lambda m: " " if (name[m.start() - 1].isupper() and name[m.start()].islower() if swapped else name[m.start() - 1].islower() and name[m.start()].isupper()) else ""
    return _CASE.sub(cut, name)


@lru_cache(maxsize=100_000)
def kind_of(word: str) -> str:
    """The kind of act that a word names: by a short form, or from six letters on with one slip; else the word itself."""
    if word in _KIND or len(word) < SHORT - 1:
        return _KIND.get(word, word)
    return next((k for k in KINDS if len(k) >= SHORT and osa_distance(word, k, 1) <= 1), word)


def words_of(name: str) -> tuple[list[str], list[str]]:
    """(words, those typed with a dot after two to five letters); kinds of act in full, no 'the' before others."""
    text = fold(_SOUND_SYSTEM.sub(" soundsystem ", name))
    found = list(_WORD.finditer(text))
    if len(found) < 2:
        text = fold(_run_together(name))
        found = list(_WORD.finditer(text))
    words = [kind_of(m[0]) for m in found]
    dotted = [m[0] for m in found if text[m.end() : m.end() + 1] == "." and 2 <= len(m[0]) <= 5 and m[0] not in _KIND and m[0].isalpha()]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    return words, dotted


def nodes_of(words: list[str]) -> list[str]:
    """The names that a list of words may stand for: sorted, each pet form put to a full name. Names of acts have no pet forms."""
    if len(words) < 2 or any(w in KINDS for w in words):
        return [" ".join(sorted(words))]
    pets = sum(w in _FULL for w in words)
    ways = [(_FULL[w] if pets <= PETS_AT_ONCE else _FULL[w][:1]) if w in _FULL else [w] for w in words]
    return sorted({" ".join(sorted(p)) for p in product(*ways)})


def beside(node: str) -> list[str]:
    """The names that a name is a short form of if they stand in the table too."""
    words = node.split(" ")
    if len(words) < 2:
        return []
    swap = lambda i, full: " ".join(sorted([*words[:i], full, *words[i + 1 :]]))
    out = {swap(i, full) for i, w in enumerate(words) for full in _OWN.get(w, ())}
    initials = [w for w in words if len(w) == 1]
    if len(words) - len(initials) >= 2 and len(initials) == 1:
        out.add(" ".join(w for w in words if len(w) > 1))  # a middle initial left out
    return sorted(out)


def alignment(a: list[str], b: list[str], dotted: Iterable[str] = ()) -> float:
    """The cost of the best assignment of two lists of words.

    Equal 0, pet form 0.25, initial or dotted abbreviation 0.5, one slip 1, anything else 9; a word left over 9.
    """
    return sum(c for c, _, _ in assignment(a, b, dotted))


def assignment(a: list[str], b: list[str], dotted: Iterable[str] = ()) -> list[tuple[float, str, str]]:
    """(cost, word, word) of the assignment of least total cost, equal words left out; '' stands for no word.

    Equal words are assigned to each other first, which no better assignment can contradict; the rest is
    solved by augmenting paths (the Hungarian method).
    """
    left, right = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    n = max(len(left), len(right))
    left += [""] * (n - len(left))
    right += [""] * (n - len(right))
    short = set(dotted)
    costs = [[_cost(x, y, short) for y in right] for x in left]
    take = [0] if n == 1 else _hungarian(costs)
    return [(costs[i][j], left[i], right[j]) for i, j in enumerate(take)]


def _hungarian(costs: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least cost."""
    n = len(costs)
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [-1] * (n + 1)
    for i in range(n):
        row_of[n], j = i, n
        least, back, used = [float("inf")] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while row_of[j] >= 0:
            used[j], row, delta, at = True, row_of[j], float("inf"), n
            for k in range(n):
                if not used[k]:
                    if (c := costs[row][k] - u[row] - v[k]) < least[k]:
                        least[k], back[k] = c, j
                    if least[k] < delta:
                        delta, at = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = at
        while j != n:
            row_of[j] = row_of[back[j]]
            j = back[j]
    out = [0] * n
    for j in range(n):
        out[row_of[j]] = j
    return out


def _cost(x: str, y: str, dotted: set[str]) -> float:
    if x == y:
        return 0.0
    if not x or not y:
        return 9.0
    fulls = [{*_FULL.get(w, ()), *_OWN.get(w, ())} for w in (x, y)]
    if y in fulls[0] or x in fulls[1] or fulls[0] & fulls[1]:
        return 0.25
    if min(len(x), len(y)) == 1:
        return 0.5 if x[0] == y[0] else 9.0
    if (x in dotted and y.startswith(x)) or (y in dotted and x.startswith(y)):
        return 0.5
    return 1.0 if x.isalpha() and y.isalpha() and osa_distance(x, y, 1) <= 1 else 9.0


_BASE, _PRIME, _WRAP = 911_382_323, (1 << 61) - 1, 1 << 64


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _signed(x: int) -> int:
    x %= _WRAP
    return x - _WRAP if x >= 1 << 63 else x


def deletes(word: str) -> set[int]:
    """The symmetric-delete neighbourhood: hashes of the word and of every form with one letter left out.

    Two words within one slip always share one. Rolling hashes keep it linear in the length of the word.
    """
    n, sums, powers = len(word), [0], [1]
    for c in word:
        sums.append((sums[-1] * _BASE + ord(c) + 1) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return {sums[n], *((sums[i] * powers[n - 1 - i] + sums[n] - sums[i + 1] * powers[n - i - 1]) % _PRIME for i in range(n))}


def slip_signatures(node: str) -> list[int]:
    """Hashes of (the other words, a form of this one) for every word of letters but initials."""
    words = node.split(" ")
    hashes = [_hash(w) for w in words]
    total = sum(hashes)
    return list({_signed((total - h) * 0x9E3779B97F4A7C15 + f) for w, h in zip(words, hashes) if len(w) > 1 and w.isalpha() for f in deletes(w)})


def letter_signatures(node: str, dotted: list[str]) -> tuple[bool, list[int]]:
    """(asks, hashes of (first letters of all words, one whole word)). A name with initials or dotted words asks by its longest whole word; others answer by each."""
    words = node.split(" ")
    letters = sum(_hash("^" + w[0]) for w in words)
    whole = [w for w in words if len(w) > 1 and w not in dotted]
    asks = any((len(w) == 1 and w.isalpha()) or w in dotted for w in words)
    chosen = ([max(whole, key=lambda w: (len(w), w))] if whole else []) if asks else whole
    return asks, list({_signed(letters * 0x9E3779B97F4A7C15 + _hash(w)) for w in chosen})


def _map(df: DataFrame, schema: str, types: list[pa.DataType], each: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows that `each` gives for every row of df, by Arrow batches."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = [out for row in zip(*[c.to_pylist() for c in batch.slice(at, 2000).columns]) for out in each(*row)]
                columns = list(zip(*rows)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return df.mapInArrow(run, schema)


TEXT, WORDS = pa.string(), pa.list_(pa.string())


def single_names(df: DataFrame, column: str, grammar: Grammar = ARTISTS) -> DataFrame:
    """(value, name): distinct values that name one artist in plain characters; name is the value without quotes and separators."""
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").rlike(r"[\p{L}\p{N}]")).distinct()
    cleaned = clean_text(values, "value", ["value"]).where(F.col("clean") == F.col("value")).select("value")
    packed = may_hold_several(F.col("value"), grammar) | F.col("value").contains('"')
    values = materialise(cleaned.withColumn("packed", packed))
    one = split_values(values.where("packed").select("value", F.col("value").alias("field_")), "value", {"field_": grammar}, single_only=True)
    return values.where("not packed").select("value", F.col("value").alias("name")).unionByName(one.select(F.col("id").alias("value"), F.col("value").alias("name")))


def readings(names: DataFrame) -> DataFrame:
    """(key, node, typed, dotted, beside) of (value, key, name): what each key is read as.

    Several nodes where a pet form has several full names, and one more, `typed`, for the pet form itself, so that a slip in it is found.
    """
    read = _map(names.select("key", "name"), "key string, words array<string>, dotted array<string>", [TEXT, WORDS, WORDS], lambda key, name: [(key, *words_of(name))])
    best = read.where(F.size("words") > 0).groupBy("key").agg(F.max(F.struct(F.size("words").alias("n"), "words", "dotted")).alias("w")).select("key", "w.words", "w.dotted")


    def each(key: str, words: list[str], dotted: list[str]) -> list[tuple]:
        nodes, typed = nodes_of(words), " ".join(sorted(words))
        return [(key, n, False, dotted, beside(n)) for n in nodes] + ([] if typed in nodes else [(key, typed, True, [], [])])

    return _map(best, "key string, node string, typed boolean, dotted array<string>, beside array<string>", [TEXT, TEXT, pa.bool_(), WORDS, WORDS], each)


@arrow_udf(StructType([StructField("cost", DoubleType()), StructField("x", StringType()), StructField("y", StringType())]))
def aligned(a: pa.Array, b: pa.Array, dotted: pa.Array) -> pa.Array:
    """The cost of the assignment of two nodes' words, and the two words of its dearest pair."""
    out = []
    for x, y, short in zip(a.to_pylist(), b.to_pylist(), dotted.to_pylist()):
        pairs = assignment(x.split(" "), y.split(" "), short or ())
        _, one, two = max(pairs, default=(0.0, "", ""))
        out.append({"cost": sum(c for c, _, _ in pairs), "x": one, "y": two})
    return pa.array(out, pa.struct([("cost", pa.float64()), ("x", TEXT), ("y", TEXT)]))


def slip_links(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose best assignment has one slip, unless the table knows both words as words of their own."""
    index = _map(nodes.select("node"), "sig long, node string", [pa.int64(), TEXT], lambda node: [(s, node) for s in slip_signatures(node)])
    met = index.hint(MERGE).join(index.withColumnRenamed("node", "node2"), "sig").where("node < node2").select("node", "node2").distinct()
    pairs = met.withColumn("m", aligned("node", "node2", F.array().cast("array<string>"))).where("m.cost = 1").select("node", "node2", "m.x", "m.y")
    stands = nodes.select(F.explode(F.array_distinct(F.split("node", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for side in "xy":
        pairs = pairs.hint(MERGE).join(stands.select(F.col("word").alias(side), F.col("n").alias(f"n{side}")), side)
    low, high, short = F.least("nx", "ny"), F.greatest("nx", "ny"), F.least(F.length("x"), F.length("y")) < SHORT
    own = (low >= F.when(short, 2).otherwise(OWN_NAMES)) & (low >= OWN_SHARE * high)
    pairs = materialise(pairs.where(~own).select("node", "node2", "nx", "ny", short.alias("short")))
    return pairs.where("not short").select(F.col("node").alias("a"), F.col("node2").alias("b")).unionByName(_chosen(pairs.where("short")))


def _chosen(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (node, node2, nx, ny) with a short word: the rarer goes with the one near it that stands in most names, if that is one only; equals only with each other."""
    ends = pairs.select("node", F.col("ny").alias("n"), F.col("node2").alias("near")).unionByName(pairs.select(F.col("node2").alias("node"), F.col("nx").alias("n"), F.col("node").alias("near"))).repartition("node")
    top = ends.groupBy("node", "n").agg(F.count("*").alias("many"), F.min("near").alias("goes")).groupBy("node").agg(F.max(F.struct("n", "many", "goes")).alias("top"))
    goes = top.where("top.many = 1").select("node", F.col("top.goes").alias("goes"))
    met = pairs.hint(MERGE).join(goes, "node", "left").hint(MERGE).join(goes.select(F.col("node").alias("node2"), F.col("goes").alias("goes2")), "node2", "left")
    there, back = F.coalesce(F.col("goes") == F.col("node2"), F.lit(False)), F.coalesce(F.col("goes2") == F.col("node"), F.lit(False))
    return met.where(F.when(F.col("nx") < F.col("ny"), there).when(F.col("nx") > F.col("ny"), back).otherwise(there & back)).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def short_forms(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(node, comp): the component meant by names with initials or abbreviations, where all names that fit them are of one.

    nodes: (node, dotted); of: (node, comp) of all nodes.
    """
    rows = materialise(_map(nodes, "node string, dotted array<string>, asks boolean, sig long", [TEXT, WORDS, pa.bool_(), pa.int64()], lambda node, dotted: [(node, dotted, asks, s) for asks, some in [letter_signatures(node, dotted)] for s in some]))
    asks = rows.where("asks").select("sig", "node", "dotted")
    answers = rows.where("not asks").select("sig", F.col("node").alias("full")).hint(MERGE).join(asks.select("sig").distinct(), "sig", "left_semi")
    fits = asks.hint(MERGE).join(answers, "sig").withColumn("m", aligned("node", "full", "dotted"))
    fits = fits.where((F.col("m.cost") < 9) & (F.col("m.cost") <= 0.5 * F.size(F.filter(F.split("node", " "), lambda w: (F.length(w) == 1) | F.array_contains("dotted", w)))))
    return fits.hint(MERGE).join(of.withColumnRenamed("node", "full"), "full").groupBy("node").agg(F.min("comp").alias("comp"), F.max("comp").alias("last")).where("comp = last").select("node", "comp")


def variants(df: DataFrame, column: str, grammar: Grammar = ARTISTS) -> DataFrame:
    """(value, key, entity): the values that stand for an artist who occurs under two or more keys.

    Values are left out that are null, blank or without letters and digits, that name several artists, or
    that hold unusual characters. Values that differ in layout only have one key. Repeated rows count once.
    Two keys share an entity if a chain of confirmed links joins them: words in another order, a pet or
    unaccented form, another form of the kind of act, 'The' before it, a slip in one word, a middle initial
    more, an initial or a dotted abbreviation that fits one entity only. A slip links unless both words are
    words of their own: found in OWN_NAMES names or more, the rarer in OWN_SHARE of the commoner's; in words of
    fewer than SHORT letters two names are enough, and one with several equally likely neighbours links to
    none. Other numbers, kinds and given names do not link. Names of any number of words are treated alike.
    An empty table gives an empty table; texts are read whole; columns that are not named are not read.
    """
    names = materialise(single_names(df, column, grammar).withColumn("key", letters_and_digits(F.col("name"))))
    read = materialise(readings(names))
    nodes = materialise(read.groupBy("node").agg(F.max("dotted").alias("dotted"), F.max("beside").alias("beside"), F.min("typed").alias("typed")))
    asked = nodes.where(F.size("beside") > 0).select("node", F.explode("beside").alias("full"))
    held = asked.hint(MERGE).join(nodes.select(F.col("node").alias("full")), "full")
    middle = F.size(F.split("node", " ")) > F.size(F.split("full", " "))
    # a middle initial only where no other one stands beside the same name
    single = held.where(middle).groupBy("full").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    links = slip_links(nodes).unionByName(held.where(~middle).select(F.col("node").alias("a"), F.col("full").alias("b"))).unionByName(single.select(F.col("node").alias("a"), F.col("full").alias("b")))
    of = components(links)
    of = materialise(nodes.select("node").hint(MERGE).join(of, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
    meant = short_forms(nodes.where("not typed").select("node", "dotted"), of).select("node", F.col("comp").alias("meant"))
    entity = of.hint(MERGE).join(meant, "node", "left").select("node", F.coalesce("meant", "comp").alias("entity"))
    member = materialise(read.select("key", "node").hint(MERGE).join(entity, "node").select("key", "entity").distinct())
    several = member.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    return names.hint(MERGE).join(member.hint(MERGE).join(several, "entity"), "key").select("value", "key", "entity")


def pairs(found: DataFrame) -> DataFrame:
    """(value_a, value_b), value_a < value_b: every two values of one entity with different keys, each pair once.

    The join runs on (entity, cell, cell) with at most CELL values a side in a cell, so no task meets a whole large entity.
    """
    found = materialise(found.select("value", "key", "entity").distinct())
    sizes = found.groupBy("entity").agg(F.count("*").alias("n"))
    cells = found.hint(MERGE).join(sizes, "entity").withColumn("cells", F.ceil(F.col("n") / CELL)).withColumn("cell", F.pmod(F.xxhash64("value"), "cells"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    left = cells.select("entity", F.col("value").alias("value_a"), F.col("key").alias("key_a"), F.col("cell").alias("row"), every.alias("column"))
    right = cells.select("entity", F.col("value").alias("value_b"), F.col("key").alias("key_b"), every.alias("row"), F.col("cell").alias("column"))
    return left.hint(MERGE).join(right, ["entity", "row", "column"]).where("value_a < value_b and key_a <> key_b").select("value_a", "value_b").distinct()
