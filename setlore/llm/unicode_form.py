"""One consistent form for text that looks the same but holds different characters.

The work is done by DuckDB inside Arrow partitions: each batch is handed to an in-process
DuckDB as an Arrow table, and one SQL statement removes what cannot be seen, maps
compatibility forms, composes accents (nfc_normalize) and replaces look-alike letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, each above its Latin twin.
CYRILLIC = "аеорсхуіѕјһԁԛԝӏАВЕКМНОРСТХУЅІЈҮԚԜ"
CYRILLIC_AS = "aeopcxyisjhdqwlABEKMHOPCTXYSIJYQW"
GREEK = "οναιρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
GREEK_AS = "ovaipucjABEZHIKMNOPTYXC"
ARMENIAN = "ոսօհզցյԼՍՕ"
ARMENIAN_AS = "nuohqgjLUO"
COPTIC = "ⲞⲟⲢⲣⲤⲥⲀⲂⲈⲎⲒⲔⲘⲚⲦⲨⲬⲌ"
COPTIC_AS = "OoPpCcABEHIKMNTYXZ"
CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ"
CHEROKEE_AS = "DRTiyAJEWMHYGhZbRWSVSLCPKdB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
# Letters of the Latin script that only phonetic writing uses and that look like plain ones.
PHONETIC = "ɑɡ"
PHONETIC_AS = "ag"
OTHER_SCRIPTS = ("Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu", "Coptic")
# Invisible characters beyond Unicode's format and control classes.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u2800\u3164\uffa0"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def looks_the_same(code: int) -> str | None:
    """The plain form of a compatibility character that looks like it, else null.

    By the tags of the Unicode database: full-width, half-width and font variants of anything, and letters
    and letter-like numbers that are written as several (ligatures, digraphs, Roman numerals). Raised,
    lowered, circled and squared forms, fractions and dots look different and stay.
    """
    c = chr(code)
    tag, _, rest = unicodedata.decomposition(c).partition("> ")
    plain = unicodedata.normalize("NFKC", c)
    if not rest or plain == c or c in INVISIBLE:
        return None
    if tag in ("<wide", "<narrow", "<font"):
        return plain
    return plain if tag == "<compat" and (unicodedata.category(c) == "Nl" or (unicodedata.category(c) in ("Lu", "Ll", "Lt") and len(plain) > 1)) else None


@lru_cache(maxsize=1)
def compatibility_forms() -> tuple[str, str, list[tuple[str, str]]]:
    """(characters, their single replacements, [(character, longer replacement)]), by the rule of looks_the_same()."""
    found = [(chr(code), plain) for code in range(0xA0, 0x20000) if (plain := looks_the_same(code))]
    single = [(c, p) for c, p in found if len(p) == 1] + list(zip(PHONETIC, PHONETIC_AS))
    return "".join(c for c, _ in single), "".join(p for _, p in single), [(c, p) for c, p in found if len(p) > 1]


def clean_sql(column: str = "value", table: str = "batch") -> str:
    """The statement that adds the consistent form of a text column as `clean`."""
    single, to, longer = compatibility_forms()
    look, latin = CYRILLIC + GREEK + ARMENIAN + COPTIC + CHEROKEE + LISU, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + COPTIC_AS + CHEROKEE_AS + LISU_AS
    classes = "".join(f"\\p{{{s}}}" for s in OTHER_SCRIPTS)
    visible = f"regexp_replace({column}, '[\\p{{Cf}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}{INVISIBLE}]', '', 'g')"
    blanks = f"regexp_replace(regexp_replace({visible}, '\\p{{Zs}}', ' ', 'g'), '[\\p{{Zl}}\\p{{Zp}}]', chr(10), 'g')"
    plain = f"CASE WHEN regexp_matches(shown, '[{single}]') THEN translate(shown, {_quote(single)}, {_quote(to)}) ELSE shown END"  # translate() builds its table for each value
    any_longer = "[" + "".join(c for c, _ in longer) + "]"
    chain = "seen"
    for c, text in longer:
        chain = f"replace({chain}, {_quote(c)}, {_quote(text)})"
    scripts = " + ".join(f"regexp_matches(w, '\\p{{{s}}}')::INT" for s in (*OTHER_SCRIPTS,))
    back_cyrillic = f"translate(w, {_quote(CYRILLIC_AS)}, {_quote(CYRILLIC)})"
    back_greek = f"translate(w, {_quote(GREEK_AS)}, {_quote(GREEK)})"
    word = f"""CASE
        WHEN NOT regexp_matches(w, '[{classes}]') THEN w
        WHEN length(regexp_replace(w, '[{look}]|[^{classes}]', '', 'g')) = 0 THEN
            CASE WHEN regexp_matches(w, '\\p{{Latin}}[\\p{{L}}\\p{{M}}]*[{classes}]|[{classes}][\\p{{L}}\\p{{M}}]*\\p{{Latin}}') OR {scripts} > 1 OR latin_only
                 THEN translate(w, {_quote(look)}, {_quote(latin)}) ELSE w END
        WHEN regexp_matches(w, '\\p{{Latin}}[\\p{{L}}\\p{{M}}]*[{classes}]|[{classes}][\\p{{L}}\\p{{M}}]*\\p{{Latin}}') THEN
            CASE WHEN regexp_matches(w, '\\p{{Greek}}') AND NOT regexp_matches(w, '\\p{{Cyrillic}}') THEN {back_greek} ELSE {back_cyrillic} END
        ELSE w END"""
    return f"""
        WITH s AS (SELECT *, {blanks} AS shown FROM {table}),
        a AS (SELECT * EXCLUDE (shown), {plain} AS seen FROM s),
        b AS (SELECT * EXCLUDE (seen), nfc_normalize(CASE WHEN regexp_matches(seen, '{any_longer}') THEN {chain} ELSE seen END) AS form FROM a),
        c AS (SELECT *, regexp_matches(form, '\\p{{Latin}}') AND length(regexp_replace(form, '[{look}]|[^{classes}]', '', 'g')) = 0 AS latin_only FROM b)
        SELECT * EXCLUDE (form, latin_only),
            CASE WHEN regexp_matches(form, '[{classes}]')
                 THEN array_to_string(list_transform(string_split(form, ' '), lambda w: {word}), ' ')
                 ELSE form END AS clean
        FROM c"""


def clean_text(df: DataFrame, id_col: str, fields: list[str], changed_only: bool = False) -> DataFrame:
    """One row a value: id, field, value, clean. `clean` differs from `value` exactly where unusual characters stand.

    Unusual are format, control and other invisible characters, blanks but the plain one, compatibility
    forms that look like plain ones (full-width, half-width, font variants, ligatures, digraphs, Roman
    numerals), phonetic twins of plain letters, accents apart from their letters, and letters of Cyrillic,
    Greek, Armenian, Coptic, Cherokee or Lisu inside a word of look-alikes. A word of look-alikes alone is
    turned to Latin where the rest of the value is Latin; words of another script with a letter of their
    own stay. Composed accents, the dotless i, typographic quotes, dashes and signs, raised, lowered, circled
    and squared forms, plain blanks, tabs and line ends are ordinary and stay.

    Null values give no row; empty ones come out unchanged. Repeated rows stay. Texts are read whole,
    whatever their length. Columns of df that are not named are not read, so their names cannot clash.
    An empty table gives an empty table. No shuffle.
    """
    stacked = df.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f"),
    ).select("id", "f.field", "f.value").where("value is not null")
    odd = F.col("value").rlike(r"[^\t\n\r -~]")  # plain ASCII without control characters cannot change: it stays in the JVM
    sql = f"SELECT * FROM ({clean_sql()}) WHERE clean <> value" if changed_only else clean_sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for one in batches:
                if one.num_rows:
                    con.register("batch", pa.Table.from_batches([one]))
                    out = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    yield from out.select(["id", "field", "value", "clean"]).cast(SCHEMA).to_batches()
        finally:
            con.close()

    cleaned = stacked.where(odd).mapInArrow(run, "id string, field string, value string, clean string")
    return cleaned if changed_only else cleaned.unionByName(stacked.where(~odd).withColumn("clean", F.col("value")))


SCHEMA = pa.schema([(c, pa.string()) for c in ("id", "field", "value", "clean")])
