"""Problem 2: one consistent form for texts that look the same.

DuckDB runs inside the Arrow partitions. Its SQL drops invisible characters, maps full-width, half-width, mathematical,
ligature and other compatibility forms (a table made from the character database; raised, lowered and circled characters
look different and stay), makes every blank a plain one, composes accents (nfc_normalize) and gives two forms: ``clean_text``, readable, in
which a look-alike letter becomes the letter of the alphabet that its word is otherwise written in; and ``look_key``,
a hash of the text with every look-alike folded to one letter, equal exactly for texts that look the same. Case,
accents, digits and word order stay.

Null text gives null in both; empty text gives an empty clean_text and the key of the empty text. Extra columns pass
through; a column named clean_text or look_key is replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.session import checkpoint

#: Characters that print nothing: soft hyphen, zero-width characters, direction marks, variation selectors, byte order mark.
INVISIBLE = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
#: Blanks of another width.
BLANKS = "".join(map(chr, [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
#: Kinds of compatibility forms that look like what they stand for.
LIKE = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Marks that look like another one: hyphens, slashes, an apostrophe.
MARKS, MARKS_PLAIN = "\u2010\u2011\ufe63\uff0d\u2044\u2215\u02bc", "----//\u2019"


def compatible() -> dict[str, str]:
    """Every character with a compatibility form that looks like it, and that form; blanks and accents standing alone are left out."""
    out = {}
    for code in range(0xA1, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if kind in LIKE and unicodedata.category(c) != "Zs":
            form = unicodedata.normalize("NFKC", c)
            if form != c and not form.startswith(" ") and c not in MARKS + "№":
                out[c] = form
    return out


COMPATIBLE = compatible()
#: Forms that many texts have, wide letters and such marks, are translated; the others are looked up in the few texts that have any.
ONE = {a: b for a, b in COMPATIBLE.items() if len(b) == 1 and "\uff01" <= a <= "\uff5e"} | dict(zip(MARKS, MARKS_PLAIN, strict=True))
RARE = {a: b for a, b in COMPATIBLE.items() if a not in ONE}
#: Latin letters with marks that stand for themselves.
LATIN = {chr(k): "" for k in range(0xC0, 0x250) if chr(k) not in COMPATIBLE}
#: Letters of two alphabets with one look, letter by letter; with Greek also Armenian ones and variants of Latin ones.
CYRILLIC, LATIN_C = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХІЈЅУԌԚԜҮ", "aeopcyxijshdqwlABEKMHOPCTXIJSYGQWY"
GREEK, LATIN_G = "οανρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳօոսհցՏԼՕՍɑɡ", "oavpABEZHIKMNOPTYXcjonuhgSLOUag"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters: dict[str, str]) -> str:
    """A regular expression for one of the characters."""
    codes, runs = sorted(map(ord, characters)), []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def _plain_sql(column: str) -> str:
    """SQL for a text without invisible, full-width or ligature characters and with plain blanks."""
    # A mark that a look-alike letter carries is composed on the folded letter later, hence two normalisations.
    sql = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    forms = f"MAP([{', '.join(map(_quote, RARE))}], [{', '.join(map(_quote, RARE.values()))}])"
    sql = f"CASE WHEN regexp_matches({column}, '{_class(RARE)}') THEN array_to_string(list_transform(regexp_extract_all({sql}, '{_class(RARE)}|{_class(RARE).replace('[', '[^', 1)}+'), lambda c: CASE WHEN length(c) = 1 THEN coalesce({forms}[c], c) ELSE c END), '') ELSE {sql} END"
    sql = f"translate({sql}, {_quote(''.join(ONE) + BLANKS)}, {_quote(''.join(ONE.values()) + ' ' * len(BLANKS))})"
    sql = f"regexp_replace(regexp_replace({sql}, ' +', ' ', 'g'), ' ?(\\r\\n|\\r|\\n) ?', '\\n', 'g')"
    return f"nfc_normalize(trim({sql}, ' \\n'))".replace("'\\n'", "chr(10)").replace("' \\n'", "' ' || chr(10)")


#: Runs of plain characters need none of the above; the pattern finds texts that do.
PLAIN_SQL = f"""CASE WHEN regexp_matches(text, '[^\\x{{20}}-\\x{{7E}}\\nЀ-ӿ«»№—–©{_class(LATIN)[1:-1]}]|[  ][ \\n]|\\n |^[ \\n]|[ \\n]$|\\x{{00A0}}|\\x{{00AD}}')
 THEN {_plain_sql("text")} ELSE text END"""
#: Composed letters whose base is a look-alike fold with it: й stays Cyrillic, but ё and ï, ё and ë look the same.
COMPOSED, COMPOSED_L = "ёЁїЇ", "ëËïÏ"
_FOLDED = f"translate(plain, {_quote(CYRILLIC + GREEK + COMPOSED)}, {_quote(LATIN_C + LATIN_G + COMPOSED_L)})"
KEY_SQL = f"md5(CASE WHEN regexp_matches(plain, '[\\x{{0300}}-\\x{{036F}}]') THEN nfc_normalize({_FOLDED}) ELSE {_FOLDED} END)"
_C, _L = "[Ѐ-ӿ]", "[A-Za-zÀ-ɏ]"
#: Characters that only one alphabet has; a word with such a Cyrillic letter is Cyrillic.
ONLY_C, ONLY_L = "[бвгджзийклмнптфцчшщъыьэюяєґБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЄҐ]", "[bdfghjklmnqrstuvwzDFGJLNQRSUVWZÀ-ɏ]"
CLEAN_SQL = f"""CASE WHEN NOT regexp_matches(plain, '{_C}{_L}|{_L}{_C}|[Ͱ-Ͽ]') THEN plain ELSE
 array_to_string(list_transform(regexp_extract_all(plain, '[\\pL\\pM]+|[^\\pL\\pM]+'), lambda w:
  CASE WHEN regexp_matches(w, '{ONLY_C}') THEN translate(w, {_quote(LATIN_C + "οαΟΑΒΕΗΚΜΡΤΧ")}, {_quote(CYRILLIC + "оаОАВЕНКМРТХ")})
       WHEN regexp_matches(w, '{ONLY_L}') THEN translate(w, {_quote(CYRILLIC + GREEK)}, {_quote(LATIN_C + LATIN_G)})
       WHEN regexp_matches(plain, '{ONLY_C}') THEN translate(w, {_quote(LATIN_C + "οαΟΑΒΕΗΚΜΡΤΧ")}, {_quote(CYRILLIC + "оаОАВЕНКМРТХ")})
       ELSE translate(w, {_quote(CYRILLIC + GREEK)}, {_quote(LATIN_C + LATIN_G)}) END), '') END"""
SQL = f"SELECT row_at, {CLEAN_SQL} AS clean_text, {KEY_SQL} AS look_key FROM (SELECT *, {PLAIN_SQL} AS plain FROM batch)"
KEY_ONLY_SQL = f"SELECT id, text_key, {KEY_SQL} AS look_key FROM (SELECT id, md5(text) AS text_key, {PLAIN_SQL} AS plain FROM batch)"


def _duck(sql: str):  # noqa: ANN202
    """A partition function that runs ``sql`` on each Arrow batch, known to it as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        con.execute("SET TimeZone = 'UTC'")
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("batch")

    return run


def normalise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with clean_text and look_key (see the module)."""
    rest = [c for c in df.columns if c not in ("clean_text", "look_key")]
    boxed = df.select(F.struct(*rest).alias("kept"), F.col(text_col).alias("text"))
    # The other columns travel as one row number and join in the batch only through Arrow, never by name.
    schema = T.StructType([T.StructField("kept", boxed.schema["kept"].dataType), T.StructField("clean_text", T.StringType()), T.StructField("look_key", T.StringType())])
    return boxed.mapInArrow(_around(SQL), schema).select("kept.*", "clean_text", "look_key")


def _around(sql: str):  # noqa: ANN202
    """Like _duck, with the column ``kept`` set aside, as not every type of it need be known to DuckDB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            table = pa.table({"row_at": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column(1)})
            con.register("batch", table)
            made = con.sql(f"SELECT row_at, clean_text, look_key FROM ({sql}) ORDER BY row_at").to_arrow_table().combine_chunks()
            con.unregister("batch")
            if made.num_rows:
                columns = [made.column(c).combine_chunks() for c in ("clean_text", "look_key")]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["kept", "clean_text", "look_key"])

    return run


def look_keys(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, text_key, look_key of every row with text: hashes of the text as it is, and as it looks."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    return texts.mapInArrow(_duck(KEY_ONLY_SQL), "id bigint, text_key string, look_key string")


def same_look_pairs(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(a, b), a < b: rows that look the same but differ in characters. Repeated rows count once; null and empty never.

    Only hashes are shuffled. Classes with one text are dropped by an aggregate before anything is paired; the texts of a
    class are paired first and then their rows, so copies of one text never meet one another.
    """
    keys = checkpoint(look_keys(df, id_col, text_col).distinct())  # hashes, read several times
    variants = keys.select("look_key", "text_key").distinct()
    mixed = variants.groupBy("look_key").agg(F.count("*").alias("n")).where("n > 1").select("look_key")
    kept = variants.join(mixed, "look_key", "left_semi")
    one, two = kept.withColumnRenamed("text_key", "one"), kept.withColumnRenamed("text_key", "two")
    pairs = one.join(two, "look_key").where("one < two")  # texts of one look, not the rows that hold them
    left = pairs.join(keys.select("look_key", F.col("text_key").alias("one"), F.col("id").alias("x")), ["look_key", "one"])
    both = left.join(keys.select("look_key", F.col("text_key").alias("two"), F.col("id").alias("y")), ["look_key", "two"])
    return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def look_classes(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, look_key, variants, links) of the rows that look like a row of another text: their class, its texts, and how many rows differ in characters. Null and empty texts have no class."""
    keys = checkpoint(look_keys(df, id_col, text_col).distinct())
    sizes = keys.groupBy("look_key", "text_key").agg(F.count("*").alias("own"))
    classes = sizes.groupBy("look_key").agg(F.count("*").alias("variants"), F.sum("own").alias("rows")).where("variants > 1")
    linked = sizes.join(classes, "look_key").select("look_key", "text_key", "variants", (F.col("rows") - F.col("own")).alias("links"))
    return keys.join(linked, ["look_key", "text_key"]).select("id", "look_key", "variants", "links")
