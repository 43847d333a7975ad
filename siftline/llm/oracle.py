"""SQL equivalents of the text queries, where SQL can say the result on whole tables.

They share no text with the operators: the look of a text is told here letter by letter, from a table of code points.
"""

#: Code points, in hexadecimal, of what prints nothing and of blanks.
_NOTHING = "00AD 034F 061C 115F 1160 17B4 17B5 180B 180C 180D 180E 200B 200C 200D 200E 200F 202A 202B 202C 202D 202E 2060 2061 2062 2063 2064 2065 2066 2067 2068 2069 206A 206B 206C 206D 206E 206F FEFF"
_BLANK = "0009 00A0 1680 2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200A 202F 205F 3000"
#: Letters that look like the Latin letter before them.
_SAME = """A 0410 0391|B 0412 0392|C 0421|E 0415 0395|G 050C|H 041D 0397|I 0406 0399|J 0408|K 041A 039A|M 041C 039C|N 039D|O 041E 039F 0555|P 0420 03A1|Q 051A|S 0405 054F|T 0422 03A4|U 054D|W 051C|X 0425 03A7|Y 0423 04AE 03A5|Z 0396
|L 053C|a 0430 03B1 0251|c 0441 03F2|d 0501|e 0435|g 0581 0261|h 04BB 0570|i 0456|j 0458 03F3|l 04CF|n 0578|o 043E 03BF 0585|p 0440 03C1|q 051B|s 0455|u 057D|v 03BD|w 051D|x 0445|y 0443|ë 0451|Ë 0401|ï 0457|Ï 0407|- 2010 2011 FE63|/ 2044 2215|’ 02BC
|fi FB01|fl FB02|ff FB00|ffi FB03|ffl FB04|st FB05 FB06"""


def _letters() -> str:
    rows = [f"(chr({int(code, 16)}), '{to}')" for codes, to in ((_NOTHING, ""), (_BLANK, " ")) for code in codes.split()]
    for entry in _SAME.replace("\n", "").split("|"):
        to, *codes = entry.split()
        rows += [f"(chr({int(code, 16)}), '{to}')" for code in codes]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(c, r) UNION ALL SELECT chr(x::INT), chr((x - 65248)::INT) FROM range(65281, 65375) t(x) WHERE x <> 65293 UNION ALL SELECT chr(65293), '-' UNION ALL SELECT chr(x::INT), '' FROM range(65024, 65040) t(x)"


#: A wide letter of another alphabet's look folds too, so letters are looked up twice.
_LOOK = f"""
letters AS ({_letters()}),
texts AS (SELECT DISTINCT text FROM text_blocks WHERE text IS NOT NULL AND text <> ''),
apart AS (SELECT text, unnest(string_split(text, '')) AS c, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM texts),
folded AS (SELECT a.text, string_agg(coalesce(l.r, a.c), '' ORDER BY a.i) AS t FROM apart a LEFT JOIN letters l ON l.c = a.c GROUP BY a.text),
spaced AS (SELECT text, regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' +', ' ', 'g'), ' ?' || chr(10) || ' ?', chr(10), 'g') AS t FROM folded),
look AS (SELECT text, nfc_normalize(trim(t, ' ' || chr(10))) AS look FROM spaced),
seen AS (SELECT DISTINCT b.block_id AS id, b.text, k.look FROM text_blocks b JOIN look k ON k.text = b.text)"""

ORACLE: dict[str, str] = {
    "p2_found": f"""WITH {_LOOK}
        SELECT DISTINCT a.id AS block_id_a, b.id AS block_id_b FROM seen a JOIN seen b ON a.look = b.look AND a.id < b.id AND a.text <> b.text""",
    "p2_classes": f"""WITH {_LOOK},
        own AS (SELECT s.*, count(*) OVER (PARTITION BY look, text) AS same, count(*) OVER (PARTITION BY look) AS n FROM seen s)
        SELECT min(id) AS class_id, count(DISTINCT text) AS variants, count(*) AS rows, CAST(sum(n - same) AS BIGINT) AS links FROM own GROUP BY look HAVING count(DISTINCT text) > 1""",
    "p4_found": """
        SELECT DISTINCT b.block_id FROM text_blocks b LEFT JOIN chunk_limits l ON l.source_type = b.source_type
        WHERE length(b.text) > coalesce(l.max_chars, (SELECT max_chars FROM chunk_limits WHERE source_type = '*'))""",
}
