"""Sources: a folder of mixed files as an inventory, and extractors that turn files into text blocks.

Folders are listed in tasks, level by level; the driver holds neither paths nor contents. Tasks read the head of each file
for its format, and the whole of those that a plan needs, by path, so contents are never joined or shuffled. A folder is
one that all executors see, or an address that Arrow can open. A file that cannot be read gives one empty block with a
warning, and never ends the job. Engines that are not installed (PDF) give such blocks too.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import os
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.formats import IGNORED
from siftline.operators.rows import ADDRESS, CONTACT, IDENTIFIER, PERSON, PHYSICAL
from siftline.session import checkpoint
from siftline.settings import setting
from siftline.sources import recognition

#: Text, place and warnings; blocks of tables have hints with their lines, and mentions of physical persons, too.
DELIMITERS = ",;\t|"
#: Lines from which a table is told, the share of them with one number of columns, and heads of files that a task holds at once.
TABLE_LINES, LEAST_STABLE, HELD_HEADS = 25, 0.8, 64
Block = tuple[str, str | None, list[str]] | tuple[str, str | None, list[str], dict[str, int], int]
BLOCK_DDL = "file_path string, source_type string, block_index int, extraction_method string, text string, page_or_sheet string, warnings array<string>, table_semantic_hints map<string,int>, physical_person_mentions int"
BLOCK_ARROW = pa.schema([("file_path", pa.string()), ("source_type", pa.string()), ("block_index", pa.int32()), ("extraction_method", pa.string()), ("text", pa.string()), ("page_or_sheet", pa.string()), ("warnings", pa.list_(pa.string())), ("table_semantic_hints", pa.map_(pa.string(), pa.int32())), ("physical_person_mentions", pa.int32())])


def opened(path: str):  # noqa: ANN201
    """(file system, path in it) of a local path or an address."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _entries(folders: Iterable[str]) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether a folder) of what is in the folders; links to folders and folders that cannot be read are passed over."""
    for folder in folders:
        try:
            system, at = opened(folder)
            found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        except OSError:
            continue
        scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
        for e in found:
            if e.type == fs.FileType.Directory:
                if scheme or not os.path.islink(e.path):
                    yield scheme + e.path, 0, True
            elif e.type == fs.FileType.File:
                yield scheme + e.path, e.size, False


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, name, decoded_name and size_bytes of the regular files below ``root``; system files are left out."""
    schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("folder", pa.bool_())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = _entries(batch.column(0).to_pylist())
            while rows := list(itertools.islice(entries, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    found: DataFrame | None = None
    while True:  # a small job a level of folders; each level's folders are spread over the tasks
        inside = checkpoint(level.mapInArrow(listed, "path string, size_bytes bigint, folder boolean"))
        files = inside.where("not folder").select("path", "size_bytes")
        found = files if found is None else found.unionByName(files)
        level = inside.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
        if level.isEmpty():
            break
    named = found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "size_bytes").where(~F.col("name").isin(*IGNORED))
    # A plus in a name is a plus: it is kept from being taken for a blank.
    return named.withColumn("decoded_name", F.coalesce(F.try_url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))), "name"))


def read_bytes(path: str, most: int | None = None) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as file:
        return file.read(most) if most else file.read()


#: What the first lines of a text show of a table: delimiter, rows looked at, columns.
TABLE_FIELDS = (("table_delimiter", T.StringType(), pa.string()), ("table_rows", T.IntegerType(), pa.int32()), ("table_columns", T.IntegerType(), pa.int32()))


def table_shape(head: bytes) -> tuple[str, int, int] | None:
    """(delimiter, rows, columns) of a text whose first lines have one number of columns, more than one, in four of five rows."""
    lines = [x for x in decode(head).splitlines()[:TABLE_LINES] if x.strip()]
    if len(lines) < 2:
        return None
    sample = "\n".join(lines)
    try:
        dialect = csv.Sniffer().sniff(sample, DELIMITERS)
        widths = Counter(len(row) for row in csv.reader(io.StringIO(sample), dialect) if row)
    except csv.Error:
        return None
    width, n = widths.most_common(1)[0] if widths else (0, 0)
    rows = sum(widths.values())
    return (dialect.delimiter, rows, width) if width > 1 and n >= LEAST_STABLE * rows else None


def heads(files: DataFrame, most: int) -> DataFrame:
    """``files`` (by path) with the first ``most`` bytes as ``content`` and what they show of a table; null where a file cannot be read."""
    own = [c for c in files.columns if c not in ("content", *(n for n, *_ in TABLE_FIELDS))]
    chosen = files.select(*own)
    schema = T.StructType([*chosen.schema.fields, T.StructField("content", T.BinaryType()), *(T.StructField(n, kind) for n, kind, _ in TABLE_FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, HELD_HEADS):
                part = batch.slice(k, HELD_HEADS)
                contents, shapes = [], []
                for path in part.column(own.index("path")).to_pylist():
                    try:
                        raw = read_bytes(path, most)
                    except OSError:
                        raw = None
                    contents.append(raw)
                    shapes.append((table_shape(raw) if raw and b"\0" not in raw else None) or (None, None, None))
                made = [pa.array(c, kind) for c, (*_, kind) in zip(zip(*shapes, strict=True), TABLE_FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary()), *made], names=[*own, "content", *(n for n, *_ in TABLE_FIELDS)])

    return chosen.mapInArrow(run, schema)


def decode(raw: bytes) -> str:
    """UTF-8 with or without its mark, else windows-1251, else UTF-8 with replacement characters."""
    for name in ("utf-8-sig", "cp1251"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def pack(lines: Iterable[str], most: int) -> Iterator[str]:
    """Lines in chunks of at most ``most`` characters; a longer line stays whole."""
    held: list[str] = []
    size = 0
    for line in lines:
        if held and size + len(line) + 1 > most:
            yield "\n".join(held)
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    if held:
        yield "\n".join(held)


def _text_blocks(text: str) -> Iterator[Block]:
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in text.replace("\u00a0", " ").splitlines()]
    chunks = list(pack([x for x in lines if x], setting("limits.block_chars")))
    if not chunks:
        yield "", None, ["no text"]
    for chunk in chunks:
        yield chunk, None, []


def _has_any(names: Iterable[str], words: list[str]) -> bool:
    return any(w in n for n in names for w in words)


def row_hints(names: list[str], cells: list[str], line: str) -> tuple[list[str], int]:
    """(hints of a table's line by its columns and values, mentions of physical persons)."""
    low = [n.casefold() for n in names]
    persons = sum(line.casefold().count(w) for w in PHYSICAL[:3])
    hints = [h for h, words in (("person_name_column", PERSON), ("address_column", ADDRESS), ("contact_column", CONTACT), ("identifier_column", IDENTIFIER), ("person_type_column", PHYSICAL)) if _has_any(low, words)]
    if persons:
        hints.append("physical_person_rows")
    if any(re.search(r"\d", c) and _has_any([n], IDENTIFIER + ADDRESS) for n, c in zip(low, cells, strict=False)):
        hints.append("sensitive_column_value")
    return hints, persons


def _row_blocks(rows: Iterable[list[str]], sheet: str | None = None, header: bool = True, columns: list[str] | None = None) -> Iterator[Block]:
    """Rows as ``name: value`` lines; a block holds so many lines, and its place is the range of its rows."""
    most, names, lines, begun, at = setting("limits.block_lines"), columns, [], 1, 0
    hints, persons = Counter(), 0
    for at, row in enumerate(rows, 1):
        cells = [c.strip() for c in row]
        if not any(cells):
            continue
        if header and names is None and sum(bool(c) for c in cells) > 1 and not any(re.search(r"\d", c) for c in cells):
            names = [c for c in cells if c]
        lines.append(" | ".join(f"{names[k]}: {c}" if names and (columns or at > 1) and k < len(names) else c for k, c in enumerate(cells) if c))
        found, more = row_hints(names or [], cells, lines[-1])
        hints.update(found)
        persons += more
        if len(lines) == most:
            yield "\n".join(lines), f"{sheet + ', ' if sheet else ''}rows {begun}-{at}", [], dict(hints), persons
            lines, begun, hints, persons = [], at + 1, Counter(), 0
    if lines:
        yield "\n".join(lines), f"{sheet + ', ' if sheet else ''}rows {begun}-{at}", [], dict(hints), persons


class _Visible(HTMLParser):
    HIDDEN, BREAKS = {"script", "style", "noscript"}, {"br", "p", "div", "tr", "li", "section", "article", "header", "footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.HIDDEN and self.depth > 0
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            self.parts += [data.strip(), " "]


def visible_text(markup: str) -> str:
    """The text that a browser would show, a line a block element."""
    parser = _Visible()
    parser.feed(markup)
    parser.close()
    return "".join(parser.parts)


def plain(raw: bytes, name: str) -> Iterator[Block]:
    return _text_blocks(decode(raw))


def html(raw: bytes, name: str) -> Iterator[Block]:
    return _text_blocks(visible_text(decode(raw)))


def delimited(raw: bytes, name: str) -> Iterator[Block]:
    text = decode(raw)
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:16_384], DELIMITERS)
    except csv.Error:
        dialect = csv.excel_tab if name.lower().endswith(".tsv") else csv.excel
    return _row_blocks(csv.reader(io.StringIO(text), dialect))


def _members(value: object, prefix: str = "") -> Iterator[list[str]]:
    """``path: scalar`` for every scalar of a parsed JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _members(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _members(v, f"{prefix}[{k}]")
    else:
        yield [f"{prefix}: {'' if value is None else value}"]


def json_text(raw: bytes, name: str) -> Iterator[Block]:
    text = decode(raw)
    most = setting("limits.json_bytes")  # null for files of any size
    if most and len(raw) > most:
        yield from ((chunk, None, ["large JSON read as text"]) for chunk in pack(text.splitlines(), setting("limits.block_chars")))
        return
    try:
        value = json.loads(text)
    except ValueError:
        yield from ((t, p, [*w, "invalid JSON read as text"]) for t, p, w in _text_blocks(text))
        return
    yield from _row_blocks(_members(value), header=False)


def parquet_rows(raw: bytes, name: str) -> Iterator[Block]:
    import pyarrow.parquet as pq

    file = pq.ParquetFile(io.BytesIO(raw))
    rows = ([str(v) for v in row] for batch in file.iter_batches(1000) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return _row_blocks(rows, columns=file.schema_arrow.names)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOCX_PART = re.compile(r"^word/(?:document|footnotes|endnotes|comments|header\d+|footer\d+)\.xml$")


def docx(raw: bytes, name: str) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        for part in sorted(n for n in box.namelist() if DOCX_PART.match(n)):
            lines = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in ElementTree.fromstring(box.read(part)).iter(f"{_W}p")]
            text = "\n".join(x.strip() for x in lines if x.strip())
            if text:
                yield text, part, []


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = re.compile(r"^ppt/slides/slide(\d+)\.xml$")


def pptx(raw: bytes, name: str) -> Iterator[Block]:
    """A block a slide: the paragraphs of its frames and tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        for number, part in sorted((int(m[1]), n) for n in box.namelist() if (m := SLIDE.match(n))):
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ElementTree.fromstring(box.read(part)).iter(f"{_A}p")]
            text = "\n".join(x for x in lines if x)
            if text:
                yield text, f"slide {number}", []


def xlsx(raw: bytes, name: str) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        names = box.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(box.read("xl/sharedStrings.xml")).iter(f"{_S}si")]

        def cell(c: ElementTree.Element) -> str:
            if c.get("t") == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{_S}t"))
            value = c.findtext(f"{_S}v") or ""
            return shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value

        for sheet in sorted(n for n in names if re.match(r"^xl/worksheets/[^/]+\.xml$", n)):
            rows = ([cell(c) for c in row.iter(f"{_S}c")] for row in ElementTree.fromstring(box.read(sheet)).iter(f"{_S}row"))
            yield from _row_blocks(rows, sheet.rpartition("/")[2])


def rtf(raw: bytes, name: str) -> Iterator[Block]:
    text = raw.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'[0-9a-fA-F]{2}", " ", text)
    text = re.sub(r"\\(?:par|line|tab)\b ?", "\n", text)
    return _text_blocks(re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]|\\\*", "", text))


#: Payloads inside binaries: signature, least offset and sizes.
PAYLOADS = {"tiff": (b"II*\x00", b"MM\x00*"), "jpeg": (b"\xff\xd8\xff",), "png": (b"\x89PNG\r\n\x1a\n",), "pdf": (b"%PDF-",), "zip": (b"PK\x03\x04",)}


def payloads(raw: bytes, name: str) -> Iterator[Block]:
    """One block for each kind of document or picture found inside a binary, in order of place."""
    least, most = setting("limits.payload_least"), setting("limits.payload_most")  # most: null for payloads of any size
    found, outside = [], []
    for kind, signatures in PAYLOADS.items():
        places = sorted(at for s in signatures for at in (m.start() for m in re.finditer(re.escape(s), raw)) if at >= 4096)
        inside = [at for at in places if len(raw) - at >= least and (not most or len(raw) - at <= most)]
        if inside:
            found.append((inside[0], kind))
        elif places:
            outside.append(kind)
    for at, kind in sorted(found):
        yield "", f"offset {at}", [f"embedded {kind}"]
    if outside:
        yield "", None, [f"{kind} outside the size limits" for kind in outside]
    elif not found:
        yield "", None, ["no payload"]


def pdf(raw: bytes, name: str) -> Iterator[Block]:
    try:
        import fitz
    except ImportError:
        yield "", None, ["no PDF engine installed"]
        return
    with fitz.open(stream=raw, filetype="pdf") as file:
        for k, page in enumerate(file):
            text = page.get_text()
            yield text, str(k + 1), [] if text.strip() else ["empty page"]


EXTRACTORS: dict[str, tuple[str, Callable[[bytes, str], Iterator[Block]]]] = {
    "plain_text_extractor": ("file", plain), "html_text_extractor": ("html", html), "csv_extractor": ("table", delimited), "json_extractor": ("json", json_text), "parquet_extractor": ("table", parquet_rows),
    "spreadsheet_extractor": ("workbook", xlsx), "docx_text_extractor": ("document", docx), "rtf_text_extractor": ("document", rtf), "presentation_text_extractor": ("pages", pptx), "pdf_text_extractor": ("pages", pdf), "binary_payload_extractor": ("file", payloads),
}


#: Blocks that are held before they are handed on: a file may unpack to much more than its size.
HELD_BLOCKS = 64


def _blocks_of(path: str, name: str | None, extractor: str, content: bytes | None, own: bool, engine: recognition.Engine | None) -> Iterator[tuple]:
    """The blocks of a file one by one, read by its path if ``own``; what it gave before an error is kept."""
    if extractor in recognition.EXTRACTORS:
        kind, reader = recognition.EXTRACTORS[extractor]
        work = lambda raw, name: reader(raw, name, engine)
    else:
        kind, work = EXTRACTORS.get(extractor, ("file", None))
    k = 0
    try:
        raw = read_bytes(path) if work and content is None and own else content
        for text, place, warnings, *hints in work(raw or b"", name or "") if work else [("", None, [f"no extractor {extractor}"])]:
            yield path, kind, k, extractor, text, place, warnings, *(hints or (None, 0))
            k += 1
    except Exception as error:  # noqa: BLE001  one bad file must not end the job
        yield path, kind, k, extractor, "", None, [f"{type(error).__name__}: {error}"[:300]], None, 0


def extract(files: DataFrame, engine: recognition.Engine | None = None) -> DataFrame:
    """Text blocks of files with path, name and extractor; their content is read by path, or taken from a column ``content``. ``engine`` reads pictures."""
    own = "content" not in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = (b for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for b in _blocks_of(*row, own, engine))
            while rows := list(itertools.islice(blocks, HELD_BLOCKS)):
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

    content = F.lit(None).cast("binary").alias("content") if own else F.col("content")
    return files.select("path", "name", "extractor", content).mapInArrow(run, BLOCK_DDL)
