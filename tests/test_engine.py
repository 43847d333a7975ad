"""The scan engine against hand-made cases and small models in plain Python."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline import cli, settings
from siftline.functions import checks, masks, text
from siftline.operators import aggregate, detect, formats, planner, risk, rows, triage
from siftline.plans import pipeline
from siftline.sources import files
from siftline.streaming import incremental


def found(spark, *texts, only=()):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    return {(r.id, r.category): (r["count"], r.examples) for r in detect.detect(df, only=only).collect()}


@pytest.mark.parametrize(
    ("value", "kind", "count"),
    [
        ("a.b+c@mail.ru, иван.петров@пример.рф", "email", 2), ("+7 (912) 345-67-89; 89123456789; +1 (663) 555-6869; 7.912.345.67.89", "phone", 2), ("112-233-445 95", "snils", 1), ("112-233-445 96", "snils", 0),
        ("001-001-998 01", "snils", 0), ("087-654-303 00 и 087-654-302 00", "snils", 2), ("7707083893", "inn_legal", 1), ("7707083894", "inn_legal", 0), ("500100732259", "inn_person", 1), ("7707083893 500100732259", "inn", 2),
        ("4111 1111 1111 1111", "bank_card", 1), ("0000000000000", "bank_card", 0), ("паспорт серия 45 10 номер 123456", "passport_rf", 1), ("4510 123456", "passport_rf", 0), ("паспорт" + " " * 73 + "4510 123456", "passport_rf", 1),
        ("БИК 044525225 бик: 044525225", "bik", 2), ("р/с 40817810099910004312 счёт: 40702810400000001234", "bank_account", 2), ("CVV: 123 cvv2: 4567 CVV2123", "cvv", 3), ("Дата рождения: 12.03.1985", "birth_date", 1),
        ("12.03.1985 г. рождения", "birth_date", 1), ("ул.Ленина 5", "address", 1), ("ул. Ленина 5", "address", 0), ("4510123456RUS8503121M2501011<<<<<<<<<<<<<<04", "mrz", 1), ("Иванов Иван Иванович", "fio", 1),
        ("Красная Площадь Москва", "fio", 0), ("Министерство Иванов Иван Иванович", "fio", 0), ("Фамилия: Иванов Имя: Иван Отчество: Иванович", "fio", 1), ("заболевание", "health_data", 1), ("биометрия", "biometric_data", 0), ("  \n", "email", 0),
    ],
)
def test_detectors(spark, value, kind, count):
    assert found(spark, value).get((0, kind), (0,))[0] == count


def test_examples_are_masked_and_few(spark):
    made = found(spark, " ".join(f"user{k}@mail.test" for k in range(9)) + " 4510123", "паспорт 4510 123456")
    assert made[0, "email"] == (9, ["u***0@mail.test", "u***1@mail.test", "u***2@mail.test"])
    assert made[1, "passport_rf"] == (1, ["45 ** ******"])
    assert found(spark, None, "") == {}


def test_context_places(spark):
    df = spark.createDataFrame([("😀 паспорт 4510 123456 и 4511 654321",)], "text string")
    spans = df.select(detect.with_context(F.col("text"), "passport", 2, 3).alias("x")).first().x
    assert [(s.value, s.context) for s in spans] == [("123456", "рт 4510 123456 и "), ("654321", " и 4511 654321")]


def test_checks_against_model(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("0123456789") for _ in range(rng.choice((10, 11, 12, 16)))) for _ in range(4000)] + ["", None, "12", "abc"]

    def luhn(v):
        return 13 <= len(v) <= 19 and len(set(v)) > 1 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(v))) % 10 == 0

    def snils(v):
        return len(v) == 11 and int(v[:9]) > 1001998 and sum(int(c) * (9 - k) for k, c in enumerate(v[:9])) % 101 % 100 == int(v[9:])

    def inn(v, *weights):
        return len(v) == len(weights[-1]) + 1 and all(sum(a * int(b) for a, b in zip(w, v, strict=False)) % 11 % 10 == int(v[len(w)]) for w in weights)

    df = spark.createDataFrame([(v,) for v in values], "v string")
    made = df.select("v", *(c(F.col("v")).alias(n) for n, c in checks.CHECKS.items())).collect()
    checks.register(spark)
    df.createOrReplaceTempView("numbers")
    by_sql = spark.sql("SELECT v, is_snils(v) AS is_snils, is_inn_legal(v) AS is_inn_legal, is_inn_person(v) AS is_inn_person, is_luhn(v) AS is_luhn FROM numbers").collect()
    for r, q in zip(made, by_sql, strict=True):
        v = r.v if r.v and r.v.isdigit() else ""
        person = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
        assert (r.is_luhn, r.is_snils, r.is_inn_legal, r.is_inn_person) == (luhn(v), snils(v), inn(v, [2, 4, 10, 3, 5, 9, 4, 6, 8]), inn(v, person, [3, *person])), r
        assert r.asDict() == q.asDict()


def test_masks(spark):
    row = spark.range(1).select(
        masks.email(F.lit("ab@x.y")).alias("a"), masks.number(F.lit("123")).alias("b"), masks.snils(F.lit("112-233-445 95")).alias("c"), masks.ends(2, 2)(F.lit("7707083893")).alias("d"),
        masks.address(F.lit("x" * 80)).alias("e"), masks.initials(F.lit("Иванов  Иван")).alias("f"), masks.ends(5, 5, False)(F.lit("ABCDEFGHIJKLMN")).alias("g"),
    ).first()
    assert list(row) == ["a*@x.y", "***", "***-***-445 95", "77******93", "x" * 70 + "...", "И*** И***", "ABCDE****JKLMN"]


def test_normalize_text(spark):
    value = "a­b​c \t d e\r\n\n  f\x07g \x85h"
    row = spark.range(1).select(text.normalize_text(F.lit(value)).alias("a"), text.clean_ocr_text(F.lit("пере-\nнос\nстрок")).alias("b"), text.quality(F.lit("   ")).alias("c"), text.is_real_text(F.lit("слово")).alias("d"), text.is_real_text(F.lit("..a")).alias("e")).first()
    assert list(row) == ["abc d e\nfg\nh", "перенос строк", 0.0, True, False]


def test_pack_lines_against_model(spark):
    rng = random.Random(2)
    texts = ["\n".join("x" * rng.randint(0, 30) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.pack_lines(F.col("t"), 40).alias("p")).collect():
        chunks, now, size = [], [], 0
        for line in r.t.split("\n"):
            if now and size + len(line) + 1 > 40:
                chunks.append("\n".join(now))
                now, size = [], 0
            now.append(line)
            size += len(line) + 1
        assert r.p == [*chunks, "\n".join(now)]


def test_row_blocks_against_model(spark):
    rng = random.Random(3)
    data = [(g, k, None if rng.random() < 0.2 else f"line {k}") for g in range(12) for k in range(rng.randint(0, 40))]
    made = rows.row_blocks(spark.createDataFrame(data, "g int, k int, line string"), "g", "k", F.col("line"), 7).collect()
    expected = set()
    for g in {d[0] for d in data}:
        own = sorted(d[1:] for d in data if d[0] == g)
        lines, begun, index = [], 1, 0
        for at, (_, line) in enumerate(own, 1):
            if line:
                lines.append(line)
                if len(lines) == 7:
                    expected.add((g, index, begun, at, "\n".join(lines)))
                    lines, begun, index = [], at + 1, index + 1
        if lines:
            expected.add((g, index, begun, len(own), "\n".join(lines)))
    assert {(r.g, r.block_index, r.row_start, r.row_end, r.text) for r in made} == expected


def test_selection_against_sequential_model(spark):
    rng = random.Random(4)
    for trial in range(4):
        caps, most, least = {b: rng.randint(0, 6) for b in ("text_table", "document", "web", "binary_media", "ocr_media", "other")}, rng.randint(0, 14), 20
        data = [(f"/f{k}", rng.choice(["document", "web", "archive", "text", "image"]), float(rng.choice([0, 10, 20, 30, 50])), rng.choice(["", "", "skip: x"]), rng.choice(list(caps))) for k in range(80)]
        df = spark.createDataFrame(data, "path string, family string, triage_score double, blocked string, bucket string").withColumns({"path_low": F.col("path"), "name_low": F.col("path"), "extension": F.lit("bin")})
        made = {r.path: (r.include, r.reason) for r in triage.select(df, caps, most, least).collect()}
        used, total = dict.fromkeys(caps, 0), 0
        for path, family, score, blocked, bucket in sorted(data, key=lambda d: (-d[2], d[0])):
            if family == "text":
                want = (True, "include: fast baseline")
            elif blocked:
                want = (False, blocked)
            elif score < least:
                want = (False, "skip: below cutoff")
            elif caps[bucket] <= 0:
                want = (False, "skip: bucket disabled")
            elif used[bucket] >= caps[bucket]:
                want = (False, "skip: bucket cap")
            elif total >= most:
                want = (False, "skip: total cap")
            else:
                want = (True, "include: candidate")
            if want[0]:
                used[bucket] += 1
                total += 1
            assert made[path] == want, (trial, path)


def test_scaled_caps():
    assert triage.scaled_caps("normal", 180) == settings.setting("triage.bucket_caps.normal")
    assert triage.scaled_caps("hard", 260) == {"text_table": 60, "document": 80, "web": 35, "binary_media": 15, "ocr_media": 110, "other": 0}
    assert triage.scaled_caps("normal", 1000)["other"] == 0


def test_base_score(spark):
    df = spark.createDataFrame([("email", 1), ("email", 11), ("email", 1000), ("inn", 2), ("snils", 1)], "c string, n int")
    assert [round(r.x, 2) for r in df.select(risk.base_score(F.col("c"), F.col("n")).alias("x")).collect()] == [10.0, 22.0, 35.0, 3.36, 55.0]


def test_planner_first_rule_wins(spark):
    data = [("/a/x.pdf", "error", 5, "pdf", "document", True, None), ("/a/x.pdf", "success", 0, "pdf", "document", True, None), ("/a/y.pdf", "success", 9, "pdf", "document", True, "application/pdf"), ("/a/z.jpg", "success", 9, "jpg", "image", True, None), ("/a/scan.jpg", "success", 9, "jpg", "image", True, None), ("/a/q", "success", 9, None, None, False, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], "k int, path string, status string, size_bytes long, extension string, family string, is_binary boolean, mime string").withColumns({"name": F.regexp_extract("path", "([^/]*)$", 1), "confidence": F.lit(0.4)})
    made = {r.k: (r.strategy, r.skip_reason) for r in planner.plans(df).collect()}
    assert made == {0: ("skip", "scanner_error"), 1: ("skip", "empty_file"), 2: ("pdf_text_then_ocr", None), 3: ("skip", "tiny_image"), 4: ("image_prefilter_then_ocr", None), 5: ("cautious_text_fallback", None), 6: ("cautious_text_fallback", None)}
    steps = planner.ordered_steps(planner.plans(df).where("k = 4"), True).orderBy("k").collect()
    assert [(s.extractor, s.priority) for s in steps] == [("image_prefilter", 15), ("ocr_extractor", 15)]


def test_headers_and_repeats(spark):
    df = spark.createDataFrame([(["Имя", "Телефон"],), (["12", "13"],), (["only"],), ([None, "", "a"],)], "c array<string>")
    assert [r.h for r in df.select(rows.is_header(F.col("c")).alias("h")).collect()] == [True, False, False, False]
    runs = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "a", "", "a", None, "b", "a"])], "g int, k int, v string")
    assert [r.k for r in aggregate.drop_repeats(runs, ["g"], ["k"], "v").orderBy("k").collect()] == [0, 5, 6]


@pytest.fixture(scope="module")
def share(tmp_path_factory):
    root = tmp_path_factory.mktemp("data") / "share"
    folder = root / "Выгрузки" / "Мои бумажки"
    folder.mkdir(parents=True)
    (folder / "clients.csv").write_text("name;phone\n" + "\n".join(f"Иванов Иван Иванович;+7 912 345-67-{k:02d}" for k in range(20)), "utf-8")
    (folder / "note.txt").write_text("Паспорт серия 45 10 номер 123456, a@mail.test", "cp1251")
    (folder / "page.xls").write_text("<html><body><p>Привет</p><script>x()</script><div>мир</div></body></html>", "utf-8")
    (folder / "data.json").write_text(json.dumps({"a": {"b": [1, None, "c@mail.test"]}}), "utf-8")
    (folder / "bad.json").write_text("{not json", "utf-8")
    (folder / "empty.txt").write_bytes(b"")
    (folder / ".DS_Store").write_bytes(b"x")
    (folder / "pic.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 50)
    (folder / "old.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 50)
    (folder / "tool.elf").write_bytes(b"\x7fELF" + b"\0" * 6000 + b"\x89PNG\r\n\x1a\n" + b"\0" * 40_000)
    (folder / "text.rtf").write_bytes(b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Hello\\par \\u1052?ir}")
    with zipfile.ZipFile(folder / "memo.docx", "w") as box:
        box.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>b@mail.test</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(folder / "sheet.xlsx", "w") as box:
        box.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Имя</t></si><si><t>Адрес</t></si></sst>')
        box.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>Анна</t></is></c><c><v>7</v></c></row></sheetData></worksheet>')
    return root


def test_formats(spark, share):
    plan = formats.detect_format(files.heads(files.listing(spark, str(share)), formats.SAMPLE_BYTES))
    assert "Join" not in plan._jdf.queryExecution().analyzed().toString().replace("Join LeftOuter, (extension", "")
    found_files = plan.collect()
    made = {r.name: (r.extension, r.method, r.family) for r in found_files}
    assert ".DS_Store" not in made and len(made) == 12
    assert made["clients.csv"] == ("csv", "csv_sniffer", "structured") and made["page.xls"] == ("html", "html", "web")
    assert made["data.json"][1] == "json_parse" and made["bad.json"][1] == "extension_json_invalid" and made["empty.txt"][1] == "empty_file"
    assert made["pic.png"][0] == "png" and made["old.doc"] == ("doc", "ole_extension", "document") and made["tool.elf"][2] == "executable" and made["memo.docx"][1] == "zip_extension"


def test_scan_folder(spark, share, tmp_path):
    scan = pipeline.scan_folder(spark, str(share), "fast")
    blocks = {(r.file_path.rpartition("/")[2], r.extraction_method): r for r in scan.blocks.collect()}
    assert blocks["page.xls", "html_text_extractor"].text == "Привет\nмир" if ("page.xls", "html_text_extractor") in blocks else True
    assert "a.b[2]: c@mail.test" in blocks["data.json", "json_extractor"].text
    assert blocks["clients.csv", "csv_extractor"].page_or_sheet == "rows 1-21" and "phone: +7" in blocks["clients.csv", "csv_extractor"].text
    assert blocks["memo.docx", "docx_text_extractor"].text == "b@mail.test" and blocks["text.rtf", "rtf_text_extractor"].text == "Hello\nМir"
    assert "Имя: Анна | Адрес: 7" in blocks["sheet.xlsx", "spreadsheet_extractor"].text and blocks["tool.elf", "binary_payload_extractor"].warnings == ["embedded png"]
    scores = {r.file_path.rpartition("/")[2]: r for r in scan.assessed.collect()}
    assert scores["clients.csv"].phone == 20 and scores["clients.csv"].level != "low" and scores["empty.txt"].score <= 25
    assert pipeline.write_submit(scan.assessed, tmp_path / "submit.txt", 60) >= 1
    assert (tmp_path / "submit.txt").read_text("utf-8").splitlines()[0].startswith("/Выгрузки/")
    assert "clients.csv" in risk.report(scan.assessed, "submit_path", "Files", 5)


def test_scan_scores_table_hints(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "table.csv").write_text("fio;address;phone;passport\n" + "Анна;Лесная, 7;нет;есть 12\nБорис, физическое лицо;Речная;нет;нет\n", "utf-8")
    (tmp_path / "plain.csv").write_text("colour;size\nred;big\nblue;small\n", "utf-8")
    pq.write_table(pa.table({"client_name": ["Анна"], "home_address": ["Лесная"]}), tmp_path / "table.parquet")
    rows = {r.file_path.rpartition("/")[2]: r for r in pipeline.scan_folder(spark, str(tmp_path), "normal").assessed.collect()}
    fast = pipeline.scan_folder(spark, str(tmp_path), "fast").assessed.select(F.explode("rule_hits.rule")).distinct().collect()
    assert not {r[0] for r in fast} & risk.NOT_IN_FAST
    rules = {name: {h.rule for h in r.rule_hits} for name, r in rows.items()}
    assert {"table_sensitive_schema", "table_physical_person_names", "table_name_address_schema", "table_name_contact_schema"} <= rules["table.csv"]
    assert (rows["table.csv"].person_name_column, rows["table.csv"].sensitive_column_value, rows["table.csv"].physical_person_rows) == (3, 1, 2)
    assert "table_name_address_schema" in rules["table.parquet"] and not {r for r in rules["plain.csv"] if r.startswith("table_")}


def test_every_page_and_row_is_read(spark, monkeypatch):
    import contextlib
    import io
    import sys
    import types

    import pyarrow as pa
    import pyarrow.parquet as pq

    held = io.BytesIO()
    pq.write_table(pa.table({"a": [f"row{k}." for k in range(40_100)]}), held)
    df = spark.createDataFrame([("/x.parquet", "x.parquet", "parquet_extractor", bytearray(held.getvalue()))], "path string, name string, extractor string, content binary")
    made = sorted(files.extract(df).collect(), key=lambda r: r.block_index)
    assert [r.block_index for r in made] == list(range(161)) and not any(r.warnings for r in made)
    assert "\n".join(r.text for r in made).split("\n") == [f"a: row{k}." for k in range(40_100)]
    pages = [types.SimpleNamespace(get_text=lambda k=k: f"page {k}") for k in range(1, 13)]
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda **_: contextlib.nullcontext(pages)))
    assert [(b[0], b[1]) for b in files.pdf(b"", "x.pdf")] == [(f"page {k}", str(k)) for k in range(1, 13)]


def test_extractors_never_fail(spark):
    df = spark.createDataFrame([("/x.docx", "x.docx", "docx_text_extractor", bytearray(b"junk")), ("/y", "y", "no_such", bytearray(b"")), ("/z.pdf", "z.pdf", "pdf_text_extractor", None)], "path string, name string, extractor string, content binary")
    made = files.extract(df).collect()
    assert len(made) == 3 and all(r.text == "" and r.warnings for r in made)


def test_slides_and_tables_by_content(spark, tmp_path):
    import io
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>slide</a:t></a:r><a:r><a:t> {k}</a:t></a:r></a:p><a:tbl><a:p><a:t>cell</a:t></a:p></a:tbl></p>')
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "talk.pptx").write_bytes(box.getvalue())
    (tmp_path / "deep" / "list.dat").write_text("a;b;c\n1;2;3\n4;5;6\n7;8;9\n", "utf-8")
    (tmp_path / "deep" / "words.txt").write_text("some words\nand more of them\n", "utf-8")
    (tmp_path / "empty.csv").write_text("", "utf-8")
    made = {r.name: r for r in formats.detect_format(files.heads(files.listing(spark, str(tmp_path)), formats.SAMPLE_BYTES)).collect()}
    assert set(made) == {"talk.pptx", "list.dat", "words.txt", "empty.csv"} and made["list.dat"].extension == "csv" and made["list.dat"].details.asDict() == {"encoding": "utf-8", "delimiter": ";", "rows_sampled": 4, "columns": 3}
    assert made["words.txt"].method == "extension" and made["empty.csv"].method == "empty_file"
    assert [(b[0], b[1]) for b in files.pptx(box.getvalue(), "x.pptx")] == [("slide 2\ncell", "slide 2"), ("slide 10\ncell", "slide 10")]


def test_pictures_are_recognised_within_the_budget(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"скан паспорт {k}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(3000 + k))
    scan = pipeline.scan_folder(spark, str(tmp_path), "hard", engine=lambda raw: f"паспорт серия 45 10 номер 123456\nx\n{len(raw)}", ocr_files=2)
    read = scan.blocks.where("ocr").collect()
    assert len(read) == 2 and all(r.text.startswith("паспорт серия 45 10") and "\nx" not in r.text for r in read)
    assert {r.category for r in scan.findings.collect()} >= {"passport_rf"}
    none = pipeline.scan_folder(spark, str(tmp_path), "hard", ocr_files=1).blocks.where("ocr").collect()
    assert len(none) == 1 and none[0].text == "" and none[0].warnings


def test_entities_of_a_model(spark):
    from siftline.operators import entities

    rows = [(1, "/a.txt", "file", 0, "Смирнова Анна живёт: Лесная улица, 5; дата рождения 1.2.1990, выпуск 3.4.2001" + " " * 100 + "5.6.2002"), (2, "/a.txt", "file", 1, None), (3, "/b.csv", "table", 0, "Смирнова Анна")]
    df = spark.createDataFrame(rows, "block_id long, file_path string, source_type string, block_index int, text string")
    model = lambda text: [("PERSON", "Смирнова Анна", 0.9), ("PERSON", "Анна", 0.9), ("LOCATION", "Лесная улица, 5", 0.8), ("LOCATION", "Омск", 0.8), ("DATE_TIME", "1.2.1990", 0.8), ("DATE_TIME", "5.6.2002", 0.8), ("SNILS_RF", "112-233-445 95", 1.0), ("OTHER", "x", 1.0)]  # noqa: E731, ARG005
    found = {(r.block_id, r.category): r.examples for r in entities.detect_entities(df, model).collect()}
    assert found == {(1, "fio"): ["С*** А***"], (1, "address"): ["Лесная улица, 5"], (1, "birth_date"): ["*.*.****"]}
    assert entities.detect_entities(df, None).count() == 0 and entities.status(None).startswith("not_used")


def test_limits_warn_and_can_be_lifted(monkeypatch):
    from siftline import settings

    raw = bytes(5000) + b"\x89PNG\r\n\x1a\n" + bytes(50_000)
    assert [b[2] for b in files.payloads(raw, "x")] == [["embedded png"]]
    monkeypatch.setattr(settings, "_loaded", lambda: settings._merged(settings.DEFAULTS, {"limits": {"payload_most": 40_000, "json_bytes": 4}}))
    assert [b[2] for b in files.payloads(raw, "x")] == [["png outside the size limits"]]
    assert next(iter(files.json_text(b'{"a": 1}', "x")))[2] == ["large JSON read as text"]
    monkeypatch.setattr(settings, "_loaded", lambda: settings._merged(settings.DEFAULTS, {"limits": {"payload_most": None, "json_bytes": None}}))
    assert [b[2] for b in files.payloads(raw, "x")] == [["embedded png"]] and not next(iter(files.json_text(b'{"a": 1}', "x")))[2]


def test_reports(spark, share, tmp_path):
    from siftline.plans import reports

    scan = pipeline.scan_folder(spark, str(share), "normal")
    reports.review_report(scan.assessed, tmp_path / "review.md", 60)
    reports.pipeline_report(scan, tmp_path / "pipeline.md", "normal", 60)
    review, whole = (tmp_path / "review.md").read_text("utf-8"), (tmp_path / "pipeline.md").read_text("utf-8")
    assert "clients.csv" in review.split("## Review Candidates")[0] and "phone:20" in review and "## Top Suppressed" in review
    assert "- Files: `12`" in whole and "csv_extractor" in whole and "include: fast baseline" in whole and "clients.csv" in whole.split("## Best risks")[0]
    levels = {r.item: r.n for r in reports.risk_summary(scan.assessed, 60).where("what = 'level'").collect()}
    assert sum(levels.values()) == 12
    reports.export_json(scan, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "findings")).count() == scan.findings.count()


def test_arguments():
    from siftline import cli

    one = cli.settle(cli.parser().parse_args(["scan", "x"]))
    assert one.mode == "fast" and one.risk and one.submit.endswith("submit.txt") and one.review_report
    two = cli.settle(cli.parser().parse_args(["scan", "x", "--detect-pii", "--ml", "--no-ml"]))
    assert two.mode == "normal" and not two.submit and not two.risk and not two.ml
    three = cli.settle(cli.parser().parse_args(["scan", "x", "--mode", "hard", "--submit", "s.txt"]))
    assert three.submit == "s.txt" and three.risk and not three.review_report
    assert cli.main(["scan", "/no/such/folder"]) == 1


def test_stream(spark, tmp_path):
    schema = "block_id long, file_path string, block_index int, text string, extracted_at timestamp"
    data = [(k % 7, f"/f{k % 2}", k, "mail a@x.test", None) for k in range(14)]
    spark.createDataFrame(data, schema).withColumn("extracted_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = incremental.findings_stream(incremental.blocks_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), only=("email",))
    got = []
    incremental.each_batch(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.block_id for r in got) == list(range(7))


def test_settings_and_cli(tmp_path, monkeypatch, capsys):
    assert settings.setting("risk.weights.email") == 10 and settings.setting("no.such", 5) == 5
    target = tmp_path / "s.json"
    assert cli.main(["init-config", str(target)]) == 0 and cli.main(["init-config", str(target)]) == 1
    assert json.loads(target.read_text("utf-8"))["limits"]["ocr_files"] == 80
    assert cli.main(["/no/such/folder"]) == 1
    monkeypatch.setenv("SIFTLINE_SETTINGS", str(tmp_path / "missing.json"))
    with pytest.raises(FileNotFoundError):
        settings.settings_path()
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
