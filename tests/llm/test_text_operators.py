"""Each text operator on small cases, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import boilerplate, chunking, encoding, language, leakage, lookalike, mixing, personal, scans, truncation

BLOCK = "block_id long, file_path string, source_type string, block_index int, extraction_method string, text string, page_or_sheet string, extra map<string,string>"
RU = ["Система показала расхождения на портале поставщиков.", "Операторы архива закрыли журнал обращений после обеда.", "Передача копий начнётся позже обычного, как сообщили дежурные смены.", "Кладовщики склада сверили карточки контрагентов без дополнительной сверки."]
EN = ["The system showed mismatches on the supplier portal.", "Archive operators closed the request log after lunch.", "Handing over copies starts later than usual, the night shift explained.", "Warehouse staff reconciled the partner cards without another comparison."]


def blocks(spark, texts, method="plain_text_extractor", kind="file", path="/share/a.txt", lang=None):
    rows = [(k, path if isinstance(path, str) else path[k], kind, k, method, t, None, {"lang": lang[k] if lang else None}) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCK)


def corpus(seed=1, n=120, lines=RU):
    rng = random.Random(seed)
    return [" ".join(rng.choice(lines) for _ in range(4)) for _ in range(n)]


def clash(df):
    """Extra columns with the names that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("kept", "n", "k", "words", "host", "nodes", "place", "named", "kind", "head", "votes", "rec_id", "tokens", "at", "piece", "clean_text", "out") if c not in df.columns})


# Problem 2


def test_same_look(spark):
    texts = ["По заявке № 5", "Пo зaявке № 5", "По​ заявке № ５", "по заявке № 5", "По заявке № 6", "ｅｘｐｏｒｔ ﬁle", "export file", "café", "café", "cafe", "", None]
    found = lookalike.same_look_pairs(clash(blocks(spark, texts)), "block_id").collect()
    assert {(r.a, r.b) for r in found} == {(0, 1), (0, 2), (1, 2), (5, 6), (7, 8)}


@pytest.mark.parametrize(("one", "two", "same"), [
    ("𝐀lpha", "Alpha", True), ("Ⅳ квартал", "IV квартал", True), ("ｱ", "ア", True), ("Congreſs", "Congress", True), ("ρay", "pay", True), ("a‑b‐c", "a-b-c", True), ("a∕b", "a/b", True), ("℀", "a/c", True), ("ﬁle", "file", True), ("е\u0301", "é", True),
    ("① пункт", "1 пункт", False), ("x²", "x2", False), ("№ 5", "No 5", False), ("Alpha", "alpha", False), ("ёж", "еж", False), ("5", "6", False),
])
def test_looks(spark, one, two, same):
    made = lookalike.look_keys(spark.createDataFrame([(1, one), (2, two)], "id long, text string"), "id").collect()
    assert (made[0].look_key == made[1].look_key) == same


def test_look_classes(spark):
    df = blocks(spark, ["По заявке", "Пo заявке", "По заявке", "Пo зaявке", "иное", "иное", None, ""])
    found = {r.id: (r.variants, r.links) for r in lookalike.look_classes(df, "block_id").collect()}
    assert found == {0: (3, 2), 1: (3, 3), 2: (3, 2), 3: (3, 3)}
    assert {(r.a, r.b) for r in lookalike.same_look_pairs(df, "block_id").collect()} == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)}


def test_same_look_repeats_and_empty(spark):
    df = blocks(spark, ["a b", "a b"])
    assert lookalike.same_look_pairs(df.unionByName(df), "block_id").count() == 1
    assert lookalike.same_look_pairs(df.limit(0), "block_id").count() == 0


def test_normalise_keeps_columns_and_alphabets(spark):
    made = {r.block_id: r for r in lookalike.normalise(clash(blocks(spark, ["Пopтaл", "ехport", None, "x" * 200_000]))).collect()}
    assert made[0].clean_text == "Портал" and made[1].clean_text == "export" and made[2].clean_text is None
    assert made[3].clean_text == "x" * 200_000 and made[0].n == "x"


# Problem 4


def pieces_of(text, most, overlap):
    return [text[a:b] for a, b in chunking.cut(text, most, overlap)]


@pytest.mark.parametrize(("most", "overlap"), [(300, 40), (120, 0), (50, 49), (7, 3)])
def test_cut_is_exact(most, overlap):
    text = "\n\n".join(corpus(3, 12))
    spans = chunking.cut(text, most, overlap)
    kept = min(overlap, most // 2)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in itertools.pairwise(spans):
        assert b - c == min(kept, b) and b > a and d > b and b - a <= most and d - c <= most


def test_cut_resists_edits():
    text = " ".join(corpus(5, 60))
    one, two = pieces_of(text, 400, 0), pieces_of("Новое начало. " + text, 400, 0)
    assert len(set(one) - set(two)) <= 3


def test_cut_without_boundaries():
    assert all(len(p) <= 100 for p in pieces_of("x" * 1000, 100, 10))


def test_split_oversized(spark):
    limits = spark.createDataFrame([("file", 50, 5), ("*", 30, 0)], "source_type string, max_chars int, overlap_chars int")
    df = clash(blocks(spark, ["a" * 50, "a" * 51, None, "", "word " * 5000])).unionByName(clash(blocks(spark, ["b" * 31], kind="json").withColumn("block_id", F.lit(9).cast("long"))))
    found = chunking.split_oversized(df, limits)
    assert {r.block_id for r in found.select("block_id").distinct().collect()} == {1, 4, 9}
    assert found.where("length(piece_text) > 50").count() == 0
    assert chunking.split_oversized(df.limit(0), limits).count() == 0
    assert chunking.split_oversized(df, limits.limit(0)).count() == 0


# Problem 10

DOC = "doc_id long, source string, text string"


def test_cut_texts(spark):
    whole = [(k, "s", t) for k, t in enumerate(corpus(2, 60))]
    odd = [
        (100, "s", whole[0][2] + " Система показала расхож"), (101, "s", whole[0][2] + " Операторы архива закрыли журнал…"), (102, "s", whole[0][2] + " Передача копий начнё�"), (103, None, whole[0][2] + " Перед&nb"),
        (104, "s", whole[0][2] + "\n- журнал обращений"), (105, "s", whole[0][2] + "\n№ 31/Нисанн"), (106, "s", whole[0][2] + "\n(передача копий)"), (107, "s", ""), (108, "s", None),
        *((110 + k, "s", whole[k][2] + "\nС уважением, отдел") for k in range(5)), (120, "s", "Слово. " * 20_000 + "и ещё одно сло"),
    ]
    df = clash(spark.createDataFrame(whole + odd, DOC))
    assert {r.doc_id for r in truncation.mark_cut(df).where("cut").collect()} == {100, 101, 102, 103, 120}
    rates = {r.source: r.cut_texts for r in truncation.cut_rates(truncation.mark_cut(df)).collect()}
    assert rates == {"s": 4, "": 1}
    assert truncation.mark_cut(df.limit(0)).count() == 0


def test_copies_and_long_lines_are_no_usual_ends(spark):
    whole = [(k, "s", t) for k, t in enumerate(dict.fromkeys(corpus(2, 60)))]
    copies = [(200 + k, "s", RU[0] + "\nОператоры архива закрыли журнал обращ") for k in range(40)]
    long = [(300 + k, "s", RU[1] + "\n" + "Кладовщики склада сверили карточки контрагентов " * 6 + RU[k][:12]) for k in range(4)]
    # An ending stays one if one of its texts has many copies.
    signed = [(400 + k, "s", whole[min(k, 4)][2] + "\nС уважением, Ваш отдел продаж") for k in range(40)]
    df = spark.createDataFrame(whole + copies + long + signed, DOC)
    assert {r.doc_id for r in truncation.mark_cut(df).where("cut").collect()} == {k for k, *_ in copies + long}


def test_automaton_sees_open_pairs():
    assert truncation.automaton("Система «Сан")[1] == truncation.PAIR and not truncation.automaton("Система «Сан».")[1]


@pytest.mark.parametrize(("text", "state"), [('Сказано "журнал', truncation.LOOSE), ("<p>Журнал", truncation.LOOSE), ("<br>Журнал", truncation.SHUT), ("(см. «журнал»", truncation.PAIR), ('"журнал" (копия)', truncation.SHUT), ("(копия\nЖурнал", truncation.SHUT)])
def test_automaton_stack(text, state):
    assert truncation.left_open(text) == state


def test_limits_and_open_pairs_are_evidence(spark):
    rng = random.Random(4)
    bare = lambda k: "том" * (k + 1) + "\n" + "\n".join(" ".join(rng.sample(["журнал", "архив", "опись", "сводка", "склад", "дело", "отчёт", "папка", "копия", "лист"], 10)) for _ in range(3))
    loose = [(k, "notes", bare(k)) for k in range(60)] + [(100 + k, "notes", (bare(k) * 3)[:150]) for k in range(8)]
    ends = [(200 + k, "mail", t) for k, t in enumerate(dict.fromkeys(corpus(3, 60)))]
    ends += [(300, "mail", RU[0] + " Передача копий (см. опись. Журнал закрыт."), (301, "mail", RU[1] + " (см. опись).")]
    made = {r.doc_id: r for r in truncation.mark_cut(spark.createDataFrame(loose + ends, DOC)).collect()}
    assert {k for k, r in made.items() if r.cut} == {*range(100, 108), 300}
    assert made[100].evidence == "limit" and made[300].evidence == "open" and made[100].at_limit and not made[0].at_limit


# Problem 5


def test_languages(spark):
    docs = [(k, "ru", t) for k, t in enumerate(corpus(1, 80))] + [(100 + k, "en", t) for k, t in enumerate(corpus(1, 80, EN))]
    odd = [(300, "en", " ".join(RU)), (301, None, " ".join(EN)), (302, "RU", " ".join(RU) + "\n" + " ".join(EN)), (303, "rus", " ".join(RU) + " a@mail.test"), (304, "ru-RU", " ".join(RU)), (305, "unknown", None), (306, "ru", ""), (307, "en-US", " ".join(EN) * 3000)]
    df = clash(spark.createDataFrame(docs + odd, "doc_id long, lang string, text string"))
    empty = blocks(spark, ["x"]).limit(0)
    found = {(r.rec_table, r.rec_id, r.lang) for r in language.wrong_labels(df, empty).collect()}
    assert found == {("documents", 300, "ru"), ("documents", 301, "en"), ("documents", 302, "ru"), ("documents", 302, "en")}
    assert language.wrong_labels(df.limit(0), empty).count() == 0


def test_viterbi_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    table = rng.normal(0, 6, (12, len(language.LANGS)))
    texts = [rng.integers(0, 12, n).tolist() for n in (0, 1, 3, 5, 4)]
    for ids, path in zip(texts, language.viterbi(texts, table), strict=True):
        value = lambda p: sum(table[w, s] for w, s in zip(ids, p, strict=True)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max((value(p) for p in itertools.product(range(len(language.LANGS)), repeat=len(ids))), default=0)
        assert abs(value(path.tolist()) - best) < 1e-9


def test_long_texts_among_short_ones():
    """One text of 300,000 words in a slice of short ones: the same labels, and memory for this one text only."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    table = rng.normal(0, 6, (12, len(language.LANGS)))
    texts = [rng.integers(0, 12, n).tolist() for n in (300_000, *rng.integers(1, 60, 1999))]
    tracemalloc.start()
    made = language.labels(texts, table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300_000_000 and [len(x) for x in made] == [len(x) for x in texts]
    for got, want in zip(made[1:], language.viterbi(texts[1:], table), strict=True):
        assert (got == want).all()
    assert (made[0][:2000] == language.viterbi([texts[0]], table)[0][:2000]).all()


# Problem 8

WORDS = [f"слово{k}" for k in range(900)]


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.sample(WORDS, 48))) for k in range(30)] + [(90, None), (91, "")]
    noise = [(k, " ".join(rng.sample(WORDS[600:], 60)) + " " + " ".join(corpus(k, 2))) for k in range(40)]
    one, two = items[0][1].split(), items[1][1].split()
    changed = [w if k % 11 else "другое" for k, w in enumerate(two)]
    docs = noise + [
        (100, noise[0][1] + " " + ", ".join(one[10:36]).upper() + ". " + noise[1][1]), (101, noise[2][1] + " " + " ".join(changed)), (102, noise[3][1] + " " + " ".join(one[:10])), (103, None), (104, ""),
        (105, " ".join(noise[k % 40][1] for k in range(300)) + " " + items[5][1]),
    ]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    found = leakage.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.item_id, r.doc_id) for r in found.collect()} == {(0, 100), (1, 101), (5, 105)}
    assert leakage.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leakage.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_alignment_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 12)
        grid = np.zeros((10, 13))
        for i in range(9):
            for k in range(12):
                grid[i + 1, k + 1] = max(0, grid[i, k] + (1 if a[i] == b[k] else -1), grid[i, k + 1] - 1, grid[i + 1, k] - 1)
        held, start, end = leakage.align(a, b)
        assert leakage._best(a, b)[0] >> 20 == grid.max() and 0 <= start <= end <= 12 and held <= end - start


def item_index(seed=3, size=30, n=50):
    import numpy as np

    from siftline.llm.common import Memo

    rng = np.random.default_rng(seed)
    index = leakage.ItemIndex([(k, " ".join(rng.choice(WORDS, size, replace=False))) for k in range(n)], {"": 5.0})
    index.other = Memo(lambda w: leakage.signs(w) * index.foreign)
    return rng, index


def test_probing_finds_all_within_radius():
    import numpy as np

    rng, index = item_index()
    for size, (flat, owner, _) in index.sizes.items():
        values = [v ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 7, replace=False))) for v in rng.choice(flat, 60)]
        values = np.array([*values, *rng.integers(0, 2**63, 50).astype(np.uint64)])
        want = {(k, int(i)) for k, v in enumerate(values) for i in owner[leakage.distance(flat, v) <= leakage.RADIUS]}
        assert set(zip(*(x.tolist() for x in index.near(size, values)), strict=True)) == want and len(want) >= 60


def test_windows_left_out_lose_no_leak():
    """Windows of little item weight are not hashed; probing them all finds the same leaks, also edited ones."""
    rng, index = item_index(5, 48, 40)
    texts = []
    for key, words in index.words.items():
        at = int(rng.integers(0, 20))
        part = [w if k % 9 else "иное" for k, w in enumerate(words[at : at + 28], 1)]
        texts.append([*rng.choice(WORDS, 40), *part, *rng.choice(WORDS, 40), *index.words[(key + 1) % 40][:9]])
    found = [set(index.verified(t, c)) for t, c in zip(texts, index.candidates(texts), strict=True)]
    own = index.windows
    index.windows = lambda texts: own(texts, 0.0)
    every = [set(index.verified(t, c)) for t, c in zip(texts, index.candidates(texts), strict=True)]
    assert found == every and sum(map(bool, found)) >= 36


def test_equal_windows_have_equal_hashes_far_into_a_text():
    import numpy as np

    _, index = item_index(7, 48, 2)
    words = index.words[0]
    far = [WORDS[k % 900] for k in range(60_000)] + words
    texts = [words[:5], words, [], far]
    seen = 0
    for _, text, places, hashes in index.windows(texts, 0.0):
        made = dict(zip(zip(text.tolist(), places.tolist(), strict=True), hashes.tolist(), strict=True))
        near = {p: h for (t, p), h in made.items() if t == 1}
        assert len(near) > 20 and all(made[3, 60_000 + p] == h for p, h in near.items())
        seen += len(near)
    assert seen > 60


# Problem 3


def name(k):
    """A name of its own for each number."""
    return "".join("абвгдежзик"[int(d)] for d in f"{k:03d}").capitalize()


def page(k, body, rng):
    return "\n".join(["Сайт Ошви", "Главная", "Новости", "Контакты", *(["Остаток мест: %d" % k] if k % 4 == 0 else []), *body, "Просмотров: %d" % k, "Читайте также", f"Записка о переносе Ган{name(k)}", "© 2021 Ошви. Все права защищены.", "Наверх"])


def test_boilerplate(spark):
    rng = random.Random(6)
    texts, body = [], []
    for k in range(60):
        own = [f"Записка о переносе Лек{name(k * 7)}", *(["Итоги"] if k % 5 == 0 else []), " ".join(rng.sample(RU, 3)) + f" Дело {name(k)}.", *(["- журнал обращений"] if k % 4 == 1 else [])] if k % 20 != 7 else []
        body.append(own)
        texts.append(page(k, own, rng))
    df = clash(blocks(spark, [*texts, None, "", "Одна строка"], "html_text_extractor", "html", [*(["/share/site_1/p%d.html" % k for k in range(60)]), "/share/site_1/a.html", "/share/site_1/b.html", "/share/other/c.html"]))
    found = {(r.block_id, r.line_no) for r in boilerplate.furniture_lines(df).collect()}
    for k, text in enumerate(texts):
        lines = text.split("\n")
        assert [x for n, x in enumerate(lines) if (k, n) not in found] == body[k]
    assert not any(b > 59 for b, _ in found)
    assert boilerplate.furniture_lines(df.limit(0)).count() == 0
    wrapper = boilerplate.expression_texts(df).where("host = 'site_1'").first().expression
    assert "Главная" in wrapper and "TEXT*" in wrapper
    bodies = {r.block_id: r.body for r in boilerplate.bodies(df).collect()}
    assert bodies[0] == "\n".join(body[0]) and bodies[7] == ""


def test_the_order_of_a_wrapper_decides(spark):
    """Two hosts with the same lines equally often: a menu's word is furniture in its place and body within the text."""
    menu, texts, paths = ["Сайт Ошви", "Главная", "Новости", "Контакты"], [], []
    for host in ("one", "two"):
        for k in range(70):
            head, own = list(menu), [RU[i] * 2 + f" Дело {name(k * 3 + i)}." for i in range(3)]
            if k == 69:
                own[0:0] = [f"Записка {name(k)}"]
                if host == "two":
                    head.remove("Новости")
                    own[2:2] = ["Новости"]
            texts.append("\n".join([*head, *own, "Наверх"]))
            paths.append(f"/share/site_{host}/p{k}.html")
    found = {(r.block_id, r.line_no) for r in boilerplate.furniture_lines(blocks(spark, texts, kind="html", path=paths)).collect()}
    lines = lambda k: [x for n, x in enumerate(texts[k].split("\n")) if (k, n) in found]
    assert lines(69) == [*menu, "Наверх"] and lines(139) == ["Сайт Ошви", "Главная", "Контакты", "Наверх"]


def test_other_orders_become_repeated_groups():
    streams = [(5.0, [[k, 5.0] for k in (1, 2, 3, 4)]), (4.0, [[k, 4.0] for k in (1, 3, 2, 4)]), (3.0, [[k, 3.0] for k in (1, 4)])]
    _, nodes = boilerplate.align_all(streams)
    groups = boilerplate.grouped(nodes)
    assert [again for again, _ in groups] == [False, True, False] and set(groups[1][1]) == {2, 3}
    assert boilerplate.align_all(streams[::-1])[1] == nodes


def test_wrappers_do_not_depend_on_rows_or_batches(spark):
    rng = random.Random(3)
    texts = [page(k, [f"Записка о переносе Лек{name(k * 3)}", " ".join(rng.sample(RU, 3))], rng) for k in range(40)]
    df = blocks(spark, texts, kind="html", path=[f"/share/site_{k % 3}/p{k}.html" for k in range(40)])
    rows = []
    for parts, size in ((1, "10000"), (5, "2")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        rows.append(sorted((r.block_id, r.line_no) for r in boilerplate.furniture_lines(df.orderBy(F.rand(parts)).repartition(parts)).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows[0] == rows[1] and rows[0]


# Problem 7


def test_encodings(spark):
    good = corpus(7, 150) + corpus(8, 60, EN)
    swap = lambda t, a, b: t.encode(a).decode(b)
    bad = [swap(good[0], "cp1251", "cp866"), swap(good[1], "utf-8", "latin-1"), swap(good[2], "koi8-r", "cp1251"), "???? ???????? ?? ?????, ??? ???", "��� ��"]
    fine = ["Пopтaл поставщиков", "Что? Где? Когда??", "Портал п0ставщиков", None, "", "20% журнал"]
    df = clash(blocks(spark, good + bad + fine))
    empty = spark.createDataFrame([], "scan_id long, decoded_name string")
    found = encoding.texts(df, empty)
    model = encoding.fit(found)
    made = {r.rec_id: r for r in encoding.garbled(found, model, restore=True).collect()}
    n = len(good)
    assert set(made) == set(range(n, n + len(bad)))
    assert made[n].restored == good[0] and made[n + 1].restored == good[1] and made[n + 2].restored == good[2]
    assert encoding.garbled(found.limit(0), encoding.fit(found.limit(0))).count() == 0


MORE = [
    "инженеры эксплуатации передали инструкцию по хранению в общем каталоге", "аналитики закупок сверили журнал обращений и график отключений", "юристы блока поставок закрыли папку с черновиками на сетевом диске",
    "кураторы договоров опечатали шаблоны уведомлений из-за нехватки места", "разработчики выгрузки вернули на доработку справочник подразделений", "расшифровка записей останется за филиалом до конца месяца",
]


@pytest.mark.parametrize("page", ["permutation", "cp1254"])
def test_unknown_ciphers_are_learned(spark, page):
    """Swaps that no listed pair of code pages makes: letters at random, and a page outside the list."""
    rng = random.Random(11)
    letters = list("абвгдежзийклмнопрстуфхцчшщьыэюя")
    mixed = rng.sample(letters, len(letters))
    swap = (lambda t: t.translate(str.maketrans("".join(letters), "".join(mixed)))) if page == "permutation" else lambda t: t.encode("cp1251").decode("cp1254")
    texts = [". ".join(rng.sample(MORE, 4)) + "." for _ in range(200)]
    bad = [swap(t) for t in texts[:25]]
    found = encoding.texts(blocks(spark, texts[25:] + bad), spark.createDataFrame([], "scan_id long, decoded_name string"))
    model = encoding.fit(found)
    assert model.letters
    made = {r.rec_id: r.restored for r in encoding.garbled(found, model, restore=True).collect()}
    assert set(made) == set(range(175, 200))
    assert [made[175 + k] for k in range(25)] == texts[:25]


def test_misreadings_are_no_cipher():
    """One letter misread in many words leaves the others as they are: no table is learned from that."""
    from siftline.llm.ciphers import Learner, Letters

    words = sorted({w for t in MORE for w in t.split() if len(w) > 3})
    letters, known = Letters([(w, 50) for w in words]), dict.fromkeys(words, 50)
    misread = {w.replace("н", "п"): 5 for w in words if "н" in w}
    swapped = {w.translate(str.maketrans("авгдеиклмнорстуы", "еыугрваикслмотдн")): 5 for w in words}
    assert len(misread) >= 15 and Learner(letters, misread).learn([], known, lambda w, made: made in known) is None
    assert Learner(letters, swapped).learn([], known, lambda w, made: made in known) is not None


def test_ciphers_against_brute_force():
    """Forward-backward gives the sums over all hidden words."""
    import numpy as np

    from siftline.llm.ciphers import Learner, Letters

    letters = Letters([("аба", 5), ("бав", 3), ("вваб", 2)])
    learner = Learner(letters, {"хуц": 2, "ух": 1, "цуху": 3})
    emit = learner.from_frequencies(1)
    got, value = learner.step(emit)
    want, total = np.zeros_like(got), 0.0
    for word, n in learner.words.items():
        ways = {}
        for path in itertools.product(range(len(letters.states)), repeat=len(word)):
            p = letters.first[path[0]] * letters.last[path[-1]]
            for a, b in zip(path, path[1:]):
                p *= letters.move[a, b]
            for s, c in zip(path, word, strict=True):
                p *= emit[s, learner.number[c]]
            ways[path] = p
        mass = sum(ways.values())
        total += n * np.log(mass)
        for path, p in ways.items():
            for s, c in zip(path, word, strict=True):
                want[s, learner.number[c]] += n * p / mass
    assert np.allclose(got, want, atol=1e-6) and abs(total - value) < 1e-6


# Problem 1


@pytest.mark.parametrize(("line", "is_page"), [("— 3 —", True), ("Стр. 12 из 40", True), ("5heet 2", True), ("Раgе 4", False), ("3 октября", False), ("лист", False), ("12/14", True)])
def test_page_numbers(line, is_page):
    assert scans.Folding(scans.ALWAYS).is_page(line) == is_page


def test_scans(spark):
    clean = corpus(9, 400)
    texts = [
        "Передача копий нач-\nнётся позже обычного, как сообщили\nдежурные смены.", "Система п0казала расхождения на портале\nпоставщиков.", "Журнал обращений\nОператоры архива закрыли журнал обращений.\n— 3 —",
        "Журнал обращений\nКладовщики склада сверили карточки контрагентов.\n— 4 —", "1. журнал обращений\n2. карточки контрагентов", None, "", "Кладовщики склада сверили карточки контрагентов. " * 4000,
    ]
    df = blocks(spark, clean, path="/share/clean.txt").unionByName(blocks(spark, texts, "ocr_extractor", "ocr", "/share/scan.jpg").withColumn("block_id", F.col("block_id") + 1000))
    df = clash(df)
    found = {(r.block_id - 1000, r.defect) for r in scans.defects(df.unionByName(df)).collect()}
    assert found == {(0, "line_hyphen"), (1, "misread_char"), (2, "running_header"), (2, "page_number"), (3, "running_header"), (3, "page_number")}
    made = {r.block_id - 1000: r.clean_text for r in scans.repair(df).distinct().collect()}
    assert made[0] == "Передача копий начнётся позже обычного, как сообщили дежурные смены."
    assert made[1] == "Система показала расхождения на портале поставщиков." and made[2] == "Операторы архива закрыли журнал обращений."
    assert scans.defects(df.limit(0)).count() == 0


# Problem 6


def test_pairs_are_counted_in_any_batches(spark):
    df = blocks(spark, ["тихий берег", "тихий берег"] * 4)
    for parts in (1, 3, 8):
        counts = {(r.a, r.b): r.n for r in scans.word_counts(df.repartition(parts)).where("kind = 'pair'").collect()}
        assert counts == {("тихий", "берег"): 8}


def test_every_confusable_place_is_tried():
    """Also in a word of more than 40 characters, and however many readings there are."""
    word = "|б" * 25 + "з"
    channel = scans.Channel({word: 50, "слово": 100}, {}, {})
    assert word in {w for w, *_ in channel.candidates("|б" * 25 + "3")}
    read = "0а|а!а1аrn"
    many = {read.replace(a, b): 5 for a, b in scans.ALWAYS if a in read}
    assert len(many) > 8 and {w for w, *_ in scans.Channel(many, {}, {}).candidates(read)} == {read, *many}


def test_confusions_are_learned():
    """What turns many unknown scanned words into known ones is a misreading; what turns known words into one another is not."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("бвдзклмнпрст") + rng.choice("аеиоу") for _ in range(4)) + "т" for _ in range(60)]
    words = {s + e: 60 for s in stems for e in ("а", "у", "ом")}
    scanned = {w.replace("т", "ж", 1): 3 for w in list(words)[:90]} | {s + "е": 3 for s in stems}
    learned = set(scans.Channel(words, {}, scanned).confusions) - set(scans.ALWAYS)
    assert learned == {("ж", "т")}
    # Names made of syllables differ in a letter as well, but are as frequent as one another.
    names = ["".join(p) for p in itertools.product(("vi", "mi", "xi", "ni"), ("lor", "gan", "tun"), ("vix", "nax", "max"))]
    known = dict.fromkeys(names[::2], 20)
    assert set(scans.Channel(words | known, {}, scanned | dict.fromkeys(names[1::2], 15)).confusions) - set(scans.ALWAYS) == {("ж", "т")}


def test_personal(spark):
    luhn = "4111 1111 1111 1111"
    texts = [
        "Ответ отправьте на a.petrov+docs@mail.test до пятницы.\nСвязь по телефону +7 (912) 345-67-89.", "Почта petrov [at] mail [dot] test, владелец Петров Иван Сергеевич.", f"В анкете указан карта {luhn}, СНИЛС 112-233-445 95.",
        "Номер партии 4111 1111 1111 1112 нанесён на короб.", "Заявитель проживает: г. Омск,\nул. Мира, д. 5, кв. 7.", "Город Омск включён в график доставки.", "The copy was signed by F. Yarrave, phone 207.555.0145.\nFull name: Yarrave, Simon", "Узел 192.0.2.37 отвечает.",
        "Паспорт серия 45 10 номер 123456 выдан.", None, "", "Накладная 6615858321 оформлена повторно.", "слово " * 40_000 + "b@mail.test",
    ]
    findings = spark.createDataFrame([(1, "email", ["x@mail.test", "x***@mail.test", None, "g***2@otdel.example"]), (2, "passport_rf", ["45 10 123456"]), (3, "fio", None), (4, "fio", ["жаркутев роман аркадьевич", "Ж*** Р***"])], "finding_id long, category string, examples array<string>")
    pieces = personal.pieces(clash(blocks(spark, texts)), clash(findings))
    # The labelers' reliabilities come from all spans; enough plain ones make them known.
    many = pieces.where("rec_table = 'text_blocks'").withColumn("rec_id", F.col("rec_id") + 1000)
    more = pieces
    for k in range(3):
        more = more.unionByName(many.withColumn("rec_id", F.col("rec_id") + 100 * k))
    spans = personal.spans(more).cache()
    model = personal.fit(spans)
    found = {(r.rec_table, r.rec_id, r.line_no, r.category) for r in personal.accepted(spans, model).collect() if r.rec_id < 1000}
    b, f = "text_blocks", "findings"
    assert found == {(b, 0, 0, "email"), (b, 0, 1, "phone"), (b, 1, 0, "email"), (b, 1, 0, "name"), (b, 2, 0, "id_number"), (b, 4, 0, "address"), (b, 6, 0, "name"), (b, 6, 0, "phone"), (b, 6, 1, "name"), (b, 8, 0, "id_number"), (b, 12, 0, "email"), (f, 1, 0, "email"), (f, 2, 0, "id_number"), (f, 4, 0, "name")}
    made = {(r.rec_table, r.rec_id): r.clean_text for r in personal.redact(pieces, personal.spans(pieces), model).where("first_line = 0").collect()}
    assert made[b, 0] == "Ответ отправьте на [EMAIL] до пятницы.\nСвязь по телефону [PHONE]." and made[b, 5] == texts[5]
    assert personal.accepted(personal.spans(pieces.limit(0)), personal.fit(personal.spans(pieces.limit(0)))).count() == 0


@pytest.mark.parametrize(("text", "category", "value"), [
    ("Заявитель: Ахметов Айдар Маратович, тел.", "name", "Ахметов Айдар Маратович"), ("Signed by Kwame Mensah today.", "name", "Kwame Mensah"), ("contact Priya Sharma", "name", "Priya Sharma"), ("Владелец Сидоров Добрыня подал", "name", "Сидоров Добрыня"),
    ("на " + "a" * 100 + "." + "b" * 90 + "@" + "c" * 60 + ".mail.test сюда", "email", "a" * 100 + "." + "b" * 90 + "@" + "c" * 60 + ".mail.test"),
    ("живёт: 123456, г. Нижний Новгород, ул. " + "Длинная" * 40 + ", д. 5", "address", "123456, г. Нижний Новгород, ул. " + "Длинная" * 40 + ", д. 5"),
])
def test_unlisted_names_and_long_values(text, category, value):
    assert [(c, text[a:b]) for c, a, b, *_ in personal.propose(text)] == [(category, value)]


def test_no_names():
    assert not list(personal.propose("Signed by The Board")) and not list(personal.propose("Красная Площадь Москва"))


# Problem 9


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(k, rng.choice(["big"] * 6 + ["small", "mid", "mid", None]), " ".join(rng.sample(WORDS, rng.randint(5, 40)))) for k in range(1500)] + [(9001, "big", None), (9002, "big", "")]
    df = clash(spark.createDataFrame(docs, DOC))
    targets = spark.createDataFrame([("big", 0.4, 1.0), ("mid", 0.4, 3.0), ("small", 0.15, 1.5), ("none", 0.05, 2.0)], "source string, target_share double, max_repeats double")
    report = {r.source: r for r in mixing.shares(df, targets).collect()}
    assert abs(report["big"].actual_share - 0.4) < 0.002 and abs(report["mid"].actual_share - 0.4) < 0.002
    assert report["small"].average_repeats <= 1.5 and report["none"].mixed_tokens == 0
    counts = {r.doc_id: (r.source, r.tokens, r.copies) for r in mixing.mix(df, targets).collect()}
    for source, r in report.items():
        assert sum(t * c for s, t, c in counts.values() if s == source) == r.mixed_tokens
    # Budgets nest: with more for a source nothing leaves the mix.
    more = {r.doc_id: r.copies for r in mixing.mix(df, targets.withColumn("target_share", F.when(F.col("source") == "big", 0.45).otherwise(F.col("target_share")))).where("source = 'big'").collect()}
    assert all(more.get(k, 0) >= c for k, (s, _, c) in counts.items() if s == "big")
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.shares(df, targets.limit(0)).count() == 0


def test_tokens_equal_the_tokenizer(spark):
    import base64

    import tiktoken

    with open(mixing.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding_ = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Привет,  мир!\n\n  x = 12345;", "it's we'll", "", RU[0] + "\t" + EN[0]]
    made = {r.doc_id: r.tokens for r in mixing.token_counts(spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], DOC)).collect()}
    assert made == {k: len(encoding_.encode_ordinary(t)) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("text", "kind"), [("Рост 50%", "bare"), ("- рост 50%", "item"), ("текст R&D", "bare"), ("обр&nb", "broken"), ("обр<b", "broken"), ("путь %D0%B", "broken"), ("слово…", "omitted"), ("a | b | 3", "closed"), ("Конец.", "terminated"), ("", "bare")])
def test_ends(text, kind):
    assert truncation.automaton(text)[0] == kind
