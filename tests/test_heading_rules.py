"""Heading rules as a table: every rule of every language, and a plan that does not grow with them."""

import re

import pytest

from quire.functions import heading_words as words
from quire.operators import heading_rules

#: A line of each rule in each language.
LINES = {
    "en": ["Chapter IV: On", "Lesson 2", "Epilogue", "Contents", "Foreword", "Appendix A", "Postscript:"],
    "fr": ["Chapitre vingt et un", "Leçon 3 – Fin", "Annexe", "Table des matières", "Préface", "ANNEXES", "Postface"],
    "de": ["KAPITEL zwölf", "Abschnitt 2.", "Einleitung", "Inhalt", "Vorwort", "Anhang 2", "Nachwort"],
    "es": ["Capítulo treinta y uno", "Sección XII", "APÉNDICE", "Índice", "Prefacio", "Anexo b)", "Posfacio"],
    "pt": ["Capítulo três", "Seção 4", "Introdução", "Sumário", "Prefácio", "Apêndice", "Posfácio"],
    "it": ["Capitolo venti", "Sezione 1", "Prologo", "Indice", "Prefazione", "Allegato 3", "Postfazione"],
    "tr": ["Bölüm on iki", "Kısım 2", "Giriş", "İçindekiler", "Önsöz", "Ekler", "Sonsöz"],
    "nl": ["Hoofdstuk zeven", "Deel II", "Bijlage", "Inhoud", "Voorwoord", "Bijlagen", "Nawoord"],
    "pl": ["Rozdział pięć", "Część 1", "Wstęp", "Spis treści", "Przedmowa", "Załącznik 2", "Posłowie"],
    "id": ["Bab sepuluh", "Bagian 3", "Pendahuluan", "Daftar isi", "Kata pengantar", "Lampiran", "Penutup"],
    "vi": ["Chương mười hai", "Phần 2", "Kết luận", "Mục lục", "Lời tựa", "Phụ lục", "Lời bạt"],
    "zh": ["第十二章 开始", "第三节", "附录", "目录", "前言", "附錄", "后记"],
    "ja": ["第3章", "第 四 節", "はじめに", "目次", "まえがき", "補遺", "あとがき"],
    "ko": ["제 3 장", "제2절", "프롤로그", "목차", "머리말", "별첨", "후기"],
    "ru": ["Глава IV", "Раздел 3", "Эпилог", "Оглавление", "Предисловие", "Приложения", "Послесловие"],
    "uk": ["ГЛАВА 2", "Розділ 3", "Вступ", "Зміст", "Передмова", "Додатки", "Післямова"],
    "ar": ["الفصل ٣", "القسم 2", "خاتمة", "المحتويات", "تمهيد", "ملاحق", "كلمة ختامية"],
    "hi": ["अध्याय ३", "खंड 2", "उपसंहार", "विषय सूची", "भूमिका", "परिशिष्ट", "पश्चलेख"],
    "th": ["บทที่ 3", "ตอน 2", "บทนำ", "สารบัญ", "คำนำ", "ภาคผนวก", "ปัจฉิมลิขิต"],
}
RULES = ["chapter", "numbered", "single", "toc", "front_matter", "appendix", "back_matter"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_rule_of_every_language(spark):
    assert set(LINES) == set(words.SINGLE) and len(LINES) == 19 and len(words.rules()) == 19 * 7
    langs = sorted(LINES)
    docs = frame(spark, [(i, "\n".join(["  some words of prose that go on, as they do", *LINES[lang], f" {LINES[lang][0]} "]), lang) for i, lang in enumerate(langs)])
    got = {(r.doc_id, r.line_no): (r.strong, r.region, r.level) for r in heading_rules.marked_lines(docs).collect()}
    for i, lang in enumerate(langs):
        assert (i, 0) not in got and got[i, 8] == ("chapter", None, 2)
        for k, rule in enumerate(RULES):
            strong, region, level = got[i, k + 1]
            assert (strong if k < 3 else region) == rule, (lang, LINES[lang][k])
            assert level == (2 if rule == "chapter" else 1)


def test_words_of_other_languages_do_not_count(spark):
    docs = frame(spark, [(1, "Chapter 1\nKapitel 1\nchapters 1\nChapter one hundred\nchapter twenty-one. So\nIntroductions\nContents of it\nAppendix B:", "en"), (2, "Chapter 1\nKapitel 1", "de"), (3, "Chapter 1", None), (4, "Chapter 1", "xx"), (5, None, "en"), (6, "", "en")])
    got = sorted((r.doc_id, r.line_no) for r in heading_rules.marked_lines(docs).collect())
    assert got == [(1, 0), (1, 3), (1, 4), (1, 7), (2, 1)]


def test_rules_are_a_parameter_and_the_plan_stays(spark):
    docs = frame(spark, [(1, "Canto 3\nChapter 1\nScene II", "en")])
    own = [("en", "chapter", "^canto\\s+[0-9]+$"), ("en", "chapter", "^scene\\s+[ivx]+$")]
    assert [r.title for r in heading_rules.marked_lines(docs, own).orderBy("line_no").collect()] == ["Canto 3", "Scene II"]
    plan = lambda table: re.sub(r"#?[0-9]+L?", "", heading_rules.marked_lines(docs, table)._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0])
    assert plan(own) == plan(None)
    with pytest.raises(ValueError, match="at most"):
        heading_rules.rule_table(spark, own * 2000)
