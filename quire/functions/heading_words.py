"""Words of headings by language, as data."""

# Words that come before a number and open a chapter.
CHAPTER = {
    "en": "chapter", "fr": "chapitre", "de": "kapitel", "es": "capítulo", "pt": "capítulo", "it": "capitolo", "tr": "bölüm", "nl": "hoofdstuk", "pl": "rozdział", "id": "bab", "vi": "chương",
    "ru": "глава", "uk": "глава", "ar": "الفصل", "hi": "अध्याय", "th": "บทที่",
}
# Other words that come before a number.
NUMBERED = {
    "en": "part|section|book|lesson|unit", "fr": "partie|section|livre|leçon|unité", "de": "teil|abschnitt|buch|lektion|einheit", "es": "parte|sección|libro|lección|unidad", "pt": "parte|seção|livro", "it": "parte|sezione|libro",
    "tr": "kısım|kesit|kitap", "nl": "deel|sectie|boek", "pl": "część|sekcja|księga", "id": "bagian|seksi|buku", "vi": "phần|mục|quyển", "ru": "раздел|книга", "uk": "розділ|книга", "ar": "القسم|الكتاب", "hi": "भाग|खंड", "th": "ภาค|ตอน",
}
# Words that are headings without a number.
SINGLE = {
    "en": "prologue|epilogue|introduction|appendix", "fr": "prologue|épilogue|introduction|annexe", "de": "prolog|epilog|einleitung|anhang", "es": "prólogo|epílogo|introducción|apéndice", "pt": "prólogo|epílogo|introdução|apêndice",
    "it": "prologo|epilogo|introduzione|appendice", "tr": "önsöz|sonsöz|giriş|ek", "nl": "proloog|epiloog|inleiding|bijlage", "pl": "prolog|epilog|wstęp|aneks", "id": "prolog|epilog|pendahuluan|lampiran", "vi": "lời mở đầu|kết luận|giới thiệu|phụ lục",
    "zh": "序章|终章|終章|附录|附錄", "ja": "序章|終章|付録|附録|はじめに|あとがき", "ko": "프롤로그|에필로그|서문|부록", "ru": "пролог|эпилог|введение|приложение", "uk": "пролог|епілог|вступ|додаток", "ar": "مقدمة|خاتمة|ملحق", "hi": "प्रस्तावना|उपसंहार|परिशिष्ट", "th": "บทนำ|บทส่งท้าย|ภาคผนวก",
}
# Numbers in words, which may follow a chapter's word, and what may follow these.
WORDS = {
    "en": "(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)([-\\s](one|two|three|four|five|six|seven|eight|nine))?",
    "fr": "(un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|trente|quarante|cinquante|soixante|soixante-dix|quatre-vingt|quatre-vingt-dix)([-\\s](et[-\\s])?(un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize))?",
    "de": "(eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|elf|zwölf|dreizehn|vierzehn|fünfzehn|sechzehn|siebzehn|achtzehn|neunzehn|zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig)([-\\s](und\\s+)?(eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun))?",
    "es": "(uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|dieciséis|diecisiete|dieciocho|diecinueve|veinte|treinta|cuarenta|cincuenta|sesenta|setenta|ochenta|noventa)(\\s+y\\s+(uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve))?",
    "pt": "um|dois|três|quatro|cinco|seis|sete|oito|nove|dez|onze|doze|treze|catorze|quinze|dezesseis|dezessete|dezoito|dezenove|vinte",
    "it": "uno|due|tre|quattro|cinque|sei|sette|otto|nove|dieci|undici|dodici|tredici|quattordici|quindici|sedici|diciassette|diciotto|diciannove|venti",
    "tr": "bir|iki|üç|dört|beş|altı|yedi|sekiz|dokuz|on|on bir|on iki", "nl": "een|twee|drie|vier|vijf|zes|zeven|acht|negen|tien|elf|twaalf", "pl": "jeden|dwa|trzy|cztery|pięć|sześć|siedem|osiem|dziewięć|dziesięć|jedenaście|dwanaście",
    "id": "satu|dua|tiga|empat|lima|enam|tujuh|delapan|sembilan|sepuluh|sebelas|dua belas", "vi": "một|hai|ba|bốn|năm|sáu|bảy|tám|chín|mười|mười một|mười hai",
}
# Digits of a language's numbers, where they are not Latin digits and roman numerals.
DIGITS = {"ar": "[0-9٠-٩]+", "hi": "[0-9०-९]+", "th": "[0-9]+"}
# Numbered headings that are not a word before a number: the chapter's form and others.
FORMS = {
    "zh": ("第\\s*[0-9一二三四五六七八九十百千零〇两兩]+\\s*章", "第\\s*[0-9一二三四五六七八九十百千零〇两兩]+\\s*(节|節)|卷\\s*[0-9一二三四五六七八九十百千零〇两兩]+"),
    "ja": ("第\\s*[0-9一二三四五六七八九十百千零〇两兩]+\\s*章", "第\\s*[0-9一二三四五六七八九十百千零〇两兩]+\\s*節"),
    "ko": ("제\\s*[0-9]+\\s*장", "제\\s*[0-9]+\\s*절"),
}
# Markers of regions.
TOC = {
    "en": "contents|table of contents|contents page", "zh": "目录|目錄|章节目录|章節目錄|篇目|总目录|總目錄", "ja": "目次|目錄|もくじ|総目次", "ko": "목차", "fr": "sommaire|table des matières", "de": "inhalt|inhaltsverzeichnis", "es": "contenido|índice|tabla de contenido|tabla de contenidos",
    "pt": "conteúdo|sumário|índice", "it": "indice|sommario", "ru": "содержание|оглавление", "ar": "الفهرس|جدول المحتويات|المحتويات", "hi": "विषय सूची|अनुक्रमणिका", "tr": "içindekiler", "nl": "inhoudsopgave|inhoud", "pl": "spis treści", "uk": "зміст", "id": "daftar isi", "vi": "mục lục", "th": "สารบัญ",
}
FRONT = {
    "en": "preface|foreword|introduction|prologue|author's note|authors note", "zh": "前言|序|序言|序文|自序|作者序|编者序|編者序|导言|導言|引言|序章", "ja": "まえがき|序文|序|はじめに|プロローグ|序章", "ko": "머리말|서문|서론|프롤로그", "fr": "préface|avant-propos|introduction|prologue",
    "de": "vorwort|einleitung|prolog", "es": "prólogo|prefacio|introducción", "pt": "prefácio|prólogo|introdução", "it": "prefazione|prologo|introduzione", "ru": "предисловие|введение|пролог", "ar": "مقدمة|تمهيد|مدخل|استهلال", "hi": "प्रस्तावना|भूमिका|परिचय|प्राक्कथन",
    "tr": "önsöz|giriş|prolog", "nl": "voorwoord|inleiding|proloog", "pl": "przedmowa|wstęp|prolog", "uk": "передмова|вступ|пролог", "id": "kata pengantar|pendahuluan|prolog", "vi": "lời nói đầu|lời tựa|giới thiệu|mở đầu", "th": "คำนำ|บทนำ|เกริ่นนำ",
}
APPENDIX = {
    "en": "appendix|appendices", "zh": "附录|附錄", "ja": "付録|附録|補遺", "ko": "부록|별첨", "fr": "annexe|annexes", "de": "anhang|anhänge", "es": "apéndice|anexo|anexos", "pt": "apêndice|anexo|anexos", "it": "appendice|appendici|allegato", "ru": "приложение|приложения", "ar": "ملحق|ملاحق",
    "hi": "परिशिष्ट|परिशिष्टें", "tr": "ek|ekler", "nl": "bijlage|bijlagen", "pl": "aneks|załącznik|załączniki", "uk": "додаток|додатки", "id": "lampiran", "vi": "phụ lục", "th": "ภาคผนวก",
}
BACK = {
    "en": "afterword|epilogue|postscript", "zh": "后记|後記|跋|终章|終章", "ja": "あとがき|後書き|エピローグ", "ko": "후기|맺음말|에필로그", "fr": "postface|épilogue", "de": "nachwort|epilog", "es": "epílogo|posfacio", "pt": "epílogo|posfácio", "it": "epilogo|postfazione", "ru": "послесловие|эпилог",
    "ar": "خاتمة|كلمة ختامية", "hi": "उपसंहार|पश्चलेख", "tr": "sonsöz|epilog", "nl": "nawoord|epiloog", "pl": "posłowie|epilog", "uk": "післямова|епілог", "id": "epilog|penutup", "vi": "lời bạt|hậu ký|kết từ", "th": "บทส่งท้าย|ปัจฉิมลิขิต",
}
REGIONS = {"toc": TOC, "front_matter": FRONT, "appendix": APPENDIX, "back_matter": BACK}

LATIN_NUMBER = "[0-9]+|[ivxlcdm]+"
#: What may follow a heading's number or word.
TITLE = "([\\s:：.\\-–—].*)?$"
LABEL = "(\\s*[:：.;；\\-–—].*|\\s+([0-9]{1,4}|[ivxlcdm]{1,7}|[a-z])[.:)]?)?$"


def rules() -> list[tuple[str, str, str]]:
    """(language, rule, pattern) for every rule that a language has; patterns are read without regard to case."""
    out = []
    for lang in SINGLE:
        number = DIGITS.get(lang, LATIN_NUMBER)
        chapter, other = FORMS[lang] if lang in FORMS else (f"({CHAPTER[lang]})\\s+({number}{'|' + WORDS[lang] if lang in WORDS else ''})", f"({NUMBERED[lang]})\\s+({number})")
        out += [(lang, "chapter", f"^({chapter}){TITLE}"), (lang, "numbered", f"^({other}){TITLE}"), (lang, "single", f"^({SINGLE[lang]}){TITLE}")]
        out += [(lang, region, f"^({words[lang]}){LABEL}") for region, words in REGIONS.items()]
    return out
