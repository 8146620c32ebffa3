"""Text functions as Column expressions: character classes, runs, n-grams, segmentation, dates and numbers.

Regular expressions spell their classes out, and positions are code points, as in instr and substring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code-point ranges of the character categories.
KANJI = "\\u4E00-\\u9FFF\\u3400-\\u4DBF\\u3005\\uF900-\\uFAFF\\x{20000}-\\x{2A6DF}"
KATAKANA = "\\u30A0-\\u30FF\\u31F0-\\u31FF\\uFF65-\\uFF9F"
HIRAGANA = "\\u3040-\\u309F"
LATIN = "A-Za-z\\uFF21-\\uFF3A\\uFF41-\\uFF5A"
DIGIT = "0-9\\uFF10-\\uFF19"
SPACE = " \\t\\n\\r\\u3000\\u00A0"
BLANKS = " \t\n\r\u3000\u00a0"
CATEGORIES = {
    "KANJI": KANJI, "KATAKANA": KATAKANA, "HIRAGANA": HIRAGANA, "LATIN": LATIN, "DIGIT": DIGIT, "SPACE": SPACE,
}
RUN = "|".join(f"[{c}]+" for c in CATEGORIES.values()) + f"|[^{''.join(CATEGORIES.values())}]+"
#: A network address, which begins like a numbered heading.
ADDRESS = "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9.])"
#: White space and punctuation that a search key drops.
SEARCH_STRIP = "[\\s。、！？!?「」『』（）()・…,.:;]+"


def char_category(ch: Column) -> Column:
    """Category of a text's first character: KANJI, KATAKANA, HIRAGANA, LATIN, DIGIT, SPACE or SYMBOL."""
    out = F.lit("SYMBOL")
    for name, chars in reversed(CATEGORIES.items()):
        out = F.when(ch.rlike(f"^[{chars}]"), name).otherwise(out)
    return F.when(ch == "", None).otherwise(out)


def category_runs(text: Column, keep_space: bool = False) -> Column:
    """Maximal runs of one category; runs of white space are dropped unless asked for."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return runs if keep_space else F.filter(runs, lambda r: ~r.rlike(f"^[{SPACE}]"))


def chars(text: Column) -> Column:
    """The characters of a text but white space: the tokens of last resort."""
    return F.array_remove(F.split(F.translate(text, BLANKS, ""), ""), "")


def ngrams(text: Column, n: int = 2) -> Column:
    """All n-grams of characters, with repeats; a shorter text is one n-gram, an empty one has none."""
    size = F.char_length(text)
    some = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(some)


def search_key(text: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.lower(F.regexp_replace(text, SEARCH_STRIP, ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def contains_term(term: Column, text: Column) -> Column:
    """Containment; a term of ASCII word characters needs other neighbours, so AP isn't found in API."""
    word = F.concat(F.lit("(?<![A-Za-z0-9_])"), term, F.lit("(?![A-Za-z0-9_])"))
    plain = term.rlike("^[A-Za-z0-9_]+$")
    return F.when(term == "", False).when(plain, F.regexp_like(text, word)).otherwise(F.contains(text, term))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.filter(F.transform(F.split(text, "\\n[ \\t]*\\n\\s*"), F.trim), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences by enders and line ends, without the quote depth that the kernel in operators.segment keeps.

    An ASCII full stop ends a sentence before white space only, and not after a digit.
    """
    marked = F.regexp_replace(text, "([。！？!?]+[」』）)\"']*|(?<![0-9])\\.(?=\\s|$)|\\n)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def is_heading(line: Column) -> Column:
    numbered = line.rlike(f"^\\s*(?!{ADDRESS})([0-9]+[.．][0-9.．]*|第[0-9一二三四五六七八九十]+[章節条項])\\s*\\S") & (F.char_length(line) <= 60)
    return line.rlike("^#{1,6}\\s") | line.rlike("^[■□◆◇●▼【]") | (numbered & ~line.rlike("[。.!?！？]\\s*$"))


def is_bullet(line: Column) -> Column:
    return line.rlike("^\\s*([-*+・‣]|[0-9]+[.)]|[①-⑳])\\s*\\S")


def is_fence(line: Column) -> Column:
    return line.rlike("^\\s*(```|~~~)")


def contact_line(line: Column) -> Column:
    """A line with an address, a telephone number or a URL."""
    return line.rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+|[0-9]{2,4}-[0-9]{2,4}-[0-9]{3,4}|https?://")


def fiscal_year(iso: Column, first_month: int = 4) -> Column:
    """FYyyyy of a date, month or year string; null if it is none."""
    year = F.try_to_number(F.substring(iso, 1, 4), F.lit("9999")).cast("int")
    month = F.try_to_number(F.substring(iso, 6, 2), F.lit("99")).cast("int")
    named = F.concat(F.lit("FY"), (year - (month < first_month).cast("int")).cast("string"))
    whole = iso.rlike("^[0-9]{4}$")
    return F.when(whole, F.concat(F.lit("FY"), iso)).when(iso.rlike("^[0-9]{4}.[0-9]{2}"), named)


def time_compatible(want: Column, value: Column) -> Column:
    """Whether a time value meets a constraint of coarser or equal granularity."""
    by_year = want.rlike("^[0-9]{4}$") & (F.substring(value, 1, 4) == want)
    by_month = want.rlike("^.{4}-.{2}$") & (F.substring(value, 1, 7) == want)
    want_fy = want.startswith("FY") & (
        F.coalesce(fiscal_year(value) == want, F.lit(False))
        | ((F.char_length(value) == 4) & (value == F.substring(want, 3, 4)))
    )
    value_fy = value.startswith("FY") & ~want.startswith("FY") & F.coalesce(fiscal_year(want) == value, F.lit(False))
    plain = ~want.startswith("FY") & ~value.startswith("FY") & (by_year | by_month)
    return (want == value) | want_fy | value_fy | plain


def shift_date(ref: Column, n: Column, unit: str) -> Column:
    """A date moved by days (a date), weeks (the Monday), months (yyyy-MM) or years (yyyy), as a string."""
    if unit == "day":
        return F.date_format(F.date_add(ref, n), "yyyy-MM-dd")
    if unit == "week":
        return F.date_format(F.trunc(F.date_add(ref, n * 7), "week"), "yyyy-MM-dd")
    if unit == "month":
        return F.date_format(F.add_months(ref, n), "yyyy-MM")
    if unit == "year":
        return (F.year(ref) + n).cast("string")
    if unit == "fiscal_year":
        return F.concat(F.lit("FY"), (F.year(ref) - (F.month(ref) < 4).cast("int") + n).cast("string"))
    raise ValueError(f"unknown unit {unit}")


def number(text: Column) -> Column:
    """Value of an ASCII number with thousands commas and one of the units 万, 億, 兆; null if it is none."""
    digits = F.regexp_extract(text, "^[約およそざっと]*([0-9][0-9,]*(?:\\.[0-9]+)?)", 1)
    unit = F.regexp_extract(text, "([千万億兆])", 1)
    scale = F.when(unit == "千", 1e3).when(unit == "万", 1e4).when(unit == "億", 1e8).when(unit == "兆", 1e12).otherwise(1.0)
    return F.when(digits != "", F.expr("1").cast("double") * F.regexp_replace(digits, ",", "").try_cast("double") * scale)


def piece_flags(piece: Column) -> Column:
    """char, ascii, digit and symbol flags of a vocabulary piece."""
    flags = [
        F.when(F.char_length(piece) == 1, "char"),
        F.when(piece.rlike("^[\\x00-\\x7F]+$"), "ascii"),
        F.when(piece.rlike(f"^[{DIGIT}]+$"), "digit"),
        F.when(~piece.rlike(f"[{KANJI}{KATAKANA}{HIRAGANA}{LATIN}{DIGIT}\\u00C0-\\u024F]"), "symbol"),
    ]
    return F.array_compact(F.array(*flags))


def contamination(piece: Column, long: int = 12) -> Column:
    """Reasons to doubt a vocabulary piece, in a fixed order; compatibility forms are the kernel's to tell."""
    kana = "\\u3040-\\u30FF\\u4E00-\\u9FFF"
    reasons = [
        F.when(piece.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFD\\uFEFF]"), "control_char"),
        F.when(piece.rlike("[\\uFF61-\\uFF9F]"), "halfwidth_kana"),
        F.when(piece.rlike("[^A-Za-z0-9_\\u00C0-\\u024F\\s\\u3040-\\u30FF\\u3400-\\u9FFF]{3,}"), "symbol_run"),
        F.when(piece.rlike("(.)\\1{3,}"), "repeated_char"),
        F.when((F.char_length(piece) >= long) & ~piece.rlike("^[\\x00-\\x7F]+$"), "abnormal_length"),
        F.when(piece.rlike(f"[{kana}]") & piece.rlike("[A-Za-z]") & piece.rlike("[0-9]"), "mixed_script"),
    ]
    return F.array_compact(F.array(*reasons))


def query_intent(text: Column) -> tuple[Column, Column]:
    """Intent and answer type of a question by the first rule that matches."""
    intent, answer = F.lit("lookup"), F.lit("NULL")
    for pattern, name, kind in reversed(INTENT_RULES):
        hit = F.lower(text).rlike(pattern)
        intent, answer = F.when(hit, name).otherwise(intent), F.when(hit, kind).otherwise(answer)
    return intent, answer


#: Ordered rules of query_intent: pattern, intent, answer type.
INTENT_RULES = [
    ("とは[？?]?$|what is|meaning of|definition", "definition", "TEXT"),
    ("方法|やり方|どうやって|how to|how do", "how_to", "TEXT"),
    ("なぜ|理由|原因|why|reason", "reason", "TEXT"),
    ("違い|比較|difference|versus|compare", "compare", "TEXT"),
    ("いくら|料金|価格|how much|price|cost", "search_value", "MONEY"),
    ("いつ|何日|when|which date", "search_value", "DATE"),
    ("どこ|場所|where|which place", "search_value", "LOCATION"),
    ("誰|だれ|who |whose", "search_value", "PERSON"),
    ("いくつ|何件|何人|how many|number of", "search_value", "NUMBER"),
    ("一覧|列挙|list of|which of", "list", "LIST"),
    ("条件|場合|condition|under which", "condition", "TEXT"),
    ("手順|手続|procedure|steps", "procedure", "TEXT"),
    ("仕様|specification", "specification", "TEXT"),
    ("ますか[？?]?$|ですか[？?]?$|^(is|are|does|do|can) ", "yes_no", "BOOLEAN"),
]
