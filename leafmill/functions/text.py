"""String functions over columns: normalisation, tokens, numbers, hyphens."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages written from right to left
RIGHT_TO_LEFT = ("ar", "dv", "fa", "ha", "he", "iw", "ji", "ps", "sd", "ug", "ur", "yi")
#: Hebrew maqaf, the hyphen of the default language
MAQAF = "־"
#: Letters that only end words
FINAL_LETTERS = "םןץףך"
QUOTES = "'\"‛“”‘’׳״"


def left_to_right(lang: Column) -> Column:
    return ~F.lower(lang).isin(*RIGHT_TO_LEFT)


def without_extension(name: Column, all_of_them: bool = False) -> Column:
    """File name without its last extension, or without all; a leading dot stays."""
    return F.regexp_replace(name, r"(?<!^)[.].*$" if all_of_them else r"(?<!^)[.][^.]*$", "")


def rounded_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def millionths(numerator: Column, denominator: Column) -> Column:
    """A fraction of positive whole numbers in millionths, rounded half up, by whole numbers only."""
    n, d = numerator.cast("long"), denominator.cast("long")
    return F.call_function("div", 2_000_000 * n + d, 2 * d)


def six_decimals(numerator: Column, denominator: Column) -> Column:
    k = millionths(numerator, denominator)
    return F.format_string("%d.%06d", F.call_function("div", k, F.lit(1_000_000)), k % 1_000_000)


def characters(s: Column) -> Column:
    """Array of characters with their combining marks; a leading mark stands alone."""
    return F.regexp_extract_all(s, F.lit(r"(?s)(.\p{M}*)"), 1)


def tokens(s: Column) -> Column:
    """White-space tokens; a leading empty one is kept, trailing ones are not."""
    parts = F.split(s, r"\s+")
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def single_paragraph_breaks(s: Column) -> Column:
    return F.regexp_replace(s, r"\n\n+", "\n")


def ascii_folded(s: Column) -> Column:
    """Every character beyond ASCII as a question mark."""
    return F.regexp_replace(s, r"[^\x00-\x7F]", "?")


def without_outer_punctuation(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\p{Punct}+", ""), r"(?U)\p{Punct}+$", "")


def alphabet_mask(s: Column) -> Column:
    """Latin, Cyrillic and Greek letters as L, C and G."""
    for script, letter in (("Latin", "L"), ("Cyrillic", "C"), ("Greek", "G")):
        s = F.regexp_replace(s, rf"\p{{Is{script}}}", letter)
    return s


def reversed_numbers(s: Column) -> Column:
    """Numbers that were written in the other direction, turned round.

    A plain or decimal number of two digits or more is reversed; where digits
    precede Hebrew letters only the digits are.
    """
    digits, letters = F.regexp_extract(s, r"^(\d+)([֐-׿]+)$", 1), F.regexp_extract(s, r"^(\d+)([֐-׿]+)$", 2)
    return F.when(s.rlike(r"^\d+\.?\d+$"), F.reverse(s)).when(digits != "", F.concat(F.reverse(digits), letters)).otherwise(s)


def ends_with_hyphen(s: Column) -> Column:
    return s.rlike(r"^(?s).+[-־]$")


#: Presentation forms of Hebrew letters (U+FB1D to U+FB4E) and what they stand for, from Unicode's own decompositions.
PRESENTATION_FORMS = {chr(c): n for c in range(0xFB1D, 0xFB4F) if (n := unicodedata.normalize("NFD", chr(c))) != chr(c)}

# fixed values: points and letters by name
SHEVA_TO_SEGOL, HOLAM, QUBUTS, SHIN_DOT = "ְ-ֳֵֶ", "ֹ", "ֻ", "ׁ"
KHIRIK, PASEKH, KOMETS, DAGESH, RAFE, SIN_DOT = "ִ", "ַ", "ָ", "ּ", "ֿ", "ׂ"
ALEF, BEYS, VOV, YUD, KHOF, PE, SHIN, TOF = "א", "ב", "ו", "י", "כ", "פ", "ש", "ת"
TSVEY_VOVN, VOV_YUD, TSVEY_YUDN = "װ", "ױ", "ײ"
#: fixed values: the letters that carry each point in standard spelling; other points are never written
CARRIERS = {KOMETS: ALEF, PASEKH: ALEF + TSVEY_YUDN, KHIRIK: YUD, DAGESH: VOV + KHOF + PE + BEYS + TOF, RAFE: BEYS + PE + KHOF, SIN_DOT: SHIN}
#: fixed values: two letters that are one sign unless this point follows
DIGRAPHS = ((YUD + YUD, TSVEY_YUDN, KHIRIK), (VOV + VOV, TSVEY_VOVN, DAGESH), (VOV + YUD, VOV_YUD, KHIRIK))
#: fixed values: signs and the one that is written for them, in this order
SIGNS = (
    (("-", "⸗"), MAQAF),
    (("\U0001d199", "←", "–", "—"), "—"),
    (("'", "‛", "’", "׳"), "’"),
    (("’’", '"', "“", "״"), "“"),
    ((",,", "‚‚"), "„"),
    (("▼", "◦", "№", "⁂"), "•"),
)


def decomposed(s: Column) -> Column:
    """Presentation forms as letters and points."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), PRESENTATION_FORMS.items(), s)


def _carried(s: Column, point: str) -> Column:
    """Drops a point wherever it stands on no letter that carries it."""
    return F.regexp_replace(s, f"(?<![{CARRIERS[point]}]){point}", "")


def simplified(s: Column, mask_alphabets: bool = False) -> Column:
    """Yiddish text in standard letters, points and signs, for comparisons."""
    s = F.regexp_replace(decomposed(s), f"[{SHEVA_TO_SEGOL}{HOLAM}{QUBUTS}{SHIN_DOT}]", "")
    s = _carried(s, KOMETS)
    s = F.replace(s, F.lit(YUD + YUD + PASEKH), F.lit(TSVEY_YUDN + PASEKH))
    for pair, sign, unless in DIGRAPHS:
        s = F.regexp_replace(s, f"{pair}(?!{unless})", sign)
    for point in (PASEKH, KHIRIK, DAGESH, RAFE, SIN_DOT):
        s = _carried(s, point)
    for signs, one in SIGNS:
        s = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(one)), (x for x in signs if x != one), s)
    return alphabet_mask(s) if mask_alphabets else s


#: fixed values: letters with points that have a sign of their own
COMPOSED = tuple((x, unicodedata.normalize("NFD", x)) for x in "וּיִײַ") + tuple((sign, pair) for pair, sign, _ in (DIGRAPHS[1], DIGRAPHS[2], DIGRAPHS[0])) + tuple((x, unicodedata.normalize("NFD", x)) for x in "אַאָבֿכּפּפֿשׂתּ")
_BEYS_WITH_DAGESH = ("בּ", BEYS + DAGESH)


def _without_beys_dagesh(s: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(BEYS)), _BEYS_WITH_DAGESH, s)


def precombined(s: Column) -> Column:
    """Letters and their points as single signs, double letters as digraphs."""
    return _without_beys_dagesh(reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), COMPOSED, s))


def with_points(s: Column, digraphs: bool = False) -> Column:
    """The inverse of ``precombined``; digraphs are taken apart only if asked for."""
    pairs = [(sign, pair) for sign, pair in COMPOSED if digraphs or sign not in (TSVEY_VOVN, VOV_YUD, TSVEY_YUDN)]
    s = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs, s)
    # a double yud with a pasekh is always the one sign
    return _without_beys_dagesh(F.replace(s, F.lit(YUD + YUD + PASEKH), F.lit(TSVEY_YUDN + PASEKH)))


def standard_punctuation(s: Column) -> Column:
    """The hyphen of the language, and one sign for abbreviations."""
    return F.translate(s, "-′׳″״", MAQAF + '""""')


def without_points(s: Column) -> Column:
    return F.regexp_replace(with_points(s), f"[{KHIRIK}{PASEKH}{KOMETS}{DAGESH}{RAFE}{SIN_DOT}]", "")


# fixed values: how each letter is romanised
ROMAN = {
    "א": "", "אַ": "a", "אָ": "o", "ב": "b", "בֿ": "v", "ג": "g", "דזש": "dzh", "ד": "d", "ה": "h", "ו": "u",
    "וּ": "u", "װ": "v", "ױ": "oy", "זש": "zh", "ז": "z", "ח": "kh", "טש": "tsh", "ט": "t", "יִ": "i", "ײ": "ey",
    "ײַ": "ay", "כ": "kh", "כּ": "k", "ך": "kh", "ל": "l", "מ": "m", "ם": "m", "נ": "n", "ן": "n", "ס": "s",
    "ע": "e", "פּ": "p", "פֿ": "f", "פ": "f", "ף": "f", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r", "ש": "sh",
    "שׂ": "s", "תּ": "t", "ת": "s", "־": "-",
}
# fixed values: words whose spelling is also that of a Germanic word, which are read as that
HOMOGRAPHS = tuple("אין צום בין ברי מיד קין שער מעגן צו מאַנס טוען מערער".split())
HEBREW = "א-תװ-ײיִײַשׂאַאָוּכּפּתּבֿפֿ"
HEBREW_WORD = f'[{HEBREW}־"-]+'


def romanized(s: Column) -> Column:
    """Precombined letters in Latin ones; a plain yud before a vowel is y, else i."""
    letters = sorted(ROMAN.items(), key=lambda kv: -len(kv[0]))
    s = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), letters, s)
    return F.replace(F.regexp_replace(s, f"{YUD}(?=[aeiou])", "y"), F.lit(YUD), F.lit("i"))


def transliterated(s: Column) -> Column:
    """Romanised Yiddish, each word as it is spelled; ``operators.transliterate`` knows words that are read otherwise."""
    return romanized(precombined(s))


#: Marks a place where letters on both sides don't belong together and a new stem begins.
BREAK = "‌"
# fixed values: romanised stems with the place (|) where a new stem begins; ^ and $ are the ends of a word
STEMS = tuple(
    """^far|ey ^anti|intel ^biz|itst ^oyb|n|oy ^oys|ib ge|ibt ge|iblt tsu|ibn$ ^oys|eydl ge|eydl tsu|eydl ^ayn|eyg ge|ey tsu|ey ge|indlt ^um|oys ^um|ayn ^um|eydl ^um|eydel ^ur|eynikl
    ^ba|ayn ge|ayn tsu|ayn durkh|ayl farbay|ayl ge|ay tsu|ayl ge|irtst tsu|irtsn$ grob|ayz pres|ayz halb|indzl hinter|oyg zun|oyfgang moyl|eyzl ^far|um ^far|ur ^for|ur ^far|ibl ^far|interes
    ^ra|yon$ ^ra|yonen$ ba|yornt ba|yort ma|yontik ma|yontkes ma|yonez ma|yestet pa|yats$ pa|yatsn$ pa|yatseve fara|yorik ^ka|yor ^a|yed ^a|yo$
    ge|yogt ge|yeg ^ge|yog$ ge|yavet ge|yadet ge|yopet ge|yabede ge|yakhmert tse|yakhmert tse|yakhmet ge|yodlt ge|yomer tse|yomer ge|yutshet ge|yoyr ^ge|yet$ ^ge|yeter ^ge|yete ^ge|yetn ^ge|yets ge|yentst ge|yenket ge|yekt ^ge|yert$ ple|yade
    pro|yekt umlo|yal lo|yal parano|ye t|stu$ ^elt|st ^kelt|st ^balibt|st ^geburt|s ^arbet|s ^arbayt|s ^demolt|s ^got|s ^gut|s ^gesheft|s ^halt|st ^bahalt|st ^farhalt|st ^derhalt|st ^shlekht|s$
    ^shpalt|st ^tseshpalt|st ^shpreyt|st ^tseshpreyt|st ^farshpreyt|st shpet|st ^rekht|s$ ^forvert|s$ ^pik|hol ^tsurik|halt ^krik|halt ^aroys|h""".split()
)
# fixed values: romanised groups and their letters
LETTERS = {
    "iyi": "יִייִ", "ayi": "ײַיִ", "eyi": "ײיִ", "oyi": "ױיִ", "uvu": "וּװוּ", "ay": "ײַ", "ey": "ײ", "oy": "ױ", "zh": "זש", "kh": "כ", "sh": "ש", "ts": "צ",
    "ia": "יִאַ", "ai": "אַיִ", "ie": "יִע", "ei": "עיִ", "ii": "יִיִ", "io": "יִאָ", "oi": "אָיִ", "iu": "יִו", "ui": "ויִ", "yi": "ייִ", "iy": "יִי",
    "uv": "וּװ", "vu": "װוּ", "uu": "וּו", "uy": "וּי",
    "a": "אַ", "b": "ב", "d": "ד", "e": "ע", "f": "פֿ", "g": "ג", "h": "ה", "i": "י", "k": "ק", "l": "ל", "m": "מ", "n": "נ", "o": "אָ", "p": "פּ", "r": "ר", "s": "ס", "t": "ט",
    "u": "ו", "v": "װ", "y": "י", "z": "ז",
}
#: fixed values: letters that have another form at the end of a word
FINALS = {"כ": "ך", "מ": "ם", "נ": "ן", "פֿ": "ף", "צ": "ץ"}


def detransliterated(s: Column) -> Column:
    """Precombined Yiddish letters for romanised text.

    Stems that begin inside a word are parted first. A stem's initial vowel
    other than a, e and o stands on a silent alef; the last letter of a word of
    more than one letter takes its final form.
    """
    s = F.lower(s)
    for stem in STEMS:
        found = stem.replace("|", "").replace("^", r"\b").replace("$", r"\b")
        s = F.regexp_replace(s, found, stem.strip("^$").replace("|", BREAK))
    # "oys" and a stem in h, but for two words in "oysh"
    s = F.regexp_replace(s, r"\boysh(?!ers?\b|vits(?:er)?\b)", f"oys{BREAK}h")
    start = f"(?<![a-z{ALEF}-{TOF}])"
    s = F.regexp_replace(s, f"{start}(?=ay|ey|oy|u|i)", ALEF)
    for group, letters in sorted(LETTERS.items(), key=lambda kv: -len(kv[0])):
        s = F.replace(s, F.lit(group), F.lit(letters))
    inside, hebrew = f"(?<=[{HEBREW}{BREAK}])", f'(?![{HEBREW}{BREAK}“"])'
    for letter, final in FINALS.items():
        s = F.regexp_replace(s, f"{inside}{letter}{hebrew}", final)
    return F.replace(s, F.lit(BREAK), F.lit(""))


def without_dram_sign(s: Column) -> Column:
    """Simplified text of a corpus line, without the sign U+058F that marks unreadable places."""
    return F.replace(simplified(s), F.lit("֏"), F.lit(""))


def iso_offset(t: Column) -> Column:
    """A point in time as ISO text with its offset."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")
