"""Text that looks the same but is made of other characters: one consistent form for every row.

Cases: wide, styled and joined forms of letters and digits; letters with separate accents; invisible characters;
spaces other than the plain one; letters of another script inside a Latin word. Left as they are: composed accents,
Greek letters used as symbols, raised and lowered signs, dashes, quotes, and words wholly in another script.

Invisible characters, spaces and letters of other scripts are mapped by tables. What a letter with its accents, or a
variant of a letter, stands for is told by collation: the letters that occur are grouped with the plain ones under an
accent-sensitive Unicode collation, a class has one canonical member, and that is joined back.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialize

# Letters of other scripts that pass for a Latin letter, each followed by that letter.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ѴV ҮY ҺH ӀI ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj ѵv үy һh ӏl ԁd ԍg ԛq ԝw"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo"
ARMENIAN = "ՍU ՏS ՕO ԼL հh ոn սu ցg օo զq լl"
CHEROKEE = "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏎS ᏏB ᏒR ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
PHONETIC = "ɑa ɡg ɩi ʋv ʏY"
_PAIRS = " ".join((CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, PHONETIC)).split()
FOREIGN, LATIN = "".join(p[0] for p in _PAIRS), "".join(p[1] for p in _PAIRS)

#: Invisible characters (fixed values).
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Those that are ordinary between characters of other scripts or within emoji: joiners, variation selectors, tags.
JOINERS = "\\x{200c}\\x{200d}\\x{fe00}-\\x{fe0f}\\x{e0020}-\\x{e007f}"
#: Spaces other than the plain one, and letters without a shape (fixed values).
SPACES = "\u00a0\u115f\u1160\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u2800\u3000\u3164\uffa0"
_ACCENTS = "\\x{300}-\\x{36f}"


def _variants() -> str:
    """Wide, styled, circled and joined forms of ASCII letters and digits, by the kind of their compatibility mapping."""
    out = ""
    for lo, hi in ((0x2100, 0x214F), (0x24B6, 0x24E9), (0xFB00, 0xFB06), (0xFF10, 0xFF5A), (0x1D400, 0x1D7FF), (0x1F130, 0x1F149)):
        for ch in map(chr, range(lo, hi + 1)):
            kind, to = unicodedata.decomposition(ch).split(" ")[0], unicodedata.normalize("NFKC", ch)
            ok = (kind in ("<wide>", "<font>", "<circle>", "<square>") and len(to) == 1) or (lo == 0xFB00 and kind == "<compat>") or ch == "\u212a"
            out += ch if ok and to.isascii() and to.isalnum() else ""
    return out


VARIANTS = _variants()


def _ranges(chars: str) -> str:
    """The characters as ranges of a regular expression's class."""
    cps, out = sorted(map(ord, chars)), []
    for c in cps:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_FOREIGN, _VARIANTS = _ranges(FOREIGN), _ranges(VARIANTS)
_ODD = f"{_FOREIGN}{_ACCENTS}{_VARIANTS}"
_UNSEEN = _ranges(INVISIBLE + SPACES) + JOINERS
_LATIN_LETTER = f"A-Za-z\\x{{c0}}-\\x{{24f}}{_ranges(''.join(c for c in VARIANTS if not unicodedata.normalize('NFKC', c).isdigit()))}"
# no case lies between: the commonest letters and signs beyond ASCII are settled by two comparisons
_BEYOND = "\\x{a0}\\x{ad}\\x{250}-\\x{10ffff}"
_HINT = f"[{_BEYOND}&&[{_ODD}]]"
# ASCII is settled by the first part of each class; the long second part is tried beyond it only
_WIDE = "\\x{a0}-\\x{10ffff}"
_IN_WORD = f"A-Za-z0-9[{_WIDE}&&[\\p{{L}}\\p{{M}}\\p{{N}}{_VARIANTS}]]"
_ORDINARY = f"A-Za-z0-9[{_WIDE}&&[\\p{{L}}\\p{{M}}\\p{{N}}]&&[^{_ODD}]]"
# a word is tried from its first letter only, and without going back
_WORD = f"(?<![{_IN_WORD}])[{_ORDINARY}]*+[{_WIDE}&&[{_ODD}]][{_IN_WORD}]*+"


def suspect(text: Column) -> Column:
    """Whether text may hold a case: one scan for characters that ordinary text has not, or not inside Latin words."""
    return text.rlike(f"[{_BEYOND}&&[{_ODD}{_UNSEEN}]]")


def _seen(text: Column) -> Column:
    """text with plain spaces and without invisible characters."""
    hidden, other = _ranges(INVISIBLE.replace("\u200c", "").replace("\u200d", "")), "[^\\x{0}-\\x{24f}]"
    # a joiner stays between two characters of other scripts, a selector or tag behind one, or in a key cap
    t = F.regexp_replace(text, f"[\\x{{a0}}-\\x{{10ffff}}&&[{hidden}]]|[\\x{{200c}}\\x{{200d}}](?:(?<!{other}[\\x{{200c}}\\x{{200d}}])|(?!{other}))|(?<=[\\x{{0}}-\\x{{24f}}])[\\x{{fe00}}-\\x{{fe0f}}\\x{{e0020}}-\\x{{e007f}}]+(?!\\x{{20e3}})", "")
    return F.translate(t, SPACES, " " * len(SPACES))


def plain_letters(spark) -> DataFrame:
    """(member): letters and digits that may stand for others: all composed ones of the Latin, Greek and Cyrillic scripts
    below U+2000, by their ranges, and the spelled forms of joined ones."""
    ch = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    letters = spark.range(0x30, 0x2000, 1, 1).select(ch.alias("member")).where(F.col("member").rlike("^[0-9\\p{IsLatin}\\p{IsGreek}\\p{IsCyrillic}&&[^ſ]]$"))
    return letters.unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, ("ff", "fi", "fl", "ffi", "ffl", "st")))).alias("member")))


def letter_forms(letters: DataFrame) -> DataFrame:
    """(letter, form) of the distinct letters, each with its accents, that have another canonical form.

    Letters are grouped with the plain ones under UNICODE_CI, an accent-sensitive collation for which variants of a
    letter, and composed and separate accents, are equal; capitals are kept apart. A class stands for its plain member
    with the fewest characters, the first in binary order on ties; without a plain one it is left as it is.
    """

    def keyed(df: DataFrame, c: str) -> DataFrame:
        return df.withColumns({"class": F.expr(f"{c} COLLATE UNICODE_CI"), "upper": F.col(c).rlike("^\\p{IsUppercase}")})

    plain = keyed(plain_letters(letters.sparkSession), "member")
    canonical = plain.groupBy("class", "upper").agg(F.min(F.struct(F.char_length("member").alias("n"), F.col("member").alias("form"))).alias("m")).select("class", "upper", "m.form")
    return keyed(letters.select("letter"), "letter").join(canonical, ["class", "upper"]).where("letter <> form").select("letter", "form")


def _swapped(text: Column, swaps: Column, what: str) -> Column:
    return F.aggregate(swaps, text, lambda t, s: F.replace(t, s[what], s["form"]))


def _swaps(what: str) -> Column:
    """The pairs (what, form) of a group, longest first: a shorter one never cuts into a longer one."""
    return F.sort_array(F.collect_set(F.when(F.col("form").isNotNull(), F.struct(F.char_length(what).alias("n"), F.col(what), F.col("form")))), asc=False)


def word_forms(words: DataFrame) -> DataFrame:
    """(word, form) of the distinct words whose form differs: foreign letters of words that also hold Latin ones are
    mapped, then accented and variant letters take their canonical form."""
    mapped = words.select("word", F.when(F.col("word").rlike(f"[{_LATIN_LETTER}]"), F.translate("word", FOREIGN, LATIN)).otherwise(F.col("word")).alias("mapped"))
    letters = F.array_distinct(F.regexp_extract_all("mapped", F.lit(f"[^\\p{{M}}]\\p{{M}}+|[{_VARIANTS}]"), F.lit(0)))
    parts = mapped.select("word", "mapped", F.explode_outer(letters).alias("letter"))
    forms = letter_forms(parts.where("letter IS NOT NULL").select("letter").distinct())
    per_word = parts.join(forms, "letter", "left").groupBy("word", "mapped").agg(_swaps("letter").alias("swaps"))
    return per_word.select("word", _swapped(F.col("mapped"), F.col("swaps"), "letter").alias("form")).where("word <> form")


def text_forms(texts: DataFrame) -> DataFrame:
    """(text, form) of the distinct values of column text, which are suspects; the work is a few rows in a hundred."""
    base = texts.select("text").distinct().select("text", _seen(F.col("text")).alias("plain"))
    words = base.select("text", "plain", F.explode_outer(F.when(F.col("plain").rlike(_HINT), F.array_distinct(F.regexp_extract_all("plain", F.lit(_WORD), F.lit(0))))).alias("word"))
    forms = word_forms(words.where("word IS NOT NULL").select("word").distinct())
    per_text = words.join(forms, "word", "left").groupBy("text", "plain").agg(_swaps("word").alias("swaps"))
    return per_text.select("text", _swapped(F.col("plain"), F.col("swaps"), "word").alias("form"))


def consistent_text(df: DataFrame, text: str, form: str = "form", changed: str = "changed") -> DataFrame:
    """df with the consistent form of a text column and whether it differs from the stored text.

    Null texts keep a null form and count as unchanged, empty texts stay empty; repeated rows stay repeated and get
    the same form; an empty table gives an empty result. All other columns are kept, whatever their names, except
    that columns called as the two new ones are replaced. A form is its own form. Rows without a suspect character
    take no part in any shuffle.
    """
    df = df.drop(form, changed) if text not in (form, changed) else df
    t = F.col(f"`{text}`")
    plain = df.where(t.isNull() | ~suspect(t)).withColumns({form: t, changed: F.lit(False)})
    # the few suspect rows are found once
    suspects = materialize(df.where(suspect(t)))
    forms = text_forms(suspects.select(t.alias("text"))).select(F.col("text").alias("__text"), F.col("form").alias("__form"))
    odd = suspects.join(forms, t == F.col("__text"), "left").withColumns({form: F.coalesce("__form", t), changed: F.coalesce(F.col("__form") != t, F.lit(False))}).drop("__text", "__form")
    return plain.unionByName(odd)
