"""Text normalisation and labels of postings: Column to Column, generated code but for texts with rare characters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds(low: int, high: int) -> dict[str, str]:
    """Characters and what compatibility decomposition leaves of them without combining marks, where it changes them."""
    found = {}
    for c in map(chr, range(low, high)):
        if not 0xD800 <= ord(c) < 0xE000 and (to := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("\u2044", " ")) != c:
            found[c] = to
    return found


#: Latin letters that fold to one other character, by rule of their decomposition.
SIMPLE = {c: to for c, to in _folds(0xC0, 0x250).items() if len(to) == 1}
#: All characters that fold to ASCII, looked up in the few texts that have others than RARE allows.
FOLDS = {c: to for c, to in _folds(0x80, 0xFFFF).items() if to.isascii()}
def _ranges(chars: list[str]) -> str:
    """A pattern class's inside: each run of neighbouring characters as one range."""
    found: list[list[int]] = []
    for c in map(ord, chars):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in found)


#: Any character beyond ASCII that ``SIMPLE`` doesn't settle: not Latin, or changed into several.
RARE = "[^" + _ranges([c for c in map(chr, range(0x250)) if c < "\x80" or c in SIMPLE or c not in FOLDS]) + "\\u2010-\\u201F\\u2022\\u20AC]"


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: The same as one text, each character and its form between a line break and a tab: a small literal in any plan.
FOLD_LINES = "\n" + "".join(f"{c}\t{to}\n" for c, to in FOLDS.items())


def once(value: Column, to) -> Column:
    """``to`` of a value that is worked out a single time, however often ``to`` names it: a function over a list of one."""
    return F.get(F.transform(F.array(value), to), F.lit(0))


def rewritten(text: Column, pattern: str, to) -> Column:
    """Text with each match of a pattern as ``to`` has it, in one pass from left to right."""
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, F.transform(found, to), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _form(c: Column) -> Column:
    at = F.instr(F.lit(FOLD_LINES), F.concat(F.lit("\n"), c, F.lit("\t")))
    return once(at, lambda p: F.when(p == 0, c).otherwise(F.substring_index(F.substring(F.lit(FOLD_LINES), p + 3, F.lit(40)), "\n", 1)))


def _plain(text: Column) -> Column:
    return F.translate(text, "".join(SIMPLE), "".join(SIMPLE.values()))


def folded(text: Column) -> Column:
    """Without accents and combining marks, compatibility forms as the ASCII they stand for.

    Texts that are ASCII once Latin letters are translated, which their length in bytes tells, take no further step.
    Of others only those with a rare character are taken apart, and there only around the characters beyond Latin.
    """
    plain = _plain(text)
    rare = once(F.regexp_replace(text, "\\p{M}+", ""), lambda x: rewritten(_plain(x), RARE, _form))
    return F.when(F.octet_length(plain) == F.char_length(plain), plain).when(text.rlike(RARE), rare).otherwise(plain)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def norm_collector(text: Column) -> Column:
    """Lower case, umlauts written out, accents dropped, other signs as blanks."""
    spelt = F.lower(present(text))
    for sign, by in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        spelt = F.replace(spelt, F.lit(sign), F.lit(by))
    return squeezed(F.regexp_replace(folded(spelt), "[^a-z0-9\\s]", " "))


def norm_state(text: Column) -> Column:
    """As the collector's, without writing out umlauts."""
    return squeezed(F.regexp_replace(folded(F.lower(present(text))), "[^a-z0-9\\s]", " "))


def norm_dedupe(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(folded(present(text))), "[^a-z0-9]+", " "))


def norm_topic(text: Column) -> Column:
    """Accents dropped, signs beyond ASCII deleted, all but letters and digits as blanks."""
    ascii_only = F.lower(F.regexp_replace(folded(present(text)), "[^\\x00-\\x7F]", ""))
    return F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def clean_text(text: Column) -> Column:
    """Without control characters, runs of blanks as one, trimmed."""
    bare = F.regexp_replace(present(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[ \\t]+", " "), "(?U)^\\s+|\\s+$", "")


# Words that tell the kind of employment and the language, in their order
EMPLOYMENT = (
    ("Vollzeit", ("vollzeit", "full-time", "fulltime", "100%", "pensum 100")),
    ("Teilzeit", ("teilzeit", "part-time", "parttime", "50%", "60%", "70%", "80%")),
    ("Freelance", ("freelance", "selbständig", "selbstaendig", "contract")),
)
LANGUAGES = (
    ("de", ("deutsch", "german", "deutschkenntnisse", "deutschsprachig")),
    ("en", ("english", "englisch", "englishspeaking")),
    ("fr", ("francais", "français", "french", "französisch", "franzosisch")),
    ("it", ("italiano", "italian", "italienisch")),
)


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def first_class(text: Column, classes, default: str) -> Column:
    """The first class with a word in the text."""
    found = F.lit(default)
    for name, words in reversed(classes):
        found = F.when(contains_any(text, words), name).otherwise(found)
    return found


def first_hit(text: Column, words) -> Column:
    """The first word, in list order, that the text contains; null if none."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))


def employment_type(text: Column) -> Column:
    return first_class(F.lower(present(text)), EMPLOYMENT, "")


def language_hint(text: Column) -> Column:
    return first_class(F.lower(present(text)), LANGUAGES, "de")


def workload(text: Column) -> Column:
    """A percentage or a range of them."""
    return F.regexp_extract(present(text), "(\\d{2,3})\\s*[-–]\\s*(\\d{2,3})\\s*%|(\\d{2,3})\\s*%", 0)


def unified_date(text: Column) -> Column:
    """YYYY-MM-DD from ISO, D.M.YYYY or D/M/YYYY; else as it is."""
    value = F.trim(present(text))
    day = "^(\\d{1,2})[./](\\d{1,2})[./](\\d{4})"
    return (
        F.when(value.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.left(value, F.lit(10)))
        .when(value.rlike(day), F.concat_ws("-", F.regexp_extract(value, day, 3), F.lpad(F.regexp_extract(value, day, 2), 2, "0"), F.lpad(F.regexp_extract(value, day, 1), 2, "0")))
        .otherwise(value)
    )


def in_order(text: Column, term: str) -> Column:
    """Whether the words of a term occur in the text in their order, gaps allowed."""
    return text.rlike("(^| )" + " (.* )?".join(term.split()) + "( |$)")


def visible(html: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags as blanks."""
    bare = F.regexp_replace(F.regexp_replace(present(html), "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")
    return squeezed(F.regexp_replace(bare, "(?s)<[^>]*>", " "))
