"""German words: stop words and the published Snowball stemmer."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

VOWELS = "aeiouyäöü"

#: German stop words (fixed values): those that are not inflected, and beginnings with the endings that they take.
PLAIN_STOPS = (
    "aber als also am an auch auf aus bei bin bis bist da damit dann daß dass das dazu dem den denn der des derer dessen dich die dir doch dort du durch "
    "er es euch für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen im in indem ins ist mich mir mit muss musste nach "
    "nicht nichts noch nun nur ob oder ohne sehr sein sich sie sind so sondern sonst über um und uns unter viel vom von vor während war waren warst was "
    "weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen könnte können soll sollte bzw"
).split()
INFLECTED_STOPS = {
    "all ander derselb denselb desselb demselb dieselb dasselb eur": "e em en er es",
    "dein ein euer ihr kein mein sein unser unse unsr eure": " e em en er es s m n r",
    "dies jed jen manch solch welch einig": "e em en er es",
    "selb": "st",
}
STOPS = frozenset(PLAIN_STOPS) | {b + e for bases, ends in INFLECTED_STOPS.items() for b in bases.split() for e in ends.split(" ")}


def _ending(endings: str) -> Callable[[str], str]:
    """A function of a word: the longest of the endings, parted by bars, that it has."""
    search = re.compile(f"(?:{endings})$").search
    return lambda word: found[0] if (found := search(word)) else ""


_first_ending, _second_ending, _third_ending, _last_ending = map(_ending, ("ern|em|er|en|es|e|s", "est|en|er|st", "isch|lich|heit|keit|end|ung|ig|ik", "lich|ig"))
_syllable = re.compile(f"[{VOWELS}][^{VOWELS}]").search
_marked = {letter: re.compile(f"([{VOWELS}]){letter}([{VOWELS}])") for letter in "uy"}
_before_s, _before_st, _ig = re.compile("[bdfghklmnrt]s$").search, re.compile("...[bdfghklmnt]st$").search, re.compile("(?:^|[^e])ig$").search
_PLAIN = str.maketrans("UYäöü", "uyaou")
#: The last letters of all endings: a word with another last letter keeps its end.
_LAST = frozenset("nmrsethdgk")


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word, after the published rules: three steps take endings off, where they lie in the right region.

    A region begins after the first consonant that follows a vowel, the second region so within the first; the first leaves three
    letters in front at least.
    """
    w = word.replace("ß", "ss")
    if w[-1:] not in _LAST:
        return w.translate(_PLAIN)
    for letter, between in _marked.items():  # between vowels they count as consonants
        if letter in w:
            w = between.sub(rf"\1{letter.upper()}\2", w)
    first = m.end() if (m := _syllable(w)) else len(w)
    second = m.end() if (m := _syllable(w, first)) else len(w)
    first = max(first, 3)
    fits = lambda w, ending, region: ending and len(w) - len(ending) >= region

    end = _first_ending(w)
    if fits(w, end, first):
        if end != "s":
            w = w[: -len(end)]
            if end in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
        elif _before_s(w):
            w = w[:-1]

    end = _second_ending(w)
    if fits(w, end, first) and (end != "st" or _before_st(w)):
        w = w[: -len(end)]

    end = _third_ending(w)
    if fits(w, end, second):
        base = w[: -len(end)]
        if end in ("end", "ung"):
            w = base
            if _ig(w) and fits(w, "ig", second):
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            w = w if base.endswith("e") else base
        elif end == "keit":
            w = base
            if fits(w, more := _last_ending(w), second):
                w = w[: -len(more)]
        else:
            w = base
            if w.endswith(("er", "en")) and fits(w, "er", first):
                w = w[:-2]
    return w.translate(_PLAIN)


def term(word: str) -> str | None:
    """What a lower-case word is looked up by; none for a stop word."""
    return None if word in STOPS else stem(word)


#: ``voc (w)`` to ``stems (w, t)`` by the same rules, as common table expressions.
STEMS_SQL = f"""s0 AS (SELECT w, regexp_replace(regexp_replace(replace(w, 'ß', 'ss'), '([{VOWELS}])u([{VOWELS}])', '\\1U\\2', 'g'), '([{VOWELS}])y([{VOWELS}])', '\\1Y\\2', 'g') AS x FROM voc WHERE w NOT IN ({", ".join(f"'{s}'" for s in sorted(STOPS))})),
    s1 AS (SELECT *, CASE WHEN regexp_matches(x, '[{VOWELS}][^{VOWELS}]') THEN length(regexp_extract(x, '^.*?[{VOWELS}][^{VOWELS}]')) ELSE length(x) END AS a FROM s0),
    s2 AS (SELECT w, x, greatest(a, 3) AS p1, a + CASE WHEN regexp_matches(substr(x, a + 1), '[{VOWELS}][^{VOWELS}]') THEN length(regexp_extract(substr(x, a + 1), '^.*?[{VOWELS}][^{VOWELS}]')) ELSE length(x) - a END AS p2,
        regexp_extract(x, '(ern|em|er|en|es|e|s)$') AS e FROM s1),
    s3 AS (SELECT w, p1, p2, CASE WHEN e = '' OR length(x) - length(e) < p1 OR e = 's' AND NOT regexp_matches(x, '[bdfghklmnrt]s$') THEN x
        WHEN e IN ('e', 'en', 'es') THEN regexp_replace(left(x, length(x) - length(e)), 'niss$', 'nis') ELSE left(x, length(x) - length(e)) END AS x FROM s2),
    s4 AS (SELECT w, p1, p2, CASE WHEN e = '' OR length(x) - length(e) < p1 OR e = 'st' AND NOT regexp_matches(x, '...[bdfghklmnt]st$') THEN x ELSE left(x, length(x) - length(e)) END AS x FROM (SELECT *, regexp_extract(x, '(est|en|er|st)$') AS e FROM s3)),
    s5 AS (SELECT *, regexp_extract(x, '(isch|lich|heit|keit|end|ung|ig|ik)$') AS e, left(x, length(x) - length(regexp_extract(x, '(isch|lich|heit|keit|end|ung|ig|ik)$'))) AS b FROM s4),
    s6 AS (SELECT w, CASE WHEN e = '' OR length(b) < p2 THEN x
        WHEN e IN ('end', 'ung') THEN CASE WHEN regexp_matches(b, '(^|[^e])ig$') AND length(b) - 2 >= p2 THEN left(b, length(b) - 2) ELSE b END
        WHEN e IN ('ig', 'ik', 'isch') THEN CASE WHEN b LIKE '%e' THEN x ELSE b END
        WHEN e = 'keit' THEN CASE WHEN b LIKE '%lich' AND length(b) - 4 >= p2 THEN left(b, length(b) - 4) WHEN b LIKE '%ig' AND length(b) - 2 >= p2 THEN left(b, length(b) - 2) ELSE b END
        WHEN (b LIKE '%er' OR b LIKE '%en') AND length(b) - 2 >= p1 THEN left(b, length(b) - 2) ELSE b END AS x FROM s5),
    stems AS (SELECT w, translate(x, 'UYäöü', 'uyaou') AS t FROM s6)"""
