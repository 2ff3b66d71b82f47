"""Snowball stemmers for English and Spanish, after the published descriptions of the algorithms."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = dict(pair.split(":") for pair in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
_KEEP = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = sorted((p.split(":") for p in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less".split()), key=lambda p: -len(p[0]))
_STEP3 = sorted((p.split(":") for p in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:".split()), key=lambda p: -len(p[0]))
_STEP3_ALL = sorted([*_STEP3, ["ative", "-"]], key=lambda p: -len(p[0]))
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=lambda s: -len(s))


@lru_cache
def _pair(vowels: str) -> re.Pattern:
    return re.compile(f"[{vowels}][^{vowels}]")


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, non-vowel that follows a vowel begin."""
    pair = _pair(vowels)

    def after(start: int) -> int:
        m = pair.search(w, start)
        return m.end() if m else len(w)

    r1 = after(0)
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=1 << 18)
def english(word: str) -> str:
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = re.match(r"(gener|commun|arsen)", w)
    r1, r2 = _regions(w, _VOWELS)
    if head:
        r1 = head.end()
        m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(w, r1)
        r2 = m.end() if m else len(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1].startswith("eed"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    w = re.sub(r"(?<=[^aeiouy])(?<!^.)[yY]$", "i", w) if len(w) > 2 else w
    for suffix, new in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: len(w) - len(suffix)] + new
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[:-3].endswith("l"):
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, new in _STEP3_ALL:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if suffix == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + new
            break
    for suffix in [*_STEP4, "ion"] if not w.endswith("ion") else ["ion"]:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_ES_VOWELS = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")
_PRONOUNS = "selas|selos|sela|selo|las|les|los|nos|me|se|la|le|lo"
_ES_STEP1 = {
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos": "r2",
    "adora ador ación adoras adores aciones ante antes ancia ancias": "ic", "logía logías": "log", "ución uciones": "u", "encia encias": "ente",
    "amente": "amente", "mente": "mente", "idad idades": "idad", "iva ivo ivas ivos": "iv",
}
_ES_RULES = sorted(((s, rule) for words, rule in _ES_STEP1.items() for s in words.split()), key=lambda p: -len(p[0]))
_ES_Y = sorted("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), key=lambda s: -len(s))
_ES_VERB = sorted(
    ("en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
     "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos").split(),
    key=lambda s: -len(s),
)


def _rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in _ES_VOWELS:
        m = re.compile(f"[{_ES_VOWELS}]").search(w, 2)
        return m.end() if m else len(w)
    if w[0] in _ES_VOWELS:
        m = re.compile(f"[^{_ES_VOWELS}]").search(w, 2)
        return m.end() if m else len(w)
    return 3


@lru_cache(maxsize=1 << 18)
def spanish(word: str) -> str:
    w = word.lower()
    rv, (r1, r2) = _rv(w), _regions(w, _ES_VOWELS)
    m = re.search(f"(iéndo|ándo|ár|ér|ír|iendo|ando|ar|er|ir|yendo)({_PRONOUNS})$", w)
    if m and m.start(1) >= rv and (m[1] != "yendo" or w[: m.start(1)].endswith("u")):
        w = w[: m.start(1)] + m[1].translate(_PLAIN)
    before = w
    for suffix, rule in _ES_RULES:
        if not w.endswith(suffix):
            continue
        stem = w[: len(w) - len(suffix)]
        if len(stem) < (r1 if rule == "amente" else r2):
            break
        w = stem
        inner = {"ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",)}.get(rule, ())
        if rule == "log":
            w = stem + "log"
        elif rule == "u":
            w = stem + "u"
        elif rule == "ente":
            w = stem + "ente"
        elif rule == "amente":
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                w = w[:-2]
        else:
            for s in inner:
                if w.endswith(s) and len(w) - len(s) >= r2:
                    w = w[: -len(s)]
                    break
        break
    if w == before:
        for suffix in _ES_Y:
            if w.endswith(suffix) and len(w) - len(suffix) >= rv:
                if w[: len(w) - len(suffix)].endswith("u"):
                    w = w[: len(w) - len(suffix)]
                break
    if w == before:
        for suffix in _ES_VERB:
            if w.endswith(suffix) and len(w) - len(suffix) >= rv:
                w = w[: len(w) - len(suffix)]
                if suffix in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
                break
    for suffix in ("os", "a", "o", "á", "í", "ó"):
        if w.endswith(suffix) and len(w) - len(suffix) >= rv:
            w = w[: len(w) - len(suffix)]
            break
    else:
        if w.endswith(("e", "é")) and len(w) - 1 >= rv:
            w = w[:-1]
            if w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS = {"english": english, "spanish": spanish}
