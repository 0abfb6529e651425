"""Porter2 in plain Python, after the published description: what the Column expressions are held against."""

from __future__ import annotations

VOWELS = "aeiouy"


def _region(word, start):
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _short_syllable(w):
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def _ending(w, endings):
    return max((e for e in endings if w.endswith(e)), key=len, default="")


def stem(word):
    if len(word) <= 2 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    special = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
    if word in special:
        return special[word]
    if word in "sky news howe atlas cosmos bias andes".split():
        return word
    w = list(word)
    for k, c in enumerate(w):
        if c == "y" and (k == 0 or w[k - 1] in VOWELS):
            w[k] = "Y"
    w = "".join(w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    # 1a
    e = _ending(w, "sses ied ies us ss s".split())
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in "inning outing canning herring earring proceed exceed succeed".split():
        return w
    # 1b
    e = _ending(w, "eed eedly ed edly ing ingly".split())
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and any(c in VOWELS for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif len(w) <= r1 and _short_syllable(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    two = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="")
    e = _ending(w, two)
    before = w[: len(w) - len(e)]
    if e and len(before) >= r1 and (e != "ogi" or before.endswith("l")) and (e != "li" or before[-1:] in tuple("cdeghkmnrt")):
        w = before + two[e]
    # 3
    three = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
    e = _ending(w, three)
    before = w[: len(w) - len(e)]
    if e and len(before) >= (r2 if e == "ative" else r1):
        w = before + three[e]
    # 4
    e = _ending(w, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
    before = w[: len(w) - len(e)]
    if e and len(before) >= r2 and (e != "ion" or before[-1:] in ("s", "t")):
        w = before
    # 5
    before = w[:-1]
    if w.endswith("e") and (len(before) >= r2 or len(before) >= r1 and not _short_syllable(before)):
        w = before
    elif w.endswith("ll") and len(before) >= r2:
        w = before
    return w.lower()
