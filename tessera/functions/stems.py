"""Stems of English words: the Porter2 algorithm as steps over a column, and the words that a search leaves out.

The steps are written once, as SQL text that names a few functions; :func:`stem` runs them on Spark, and the SQL
that queries are compared with takes the same text with another engine's names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The common English list of words that carry no meaning for a search.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
should now""".split()

# Fixed values of the Porter2 algorithm: words with a stem of their own, words that keep their form after the first step,
# beginnings after which the first region starts, and the suffixes of the later steps with what replaces them.
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
BEGINNINGS = ["gener", "commun", "arsen"]
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]

#: All suffixes that a step takes off or changes; a word without one is its own stem.
ENDS = "|".join(["s", "ed", "ing", "y", "e", "ll", "logi", "li", "ion", *[x for x in [*STEP_2, *STEP_3, *STEP_4] if x[-1] not in "sey"]])
SHORT_END = "(^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$)"


def _cut(n: int, by: str = "") -> str:
    """The word without its last ``n`` letters, with ``by`` instead."""
    rest = f"substr(w, 1, length(w) - {n})" if n else "w"
    return f"concat({rest}, '{by}')" if by else rest


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _in(region: str, suffix: str) -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def _longest(cases: list[tuple[str, str]], otherwise: str = "w") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + f" else {otherwise} end"


def _region(of: str, text: str) -> str:
    return f"case when MATCHES({text}, '^[^aeiouy]*[aeiouy]+[^aeiouy]') then length(EXTRACT({text}, '^[^aeiouy]*[aeiouy]+[^aeiouy]')) else length({text}) end{of}"


def steps() -> list[dict[str, str]]:
    """The steps: each names the columns it sets, of ``w``, ``r1``, ``r2``, ``done`` and ``e``, and how."""
    own = _longest([(f"word = '{k}'", f"'{v}'") for k, v in OWN_STEMS.items()], "word")
    out = [
        {"w": own, "done": "length(word) <= 2 or word in (" + ", ".join(f"'{k}'" for k in OWN_STEMS) + ")"},
        # A y that begins a word or follows a vowel is a consonant; of two in a row the second follows one.
        {"w": "case when left(w, 1) = 'y' then concat('Y', substr(w, 2)) else w end"},
        {"w": "REPLACE_ALL(w, '([aeiou])y', 'GROUP1Y')"},
        {"w": "REPLACE_ALL(w, '([aeiouy])yy', 'GROUP1yY')"},
        {"r1": _longest([(f"left(w, {len(b)}) = '{b}'", str(len(b))) for b in BEGINNINGS], _region("", "w"))},
        {"r2": "r1 + " + _region("", "substr(w, r1 + 1)")},
        {"w": _longest([
            (_ends("sses"), _cut(2)), (f"{_ends('ied')} or {_ends('ies')}", f"case when length(w) > 4 then {_cut(2)} else {_cut(1)} end"),
            (f"{_ends('us')} or {_ends('ss')}", "w"), ("MATCHES(w, '[aeiouy].+s$')", _cut(1)),
        ])},
        {"done": "done or w in (" + ", ".join(f"'{k}'" for k in STAY) + ")"},
        {
            "e": "case when MATCHES(w, '(eed|eedly)$') then false else MATCHES(w, '[aeiouy].*(ed|edly|ing|ingly)$') end",
            "w": _longest([
                (_ends("eedly"), f"case when {_in('r1', 'eedly')} then {_cut(3)} else w end"), (_ends("eed"), f"case when {_in('r1', 'eed')} then {_cut(1)} else w end"),
                ("MATCHES(w, '[aeiouy].*ingly$')", _cut(5)), ("MATCHES(w, '[aeiouy].*edly$')", _cut(4)), ("MATCHES(w, '[aeiouy].*ing$')", _cut(3)), ("MATCHES(w, '[aeiouy].*ed$')", _cut(2)),
            ]),
        },
        {"w": _longest([("not e", "w"), ("MATCHES(w, '(at|bl|iz)$')", "concat(w, 'e')"), ("MATCHES(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')", _cut(1)), (f"length(w) <= r1 and MATCHES(w, '{SHORT_END}')", "concat(w, 'e')")])},
        {"w": _longest([("MATCHES(w, '.[^aeiouy][yY]$')", _cut(1, "i"))])},
        {"w": _longest([(_ends(s), f"case when {_in('r1', s)} then {_cut(len(s), by)} else w end") for s, by in STEP_2.items()] + [
            ("MATCHES(w, 'logi$')", f"case when {_in('r1', 'ogi')} then {_cut(1)} else w end"), ("MATCHES(w, '[cdeghkmnrt]li$')", f"case when {_in('r1', 'li')} then {_cut(2)} else w end"),
        ])},
        {"w": _longest([(_ends(s), f"case when {_in('r1', s)} then {_cut(len(s), by)} else w end") for s, by in STEP_3.items()] + [(_ends("ative"), f"case when {_in('r2', 'ative')} then {_cut(5)} else w end")])},
        {"w": _longest([(_ends(s), f"case when {_in('r2', s)} then {_cut(len(s))} else w end") for s in STEP_4] + [("MATCHES(w, '[st]ion$')", f"case when {_in('r2', 'ion')} then {_cut(3)} else w end")])},
        {"w": _longest([
            (f"{_ends('e')} and ({_in('r2', 'e')} or {_in('r1', 'e')} and not MATCHES({_cut(1)}, '{SHORT_END}'))", _cut(1)), (f"{_ends('ll')} and {_in('r2', 'l')}", _cut(1)),
        ])},
    ]
    for step in out[1:]:
        if "w" in step:
            step["w"] = f"case when done then w else {step['w']} end"
    return out


def as_sql(text: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        text = text.replace(k, v)
    return text


SPARK = {"MATCHES": "regexp_like", "EXTRACT(": "regexp_substr(", "REPLACE_ALL": "regexp_replace", "GROUP": "$"}


def stem(word: str) -> Column:
    """The stem of the lower-case words of a column; null stays null. One expression: each step binds what the one before gave by a lambda."""
    names = ["word", "w", "r1", "r2", "e", "done"]
    now = "named_struct('word', __WORD__, 'w', __WORD__, 'r1', 0, 'r2', 0, 'e', false, 'done', false)"
    for step in steps():
        # A suffix is compared in place rather than cut out first.
        fields = re.sub(r"right\(w, \d+\) = ('\w+')", r"endswith(w, \1)", ", ".join(f"'{n}', {as_sql(step[n], SPARK) if n in step else n}" for n in names))
        # Names outside of quotes are fields of the step before.
        body = re.sub(r"(?<!')\b(" + "|".join(names) + r")\b(?!')", r"s.\1", fields)
        now = f"transform(array({now}), s -> named_struct({body}))[0]"
    return F.when(~F.col(word).rlike(f"({ENDS})$"), F.col(word)).otherwise(F.lower(F.expr(now.replace("__WORD__", f"`{word}`")).getField("w")))


def stem_ctes(source: str) -> str:
    """The same steps as common table expressions ``st_k`` of SQL over a table ``source`` (word): the last is ``stems`` (word, stem)."""
    names = {"MATCHES": "regexp_matches", "EXTRACT(": "regexp_extract(", "REPLACE_ALL(w, '([aeiou])y', 'GROUP1Y')": "regexp_replace(w, '([aeiou])y', '\\1Y', 'g')", "REPLACE_ALL(w, '([aeiouy])yy', 'GROUP1yY')": "regexp_replace(w, '([aeiouy])yy', '\\1yY', 'g')"}
    columns = {"word": "word", "w": "word", "r1": "cast(0 as bigint)", "r2": "cast(0 as bigint)", "e": "false", "done": "false"}
    sql = f"st_s as (select {', '.join(f'{v} as {k}' for k, v in columns.items())} from {source})"
    last = "st_s"
    for i, step in enumerate(steps()):
        cols = ", ".join(f"{as_sql(step[k], names)} as {k}" if k in step else k for k in columns)
        sql += f",\nst_{i} as (select {cols} from {last})"
        last = f"st_{i}"
    return sql + f",\nstems as (select word, lower(w) as stem from {last})"
